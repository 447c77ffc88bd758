"""Encoding by public tokenizers through a bounded cache of pre-tokens.

The two byte-pair tokenizers cut a text into pre-tokens and encode each alone,
so the ids of a text are those of its pre-tokens in a row. Texts whose other
than ASCII characters are all letters, also when normalised, are cut here by byte
patterns, and the library's model is asked for each pre-token that the cache does
not hold; any other text, and one that may hold a special token, is encoded whole
by the library.
The tests hold both ways against the library on whole texts. Tokenizer files are
opened by path on each executor; none is trained or copied.
"""

from __future__ import annotations

import os
import re
from array import array
from codecs import charmap_decode
from functools import lru_cache
from itertools import compress, count, repeat
from operator import is_

import regex

CACHED = 300_000
LONGEST_CACHED = 128
# The pre-token patterns of the two tokenizers (with white space
# kept and dropped), for bytes: \x80-\xff are parts of letters.
_KEPT = re.compile(
    rb" ?[A-Za-z\x80-\xff]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^A-Za-z0-9\x80-\xff\s]+|\s+(?!\S)|\s+"
)
_DROPPED = re.compile(rb"[a-z\x80-\xff]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^a-z0-9\x80-\xff\s]+")
_NO_LETTER = regex.compile(r"[^\x00-\x7f\p{L}]")
# Without these bytes, all that isn't ASCII lies in U+00C0 to U+024F, is a letter
# and not U+0130.
_NO_LATIN = re.compile(rb"[\xc2\xca-\xff]|\xc3[\x97\xb7]|\xc4\xb0")
_SPECIAL = b"<|"  # how special tokens begin
_ASCII = bytes(range(128))


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def vocabulary_size(path: str) -> int:
    return _tokenizer(path).get_vocab_size(with_added_tokens=True)


@lru_cache(maxsize=1)
def _byte_letters() -> str:
    """How byte-level models write each byte: visible Latin-1 characters stay,
    the others follow in order from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = count(0x100)
    return "".join(chr(b if b in shown else next(others)) for b in range(256))


class _Words(dict):
    """Pre-token -> ids, asked of the library's model at the first use. There
    is nothing left to cut in a pre-token, and the normalizer changes only letters
    outside ASCII in it. Two generations of at most `cached` words: what is used
    again moves on, the rest is forgotten; long words are not kept."""

    def __init__(self, path: str, cached: int) -> None:
        super().__init__()
        self.path, self.cached = path, cached
        self.old: dict[bytes, bytes] = {}
        self.model = self.normalizer = None

    def _ask(self, word: bytes) -> bytes:
        if self.model is None:
            made = _tokenizer(self.path)
            self.model, self.normalizer = made.model, made.normalizer
        if self.normalizer and not word.isascii():
            word = self.normalizer.normalize_str(word.decode("utf-8", "replace")).encode()
        letters, _ = charmap_decode(word, "strict", _byte_letters())
        return array("I", [token.id for token in self.model.tokenize(letters)]).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self._ask(word)
        if len(word) <= LONGEST_CACHED:
            if len(self) >= self.cached:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


class TextEncoder:
    """Text (UTF-8 bytes) -> ids as little-endian uint32 bytes, without added
    special tokens. spaced: the tokenizer keeps white space and glues it to the
    word that follows; otherwise it drops white space and lower-cases."""

    def __init__(self, path: str, spaced: bool, cached: int = CACHED) -> None:
        self.path, self.spaced = path, spaced
        self.words = _Words(path, cached)
        self.letters: dict[str, bool] = {}

    def _letter(self, char: str) -> bool:
        """Whether it stays inside a word of the library: U+0130 and U+0958, say,
        end in a mark when normalised, and new letters are none to old tables."""
        if char not in self.letters:
            made, word = _tokenizer(self.path), f"a{char}a"
            word = made.normalizer.normalize_str(word) if made.normalizer else word
            self.letters[char] = len(made.pre_tokenizer.pre_tokenize_str(word)) == 1
        return self.letters[char]

    def _by_letters(self, text: str) -> bool:
        return not _NO_LETTER.search(text) and all(map(self._letter, set(text)))

    def _pre_tokens(self, text: bytes) -> list[bytes] | None:
        if _SPECIAL in text:
            return None
        if not text.isascii():
            rest = text.translate(None, _ASCII)
            if _NO_LATIN.search(rest) and not self._by_letters(rest.decode("utf-8", "replace")):
                return None
        return _KEPT.findall(text) if self.spaced else _DROPPED.findall(text.lower())

    def _by_library(self, texts: list[bytes]) -> list[bytes]:
        words = [t.decode("utf-8", "replace") for t in texts]
        found = _tokenizer(self.path).encode_batch_fast(words, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        cut = [self._pre_tokens(t) for t in texts]
        whole = iter(self._by_library([t for t, c in zip(texts, cut) if c is None]))
        ids_of = self.words.__getitem__
        return [next(whole) if c is None else b"".join(map(ids_of, c)) for c in cut]


def missing(values: list) -> list[int]:
    """Places of None."""
    return list(compress(count(), map(is_, values, repeat(None))))


@lru_cache(maxsize=2)
def text_encoder(path: str, spaced: bool) -> TextEncoder:
    """One encoder, and so one cache, for each worker."""
    return TextEncoder(path, spaced)
