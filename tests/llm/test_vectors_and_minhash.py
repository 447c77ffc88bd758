"""Clustering, hard negatives and MinHash groups against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from brute import lowered, words
from pyspark.sql import functions as F
from sluice.llm import minhash
from sluice.llm.grid import grid_rows, narrow, product, widen
from sluice.llm.hard_negatives import hard_negatives, tiles
from sluice.llm.lloyd import clustered
from sluice.llm.minhash import near_duplicates

NAN, INF = float("nan"), float("inf")
SHAPE = (
    "vec_id long, embedding array<float>, label int, block long, shard int, n int, x string, v int, uid long, "
    "cluster int, pack int, dims int, _key map<string, int>"
)
EXTRA = (1, 2, 3, "x", 5, 6, 7, 8, 9, {"a": 1})


def vectors():
    """Ties, copies, repeated and null ids, other lengths, nulls, non-finite."""
    rng = np.random.default_rng(3)
    made = [(i, (rng.normal(size=8) / 3).round(1).astype(np.float32).tolist(), i % 4) for i in range(240)]
    made += [(300 + i, made[20][1], i % 3) for i in range(160)]  # one vector holds a third of all rows
    made += [(40, made[50][1], 1), (40, made[50][1], 1), (None, made[60][1], 2), (None, made[60][1], 2)]
    bad = [None, [], [0.5] * 7, [0.5] * 9, [0.5] * 7 + [None], [0.5] * 7 + [NAN], [0.5] * 7 + [-INF]]
    made += [(600 + i, b, 1) for i, b in enumerate(bad)] + [(700, [0.25] * 8, None), (800, [0.25] * 9, 1)]
    return made


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(*r, *EXTRA) for r in vectors()], SHAPE).repartition(7)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SHAPE)


def whole(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def grid(v):
    return tuple(int(np.floor(256 * float(np.float32(x)))) for x in v)


def lloyd(rows, k, rounds, dims):
    kept = [(i, grid(v)) for i, v, _ in rows if whole(v) and len(v) == dims]
    name = lambda r: hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest()
    centroids = [list(q) for _, q in sorted(kept, key=lambda r: (name(r), r[1]))[:k]]

    def nearest(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        held = defaultdict(list)
        for _, q in kept:
            held[nearest(q)[1]].append(q)
        for j, qs in held.items():
            centroids[j] = [sum(x) // len(qs) for x in zip(*qs)]
    found = [(i, *nearest(q)[::-1]) for i, q in kept]
    inertia = defaultdict(int)
    for _, c, d in found:
        inertia[c] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, c, d, inertia[c], sum(inertia.values()), sha[c]) for i, c, d in found]


def plain(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("k,width,slice_bytes", [(9, 3, 1 << 20), (9, 8, 0), (1_000, 5, 1 << 20)])
def test_clustering(table, k, width, slice_bytes):
    got = clustered(table, k=k, rounds=3, dims=8, width=width, block_bytes=1 << 12, slice_bytes=slice_bytes)
    assert plain(got.collect()) == sorted(lloyd(vectors(), k, 3, 8), key=repr)


def test_clustering_of_nothing(table, empty):
    assert clustered(empty).count() == 0
    assert clustered(table, dims=64).count() == 0


def mined(rows, k=5, low=80, high=100):
    made = [(i, grid(v), y) for i, v, y in rows if whole(v) and i is not None and y is not None]
    out = []
    for a, (ai, aq, ay) in enumerate(made):
        if ai % 20:
            continue
        scored = [
            (-sum(x * y for x, y in zip(aq, q)), i, y == ay, n)
            for n, (i, q, y) in enumerate(made)
            if n != a and len(q) == len(aq)
        ]
        scored.sort(key=lambda r: (r[0], r[1], r[3]))
        for p, pi, _, _ in [r for r in scored if r[2]][:k]:
            fits = [r for r in scored if not r[2] and low * -p <= 100 * -r[0] <= high * -p]
            out += [(ai, pi, n + 1, r[1], -p, -r[0]) for n, r in enumerate(fits[:k])]
    return out


@pytest.mark.parametrize("size", [400, 1 << 22])
def test_hard_negatives(table, size):
    got = hard_negatives(table, F.col("vec_id") % 20 == 0, pack_bytes=size, block_bytes=size)
    want = mined(vectors())
    assert plain(got.collect()) == sorted(want, key=repr) and len(want) > 100


def test_hard_negatives_of_nothing(table, empty):
    assert hard_negatives(empty, F.col("vec_id") % 20 == 0).count() == 0
    assert hard_negatives(table, F.col("vec_id") < 0).count() == 0


def test_queue_skips_boxes(monkeypatch):
    """In few dimensions most leaves are never scored, and the best are right."""
    from sluice.llm import hard_negatives as module

    rng = np.random.default_rng(1)
    points = rng.integers(-1_000, 1_000, (8_000, 2))
    ids = np.arange(8_000)
    labels = (points[:, 0] > 0).astype(np.int64)
    trees = module._Trees(module._packed(points, ids, ids, labels))
    assert sorted(trees.ids.tolist()) == ids.tolist() and len(trees.roots) >= 4
    offered = []
    real = module._Best.offer
    monkeypatch.setattr(module._Best, "offer", lambda self, s, i, u: (offered.append(len(s)), real(self, s, i, u)))
    for a in range(0, 8_000, 800):
        lows, highs = trees.bounds(points[a : a + 1])
        best = [module._Best(5, -(2**62), 2**62)]
        module.search(trees, points[a], lows[0].tolist(), highs[0].tolist(), int(labels[a]), a, True, best)
        scores = points @ points[a]
        want = sorted((-scores[j], j, j) for j in ids.tolist() if labels[j] == labels[a] and j != a)[:5]
        assert best[0].rows == want
    assert sum(offered) < 0.2 * 10 * 8_000


def test_tiles_hold_every_row_once():
    rng = np.random.default_rng(4)
    for n, d in [(1, 3), (500, 1), (777, 4), (300, 0)]:
        leaves = tiles(rng.integers(0, 9, (n, d)), 16)
        assert sorted(np.concatenate(leaves).tolist()) == list(range(n)) and max(map(len, leaves)) <= 16


def test_integers():
    import pyarrow as pa

    for top in (5, 40_000, 1 << 33, 1 << 40):
        m = np.random.default_rng(top).integers(-top, top, (7, 5))
        assert (widen(narrow(m).tobytes(), m.size).reshape(m.shape) == m).all()
        if top < 1 << 33:
            assert (product(m, m) == m @ m.T).all()
    with pytest.raises(ValueError):
        list(grid_rows(pa.array([[1e30, 0.0]], pa.list_(pa.float64())), 256))


SHARED = " ".join(f"w{i % 17}x{i}" for i in range(120))


def texts():
    rng = random.Random(6)
    base = [f"v{rng.randrange(4000)}" for _ in range(150)]
    made = [
        (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "ONE"), (6, "one two"), (7, "two one"), (8, SHARED),
        (9, SHARED.upper()), (9, SHARED + " end"), (None, SHARED + " tail"), (None, "alone " * 40), (None, None),
        (10, "the " * 3000), (11, "the the"), (12, "x" * 50_000), (13, "a\x00b\r\nc\x0bd é ü"),
        (14, " ".join(f"z{i}" for i in range(40_000))), (15, " ".join(f"z{i}" for i in range(2_000, 40_000))),
    ]
    # A third of all rows round one text, some within the threshold, some not.
    for i in range(120):
        copy = list(base)
        for _ in range(rng.randrange(0, 14)):
            copy[rng.randrange(len(copy))] = f"u{rng.randrange(4000)}"
        made.append((100 + i, " ".join(copy)))
    chain = [f"c{i}" for i in range(60)]  # each like the next, the ends unlike
    made += [(300 + i, " ".join(chain[i:] + [f"d{j}" for j in range(i)])) for i in range(0, 40, 3)]
    made += [(400 + i, " ".join(rng.choice("abcdefgh") * 3 for _ in range(rng.randint(0, 60)))) for i in range(60)]
    return made


def linked_groups(rows, low=80):
    sets = []
    for _, t in rows:
        w = words(lowered(t))
        sets.append(set(zip(w, w[1:])) if len(w) > 1 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= low * len(a | sets[j]):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[root(i)].append(2**63 - 1 if d is None else d)
    out = []
    for i, (d, _) in enumerate(rows):
        least = min(ids[root(i)])
        least = None if least == 2**63 - 1 else least
        out.append((d, len(sets[i]), least, d == least))
    return out


DOCS = "doc_id long, text string, uid long, node long, cluster long, digest string, bands int, rows int, part int"


@pytest.mark.parametrize("sizes", [{}, {"bucket_bytes": 9_000, "unit_bytes": 6_000, "broadcast_rows": 0}])
def test_minhash_groups(spark, sizes):
    docs = spark.createDataFrame([(*r, 1, 2, 3, "d", 4, 5, 6) for r in texts()], DOCS).repartition(6)
    got = near_duplicates(docs, **sizes)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert plain(got.collect()) == sorted(linked_groups(texts()), key=repr)


def test_minhash_of_nothing(spark):
    assert near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    assert near_duplicates(spark.createDataFrame([(1, None)], "doc_id long, text string")).first()[:3] == (1, 0, 1)


def test_collections_agree_as_often_as_sets(monkeypatch):
    """Share of collections that agree: similarity to the power of depth; and
    pairs of similarity 0.8 have a key in common."""
    rng = np.random.default_rng(9)
    agree, met, pairs = 0, 0, 400
    for _ in range(pairs):
        all_ = rng.integers(0, 1 << 63, 450, dtype=np.uint64)
        made = minhash.bands([all_[:405], all_[45:]], 20, 3)  # 360 of 450: 0.8
        agree += int((made[0] == made[1]).sum())
        keys = minhash.tensored(made)
        met += bool((keys[0] == keys[1]).any())
        assert keys.shape[1] == 190
    assert abs(agree / pairs / 20 - 0.8**3) < 0.02 and met == pairs


def test_bit_rows_in_pieces(monkeypatch):
    """Few bits at once: the unit is halved, with the same links."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 40, 200, dtype=np.uint64)
    sets = [np.unique(np.append(rng.permutation(base)[: rng.integers(150, 200)], base[:100])) for _ in range(40)]
    full, cut = minhash._Forest(40), minhash._Forest(40)
    minhash.linked(sets, (80, 100), full, list(range(40)))
    monkeypatch.setattr(minhash, "BITS", 1 << 10)
    minhash.linked(sets, (80, 100), cut, list(range(40)))
    assert [full.root(i) for i in range(40)] == [cut.root(i) for i in range(40)] and len(full.edges) > 10
