"""Stop words of the vectorizer."""

# English function words, alphabetical. The negations in
# NEGATIONS carry meaning in reports and are therefore never in the list.
NEGATIONS = ("never", "no", "nor", "not", "without")

STOP_WORDS = (
    "about", "above", "after", "again", "against", "all", "also", "am", "an",
    "and", "any", "are", "as", "at", "be", "because", "been", "before",
    "being", "below", "between", "both", "but", "by", "can", "could", "did",
    "do", "does", "doing", "down", "during", "each", "few", "for", "from",
    "further", "had", "has", "have", "having", "he", "her", "here", "hers",
    "herself", "him", "himself", "his", "how", "if", "in", "into", "is", "it",
    "its", "itself", "just", "me", "more", "most", "my", "myself", "of",
    "off", "on", "once", "only", "or", "other", "our", "ours", "ourselves",
    "out", "over", "own", "same", "she", "should", "so", "some", "such",
    "than", "that", "the", "their", "theirs", "them", "themselves", "then",
    "there", "these", "they", "this", "those", "through", "to", "too",
    "under", "until", "up", "very", "was", "we", "were", "what", "when",
    "where", "which", "while", "who", "whom", "why", "will", "with", "would",
    "you", "your", "yours", "yourself", "yourselves",
)


def stop_words_without(words, keep=NEGATIONS) -> tuple[str, ...]:
    """Any caller-supplied list with the negations taken out, sorted."""
    return tuple(sorted(set(words) - set(keep)))
