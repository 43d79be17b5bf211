"""Fixed values that must equal the reference for identical results."""

# --- fixed values: token pattern (word runs, else any single visible char) ---
TOKEN_PATTERN = r"[\p{L}\p{N}\p{M}]+|[^\p{Z}\p{C}]"

# The kept-word form of the same pattern for unigrams: a single character
# that is punctuation is skipped by the scanner instead of being matched
# and then dropped; the sequence of the other tokens is unchanged.
KEPT_TOKEN_PATTERN = r"[\p{L}\p{N}\p{M}]+|[^\p{Z}\p{C}\p{P}]"

# Same two branches plus a third one for the gaps between tokens, so the
# matches tile the whole text (used to recover character offsets).
SEGMENT_PATTERN = r"[\p{L}\p{N}\p{M}]+|[^\p{Z}\p{C}]|[\p{Z}\p{C}]+"

# A token with the gap after it.
SPACED_TOKEN_PATTERN = r"(?:[\p{L}\p{N}\p{M}]+|[^\p{Z}\p{C}])[\p{Z}\p{C}]*"

# --- fixed values: English stop words, in the reference's order ---
STOPWORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your",
    "yours", "yourself", "yourselves", "he", "him", "his", "himself", "she",
    "her", "hers", "herself", "it", "its", "itself", "they", "them", "their",
    "theirs", "themselves", "what", "which", "who", "whom", "this", "that",
    "these", "those", "am", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an",
    "the", "and", "but", "if", "or", "because", "as", "until", "while", "of",
    "at", "by", "for", "with", "about", "against", "between", "into", "through",
    "during", "before", "after", "above", "below", "to", "from", "up", "down",
    "in", "out", "on", "off", "over", "under", "again", "further", "then",
    "once", "here", "there", "when", "where", "why", "how", "all", "any",
    "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor",
    "not", "only", "own", "same", "so", "than", "too", "very", "s", "t", "can",
    "will", "just", "don", "should", "now", "d", "ll", "m", "o", "re", "ve",
    "y", "ain", "aren", "couldn", "didn", "doesn", "hadn", "hasn", "haven",
    "isn", "ma", "mightn", "mustn", "needn", "shan", "shouldn", "wasn", "weren",
    "won", "wouldn", "'ll", "'re", "'ve", "n't", "'s", "'d", "'m", "''", "``",
)

# --- fixed values: retrieval and reading defaults ---
BM25_K1 = 1.2
BM25_B = 0.75
DOCS_PER_QUESTION = 30
EVAL_CUTOFF = 5
N_BEST = 60
EMITTED_SPANS = 30
MAX_ANSWER_TOKENS = 5
ENTITY_CANDIDATES = 30

# --- fixed values: the pair encoding markers ---
CLS = "[CLS]"
SEP = "[SEP]"
EMPTY_PASSAGE = "pass"

# --- fixed values: answer normalisation ---
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ARTICLES = ("a", "an", "the")
