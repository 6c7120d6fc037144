"""Fixed word lists and alphabets, and the reading of longer ones."""

from __future__ import annotations

from pyspark.sql import SparkSession

# They decide which terms exist, so results depend on every entry.
STOP_CS = (
    "a", "v", "na", "je", "se", "s", "z", "do", "pro", "o", "k", "i", "ale", "jako", "tak",
    "tento", "tato", "toto", "že", "by", "si", "jsou", "být", "který", "která", "které",
    "co", "ve", "po", "při", "už", "jen", "může", "musí",
)
STOP_EN = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your",
    "yours", "yourself", "yourselves", "he", "him", "his", "himself", "she", "her",
    "hers", "herself", "it", "its", "itself", "they", "them", "their", "theirs",
    "themselves", "what", "which", "who", "whom", "this", "that", "these", "those",
    "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had",
    "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if",
    "or", "because", "as", "until", "while", "of", "at", "by", "for", "with",
    "about", "against", "between", "into", "through", "during", "before", "after",
    "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over",
    "under", "again", "further", "then", "once", "here", "there", "when", "where",
    "why", "how", "all", "any", "both", "each", "few", "more", "most", "other",
    "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than",
    "too", "very", "s", "t", "can", "will", "just", "don", "should", "now",
)
CZECH_LETTERS = "áčďéěíňóřšťúůýž"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" + "„“‚‘–—…«»"
EDIT_ALPHABET = "abcdefghijklmnopqrstuvwxyzáéíóúýčďěňóřšťžů"

#: What the index leaves out unless told otherwise; pass a longer Czech list read
#: with load_stop_words() to leave out more.
INDEX_STOP = tuple(dict.fromkeys(STOP_CS + STOP_EN))


def load_stop_words(spark: SparkSession, path: str, most: int = 100_000) -> tuple[str, ...]:
    """The words of a file with one on each line, in the file's order."""
    words = [r.value.strip() for r in spark.read.text(path).limit(most + 1).collect()]
    if len(words) > most:
        raise ValueError(f"{path} has more than {most} lines: not a stop list")
    return tuple(dict.fromkeys(w for w in words if w))
