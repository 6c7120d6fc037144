"""Rows that every operator must take: nulls in any column, empty and long texts,
ties, repeated rows, and columns whose names clash with those an operator adds."""

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, node string, score string, kept string, h string, _text string, rk string"


def odd_docs(spark, texts=()):
    rows = []
    base = [None, "", "   \n\t ", "!!! 123 ???", "short text", "w" * 50_000, "word " * 8_000, "línea única é日本\n" * 40, "same row", "same row"]
    for i, t in enumerate([*base, *texts]):
        rows.append((i, t, "en" if i % 2 else None, "s" if i % 3 else None, None, "n", "x", "k", "h", "t", "r"))
    rows.append((None, "a row without an id", None, None, None, *[None] * 6))
    rows.append(rows[8])  # a repeated row
    rows.append((8, "another text with the same id", "en", "s", 1, *[None] * 6))
    return spark.createDataFrame(rows, COLUMNS)


def empty_docs(spark):
    return spark.createDataFrame([], COLUMNS)
