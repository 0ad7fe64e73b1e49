"""Small awkward tables: nulls, empty and long texts, ties, repeated rows, clashing names."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows], DOCS)


AWKWARD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One two"), (6, "a b c d e f g h"), (7, "a b c d e f g h"), (7, "a b c d e f g h"),
    (None, "no id"), (None, None), (8, "é ß ü É naïve"), (9, "word " * 30000), (10, "A\x0bB\x0cC D"),
]


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
