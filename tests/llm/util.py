"""Small tables with the hard cases, for the tests of every operator."""

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket int, pos string"


def docs(spark, rows):
    """rows: (doc_id, text[, source]); further columns clash in name with the operators' own."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), 7, "x") for r in rows]
    return spark.createDataFrame(full, DOC_SCHEMA)


EDGE = [(1, None), (2, ""), (3, "one"), (4, "same text here"), (5, "same text here"), (5, "same text here"), (None, "no id"), (7, "  \t\n "), (8, "日本語 テキスト é" * 3)]
