"""Small tables with the awkward rows every operator must bear."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, shard string, band int"


def awkward(spark):
    """Nulls, empty and blank texts, repeated rows, equal texts, one long text, clashing extra columns."""
    base = "the quick brown fox jumps over the lazy dog while the band plays on and on until dawn"
    rows = [
        (1, base), (2, base), (2, base), (3, None), (4, ""), (5, " \t\n \n"), (6, base.upper()), (None, base), (None, None),
        (7, "word " * 60000), (8, "é 日本 ’s 👍🏽\r\n\x00 x"), (9, "one two"), (10, "one two"), (11, base + " again"),
    ]
    return spark.createDataFrame([(i, t, None, "s", len(t or ""), "x", "y", 1) for i, t in rows], DOCS)


def nothing(spark):
    return spark.createDataFrame([], DOCS)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")
