"""Rows that every operator over documents must survive."""

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "word and longer words " * 30_000


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def odd_docs(spark, more: str = ""):
    """Nulls in every column, empty and long texts, repeated rows and ids, and clashing extra columns."""
    data = [
        (1, "some plain text of a document", "en", "src0", 29),
        (1, "some plain text of a document", "en", "src0", 29),
        (1, "another text under the same number", "en", "src1", 34),
        (2, None, "en", "src0", None),
        (3, "", None, None, 0),
        (None, "text without a number", "de", "src2", 21),
        (None, None, None, None, None),
        (4, LONG, "en", "src0", len(LONG)),
        (5, " \t\n", "en", "", 3),
        (6, "\U0001f600 ünïcode \x00 text\r\nhere", "fr", "src1", 22),
    ]
    df = spark.createDataFrame(data, DOCS)
    for extra in ("__row", "__MARK", "__n", "id", "grp", "fp", "size", "rate", "__toxicity", "__mix_key", "slot", "g", "score", "copy"):
        df = df.selectExpr("*", f"cast(doc_id as string) as `{extra}`")
    return df
