import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """rows: (doc_id, text) pairs, in three partitions."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS).repartition(3)


def clashing(df):
    """Extra columns with the names that operators give their own columns."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("x") for c in ("t", "w", "n_words", "kept", "key", "th", "row", "start", "length", "fail_bits", "n_tokens", "digest", "txn", "value", "bytes", "spans")})


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


WS = re.compile(r"[^\x20\x09-\x0D]+")
