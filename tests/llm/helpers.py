import hashlib

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor " * 20000


def table(spark, rows, schema=COLUMNS):
    return spark.createDataFrame(rows, schema)


def docs(spark, texts, ids=None, source="s", lang="en"):
    return table(spark, [(i, t, lang, source, len(t or "")) for i, t in zip(ids or range(len(texts)), texts, strict=True)])


def odd(spark):
    """Nulls in every column, empty, blank and long texts, ties, repeated rows and repeated ids."""
    return table(spark, [
        (1, "a b c d e f", "en", "x", 11), (2, None, "en", "x", None), (3, "", None, None, 0), (None, "a b c d e f", "en", "y", 11),
        (4, " \t\n", "en", None, 3), (5, LONG, "de", "x", len(LONG)), (1, "a b c d e f", "en", "x", 11), (6, "same text here", "en", "y", 14),
        (7, "same text here", "fr", "y", 14), (8, "é ü 🙂 <|endoftext|> x", "fr", "z", 20), (8, "other text of the same id", None, "z", 25), (None, None, None, None, None),
    ])


def empty(spark):
    return table(spark, [])


def clashing(df):
    """Extra columns by the names that operators use for their own."""
    from pyspark.sql import functions as F

    names = ["digest", "row", "n", "id", "size", "kept", "keep_id", "bucket", "hash", "score", "target", "taken", "bin", "piece", "shard", "root", "sign", "prefix", "token", "group_size", "_size", "_source", "_part", "cluster", "rate", "value"]
    return df.withColumns({k: F.lit(k) for k in names})


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()
