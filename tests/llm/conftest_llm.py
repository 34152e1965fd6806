import os

from pyspark.sql import functions as F

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents_of(spark, rows):
    """Rows of (doc_id, text, lang, source) as documents, with further columns whose names the operators use themselves."""
    full = [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]
    docs = spark.createDataFrame(full, DOCUMENTS)
    for name in ("n", "size", "token", "tokens", "_text", "p", "key", "bucket", "component", "spans", "measure", "start", "copies", "sid"):
        docs = docs.withColumn(name, F.lit("clash"))
    return docs.repartition(3)


LONG = " ".join(f"word{i * i % 977}" for i in range(30_000))

ODD_ROWS = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n", None, None), (4, "one two three", "en", None), (5, "one two three", None, "b"),
    (5, "one two three", None, "b"), (6, "ONE Two\x0bthree", "fr", "b"), (7, LONG, "en", "a"), (8, LONG + " end", "en", "b"), (None, "one two three", "en", "a"),
    (None, None, None, None), (9, "12 34 !!", "en", "c"), (10, "é" * 3000, "fr", "c"), (11, "naïve café 日本語 \U0001f600 ok", "fr", "c"), (10, "a b c d e f g h", "fr", "c"),
]
