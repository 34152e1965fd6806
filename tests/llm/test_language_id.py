import numpy as np
from pyspark.sql import functions as F

from fairlead.llm import language_id, queries


def test_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    told = queries.QUERIES["op2_language_id"](spark, "/root/testdata/sf0.01")
    rows = told.join(docs, "doc_id").where("held_out").collect()
    assert len(rows) > 250
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.98
    assert np.mean([r.rejected for r in rows]) < 0.01
    assert all(0 <= r.score <= 1 for r in rows)
    assert told.where(F.crc32(F.col("doc_id").cast("string")) % 3 == 1).count() == told.where("held_out").count()


def test_learns_only_from_the_others(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    wrong = docs.withColumn("lang", F.when(held, "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("other"))
    run = lambda d: sorted(map(tuple, language_id.identify(d, d.where(~held)).collect()))
    assert run(docs) == run(wrong)


def test_odd_rows(odd, empty):
    told = {(r.doc_id, r.text): r for r in language_id.predict(odd.withColumn("_id", F.col("doc_id")), language_id.train([("the cat sat on the mat", "en"), ("le chat est sur la table", "fr")] * 20), keep=("doc_id", "text")).collect()}
    assert all((r.lang_pred, r.score, r.rejected) == ("und", 0.0, True) for (_, t), r in told.items() if not any(c.isalpha() for c in t or ""))
    assert told[4, "one two three"].lang_pred == "en" or told[4, "one two three"].score <= 1
    assert language_id.identify(empty, empty).collect() == []
    assert {r.lang_pred for r in language_id.predict(odd, None).collect()} == {"und"}
    assert language_id.identify(odd, odd).count() == odd.count()


def test_predictions_do_not_depend_on_neighbours():
    model = language_id.train([("der Hund und die Katze", "de"), ("the dog and the cat", "en"), ("el perro y el gato", "es")] * 30)
    texts = ["the end", "x", "die Katze", "", "y", "perro", "a", "日本語", "ß"]
    assert model.predict(texts) == [model.predict([t])[0] for t in texts]
    assert [p[0] for p in model.predict(["the dog", "der Hund", "el gato"])] == ["en", "de", "es"]


def test_rejects_what_it_has_never_seen(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text", "lang").collect()]
    model = language_id.train(rows)
    assert all(p[2] for p in model.predict(["Привет, как твои дела сегодня вечером, друзья мои", "qqxz zzqj xkcdw vvvq jjjq xqxq zxzx qvqv"]))
