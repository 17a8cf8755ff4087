"""Language and quality classifiers: held-out accuracy, scoring by hand, odd rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kerbwise.llm import lang_id, quality
from kerbwise.llm.queries import QUERIES
from tests.llm import cases


def test_languages_of_held_out_documents(spark):
    got = QUERIES["op7_language_id"](spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    held = got.filter("held_out").join(docs, "doc_id")
    assert got.count() == docs.count() and held.count() > 100
    assert held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] >= 0.98
    assert got.filter("score not between 0 and 1 or lang_pred is null").isEmpty()


def test_language_does_not_depend_on_other_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = lang_id.train(docs)
    a = lang_id.identify(docs.select("doc_id", "text"), model)
    b = lang_id.identify(docs.select("doc_id", "text").withColumn("lang", F.lit("xx")).repartition(5), model).select("doc_id", "lang_pred", "score")
    assert sorted(map(tuple, a.select("doc_id", "lang_pred", "score").collect())) == sorted(map(tuple, b.collect()))


def test_grams_are_those_of_each_text():
    texts = pa.array(["Ab c", None, "12", "éa", ""])
    (row, feature, bounds, lettered), = lang_id.grams(texts)
    assert row == 0 and lettered.tolist() == [True, False, False, True, False]
    # 'ab c': four letters or blanks; grams of blanks only, or that begin and end with one, are left out
    single = [next(lang_id.grams(pa.array([t])))[1].tolist() for t in ("ab c", "éa")]
    assert feature[bounds[0] : bounds[1]].tolist() == single[0] and feature[bounds[3] : bounds[4]].tolist() == single[1]
    assert np.diff(bounds).tolist()[1:3] == [0, 0] and bounds[-1] == len(feature)


def test_ftrl_learns_and_stays_sparse():
    r = np.random.default_rng(0)
    labels = r.integers(0, 3, 300)
    rows = [(np.array([y, 3 + int(r.integers(50))]), np.array([1.0, 1.0])) for y in labels]
    weights = lang_id.follow_the_leader(rows, labels, 3, 60)
    assert all(int(np.argmax(x @ weights[f] + weights[-1])) == y for (f, x), y in zip(rows, labels))
    assert (weights[53:60] == 0).all()


def test_temperature_mends_overconfidence():
    r = np.random.default_rng(1)
    labels = r.integers(0, 2, 2000)
    logits = np.zeros((2000, 2))
    logits[np.arange(2000), np.where(r.random(2000) < 0.8, labels, 1 - labels)] = 20.0
    t = lang_id.best_temperature(logits, labels)
    assert lang_id.softmax(logits / t).max(1).mean() == pytest.approx(0.8, abs=0.03)


def test_language_on_odd_rows(spark):
    odd = cases.odd(spark)
    got = lang_id.identify(odd, lang_id.train(odd)).collect()
    assert len(got) == len(cases.rows())
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in got)
    assert all(r.score == 0 for r in got if r.lang_pred == "und") and set(odd.columns) <= set(got[0].asDict())
    assert lang_id.train(odd.withColumn("lang", F.lit(None).cast("string"))) is None
    assert {r.lang_pred for r in lang_id.identify(odd, None).collect()} == {"und"}
    assert lang_id.identify(cases.empty(spark), lang_id.train(odd)).count() == 0


def test_quality_of_held_out_documents(spark):
    got = QUERIES["op8_quality"](spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = got.filter("held_out").join(labels, "doc_id").select("quality", "predicted", "score").toPandas()
    assert (held.quality == held.predicted).mean() >= 0.97
    low, high = held.score[held.quality == 0], held.score[held.quality == 1]
    assert (np.subtract.outer(high.to_numpy(), low.to_numpy()) > 0).mean() >= 0.97


def test_interactions_in_linear_time_equal_all_pairs():
    m = quality.FactorisationMachine()
    r = np.random.default_rng(3)
    m.linear = r.normal(size=m.size)
    words = r.integers(0, quality.BUCKETS, 7)
    words[3] = words[0]  # a repeated word is two active features
    stats = r.normal(size=(1, len(quality.STATISTICS)))
    active = [(w, 1 / 7) for w in words] + [(quality.BUCKETS + i, x) for i, x in enumerate(stats[0])]
    pairs = sum(m.vectors[a] @ m.vectors[b] * x * y for i, (a, x) in enumerate(active) for b, y in active[i + 1 :])
    want = m.bias + sum(m.linear[a] * x for a, x in active) + pairs
    assert m.margins(words.astype(np.int32), np.array([0, 7]), stats)[0] == pytest.approx(want)


def test_quality_on_odd_rows(spark):
    odd = cases.odd(spark)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 18)] + [(3, None), (None, 1), (4, 7)], "doc_id long, quality long")
    model = quality.train(quality.labelled(odd, labels))
    got = quality.score(odd, model).collect()
    assert len(got) == len(cases.rows()) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality.score(odd, quality.train(quality.labelled(odd, labels.filter("quality = 1")))).collect()} == {0.5}
    assert quality.score(cases.empty(spark), model).count() == 0
    assert quality.score(odd, model, size=None).count() == len(got)


def test_copies_and_blank_texts_take_no_training_places(spark):
    texts = [(f"{w} {i} {w[::-1]}", lang) for i in range(20) for lang, w in (("aa", "alpha"), ("bb", "omega"), ("cc", "été"))]
    h = F.xxhash64("text", "lang")
    kinds = spark.createDataFrame(texts, "text string, lang string")
    blanks = spark.createDataFrame([(None, f"l{i}") for i in range(40)] + [(f" {i}.", "aa") for i in range(40)], "text string, lang string")
    first = kinds.orderBy(h).limit(1)
    docs = kinds.unionAll(first.crossJoin(spark.range(4500)).drop("id")).unionAll(blanks)
    rows, names = lang_id.training_rows(docs, "text", "lang", lang_id.TRAIN_DOCS)
    assert len(rows) == 60 and sorted(names) == sorted(lang for _, lang in texts)
    rows, names = lang_id.training_rows(docs, "text", "lang", 25)
    assert names == [r.lang for r in kinds.orderBy(h).limit(25).collect()] and len(rows) == 25
    assert lang_id.train(docs).languages == ["aa", "bb", "cc"]


def test_letters_in_sql_are_those_of_the_classifier(spark):
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(c, chr(c)) for c in codes[::7] + [0x2E80, 0x3400, 0x1E900]], "c int, text string")
    got = df.select("c", lang_id.has_letter(F.col("text")).alias("l")).collect()
    assert all(r.l == chr(r.c).isalpha() for r in got)


def test_few_rows_are_calibrated_too(spark):
    docs = spark.createDataFrame([("abcdefghijklmnopqrstuvwxyz"[i : i + 3], f"l{i * 7 % 5 % 2}") for i in range(24)], "text string, lang string")
    model = lang_id.train(docs)
    assert model.temperature != 1.0
    assert lang_id.identify(docs, model).filter("score between 0.5 and 1").count() == 24
    assert lang_id.train(docs.limit(1)).languages == ["l0"]
