"""Exact, near and substring duplicates against brute force, and on odd rows."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from kerbwise.llm import exact_dedup, jaccard_join, substring_dedup
from tests.llm import cases


def _exact(docs):
    norm = [re.sub("[ \t-\r]+", "", t or "") for _, t in docs]
    out = []
    for (key, _), n in zip(docs, norm):
        group = [(-len(t or ""), k is None, k or 0, k) for (k, t), m in zip(docs, norm) if m == n]
        out.append((key, min(group)[3], len(group), hashlib.sha256(n.encode()).hexdigest()))
    return out


def _key(r):
    return tuple((x is None, x if x is not None else 0) for x in r)


def test_exact_dedup_on_odd_rows(spark):
    given = [(r[0], r[1]) for r in cases.rows()]
    got = exact_dedup.exact_dedup(cases.odd(spark)).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=_key) == sorted(_exact(given), key=_key)
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})  # one row of each group, repeated rows too
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_dedup.exact_dedup(cases.empty(spark)).count() == 0


def test_overfull_buckets_split(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % 300).cast("string")).alias("text"))
    got = exact_dedup.exact_dedup(docs, capacity=4)
    assert got.filter("kept").count() == 300 and got.agg(F.sum("group_size")).first()[0] == 200 * 4 + 100
    entries = docs.select(F.xxhash64("text").alias("h"), F.lit("s").alias("sha"), "doc_id")
    cells, depth = exact_dedup.directory(entries, 4)
    buckets = entries.select("h").distinct().withColumn("cell", F.shiftrightunsigned("h", 64 - depth)).join(cells, "cell").groupBy("bucket").count()
    assert buckets.agg(F.max("count")).first()[0] <= 4 and buckets.count() > 60


@pytest.mark.parametrize("hot_rows", [1, 40, 4096])
def test_groups_beyond_a_broadcast_are_answered_by_their_buckets(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROW_LIMIT", 5)
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", hot_rows)
    docs = [(i, f"t {0 if i % 3 == 0 else i % 150}") for i in range(400)] + [(400, None), (401, "")]
    got = exact_dedup.exact_dedup(spark.createDataFrame(docs, "doc_id long, text string"), capacity=4).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == sorted(_exact(docs))


def _entries(spark, n=300):
    return spark.range(n).select(F.xxhash64("id").alias("h"), F.col("id").cast("string").alias("sha"), F.lit(1).alias("group_size"))


def test_a_bucket_lies_in_one_file_of_its_owner(spark):
    placed = exact_dedup.Index(_entries(spark), 4).entries.withColumn("file", F.input_file_name())
    found = placed.groupBy("bucket").agg(F.count_distinct("file").alias("files"), F.count(F.lit(1)).alias("n"))
    most = found.agg(F.max("files").alias("files"), F.max("n").alias("n"), F.sum("n").alias("all")).first()
    assert (most["files"], most["all"]) == (1, 300) and most["n"] <= 4
    assert found.select("bucket").count() > 60


@pytest.mark.parametrize("wrong", ["one bucket", "a cell less"])
def test_a_wrong_directory_is_refused(spark, monkeypatch, wrong):
    right = exact_dedup.directory

    def broken(entries, capacity):
        cells, depth = right(entries, capacity)
        some = cells.agg(F.min("cell")).first()[0]
        return (cells.withColumn("bucket", F.lit(0).cast("long")) if wrong == "one bucket" else cells.filter(F.col("cell") != some)), depth

    monkeypatch.setattr(exact_dedup, "directory", broken)
    with pytest.raises(RuntimeError, match="directory"):
        exact_dedup.Index(_entries(spark), 4)


def test_colliding_digests_are_told_apart_by_their_bytes(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda *_: F.lit("same"))
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *_: F.lit(5).cast("long"))
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a "), (4, "c")], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs).collect()}
    assert got == {1: (3, 2), 2: (2, 1), 3: (3, 2), 4: (4, 1)}


def _near_copies(seed, groups, copies, words=60):
    """Base texts and copies of them with a few words changed or dropped, some in chains."""
    r = random.Random(seed)
    out = []
    for g in range(groups):
        text = [f"v{r.randrange(400)}" for _ in range(r.randrange(3, words))]
        for c in range(r.randrange(1, copies)):
            other = list(text)
            for _ in range(r.randrange(0, 3)):
                other[r.randrange(len(other))] = f"n{g}x{c}"
            if r.random() < 0.3:
                text = other  # a chain: the next copies follow this one
            out.append(" ".join(other))
    r.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (1, 60)])
def test_jaccard_components_equal_brute_force(spark, k, percent):
    docs = _near_copies(k, 60, 12)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(tuple(r) for r in jaccard_join.jaccard_components(df, k=k, percent=percent).collect())
    assert got == cases.components(docs, k, percent)


def test_common_shingles_and_large_groups(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FLUSH", 500)
    r = random.Random(3)
    base = [f"b{i}" for i in range(50)]
    docs = []
    for i in range(260):  # a third of all rows near one text, with a common passage in the others
        if i % 3 == 0:
            other = list(base)
            for _ in range(r.randrange(0, 4)):
                other[r.randrange(50)] = f"c{i}"
            docs.append((i, " ".join(other)))
        else:
            docs.append((i, " ".join([f"u{r.randrange(10**6)}" for _ in range(8)] + base[:9] + [f"u{r.randrange(10**6)}" for _ in range(5)])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    described = jaccard_join.describe_sets(df, 4, "doc_id", "text")
    assert len(jaccard_join.common_tokens(described)) > 0
    got = sorted(tuple(r) for r in jaccard_join.jaccard_components(df, k=4, percent=85).collect())
    assert got == cases.components(docs, 4, 85)


def test_jaccard_on_odd_rows(spark):
    got = jaccard_join.jaccard_components(cases.odd(spark)).collect()
    assert len(got) == len(cases.rows())
    by_id = {r.doc_id: r for r in got}
    assert by_id[6].component_id == by_id[7].component_id == by_id[8].component_id == 6
    assert by_id[3].component_id == by_id[4].component_id == 3 and by_id[3].n_shingles == 1
    assert by_id[0].component_id == 0 and by_id[18].component_id == 18 and by_id[2].n_shingles == 0
    assert by_id[9].component_id == by_id[10].component_id == 9 and by_id[None].n_shingles == 1
    assert jaccard_join.jaccard_components(cases.empty(spark)).count() == 0


def test_substrings_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "FLUSH", 300)
    r = random.Random(5)
    passages = [[f"p{r.randrange(30)}" for _ in range(r.randrange(5, 25))] for _ in range(12)]
    docs = []
    for i in range(120):
        w = []
        for _ in range(r.randrange(0, 5)):
            w += r.choice(passages) if r.random() < 0.6 else [f"u{r.randrange(50)}" for _ in range(r.randrange(1, 20))]
        docs.append((r.randrange(10**12) if i % 10 else None, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    for size in (13, 3):
        got = substring_dedup.substring_dedup(df, size).withColumn("sha", F.sha2("kept", 256)).select("doc_id", "n_words", "n_removed", "sha").collect()
        assert sorted(map(tuple, got), key=_key) == sorted(cases.deduplicated(docs, size), key=_key)


def test_substrings_on_odd_rows(spark):
    given = [(r[0], r[1]) for r in cases.rows()]
    got = substring_dedup.substring_dedup(cases.odd(spark)).withColumn("sha", F.sha2("kept", 256)).select("doc_id", "n_words", "n_removed", "sha").collect()
    assert sorted(map(tuple, got), key=_key) == sorted(cases.deduplicated(given, 13), key=_key)
    assert substring_dedup.substring_dedup(cases.empty(spark)).count() == 0
