"""Rows keep their identity when the splits of a scan change between two passes."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from kerbwise.llm import store, substring_dedup, warc
from tests.llm import cases

SF = "/root/testdata/sf0.001"
FEWER = {"spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}


@pytest.fixture
def merged(spark):
    """Call it to have all files of later scans in one split."""
    yield lambda: [spark.conf.set(k, v) for k, v in FEWER.items()]
    for k in FEWER:
        spark.conf.unset(k)


def _several_files(df):
    """Read from six files of different sizes, each a split of its own."""
    part = F.least(F.floor(F.rand(1) * 12), F.lit(5)).cast("int")
    path = store.fresh_path(df.sparkSession, "split")
    df.repartitionByRange(6, part).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def test_numbers_do_not_follow_the_splits(spark, merged):
    given = _several_files(spark.range(5000).withColumn("c", F.col("id") % 7))
    kept = given.filter("c < 5").select("id")
    assert store.rereads_alike(given) and store.rereads_alike(kept)
    for other in (given.unionAll(given), given.filter(F.rand() < 0.5), given.crossJoin(spark.range(2).toDF("x")), spark.read.parquet(*given.inputFiles())):
        assert not store.rereads_alike(other)
    rows = [store.numbered(df, "row", F.col("id")) for df in (given, kept, given.repartition(3))]
    before = [sorted(map(tuple, r.collect())) for r in rows]
    merged()
    assert [sorted(map(tuple, r.collect())) for r in rows] == before
    assert [len({n for _, n in b}) for b in before] == [5000, kept.count(), 5000]


def test_stages_drop_the_same_rows_whatever_the_splits(spark, merged):
    docs = _several_files(spark.read.parquet(f"{SF}/documents.parquet"))
    for stage in (P.near_duplicates, P.benchmark_passages):
        want = sorted(r.doc_id for r in stage(spark, docs, SF).collect())
        assert len(want) < docs.count()
        later = stage(spark, docs, SF)
        merged()
        assert sorted(r.doc_id for r in later.collect()) == want
        for k in FEWER:
            spark.conf.unset(k)


def test_substrings_are_cut_from_their_rows_whatever_the_splits(spark, merged):
    docs = _several_files(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    given = [tuple(r) for r in docs.collect()]
    got = substring_dedup.substring_dedup(docs).withColumn("sha", F.sha2("kept", 256)).select("doc_id", "n_words", "n_removed", "sha")
    merged()
    assert sorted(map(tuple, got.collect())) == sorted(cases.deduplicated(given, 13))


def test_one_response_of_each_payload_whatever_the_splits(spark, merged, monkeypatch):
    # Rows that repeat the largest page_id are told apart by their number alone.
    pages = _several_files(spark.range(900).select(F.lit(7).alias("page_id"), F.lit("u").alias("url"), (F.col("id") % 30).cast("string").alias("html")))
    small = warc.small
    monkeypatch.setattr(warc, "small", lambda table: (merged(), small(table))[1])
    got = warc.read_archives(warc.write_archives(pages, warc.archive_folder(pages)))
    assert got.count() == 900
    assert sorted(r["count"] for r in got.filter("kind = 'response'").groupBy("payload_digest").count().collect()) == [1] * 30
