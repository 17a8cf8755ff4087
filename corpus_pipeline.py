"""The corpus pipeline: language, near duplicates, benchmark passages, mix, shards.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Rows are told apart by a number
that is the same in every pass (``store.numbered``), so that repeated or missing ids are no ambiguity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbwise.llm import decontaminate, jaccard_join, lang_id, mixing, sharding
from kerbwise.llm.store import give_back_driver, numbered, small, stored

#: A document stays if a language was found with at least this calibrated probability.
MIN_LANGUAGE_SCORE = 0.5
#: Documents handed to Python at a time. Long texts make Spark's 10,000 a large batch, which the executor and each of its
#: workers hold at once, beside what earlier stages left.
BATCH_ROWS = 1_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter or without a clear language. Learned from the labelled documents themselves."""
    _small_batches(spark)
    model = lang_id.train(docs)
    give_back_driver(spark)  # the training rows
    judged = lang_id.identify(docs, model, names=("_stage_language", "_stage_score"))
    sure = (F.col("_stage_language") != lang_id.UNKNOWN) & (F.col("_stage_score") >= MIN_LANGUAGE_SCORE)
    return judged.filter(sure).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at a similarity of 0.8 of five-word shingles the one with the smallest doc_id stays."""
    _small_batches(spark)
    rows = _numbered(docs)
    key = F.struct(F.col("_doc.doc_id").isNull().alias("n"), F.col("_doc.doc_id").alias("id"), F.col("_row").alias("row"))
    linked = jaccard_join.jaccard_components(rows.select(key.alias("_key"), F.col("_doc.text").alias("text")), k=5, percent=80, key="_key")
    gone = linked.filter("_key.row != component_id.row").select(F.col("_key.row").alias("_row"))
    return _without(rows, gone)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    _small_batches(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = _numbered(docs)
    found = decontaminate.contaminated(rows.select("_row", F.col("_doc.text").alias("text")), benchmark, key="_row")
    return _without(rows, found.select("_row").distinct())


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take sources at their weights: a document stays once, twice or not at all."""
    mixed = mixing.apply_mix(_packed(docs, "doc_id", "text", "source"), mixing.plan_mix(docs))
    copies = F.explode(F.array_repeat(F.lit(1), F.col("_copies")))
    return mixed.filter("_copies > 0").select("_doc", copies.alias("_copy")).select("_doc.*")


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shards of nearly equal bytes, with the documents."""
    return sharding.shard(docs, keep=True)


STAGES = [
    ("language", language), ("near_duplicates", near_duplicates), ("benchmark_passages", benchmark_passages), ("mix", mix), ("shards", shards),
]

#: SQL cannot express the trained language model; stages are tested against brute force instead.
ORACLE_SQL = None


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def _packed(docs: DataFrame, *columns: str) -> DataFrame:
    """All columns as one, so that none can clash with those of a stage, and the named ones beside it."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), *columns)


def _numbered(docs: DataFrame) -> DataFrame:
    return numbered(docs, "_row", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    return rows.join(small(stored(gone, "gone")), "_row", "left_anti").select("_doc.*")


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written before the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
