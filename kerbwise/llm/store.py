"""Written intermediate tables, running sums without a single task, size-checked broadcasts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kerbwise.llm.words import give_back
from kerbwise.session import BROADCAST_ROW_LIMIT, shared_dir, trim_jvm


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of the cluster."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def give_back_driver(spark: SparkSession) -> None:
    """Return freed memory of the driver, of its Python and of its JVM."""
    give_back()
    trim_jvm(spark)


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and continue from there, so that lost
    executors cost a reread and not a recomputation. The driver returns what it freed until then."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    give_back_driver(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(table: DataFrame, limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Mark a stored narrow table for broadcast if it is counted at ``limit`` rows or fewer;
    beyond that the join shuffles. Rows never depend on which of the two happens."""
    return F.broadcast(table) if table.limit(limit + 1).count() <= limit else table


def rereads_alike(df: DataFrame) -> bool:
    """Whether ``df`` is the scan of one Parquet path with at most a choice of columns and rows above it, so that
    path and row index of a file name a row once, however its splits are drawn."""
    if not hasattr(df, "_jdf"):
        return False
    plan = df._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias") and plan.deterministic():
        plan = plan.children().apply(0)
    if plan.getClass().getSimpleName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return False
    relation = plan.relation()
    return relation.fileFormat().getClass().getSimpleName() == "ParquetFileFormat" and relation.location().rootPaths().size() == 1


def numbered(df: DataFrame, name: str, *columns: Column) -> DataFrame:
    """``columns`` of ``df`` with a number of the row, ``name``, that is the same in every pass and job.

    A number given during a scan follows its splits, and these follow the cores registered at that moment. Rows
    of a Parquet path are therefore numbered by file and place in the file; those of any other frame are written
    once with their number.
    """
    if not rereads_alike(df):
        return stored(df.select(*columns, F.monotonically_increasing_id().alias(name)), "numbered")
    place = df.metadataColumn("_metadata")
    paths = sorted(r[0] for r in df.select(place.getField("file_path")).distinct().toLocalIterator())  # one a file
    files = df.sparkSession.createDataFrame(list(enumerate(paths)), "_file_number long, _file_path string")
    placed = df.select(*columns, place.getField("file_path").alias("_file_path"), place.getField("row_index").alias("_file_row"))
    joined = placed.join(small(files), "_file_path")
    return joined.withColumn(name, F.shiftleft("_file_number", 40) + F.col("_file_row")).drop("_file_path", "_file_row", "_file_number")


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ordered_sums(df: DataFrame, order: list[str | Column], sums: dict[str, Column], name: str) -> DataFrame:
    """Rows of ``df`` with, for each entry of ``sums``, the sum over all rows before them in ``order``.

    The order must be total (end it with a unique column). Rows are dealt to ranges of that order and
    written; each range sums by itself, then the totals of the earlier ranges are added. Only one row
    per range is ever ordered in one place.
    """
    ranged = df.repartitionByRange(tasks(df.sparkSession), *order).withColumn("_range", F.spark_partition_id())
    table = stored(ranged, name)
    totals = table.groupBy("_range").agg(*[F.sum(c).alias(f"_t_{k}") for k, c in sums.items()])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_range", *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in sums])
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = table.withColumns({k: F.coalesce(F.sum(c).over(within), F.lit(0)) for k, c in sums.items()})
    joined = summed.join(F.broadcast(offsets), "_range")  # one row per range, as many as shuffle partitions
    return joined.withColumns({k: F.col(k) + F.col(f"_o_{k}") for k in sums}).drop("_range", *[f"_o_{k}" for k in sums])
