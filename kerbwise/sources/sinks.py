"""Sinks: stage tables and the nested JSON feed document."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbwise.session import cut, sized, together

# Sorted by these, the lines of a feed are its text.
LINE_ORDER = ["n", "part", "key", "level", "place", "json", "row"]

# A null in a CSV table, apart from the empty text.
CSV_NULL = "\\N"


def write_table(df: DataFrame, path: str, partition_by: str | None = None, format: str = "parquet") -> DataFrame:
    """Write a table and read it back typed. ``csv`` writes a header row.

    Partitioned tables are rebalanced first: adaptive execution splits a date that
    holds much of the log over several files and joins small dates per task.
    """
    if partition_by:
        df = df.hint("rebalance", partition_by)
    writer = df.write.mode("overwrite").format(format)
    if format == "csv":
        writer = writer.options(header=True, escape='"', quoteAll=True, emptyValue="", nullValue=CSV_NULL)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.save(path)
    reader = df.sparkSession.read.schema(df.schema).format(format)
    if format == "csv":
        reader = reader.options(header=True, multiLine=True, escape='"', emptyValue="", nullValue=CSV_NULL, enforceSchema=False)
    return reader.load(path)


def write_tables(tables: dict[str, DataFrame], folder: str, partitions: dict[str, str]) -> dict[str, DataFrame]:
    """Tables that do not need each other, written at the same time."""
    if not tables:
        return {}
    spark = next(iter(tables.values())).sparkSession
    return together(spark, **{n: partial(write_table, df, f"{folder}/{n}", partitions.get(n)) for n, df in tables.items()})


@dataclass(frozen=True)
class Section:
    """A part of the feed: one piece of JSON per report row, with the row's place.

    ``pieces`` has ``key`` (the JSON text of a grouped section's key, else empty), ``place`` (an
    array that sorts like the order columns, nulls first) and ``json``. ``opening`` and
    ``closing`` are the brackets around the pieces; ``nested`` sections hold a list per key.
    """

    pieces: DataFrame
    opening: str = "["
    closing: str = "]"
    nested: bool = False


def _place(df: DataFrame, order: list[str]) -> Column:
    """Order columns as one sortable array: numbers as numbers, anything else as text."""
    kinds = dict(df.dtypes)
    none_n, none_s = F.lit(None).cast("double"), F.lit(None).cast("string")
    entries = []
    for name in order:
        text = kinds[name] in ("string", "date", "timestamp")
        number, label = (none_n, F.col(name).cast("string")) if text else (F.col(name).cast("double"), none_s)
        entries.append(F.struct(number.alias("n"), label.alias("s")))
    return F.array(*entries)


def _value_json(value: Column) -> Column:
    """JSON text of a single value, ``null`` for a missing one."""
    whole = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
    return F.substr(whole, F.lit(6), F.length(whole) - 6)


def _key_json(key: str) -> Column:
    return _value_json(F.coalesce(F.col(key).cast("string"), F.lit("null")))


def records(df: DataFrame, order: list[str], columns: list[str] | None = None) -> Section:
    """A report table as an ordered list of records."""
    record = F.to_json(F.struct(*(columns or df.columns)))
    return Section(df.select(F.lit("").alias("key"), _place(df, order).alias("place"), record.alias("json")))


def mapping(df: DataFrame, key: str, value: Column) -> Section:
    """A report table as a key to value map, ordered by the key's text."""
    place = F.array(F.struct(F.lit(None).cast("double").alias("n"), F.col(key).cast("string").alias("s")))
    entry = F.concat(_key_json(key), F.lit(":"), _value_json(value))
    return Section(df.select(F.lit("").alias("key"), place.alias("place"), entry.alias("json")), "{", "}")


def grouped(df: DataFrame, key: str, order: list[str], columns: list[str]) -> Section:
    """A report table as a map from key to an ordered list of records."""
    record = F.to_json(F.struct(*columns))
    return Section(df.select(_key_json(key).alias("key"), _place(df, order).alias("place"), record.alias("json")), "{", "}", True)


def document(spark: SparkSession, sections: dict[str, Section]) -> DataFrame:
    """The lines of the feed, unordered: ``section``, ``text``, ``json`` (of report rows only) and LINE_ORDER.

    Every row of a report is a line of its own and every bracket is one, so nothing is folded: a section may hold any
    number of cells, zones, causes or corridors. A comma leads every row but the first of its list, and the first is one
    minimum per list, combined before the shuffle. Equal rows are told apart by a stored number. An empty section
    keeps its brackets; a missing key is the text "null".
    """
    named = [(n, name, part) for n, (name, part) in enumerate(sorted(sections.items()))]
    tagged = [
        part.pieces.select(
            F.lit(n).alias("n"), F.lit(name).alias("section"), F.lit(part.nested).alias("nested"), "key", "place", "json"
        )
        for n, name, part in named
    ]
    pieces = cut(reduce(DataFrame.unionByName, tagged).withColumn("row", F.monotonically_increasing_id()))
    found = pieces.groupBy("n", "section", "nested", "key").agg(F.min(F.struct("place", "json", "row")).alias("first"))
    lists = sized(found.select("n", "section", "nested", "key", F.col("first.row").alias("first_row")))

    comma = F.when(F.col("row") == F.col("first_row"), F.lit("")).otherwise(F.lit(","))
    listed = pieces.drop("section", "nested").join(lists, ["n", "key"])
    rows = listed.select(
        "n", "section", F.lit(1).alias("part"), "key", F.lit(1).alias("level"), "place", "json", "row",
        F.concat(comma, "json").alias("text"),
    )
    nested = lists.filter("nested")
    lowest = F.broadcast(nested.groupBy("n").agg(F.min("key").alias("lowest")))  # one row a section
    lead = F.when(F.col("key") == F.col("lowest"), F.lit("")).otherwise(F.lit(","))
    level = F.explode(F.array(F.lit(0), F.lit(2)))
    ends = nested.join(lowest, "n").select("n", "section", F.lit(1).alias("part"), "key", level.alias("level"), lead.alias("lead"))
    text = F.when(F.col("level") == 0, F.concat("lead", "key", F.lit(":["))).otherwise(F.lit("]"))
    ends = ends.withColumn("text", text).drop("lead")

    outer = []
    for n, name, part in named:
        before, after = "," if n else "{", "}" if n == len(named) - 1 else ""
        outer.append((n, name, 0, "", 0, f"{before}{json.dumps(name)}:{part.opening}"))
        outer.append((n, name, 2, "", 0, part.closing + after))
    brackets = spark.createDataFrame(outer, "n int, section string, part int, key string, level int, text string")
    return rows.unionByName(ends.unionByName(brackets), allowMissingColumns=True)


def write_feed(feed: DataFrame, path: str) -> None:
    """The feed as one JSON object: the text parts in the order of their names, each a range of the sorted lines."""
    feed.orderBy(*LINE_ORDER).select("text").write.mode("overwrite").text(path)


def feed_rows(feed: DataFrame) -> DataFrame:
    """The report rows of a feed: section, key of a grouped section (as JSON, else empty) and JSON text."""
    return feed.filter(F.col("json").isNotNull()).select("section", "key", "json")
