"""Scans of the raw incident log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from kerbwise import settings as S
from kerbwise.session import prepare

RAW_COLUMNS = (
    "id", "latitude", "longitude", "endlatitude", "endlongitude", "start_datetime",
    "created_date", "modified_datetime", "closed_datetime", "resolved_datetime",
    "event_type", "event_cause", "priority", "requires_road_closure", "corridor",
    "junction", "zone", "description",
)
RAW_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in RAW_COLUMNS])


def scan_csv(spark: SparkSession, path: str | list[str], multi_line: bool = True) -> DataFrame:
    """Raw log from CSV with a header row; columns are matched by name, all as text.
    Files of one scan must have the same header: one that differs is an error.

    ``multi_line`` keeps line breaks inside quoted descriptions and reads one file
    per task. For logs without such breaks turn it off so that large files split.
    """
    prepare(spark)
    reader = (
        spark.read.option("header", True)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .option("inferSchema", False)
        .option("enforceSchema", False)
    )
    return null_tokens(reader.csv(path).select(*RAW_COLUMNS), S.CSV_NA_TOKENS)


def scan_parquet(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Raw log stored as Parquet with the declared all-text schema."""
    prepare(spark)
    return spark.read.schema(RAW_SCHEMA).parquet(*([path] if isinstance(path, str) else path))


def null_tokens(df: DataFrame, tokens: tuple[str, ...] = S.NULL_TOKENS) -> DataFrame:
    """Cells equal to a missing-value token become null, on every text column."""
    listed = ", ".join("'" + token.replace("'", "\\'") + "'" for token in tokens)
    return df.selectExpr(
        *[
            f"CASE WHEN `{f.name}` NOT IN ({listed}) THEN `{f.name}` END AS `{f.name}`"
            if isinstance(f.dataType, T.StringType)
            else f"`{f.name}`"
            for f in df.schema.fields
        ]
    )
