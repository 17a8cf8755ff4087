"""Raw incident log derived from the ``events`` table by integer arithmetic.

The same text is expanded for Spark and for the checking database, so that both
sides start from identical rows (see FIXTURES.md).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from kerbwise.session import prepare, spread

TEMPLATE = """
WITH k AS (
  SELECT event_id AS n, event_type AS et,
         CASE WHEN user_id % 10 < 3 THEN 0 ELSE user_id % 15 END AS cl,
         1699488000 + CAST(floor(5 * ({US_TS} - 1704067200000000) / 1000000) AS BIGINT) AS cs
  FROM {EVENTS}
), g AS (
  SELECT *, 1285000 + (cl % 5) * 3500 + ((n * 37) % 101) * 15 AS la,
         7750000 + CAST(floor(cl / 5) AS BIGINT) * 3500 + ((n * 53) % 97) * 15 AS lo
  FROM k
)
SELECT 'E' || n AS id,
  CASE WHEN n % 211 = 0 THEN '0' WHEN n % 223 = 0 THEN 'NULL' ELSE {DEG:la} END AS latitude,
  CASE WHEN n % 227 = 0 THEN 'abc' ELSE {DEG:lo} END AS longitude,
  CASE WHEN n % 9 = 0 AND n % 2 = 0 THEN {DEG:(la + 400)} WHEN n % 9 = 0 THEN '0' ELSE 'NULL' END AS endlatitude,
  CASE WHEN n % 9 = 0 AND n % 2 = 0 THEN {DEG:lo} WHEN n % 9 = 0 THEN '0' ELSE 'NULL' END AS endlongitude,
  {F:cs - (n % 7) * 60} AS start_datetime,
  CASE WHEN n % 97 = 0 THEN 'NULL' ELSE {F:cs} END AS created_date,
  {F:cs + (30 + (n * 29) % 2000) * 60} AS modified_datetime,
  CASE WHEN n % 5 IN (0, 1) THEN {F:cs + (118 + n % 65) * 60}
       WHEN n % 5 = 2 THEN {F:cs + (5 + (n * 7) % 300) * 60} ELSE '' END AS closed_datetime,
  CASE WHEN n % 5 = 3 THEN {F:cs + (10 + (n * 17) % 400) * 60}
       WHEN n % 101 = 0 THEN 'not a date' ELSE 'None' END AS resolved_datetime,
  CASE WHEN et = 'signup' AND n % 2 = 0 THEN 'planned'
       WHEN n % 31 = 0 THEN ' Unplanned ' ELSE 'unplanned' END AS event_type,
  CASE WHEN n % 10 <> 0 AND CAST(floor(cs / 86400) AS BIGINT) % 4 = 0 THEN 'pot_holes' ELSE
    CASE (n * 13) % 11 WHEN 0 THEN 'accident' WHEN 1 THEN 'Pot_Holes' WHEN 2 THEN 'tree_fall'
      WHEN 3 THEN 'congestion' WHEN 4 THEN 'construction' WHEN 5 THEN 'water_logging'
      WHEN 6 THEN 'debris ' WHEN 7 THEN 'public_event' WHEN 8 THEN 'NULL'
      ELSE 'vehicle_breakdown' END END AS event_cause,
  CASE WHEN n % 17 = 0 THEN 'NULL' WHEN (n + cl) % 3 = 0 THEN 'High' ELSE 'Low' END AS priority,
  CASE WHEN n % 9 = 0 THEN 'TRUE' WHEN n % 10 = 1 THEN 'false' ELSE 'FALSE' END AS requires_road_closure,
  CASE WHEN cl = 14 THEN 'NULL' ELSE 'Corridor ' || cl || CASE WHEN n % 41 = 0 THEN ' ' ELSE '' END END AS corridor,
  CASE WHEN n % 3 = 0 THEN 'NULL' ELSE 'Junction ' || (la % 7) END AS junction,
  CASE WHEN n % 53 = 0 THEN 'NULL' ELSE 'Zone ' || (cl % 6) END AS zone,
  CASE WHEN et = 'signup' AND n % 2 = 0 THEN
    CASE ({HALF:n} - CAST(floor(n / 14) AS BIGINT) * 7) WHEN 0 THEN 'IPL cricket match'
      WHEN 1 THEN 'Namma Metro work' WHEN 2 THEN 'temple car festival' WHEN 3 THEN 'protest rally'
      WHEN 4 THEN 'VIP convoy' WHEN 5 THEN 'BWSSB road work' ELSE 'misc programme' END
  ELSE CASE n % 8 WHEN 0 THEN 'Traffic slow near junction' WHEN 1 THEN 'traffic normal sir'
      WHEN 2 THEN 'ಟ್ರಾಫಿಕ್ ಜಾಮ್' WHEN 3 THEN 'ಸಮಸ್ಯೆ ಇಲ್ಲ' WHEN 4 THEN 'slow but cleared'
      WHEN 5 THEN 'NULL' WHEN 6 THEN 'Heavy Traffic, OK' ELSE 'vehicle parked' END END AS description
FROM g
"""

SPARK_FORMS = {
    "US_TS": "unix_micros(CAST(ts AS TIMESTAMP))",
    "F": "date_format(timestamp_seconds({x}), 'yyyy-MM-dd HH:mm:ss') || '+00'",
    "DEG": "CAST(floor({x}/100000) AS BIGINT) || '.' || lpad(CAST({x} % 100000 AS STRING), 5, '0')",
    "HALF": "{x} div 2",
}
DUCKDB_FORMS = {
    "US_TS": "epoch_us(ts)",
    "F": "strftime(make_timestamp(CAST({x} AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S') || '+00'",
    "DEG": "CAST(floor({x}/100000) AS BIGINT) || '.' || lpad(CAST({x} % 100000 AS VARCHAR), 5, '0')",
    "HALF": "{x} // 2",
}


def expand(forms: dict[str, str], events: str) -> str:
    """Template text in one SQL dialect, reading the relation ``events``."""

    def fill(match: re.Match[str]) -> str:
        name, _, argument = match.group(1).partition(":")
        return forms[name].replace("{x}", f"({argument})" if argument else "")

    return re.sub(r"\{([A-Z_]+(?::[^}]*)?)\}", fill, TEMPLATE.replace("{EVENTS}", events))


def incidents_from_events(spark: SparkSession, events: DataFrame) -> DataFrame:
    """Raw incident rows (all text) for a batch or streaming ``events`` frame."""
    prepare(spark)
    return spark.sql(expand(SPARK_FORMS, "{events}"), events=events)


def scan_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type")
    return incidents_from_events(spark, spread(events))
