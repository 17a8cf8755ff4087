"""Small raw incident frames."""

import math

from kerbwise.sources.incidents import RAW_SCHEMA

DEFAULTS = {
    "latitude": "12.95", "longitude": "77.6", "endlatitude": None, "endlongitude": None,
    "start_datetime": "2024-01-01 06:00:00+00", "created_date": "2024-01-01 06:00:00+00", "modified_datetime": None,
    "closed_datetime": None, "resolved_datetime": None, "event_type": "unplanned", "event_cause": "accident",
    "priority": "Low", "requires_road_closure": "FALSE", "corridor": "Main Road", "junction": None, "zone": None,
    "description": None,
}


def raw(spark, rows):
    """Raw incidents from partial rows; ids count up from 1."""
    full = [{"id": f"E{i}", **DEFAULTS, **row} for i, row in enumerate(rows, 1)]
    return spark.createDataFrame([tuple(r[f.name] for f in RAW_SCHEMA) for r in full], RAW_SCHEMA)


def by_id(df, *columns):
    return {r["id"]: (r[columns[0]] if len(columns) == 1 else tuple(r[c] for c in columns)) for r in df.collect()}


def distance(a, b):
    (la, lo), (lb, lp) = a, b
    p, q = math.radians(la), math.radians(lb)
    x = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(lp - lo) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(x))
