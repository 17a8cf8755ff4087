"""The feed document: one JSON object from any number of report rows, without folding them."""

import json
import random

from pyspark.sql import functions as F

from kerbwise.sources import sinks


def _written(spark, sections, folder):
    sinks.write_feed(sinks.document(spark, sections), str(folder))
    parts = sorted(folder.glob("part-*"))
    return json.loads("".join(p.read_text(encoding="utf-8") for p in parts)), len(parts)


def test_feed_equals_nested_values(spark, tmp_path):
    r = random.Random(5)
    odd = ['say "x"', "line\nbreak", "tab\t\\", "ü – 漢", "", None, "b"]
    rows = [(r.choice(odd), r.choice([None, -1.5, 2.0, 10.0]), i % 40) for i in range(300)]
    rows += rows[:20]
    df = spark.createDataFrame(rows, "k string, x double, i long").repartition(7)
    got, _ = _written(spark, {
        "list": sinks.records(df, ["x", "k", "i"]),
        "empty": sinks.records(df.limit(0), ["i"]),
        "none": sinks.grouped(df.limit(0), "k", ["i"], ["i"]),
        "groups": sinks.grouped(df, "k", ["i", "x"], ["i", "x"]),
        "map": sinks.mapping(df.groupBy("i").agg(F.max("x").alias("x")), "i", F.col("x")),
    }, tmp_path / "feed")

    def record(**values):
        return {k: v for k, v in values.items() if v is not None}

    def name(k):
        return "null" if k is None else k

    def place(row):
        return ((row[1] is not None, row[1] or 0.0), (row[0] is not None, (row[0] or "").encode()), row[2])

    assert got["empty"] == [] and got["none"] == {}
    assert got["list"] == [record(k=k, x=x, i=i) for k, x, i in sorted(rows, key=place)]
    want = {}
    for k, x, i in sorted(rows, key=lambda row: (row[2], row[1] is not None, row[1] or 0.0)):
        want.setdefault(name(k), []).append(record(i=i, x=x))
    assert got["groups"] == want
    best = {}
    for _, x, i in rows:
        best[i] = x if best.get(i) is None else max(best[i], x if x is not None else best[i])
    assert got["map"] == {str(i): x for i, x in best.items()} and list(got["map"]) == sorted(map(str, best))


def test_a_long_section_is_many_parts(spark, tmp_path):
    cells = spark.range(200_000).select((F.col("id") * 7919 % 200_000).alias("gy"), F.lit(0.5).alias("w"))
    got, parts = _written(spark, {"cells": sinks.records(cells, ["gy"]), "one": sinks.records(cells.limit(1), ["gy"])}, tmp_path / "feed")
    assert [c["gy"] for c in got["cells"]] == list(range(200_000)) and len(got["one"]) == 1 and parts > 1


def test_many_groups_join_without_a_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "sized", sinks.cut)
    df = spark.range(3000).select((F.col("id") % 900).cast("string").alias("k"), F.col("id"))
    got, _ = _written(spark, {"g": sinks.grouped(df, "k", ["id"], ["id"])}, tmp_path / "feed")
    assert got["g"] == {str(k): [{"id": i} for i in range(k, 3000, 900)] for k in range(900)}
