import datetime as dt
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbwise import settings as S
from kerbwise.functions.geo import distance_pairs, nearest
from kerbwise.functions.numbers import round_half_even
from kerbwise.functions.quantiles import exact_quantile, value_counts
from kerbwise.operators import anomaly, barricade, bursts, cleaning, cover, evaluate, impact, network, surface
from tests.helpers import by_id, distance, raw


def test_rounding_is_half_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,), (0.8500000000000001,)], "x double")
    assert [r[0] for r in df.select(round_half_even(F.col("x"))).collect()] == [0.0, 2.0, 2.0, -0.0, 1.0]
    assert df.select(round_half_even(F.col("x"), 1)).collect()[4][0] == np.round(0.8500000000000001, 1)


@pytest.mark.parametrize("width", [None, 10])
def test_quantiles_match_numpy(spark, width):
    rng = random.Random(3)
    rows = [(k, rng.randrange(200)) for k in "aab" for _ in range(rng.randrange(1, 60))] + [("c", 5), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v long")
    for q in (0.0, 0.5, 0.75, 0.9, 1.0):
        got = {r["k"]: r["x"] for r in exact_quantile(value_counts(df, ["k"], "v"), ["k"], "v", q, "x", width).collect()}
        want = {k: np.percentile([v for kk, v in rows if kk == k], 100 * q) for k in "abc"}
        assert got == pytest.approx(want)


def test_distance_join_equals_brute_force(spark):
    rng = random.Random(5)
    places = [(i, round(12.6 + rng.random() * 0.7, 5), round(77.3 + rng.random() * 0.6, 5)) for i in range(150)]
    df = spark.createDataFrame(places, "i int, lat double, lon double")
    got = {(r["a"], r["b"]) for r in distance_pairs(
        df.withColumnRenamed("i", "a"), df.withColumnRenamed("i", "b"), 4.0).collect()}
    want = {(a[0], b[0]) for a in places for b in places if distance(a[1:], b[1:]) <= 4.0}
    assert got == want


def incident_rows(count, seed, hours=12, spread=0.05, copies=0):
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for _ in range(count):
        when = start + dt.timedelta(seconds=rng.randrange(0, hours * 3600, 300))
        rows.append({
            "latitude": f"{12.95 + rng.randrange(50) / 50 * spread:.5f}", "longitude": f"{77.6 + rng.randrange(50) / 50 * spread:.5f}",
            "created_date": when.strftime("%Y-%m-%d %H:%M:%S+00"), "corridor": f"C{rng.randrange(3)}",
            "event_cause": rng.choice(["accident", "pot_holes", "debris", "construction"]),
            "resolved_datetime": (when + dt.timedelta(minutes=rng.randrange(10, 100))).strftime("%Y-%m-%d %H:%M:%S+00"),
        })
    return rows + [dict(rows[0]) for _ in range(copies)]


def parsed(rows):
    return [(f"E{i}", dt.datetime.strptime(r["created_date"][:19], "%Y-%m-%d %H:%M:%S").timestamp(),
             (float(r["latitude"]), float(r["longitude"])), r["corridor"], r["event_cause"]) for i, r in enumerate(rows, 1)]


def test_spillover_counts_equal_brute_force_with_many_copies(spark):
    rows = incident_rows(120, 11, copies=60)
    enriched = impact.enrich(raw(spark, rows))
    net = network.Network(enriched)
    got = {(r["src"], r["dst"]): r["count"] for r in net.pairs.collect()}
    want = {}
    for a in parsed(rows):
        for b in parsed(rows):
            gap = b[1] - a[1]
            if a[3] != b[3] and 0 <= gap <= 5400 and (gap > 0 or b[3] > a[3]) and distance(a[2], b[2]) <= 4.0:
                want[a[3], b[3]] = want.get((a[3], b[3]), 0) + 1
    assert got == want and sum(want.values()) > 1000
    edges = net.edges.collect()
    total = sum(1 for r in rows)
    for e in edges:
        base = sum(1 for r in rows if r["corridor"] == e["dst"]) / total
        out = sum(c for (s, _), c in want.items() if s == e["src"])
        assert e["lift"] == pytest.approx(e["count"] / out / base, abs=0.006)


def test_window_edge_is_inclusive(spark):
    times = ["00:00:00", "01:30:00", "01:30:01"]
    rows = [{"created_date": f"2024-01-01 {t}+00"} for t in times]
    assert by_id(bursts.burst_neighbours(cleaning.clean(raw(spark, rows))), "size") == {"E1": 2, "E2": 2, "E3": 1}


def test_burst_neighbours_equal_brute_force(spark):
    rows = incident_rows(150, 13, spread=0.03, copies=20)
    got = by_id(bursts.burst_neighbours(cleaning.clean(raw(spark, rows))), "size", "mix")
    for a in parsed(rows):
        near = [b for b in parsed(rows) if 0 <= b[1] - a[1] <= 5400 and distance(a[2], b[2]) <= 1.5]
        assert got[a[0]] == (len(near), len({b[4] for b in near}))


def test_halving_crowded_boxes_gives_the_same_counts(spark):
    rows = incident_rows(160, 19, hours=3, spread=0.02, copies=15)
    rows += incident_rows(60, 23, hours=3, spread=0.08)
    cleaned = cleaning.clean(raw(spark, rows))
    key = ["t_s", "lat", "lon", "cause"]
    plain = {tuple(r[k] for k in key): r["n"] for r in bursts.cause_neighbours(cleaned).collect()}
    for limit in (400, 20):
        halved = {tuple(r[k] for k in key): r["n"] for r in bursts.cause_neighbours(cleaned, limit).collect()}
        assert halved == plain
    pairs = {(r["src"], r["dst"]): r["count"] for r in network.spillover_pairs(cleaned).collect()}
    assert pairs == {(r["src"], r["dst"]): r["count"] for r in network.spillover_pairs(cleaned, 300).collect()}


def test_burst_rules(spark):
    def group(causes, day):
        return [{"created_date": f"2024-01-{day:02d} 06:0{i}:00+00", "event_cause": c} for i, c in enumerate(causes)]

    rows = (group(["pot_holes"] * 4 + ["debris"], 1) + group(["pot_holes", "pot_holes", "debris", "x"], 3)
            + group(["x", "x", "y", "y"], 5) + group(["x", "x", "accident", "x"], 7) + group(["accident"] * 3, 9))
    scored = bursts.burst_score(cleaning.clean(raw(spark, rows)))
    assert {r["date"].day for r in scored.collect()} == {3, 7}
    report = bursts.burst_dedup(scored).collect()
    assert [(r["size"], r["mix"]) for r in report] == [(4, 3), (4, 2)]


def grid(spark, cells):
    return spark.createDataFrame(cells, "gy int, gx int, lat double, lon double, w double")


def greedy_reference(cells, units, reach, minsep):
    left, picks = {i: c[4] for i, c in enumerate(cells)}, []
    at = [(c[2], c[3]) for c in cells]
    for _ in range(units):
        best = None
        for i in range(len(cells)):
            if i in [p for p, _ in picks] or any(distance(at[i], at[p]) < minsep for p, _ in picks):
                continue
            gain = sum(w for j, w in left.items() if distance(at[i], at[j]) <= reach)
            if best is None or gain > best[1] + 1e-9:
                best = (i, gain)
        if best is None:
            break
        picks.append(best)
        for j in left:
            if distance(at[best[0]], at[j]) <= reach:
                left[j] = 0.0
    return [(cells[i][0], cells[i][1], round(g, 1)) for i, g in picks]


@pytest.mark.parametrize("minsep", [0.0, 2.0])
def test_greedy_equals_plain_loop(spark, minsep):
    rng = random.Random(17)
    cells = sorted({(y, x) for y, x in ((rng.randrange(8), rng.randrange(8)) for _ in range(40))})
    cells = [(y, x, 12.9 + 0.012 * y, 77.5 + 0.012 * x, float(rng.choice([0, 0.1, 5, 5, 12.5]))) for y, x in cells]
    picks = cover.greedy_cover(grid(spark, cells), [], 6, 2.5, minsep).orderBy("k").collect()
    assert [(p["gy"], p["gx"], round(p["covers"], 1)) for p in picks] == greedy_reference(cells, 6, 2.5, minsep)
    fewer = cover.greedy_cover(grid(spark, cells), [], 3, 2.5, minsep).orderBy("k").collect()
    assert [(p["gy"], p["gx"]) for p in fewer] == [(p["gy"], p["gx"]) for p in picks[:3]]
    if minsep == 0.0:
        assert all(a["covers"] >= b["covers"] for a, b in zip(picks, picks[1:]))


def test_greedy_stops_when_nothing_is_left(spark):
    cells = [(0, 0, 12.9, 77.5, 1.0), (0, 1, 12.9, 77.51, 0.0)]
    picks = cover.greedy_cover(grid(spark, cells), [], 4, 2.5, 0.0).orderBy("k").collect()
    assert [(p["gx"], p["covers"]) for p in picks] == [(0, 1.0), (1, 0.0)]


def test_event_bump_uses_nearest_cell_when_none_is_close(spark):
    cells = grid(spark, [(0, 0, 12.90, 77.50, 1.0), (0, 1, 12.90, 77.51, 1.0), (9, 9, 13.2, 77.8, 1.0)])
    events = spark.createDataFrame([("in", 12.90, 77.505, 5.0), ("far", 13.25, 77.85, 7.0)],
                                   "scenario string, lat double, lon double, bump double")
    got = sorted(tuple(r) for r in cover.event_bump(cells, events).collect())
    assert got == [("far", 9, 9, 7.0), ("in", 0, 0, 5.0), ("in", 0, 1, 5.0)]


def test_approach_points(spark):
    ends = [(None, None), ("0", "0"), ("12.95", "77.6"), ("12.95004", "77.60004"), ("12.96", "77.6"), ("12.96", None)]
    rows = [{"requires_road_closure": "TRUE", "endlatitude": a, "endlongitude": b,
             "resolved_datetime": "2024-01-01 07:00:00+00"} for a, b in ends]
    got = barricade.approach_points(impact.enrich(raw(spark, rows))).groupBy("id").count().collect()
    assert {r["id"]: r["count"] for r in got} == {"E1": 1, "E2": 1, "E3": 1, "E4": 1, "E5": 2, "E6": 1}


def test_single_day_weekday_has_no_score_and_sorts_last(spark):
    rows = [{"created_date": f"2024-01-{d:02d} 06:00:00+00", "resolved_datetime": f"2024-01-{d:02d} 07:00:00+00"}
            for d in (1, 1, 8, 15, 15, 15, 2)]
    got = anomaly.abnormal_days(impact.enrich(raw(spark, rows))).collect()
    assert got[-1]["date"] == dt.date(2024, 1, 2) and got[-1]["z"] is None
    loads = [r["impact"] for r in got if r["dow"] == 0]
    top = max(loads)
    assert got[0]["z"] == pytest.approx((top - statistics.mean(loads)) / statistics.stdev(loads), abs=0.006)


def test_capture_counts_top_fifth(spark):
    rows = [(0, i, dt.date(2024, 1, 1), float(10 - i), 1.0 if i < 5 else 0.0) for i in range(10)]
    rows += [(0, i, dt.date(2024, 1, 2), 1.0, 0.0) for i in range(10)]
    df = spark.createDataFrame(rows, "gy int, gx int, date date, score double, y double")
    assert [(r["date"].day, r["capture"]) for r in evaluate.capture_by_date(df).collect()] == [(1, 0.4)]


def test_reach_without_plan_is_false(spark):
    enriched = impact.enrich(raw(spark, [{"resolved_datetime": "2024-01-01 07:00:00+00"},
                                         {"created_date": "2024-01-02 06:00:00+00"}]))
    plan = spark.createDataFrame([(0, 12.95, 77.6)], "dow int, lat double, lon double")
    assert by_id(evaluate.reach(enriched, plan), "reached") == {"E1": True, "E2": False}


def test_panel_features_ignore_later_days(spark):
    days = [(dt.date(2024, 1, 1) + dt.timedelta(days=d)).isoformat() for d in range(60)]

    def panel(last_factor):
        rows = [{"created_date": f"{d} 06:00:00+00", "resolved_datetime": f"{d} 07:00:00+00",
                 "description": "jam" if i >= 55 and last_factor else None} for i, d in enumerate(days)]
        return surface.cell_date_panel(surface.cell_days(impact.enrich(raw(spark, rows))))

    features = ["lat", "lon", "hist_n", "hist_impact"]
    plain, changed = (p.select(*features).distinct().collect() for p in (panel(False), panel(True)))
    assert plain == changed and plain[0]["hist_n"] == 60 - S.HOLDOUT_DAYS


def test_nearest_equals_brute_force_around_the_globe(spark):
    r = random.Random(8)
    spots = [(r.uniform(-90, 90), r.uniform(-180, 180)) for _ in range(60)]
    spots += [(12.9 + r.uniform(-0.2, 0.2), 77.5 + r.uniform(-0.2, 0.2)) for _ in range(150)]
    spots += [(0.0, 179.99), (0.0, -179.9), (89.9, 10.0), (-89.9, -120.0), (90.0, 0.0)]
    spots += [(10.0, 20.0), (10.0, 20.2), (None, 3.0)]
    asked = [(f"p{i}", r.uniform(-90, 90), r.uniform(-180, 180)) for i in range(80)]
    asked += [("east", 0.0, -179.98), ("pole", 89.95, -170.0), ("tie", 10.0, 20.1), ("none", None, 1.0), ("in", 12.9, 77.5)]
    places = spark.createDataFrame([(i, *p) for i, p in enumerate(spots)], "j long, lat double, lon double")
    points = spark.createDataFrame(asked, "name string, lat double, lon double")
    got = {x["name"]: (x["j"], x["km"]) for x in nearest(points, places, ["name"]).collect()}
    full = [(i, *p) for i, p in enumerate(spots) if p[0] is not None]
    for name, lat, lon in asked:
        if lat is None:
            assert name not in got
            continue
        best = min((distance((lat, lon), p[1:]), p[1], p[2], p[0]) for p in full)
        assert got[name][1] == pytest.approx(best[0], abs=1e-6)
        if name in ("east", "pole", "in"):
            assert got[name][0] == best[3]
    assert nearest(points, places.limit(0), ["name"]).count() == 0


@pytest.mark.parametrize("centre", [(0.0, 180.0), (-17.0, 179.95), (89.95, 30.0), (-89.97, -60.0), (89.8, 179.0)])
def test_distance_pairs_cross_the_meridian_and_the_poles(spark, centre):
    r = random.Random(int(centre[0] * 7))
    spread = 180.0 if abs(centre[0]) > 89 else 0.2
    points = []
    for i in range(120):
        lon = (centre[1] + r.uniform(-spread, spread) + 180.0) % 360.0 - 180.0
        points.append((i, max(-90.0, min(90.0, centre[0] + r.uniform(-0.2, 0.2))), lon))
    left = spark.createDataFrame(points, "a long, lat double, lon double")
    found = distance_pairs(left, left.withColumnRenamed("a", "b"), 8.0).select("a", "b").collect()
    want = {(p[0], q[0]) for p in points for q in points if distance(p[1:], q[1:]) <= 8.0}
    assert len(found) == len(want) and {tuple(x) for x in found} == want
