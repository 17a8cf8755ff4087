import datetime as dt
import random

import pytest

from kerbwise import settings as S
from kerbwise.functions.geo import distance_pairs
from kerbwise.operators import bursts, cleaning, impact
from kerbwise.streaming import live, refit

from .helpers import by_id, distance, raw

SCHEMA = "id string, t_event timestamp, lat double, lon double, cause string"
START = dt.datetime(2024, 1, 1, 6)


def crowd(lat, lon, n, seed):
    """Incidents of some hours around a point; several copies, several of one second."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        when = START + dt.timedelta(seconds=rng.randrange(0, 5 * 3600, 60), microseconds=rng.choice([0, 400_000]))
        east = (lon + rng.uniform(-0.02, 0.02) + 180) % 360 - 180
        rows.append((f"{seed}-{i}", when, lat + rng.uniform(-0.02, 0.02), east, rng.choice(["accident", "debris", "tree_fall"])))
    return rows + rows[:5]


def expected(rows, until):
    """(second, place) -> (size, mix) by trying every pair."""
    seconds = [(r[1].replace(microsecond=0), r[2], r[3], r[4]) for r in rows]
    out = {}
    for t, lat, lon, _ in set(seconds):
        end = t + dt.timedelta(seconds=S.PAIR_WINDOW_SEC)
        causes = [c for s, y, x, c in seconds if t <= s <= end and distance((lat, lon), (y, x)) <= S.BURST_KM]
        most = max(causes.count(c) for c in causes)
        leading = min(c for c in causes if causes.count(c) == most)
        survey = most / len(causes) > 0.7 and leading in S.PASSIVE_CAUSES
        kind = set(causes) & set(S.LIVE_CAUSES) or len(set(causes)) >= 3
        if len(causes) >= S.BURST_MIN_SIZE and not survey and kind and end <= until:
            out[(t, lat, lon)] = (len(causes), len(set(causes)))
    return out


def found(df):
    rows = df.collect()
    got = {(dt.datetime.fromtimestamp(r["t_s"], dt.UTC).replace(tzinfo=None), r["lat"], r["lon"]): (r["size"], r["mix"]) for r in rows}
    assert len(got) == len(rows)
    return got


PLACES = [(12.95, 77.6), (10.0, 179.995), (-89.99, 0.0)]


@pytest.mark.parametrize("place", PLACES)
def test_circle_alarm_equals_trying_every_pair(spark, place):
    rows = crowd(*place, 120, 7)
    got = found(live.circle_bursts(spark.createDataFrame(rows, SCHEMA)))
    want = expected(rows, dt.datetime.max)
    assert want and got == want


def test_streamed_circle_alarm_over_several_batches(spark, tmp_path):
    rows = sorted(crowd(12.95, 77.6, 150, 3), key=lambda r: r[1])
    quiet = [("last", START + dt.timedelta(hours=9), 12.95, 77.6, "debris")]
    empty = [("none", None, 12.95, 77.6, "debris"), ("nowhere", START, None, None, "debris")]
    for n, part in enumerate([rows[:40], rows[40:90] + empty, rows[90:], quiet]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{n}"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in" / "*"))
        got = live.run_available(live.circle_bursts(stream), str(tmp_path / "out"), str(tmp_path / "progress"))
    want = expected(rows, dt.datetime.max)
    assert want and found(got) == want
    assert live.circle_bursts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_circle_alarm_counts_what_the_batch_query_counts(spark):
    rng = random.Random(5)
    rows = [{"created_date": f"2024-01-01 0{rng.randrange(5, 9)}:{rng.randrange(60):02d}:00+00", "event_cause": rng.choice(["accident", "debris"]),
             "latitude": str(12.95 + rng.uniform(0, 0.03)), "longitude": str(77.6 + rng.uniform(0, 0.03))} for _ in range(120)]
    cleaned = cleaning.clean(raw(spark, rows))
    columns = ["t_s", "lat", "lon", "size", "mix", "dom_cause", "dom_share"]
    batch = {tuple(r) for r in bursts.burst_score(cleaned).select(*columns).collect()}
    assert batch and batch == {tuple(r) for r in live.circle_bursts(cleaned).select(*columns).collect()}


def test_distance_join_agrees_in_further_columns(spark):
    left = spark.createDataFrame([(1, 1, 10.0, 179.999), (2, 2, 10.0, 179.999)], "a int, k int, lat double, lon double")
    right = spark.createDataFrame([(7, 1, 10.0, -179.999), (8, 3, 10.0, -179.999)], "b int, k int, lat double, lon double")
    assert [(r["a"], r["b"]) for r in distance_pairs(left, right, 1.0, on=("k",)).collect()] == [(1, 7)]


def incidents():
    rng = random.Random(11)
    rows = []
    for i in range(60):
        start = dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)
        end = start + dt.timedelta(minutes=rng.randrange(5, 300))
        rows.append({"created_date": f"{start}+00", "resolved_datetime": f"{end}+00" if i % 5 else None, "priority": rng.choice(["High", "Low"]),
                     "event_cause": rng.choice(["accident", "debris"]), "corridor": rng.choice(["A Road", "B Road", None])})
    return rows


def tables(lookups):
    return [sorted(map(str, df.collect())) for df in lookups]


@pytest.mark.parametrize("cuts", [(), (1,), (10, 11, 45)])
def test_maintained_lookups_equal_the_batch_ones_for_any_split(spark, tmp_path, cuts):
    whole = raw(spark, incidents())
    rows, edges = whole.collect(), [0, *cuts, 60]
    store = refit.LookupStore(spark, str(tmp_path / "counts"))
    for epoch, (a, b) in enumerate(zip(edges, edges[1:])):
        part = cleaning.clean(spark.createDataFrame(rows[a:b], whole.schema))
        store.update(part, epoch)
        store.update(part, epoch)  # the batch runs again after a failure
    assert tables(store.lookups()) == tables(impact.lookups(cleaning.clean(whole)))
    first = cleaning.clean(spark.createDataFrame(rows[: edges[1]], whole.schema))
    assert tables(store.lookups(0)) == tables(impact.lookups(first))


def test_scored_stream_uses_the_lookups_of_its_batch(spark, tmp_path):
    whole = raw(spark, incidents())
    rows = whole.collect()
    store = refit.LookupStore(spark, str(tmp_path / "counts"))
    for n, part in enumerate([rows[:25], rows[25:]]):
        spark.createDataFrame(part, whole.schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{n}"))
        stream = spark.readStream.schema(whole.schema).parquet(str(tmp_path / "in" / "*"))
        got = refit.refit_enrich(stream, store, str(tmp_path / "out"), str(tmp_path / "progress"))
    early, late = (by_id(got.filter(f"epoch = {e}"), "impact_min") for e in (0, 1))
    assert early == by_id(impact.enrich(spark.createDataFrame(rows[:25], whole.schema)), "impact_min")
    everything = by_id(impact.enrich(whole), "impact_min")
    assert len(late) == 35 and late == {i: everything[i] for i in late}
