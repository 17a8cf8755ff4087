"""The alarm on the circle compares boxes instead of joining rows; the network follows from one read of the log."""

import random

import pytest

from kerbwise.functions.geo import reach_boxes
from kerbwise.operators import network
from kerbwise.operators.impact import enrich
from kerbwise.streaming import live

from .helpers import distance, raw


@pytest.mark.parametrize("place", [(12.95, 77.6), (10.0, 179.995), (-89.98, 0.0), (89.7, -179.99), (0.0, 0.0)])
def test_every_place_is_offered_to_the_boxes_within_reach(spark, place):
    rng = random.Random(4)
    rows = [(i, max(-90.0, min(90.0, place[0] + rng.uniform(-0.06, 0.06))), (place[1] + rng.uniform(-0.06, 0.06) + 180) % 360 - 180) for i in range(60)]
    found = reach_boxes(spark.createDataFrame(rows, "i int, lat double, lon double"), 1.5, 2).collect()
    offered = {(r["i"], r["_by"], r["_bx"]) for r in found}
    own = {r["i"]: (r["_by"], r["_bx"]) for r in found if r["_own"]}
    assert len(own) == 60 == sum(r["_own"] for r in found) and len(offered) == len(found)
    for i, *a in rows:
        for j, *b in rows:
            assert distance(a, b) > 1.5 or (j, *own[i]) in offered


def test_circle_alarm_joins_no_rows(spark):
    schema = "id string, t_event timestamp, lat double, lon double, cause string"
    plan = live.circle_bursts(spark.createDataFrame([], schema))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_network_follows_from_one_count_of_the_log(spark):
    rng = random.Random(3)
    rows = [{"created_date": rng.choice([None, f"2024-01-0{rng.randrange(1, 4)} 0{rng.randrange(9)}:00:00+00"]), "start_datetime": None,
             "event_type": rng.choice(["planned", "unplanned"]), "corridor": rng.choice(["A Road", "B Road", "C Road", None]),
             "latitude": str(12.95 + rng.uniform(0, 0.03)), "longitude": str(77.6 + rng.uniform(0, 0.03))} for _ in range(200)]
    enriched = enrich(raw(spark, rows + rows[:30]))
    got = network.Network(enriched)
    nodes = network.corridor_nodes(enriched)
    assert sorted(map(tuple, got.nodes.collect())) == sorted(map(tuple, nodes.collect())) and got.nodes.count() == 3
    pairs = network.spillover_pairs(network.node_incidents(enriched, nodes))
    assert sorted(map(tuple, got.pairs.collect())) == sorted(map(tuple, pairs.collect()))
