import random

import numpy as np
import pytest

from kerbwise.operators import bursts, cleaning, neighbours
from kerbwise.operators.network import spillover_pairs

from .helpers import distance, raw


def crowd(spark, n=60):
    rng = random.Random(3)
    rows = [{"created_date": f"2024-01-0{rng.randrange(1, 4)} {rng.randrange(24):02d}:{rng.randrange(0, 60, 20):02d}:00+00",
             "event_cause": rng.choice(["accident", "debris"]), "corridor": rng.choice(["A Road", "B Road", "C Road"]),
             "latitude": str(12.95 + rng.uniform(0, 0.03)), "longitude": str(77.6 + rng.uniform(0, 0.03))} for _ in range(n)]
    return cleaning.clean(raw(spark, rows))


@pytest.mark.parametrize("query", [bursts.burst_neighbours, bursts.burst_score, spillover_pairs])
def test_neighbours_are_never_broadcast_by_a_guess(spark, query):
    found = query(crowd(spark))
    found.collect()
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("blocks", [(128, 16_384), (7, 5)])
def test_sums_of_a_box_equal_trying_every_pair(monkeypatch, blocks):
    monkeypatch.setattr(neighbours, "ANCHOR_BLOCK", blocks[0])
    monkeypatch.setattr(neighbours, "POINT_BLOCK", blocks[1])
    rng = np.random.default_rng(5)
    t, lat, lon = np.sort(rng.integers(0, 9000, 150)), 12.95 + rng.random(150) * 0.04, 77.6 + rng.random(150) * 0.04
    codes, weights = rng.integers(0, 3, 150), rng.integers(1, 4, 150)
    first, last = np.searchsorted(t, t, "left"), np.searchsorted(t, t + 5400, "right")
    # a radius that is the exact distance of one pair
    km = float(neighbours._distances((t, lat, lon), np.array([0]), (t, lat, lon), np.array([9]))[0])
    assert distance((lat[0], lon[0]), (lat[9], lon[9])) == pytest.approx(km)
    got = np.concatenate([s for _, s in neighbours._near_sums((t, lat, lon), (t, lat, lon), first, last, codes, weights, 3, km)])
    want = np.zeros((150, 3), int)
    for i in range(150):
        for j in range(first[i], last[i]):
            if neighbours._distances((t, lat, lon), np.array([i]), (t, lat, lon), np.array([j]))[0] <= km:
                want[i, codes[j]] += weights[j]
    assert want[0, codes[9]] and (got == want).all()


def test_boxes_with_too_many_rows_are_halved_with_the_same_counts(spark, monkeypatch):
    df = crowd(spark)
    results = []
    for rows in (neighbours.ROW_LIMIT, 3):
        monkeypatch.setattr(neighbours, "ROW_LIMIT", rows)
        results.append([sorted(map(tuple, f(df).collect())) for f in (bursts.burst_neighbours, spillover_pairs)])
    assert results[0] == results[1] and all(results[0])
