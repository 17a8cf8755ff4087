"""Mixing and sharding against brute force, and on odd rows."""

import random
import zlib
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from kerbwise.llm import mixing, sharding
from tests.llm import cases


def _targets(sizes, weights, share, repeats):
    """Fixed point of giving by weight and reshaping what is above the stop, step by step."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, stopped = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in stopped]
        left = budget - sum(stopped.values())
        total = sum(weight[s] for s in free)
        got = {s: left * weight[s] / total for s in free}
        above = {s: repeats * sizes[s] for s in free if got[s] > repeats * sizes[s]}
        if not above:
            return stopped | got
        stopped |= {s: float(v) for s, v in above.items()}


def _mix_input(spark):
    r = random.Random(2)
    docs = []
    for i in range(900):
        source = "big" if i % 3 == 0 else r.choice(["a", "b", "c", None, "d", "e"])
        docs.append((i, "w " * (r.randrange(0, 40) if r.random() < 0.97 else 900), source))
    return docs, spark.createDataFrame(docs, "doc_id long, text string, source string")


def test_mix_meets_its_targets(spark):
    docs, df = _mix_input(spark)
    got = mixing.mix(df).collect()
    by_id = {r.doc_id: r for r in got}
    sizes, taken = {}, {}
    for i, text, source in docs:
        assert by_id[i].size == len(text.split())
        sizes[source] = sizes.get(source, 0) + by_id[i].size
        taken[source] = taken.get(source, 0) + by_id[i].taken
        assert by_id[i].taken in (0, by_id[i].size, 2 * by_id[i].size)
    want = _targets(sizes, mixing.WEIGHTS, mixing.SHARE, mixing.REPEATS)
    for i, _, source in docs:
        assert by_id[i].source_size == sizes[source] and by_id[i].target == pytest.approx(want[source])
    for source, target in want.items():
        assert taken[source] <= target + 1e-6 and taken[source] >= target * 0.97
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_mix_is_first_fit_in_order_of_place(spark):
    """The intervals take what a sequential scan in order of place would take, up to the tolerance."""
    docs, df = _mix_input(spark)
    placed = {r.doc_id: r.p for r in df.select("doc_id", mixing.place(F.col("doc_id"), F.col("text")).alias("p")).collect()}
    got = {r.doc_id: r for r in mixing.mix(df, tolerance=0.0).collect()}
    for source in {s for _, _, s in docs}:
        own = sorted((d for d in docs if d[2] == source), key=lambda d: placed[d[0]])
        total, target = got[own[0][0]].source_size, got[own[0][0]].target
        rounds = int(target // total)
        left = target - rounds * total
        for i, text, _ in own:
            size = len(text.split())
            fits = 0 < size <= left
            left -= size if fits else 0
            assert got[i].copies == ((rounds + fits) if size else 0)


def test_smaller_budgets_take_a_prefix(spark):
    _, df = _mix_input(spark)
    half, full = (mixing.mix(df.filter("source = 'a'"), share=s, tolerance=1.0 if s else 0).filter("copies > 0") for s in (0.3, 0.6))
    assert half.join(full, "doc_id", "left_anti").count() == 0


def test_mix_on_odd_rows(spark):
    got = mixing.mix(cases.odd(spark)).collect()
    assert len(got) == len(cases.rows())
    assert all(r.taken == 0 for r in got if r.size == 0)
    assert len({(r.size, r.taken) for r in got if r.doc_id == 6}) == 1  # repeated rows together
    assert mixing.mix(cases.empty(spark)).count() == 0


def _best(sizes, shards):
    """Smallest largest part over all contiguous partitions."""
    best = sum(sizes)
    for n in range(min(shards, len(sizes))):
        for cut in combinations(range(1, len(sizes)), n):
            edges = [0, *cut, len(sizes)]
            best = min(best, max(sum(sizes[a:b]) for a, b in zip(edges, edges[1:])))
    return best


@pytest.mark.parametrize("seed", range(4))
def test_cuts_are_minimax(spark, seed, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCKS", 4)
    monkeypatch.setattr(sharding, "FINER_BITS", 1)
    r = random.Random(seed)
    sizes = [r.randrange(1, 60) for _ in range(14)]
    starts = [sum(sizes[:i]) for i in range(len(sizes))]
    groups = spark.createDataFrame(list(zip(starts, sizes)), "start long, bytes long")
    for shards in (1, 3, 5):
        found = sharding.minimax_cuts(groups, sum(sizes), shards)
        edges = [0, *found, sum(sizes)]
        assert set(found) <= set(starts) and len(found) < shards
        assert max(b - a for a, b in zip(edges, edges[1:])) == _best(sizes, shards)


@pytest.mark.parametrize("seed", range(6))
def test_cuts_are_spread_within_the_capacity(seed):
    r = random.Random(seed)
    n = r.randrange(5, 12)
    sizes = [r.randrange(1, 30) for _ in range(n)]
    edges, total = [sum(sizes[:i]) for i in range(n)], sum(sizes)
    for shards in (1, 2, 4, 7, 15):
        capacity = sharding.smallest(edges, total, shards)
        found = sharding.spread(edges, total, capacity, shards)
        parts = [b - a for a, b in zip([0, *found], [*found, total])]
        assert len(parts) == min(shards, n) and max(parts) <= capacity and set(found) <= set(edges)
        best = 0
        for cut in combinations(edges[1:], min(shards, n) - 1):
            other = [b - a for a, b in zip([0, *cut], [*cut, total])]
            best = max(best, min(other)) if max(other) <= capacity else best
        assert min(parts) == best > 0


@pytest.mark.parametrize("groups", [16, 20, 50, 200])
def test_few_groups_leave_no_shard_empty(spark, groups):
    df = spark.createDataFrame([(i, f"text {i:08d}") for i in range(groups)], "doc_id long, text string")
    sizes = _check(sharding.shard(df).collect(), 16)
    per = 14
    assert min(sizes) == groups // 16 * per and max(sizes) == -(-groups // 16) * per


def _check(rows, shards):
    groups, slots, sizes = {}, {}, [0] * shards
    for r in rows:
        groups.setdefault(r.text_crc32, set()).add(r.shard)
        slots.setdefault(r.shard, []).append(r.slot)
        sizes[r.shard] += r["size"]
        assert r.law == "bytes" and r.grown_shard is None
    assert all(len(s) == 1 for s in groups.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sizes


def test_shards_are_even_and_keep_groups_together(spark):
    texts = [f"text {i % 700} " * (1 + i % 17) for i in range(2000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows = sharding.shard(df).collect()
    sizes = _check(rows, 16)
    assert sum(sizes) == sum(len(t) + 1 for t in texts) and max(sizes) < 1.05 * min(sizes)
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)


def test_a_group_of_a_third_gets_a_shard_of_its_own(spark):
    texts = ["hot " * 5 if i % 3 == 0 else f"text {i} " * 3 for i in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sharding.shard(df).collect()
    sizes = _check(rows, 16)
    assert {r.doc_id % 3 for r in rows if r.shard == 0} == {0} and max(sizes[1:]) < 1.1 * min(sizes[1:])


def test_shards_on_odd_rows(spark):
    odd = cases.odd(spark)
    rows = sharding.shard(odd, 4, keep=True).collect()
    assert len(rows) == len(cases.rows())
    _check(rows, 4)
    assert {r.text_crc32 for r in rows if r.text is None} == {0} and {r["size"] for r in rows if not r.text} == {1}
    assert set(rows[0].asDict()) == set(odd.columns) | {"size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    assert sharding.shard(cases.empty(spark)).count() == 0 and sharding.shard(cases.empty(spark), keep=True).count() == 0
