"""Decontamination: guarantees of the Hamming index, brute force over windows, odd rows."""

import random
from collections import Counter

import numpy as np

from kerbwise.llm import decontaminate as D
from tests.llm import cases


def test_index_finds_every_fingerprint_within_the_radius():
    r = np.random.default_rng(4)
    prints = r.integers(0, 2**64, 300, dtype=np.uint64)
    queries = prints[r.integers(0, 300, 200)].copy()
    for i in range(200):  # flip up to 30 bits
        for b in r.choice(64, r.integers(0, 31), replace=False):
            queries[i] ^= np.uint64(1) << np.uint64(b)
    for radius in (0, 3, 16, 24):
        q, p, d = D.HammingIndex(prints, radius).search(queries)
        distance = np.bitwise_count(queries[:, None] ^ prints[None, :])
        assert set(zip(q.tolist(), p.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(distance <= radius))))
        assert (distance[q, p] == d).all()


def _similarity(a, b, k):
    x, y = (Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) for w in (a, b))
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def _brute(docs, items):
    found = set()
    for key, text in docs:
        w = (text or "").lower().split()
        for item, passage in items:
            n = (passage or "").lower().split()
            k = min(5, len(n))
            if n and len(w) >= k and any(_similarity(w[s : s + len(n)], n, k) >= 0.8 for s in range(max(1, len(w) - len(n) + 1))):
                found.add((key, item))
    return found


def test_contaminated_equals_brute_force(spark):
    r = random.Random(6)
    items = [(i, " ".join(f"i{i}w{r.randrange(60)}" for _ in range(r.randrange(1, 60)))) for i in range(25)] + [(90, None), (91, ""), (92, "Le Chat É")]
    docs = []
    for i in range(150):
        w = [f"d{r.randrange(99)}" for _ in range(r.randrange(0, 80))]
        if i % 2:
            p = r.choice(items[:25])[1].split()
            for _ in range(r.randrange(0, 4)):  # changed, dropped and added words
                at = r.randrange(len(p))
                p = p[:at] + r.choice([[], ["x"], [p[at], "y"]]) + p[at + 1 :] or ["z"]
            w[10:10] = p
        docs.append((i, " ".join(w).upper() if i % 7 == 0 else " ".join(w)))
    docs += [(200, "oui LE CHAT é non"), (201, " ".join(items[0][1].split()[:-1]))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = D.contaminated(df, spark.createDataFrame(items, "item_id long, text string"))
    rows = got.collect()
    assert {(x.doc_id, x.item_id) for x in rows} == _brute(docs, items)
    assert len(rows) == len({(x.doc_id, x.item_id) for x in rows}) and all(x.similarity >= 0.8 and x.distance <= D.RADIUS for x in rows)


def test_contaminated_on_odd_rows(spark):
    items = spark.createDataFrame([(1, cases.PASSAGE, "x"), (None, "one two three four five", "x"), (3, None, "x")], "item_id long, text string, similarity string")
    rows = D.contaminated(cases.odd(spark), items).collect()
    assert sorted({(x.doc_id, x.item_id) for x in rows if x.item_id}) == [(11, 1), (12, 1), (13, 1)]
    assert {x.doc_id for x in rows if x.item_id is None} == {6, 7, 8} and len(rows) == 8  # repeated rows are reported each
    assert D.contaminated(cases.empty(spark), items).count() == 0
    assert D.contaminated(cases.odd(spark), items.limit(0)).count() == 0
