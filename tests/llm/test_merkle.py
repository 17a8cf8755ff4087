"""Merkle manifest against trees built in plain Python, at several sizes, with both ways of climbing."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from kerbwise.llm import merkle
from kerbwise.llm.queries import QUERIES
from tests.llm import cases

SF = "/root/testdata/sf0.001"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(hashes):
    """Top, and for each leaf its siblings, level by level, as (before, after)."""
    now = [(x, [i]) for i, x in enumerate(hashes)]
    met = [[] for _ in hashes]
    while len(now) > 1:
        above = []
        for i in range(0, len(now), 3):
            run = now[i : i + 3]
            for j, (_, leaves) in enumerate(run):
                for leaf in leaves:
                    met[leaf].append(([x for x, _ in run[:j]], [x for x, _ in run[j + 1 :]]))
            above.append((h(*[x for x, _ in run]), [leaf for _, leaves in run for leaf in leaves]))
        now = above
    return now[0][0], met


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text) -> sorted results."""
    by_source = defaultdict(list)
    for row in rows:
        by_source[row[1]].append(row)
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by_source[s].sort(key=lambda r: (r[0] is None, r[0], h(*map(field, r))))
        trees[s] = tree([h(*map(field, r)) for r in by_source[s]])
    root, upper = tree([trees[s][0] for s in sources])
    out = []
    for place, s in enumerate(sources):
        for row, met in zip(by_source[s], trees[s][1]):
            leaf = after = h(*map(field, row))
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None:
                after = h(*map(field, (*row[:4], row[4].replace("\n", ""))))
            proof = ""
            for before, behind in met + upper[place]:
                after = h(*before, after, *behind)
                proof += "".join(before + behind)
            out.append((row[0], leaf, trees[s][0], root, h(proof), after, after == root))
    return sorted(out, key=lambda r: (r[0] is None, r[0], r[1:]))


def results(frame):
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in frame.select(*names).collect()), key=lambda r: (r[0] is None, r[0], r[1:]))


def run(docs):
    return results(merkle.manifest(docs, tampered=merkle.without_line_feeds()))


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = results(QUERIES["op12_merkle"](spark, SF))
    assert got == brute(rows) and {True, False} == {r[-1] for r in got}


@pytest.mark.parametrize("sizes", [[1], [4], [9, 1, 28, 3]])
def test_shapes(spark, sizes):
    rows, n = [], 0
    for i, size in enumerate(sizes):
        for _ in range(size):
            rows.append((n, f"s{i}" if i else None, "en" if n % 2 else None, n if n % 3 else None, f"line {n}\nnext" if n % 4 else None))
            n += 1
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert run(docs) == brute(rows)


def test_odd_rows(spark):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in cases.odd(spark).collect()]
    got = run(cases.odd(spark))
    assert got == brute(rows)
    assert run(cases.empty(spark)) == []


def test_climbing_by_shuffles_gives_the_same(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    leaves, nodes, _ = merkle.build(docs, tampered=merkle.without_line_feeds())
    wide = sorted(map(tuple, merkle.prove(leaves, nodes).collect()))
    for limit in (0, 30):
        assert sorted(map(tuple, merkle.prove(leaves, nodes, limit).collect())) == wide
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") != "-1"


def test_upper_levels_take_few_tasks(spark):
    """Levels that all leaves share are neither built nor climbed with the tasks of the whole table."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    many = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in many}
    context, tracker = spark.sparkContext, spark.sparkContext.statusTracker()
    for k, v in many.items():
        spark.conf.set(k, v)
    context.setJobGroup("merkle", "tasks are counted")
    try:
        merkle.manifest(docs, tampered=merkle.without_line_feeds()).write.format("noop").mode("overwrite").save()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    stages = {s for j in tracker.getJobIdsForGroup("merkle") for s in tracker.getJobInfo(j).stageIds}
    ran = sum(found.numCompletedTasks for s in stages if (found := tracker.getStageInfo(s)))
    assert 0 < ran < 2500  # 1,771; 3,457 when every leaf climbed all levels
