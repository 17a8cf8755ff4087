"""What the driver holds: freed memory goes back, and lookup tables of the benchmark are made where they are searched."""

import pickle
import re
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from kerbwise.llm import decontaminate, jaccard_join, lang_id, store


def _resident(spark):
    """MB of the driver's JVM."""
    pid = spark._jvm.java.lang.ProcessHandle.current().pid()
    return int(re.search(r"VmRSS:\s+(\d+)", Path(f"/proc/{pid}/status").read_text())[1]) / 1024


def _free_native_memory(spark, number=400):
    """Let the driver's JVM free some 100 MB that its C library keeps; returns the last block, which stays in use above them."""
    jvm = spark._jvm
    data = spark.sparkContext._gateway.new_array(jvm.byte, 300_000)
    held = [jvm.java.util.zip.Deflater() for _ in range(number)]
    for d in held:
        d.setInput(data)
        d.finish()
        d.deflate(data)
    for d in held[:-1]:
        d.end()
    return held[-1]


def test_native_memory_of_the_driver_is_returned(spark):
    if "systemTrimNativeHeap" not in _operations(spark):
        pytest.skip("this JVM cannot return native memory")
    store.give_back_driver(spark)
    last = _free_native_memory(spark)
    before = _resident(spark)
    store.give_back_driver(spark)
    assert _resident(spark) < before - 50
    last.end()


def test_writing_a_table_returns_memory_after_it(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(store, "give_back_driver", seen.append)
    assert store.stored(spark.range(10)).count() == 10
    assert seen == [spark]


def _operations(spark):
    """Names of the JVM's diagnostic operations."""
    jvm = spark._jvm
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "getMBeanInfo")
    given = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 1)
    given[0] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    return [o.getName() for o in call.invoke(server, given).getOperations()]


def test_language_returns_memory_after_training(spark, monkeypatch):
    docs = store.stored(spark.createDataFrame([(i, "one two three", "en", "web", 13) for i in range(5)], "doc_id long, text string, lang string, source string, n_chars long"))
    order = []
    train, identify = lang_id.train, lang_id.identify
    monkeypatch.setattr(lang_id, "train", lambda *a, **b: order.append("train") or train(*a, **b))
    monkeypatch.setattr(corpus_pipeline, "give_back_driver", lambda s: order.append("give back"))
    monkeypatch.setattr(lang_id, "identify", lambda *a, **b: order.append("identify") or identify(*a, **b))
    corpus_pipeline.language(spark, docs, "")
    assert order == ["train", "give back", "identify"]


def test_items_ship_without_their_tables():
    texts = [" ".join(f"w{i}x{j}" for j in range(5 + i)) for i in range(40)]
    items = decontaminate.Items(list(range(40)), texts)
    assert len(pickle.dumps(items)) < 400_000  # with the tables of 40 lengths: above 3 MB
    sent = pickle.loads(pickle.dumps(items))
    own = next(decontaminate.folded(pa.array([texts[7]]))).hashes
    assert [m[0] for m in sent.matches(own, 0.8)] == [7]


def test_scaling_where_used_trains_the_same_weights():
    random = np.random.default_rng(3)
    rows = [(np.sort(random.choice(60, 9, replace=False)).astype(np.int32), random.random(9).astype(np.float32)) for _ in range(40)]
    labels, idf = random.integers(0, 3, 40), random.random(60) + 1
    before = lang_id.follow_the_leader([(f, t * idf[f] * lang_id.SCALE) for f, t in rows], labels, 3, 60)
    assert np.array_equal(lang_id.follow_the_leader(rows, labels, 3, 60, idf), before)


def test_shared_tokens_are_found_range_by_range():
    random = np.random.default_rng(5)
    pool = random.integers(-(2**63), 2**63 - 1, 300)
    rows = [random.choice(pool, n, replace=False).tolist() for n in (0, 40, 7, 0, 90, 120, 1, 0)]
    lists = pa.chunked_array([pa.array(rows[:3], pa.list_(pa.int64())), pa.array(rows[3:], pa.list_(pa.int64()))])
    expected = np.array([[len(set(a) & set(b)) for b in rows] for a in rows])
    for most in (1, 16, 1000):
        common = np.zeros((len(rows), len(rows)), int)
        for token, owner in jaccard_join._shared_tokens(lists, most):
            held = np.zeros((len(rows), token.max(initial=-1) + 1), int)
            held[owner, token] = 1
            common += held @ held.T
        np.fill_diagonal(common, 0)
        assert np.array_equal(common, expected - np.diag(expected.diagonal()))
    empty = pa.chunked_array([], pa.list_(pa.int64()))
    assert [len(t) for t, _ in jaccard_join._shared_tokens(empty)] == [0]


def test_two_blocks_are_compared_in_little_memory():
    values = np.random.default_rng(7).integers(-(2**63), 2**63 - 1, 2_000_000)
    lists = pa.chunked_array([pa.ListArray.from_arrays(pa.array(np.arange(0, 2_000_001, 2000, dtype=np.int32)), pa.array(values))])
    tracemalloc.start()
    for _ in jaccard_join._shared_tokens(lists):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50_000_000  # sorted at once: above 100 MB
