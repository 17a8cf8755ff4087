"""The pipeline's stages: order, effect, columns, odd rows; the whole against stage-wise brute force."""

import corpus_pipeline as P
from kerbwise.llm.store import stored
from tests.llm import cases
from tests.llm.test_decontaminate import _brute

SF = "/root/testdata/sf0.001"


def test_stages_and_their_effects(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["language", "near_duplicates", "benchmark_passages", "mix", "shards"]
    kept = stored(P.language(spark, docs, SF))
    assert kept.columns == docs.columns and 0.97 * docs.count() < kept.count() <= docs.count()

    given = [(r.doc_id, r.text) for r in kept.select("doc_id", "text").collect()]
    apart = stored(P.near_duplicates(spark, kept, SF))
    assert sorted(r.doc_id for r in apart.collect()) == sorted({c for _, _, c in cases.components(given, 5, 80)})

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = stored(P.benchmark_passages(spark, apart, SF))
    leaked = {d for d, _ in _brute([(r.doc_id, r.text) for r in apart.collect()], items)}
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in apart.collect() if r.doc_id not in leaked) and leaked

    mixed = stored(P.mix(spark, clean, SF))
    assert mixed.columns == docs.columns
    times = [r["count"] for r in mixed.groupBy("doc_id").count().collect()]
    assert set(times) <= {1, 2} and mixed.join(clean, "doc_id", "left_anti").isEmpty()

    final = P.shards(spark, mixed, SF)
    assert final.count() == mixed.count() and set(docs.columns) < set(final.columns)
    assert final.groupBy("text").agg({"shard": "min", "doc_id": "count"}).count() == final.select("text", "shard").distinct().count()


def test_odd_rows_pass_every_stage(spark):
    for docs in (cases.odd(spark), cases.empty(spark)):
        docs = stored(docs)
        for name, stage in P.STAGES:
            out = stored(stage(spark, docs, SF))
            if name != "shards":
                assert out.columns == docs.columns
            docs = out


def test_stages_hand_python_small_batches(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, f"text {i}") for i in range(1500)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "docs"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    seen = []

    def contaminated(docs, benchmark, key):
        def run(batches):
            for b in batches:
                yield b.slice(0, 0) if b.num_rows <= 1000 else b.slice(0, 1)

        seen.append(docs.mapInArrow(run, docs.schema).count())
        return docs.filter("false")

    monkeypatch.setattr(P.decontaminate, "contaminated", contaminated)
    kept = P.benchmark_passages(spark, spark.read.parquet(str(tmp_path / "docs")), str(tmp_path))
    assert kept.count() == 1500 and seen == [0]
