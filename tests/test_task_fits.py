"""Boosting within a task: the trees of Spark's booster, a job for all folds, the stop rule and missing values."""

import datetime as dt
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbwise.operators import boosting, models

FEATURES = ["a", "b", "c"]


def vectors_of(spark, folds, size=700):
    r = random.Random(3)
    rows = []
    for fold in folds:
        for i in range(size):
            a, b, c = float(r.randrange(9)), float(r.randrange(2)), r.random()  # more values of c than bins
            n = r.randrange(6)
            rows.append((fold, i, fold, i % 7, 1 + i % 12, a, b, c, n, n * (3 * a + (5 if b else 0) * (c > 0.4) + r.random()), r.random() < 0.1))
    return spark.createDataFrame(rows, "fold int, gy long, gx long, dow int, month int, a double, b double, c double, n int, y double, held boolean").repartition(3)


def by_vector(df):
    return {(r.fold, r.gy): r.pred for r in df.collect()}


def test_a_task_fits_what_sparks_trees_fit(spark):
    rows = vectors_of(spark, [0, 1, 4]).cache()
    got = by_vector(models.boosted(rows, FEATURES, 12))
    want = by_vector(models.boosted(rows, FEATURES, 12, task_vectors=0))
    assert got.keys() == want.keys() and len(got) == 2100
    assert max(abs(got[k] - want[k]) for k in want) < 1e-9 and len({round(v, 6) for v in got.values()}) > 100
    mixed = rows.filter("fold < 4 or gy < 300")
    both = by_vector(models.boosted(mixed, FEATURES, 12, task_vectors=300))  # two folds by jobs, one by a task
    assert all(abs(both[k] - want[k]) < 1e-9 for k in both if k[0] < 4) and len(both) == 1700


def test_rounds_are_chosen_on_the_held_out_rows():
    r = np.random.default_rng(5)
    x = r.integers(0, 40, (2, 900)).astype(float)
    y, w, held = x[0] + r.normal(size=900) * 4, r.integers(1, 5, 900).astype(float), r.random(900) < 0.1
    errors = [np.average((y[held] - p) ** 2, weights=w[held]) for p in boosting.boosted(x[:, ~held], y[~held], w[~held], x[:, held], 80)]
    kept = boosting.chosen_rounds(errors)
    assert 1 < kept < 70
    *_, want = boosting.boosted(x, y, w, x, kept)
    assert np.array_equal(boosting.fitted(x, y, w, held, 300), want)
    *_, few = boosting.boosted(x, y, w, x, min(len(y), models.PATIENCE))
    assert np.array_equal(boosting.fitted(x, y, w, held & False, 300), few)


def test_folds_without_known_vectors_and_missing_features(spark):
    rows = vectors_of(spark, [0, 2], 60)
    rows = rows.withColumn("n", F.when(F.col("fold") == 2, 0).otherwise(F.col("n")))
    assert {k[0] for k in by_vector(models.boosted(rows, FEATURES, 3))} == {0}
    assert models.boosted(rows.filter("fold = 2"), FEATURES, 3).isEmpty()
    with pytest.raises(Exception, match="no value"):
        models.boosted(rows.withColumn("a", F.when(F.col("gy") != 7, F.col("a"))), FEATURES, 3).collect()


def test_weekly_fits_are_not_a_job_per_tree_level(spark):
    r = random.Random(1)
    first = dt.date(2024, 1, 1)
    rows = [(gy, 6450, first + dt.timedelta(days=d), 1, r.randrange(100 * (gy - 1069)), r.randrange(1000), r.randrange(1000), 10**9)
            for gy in range(1070, 1076) for d in range(100) if r.random() < 0.8]
    days = spark.createDataFrame(rows, "gy int, gx int, date date, n long, impact_t long, lat_off long, lon_off long, crit_e9 long").cache()
    context, group = spark.sparkContext, f"fits-{uuid.uuid4().hex}"
    context.setJobGroup(group, "fits")
    try:
        weeks = models.walk_forward_scores_model(days).groupBy("fold").count().collect()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert len(weeks) >= 5
    assert 0 < len(context.statusTracker().getJobIdsForGroup(group)) < 60  # was some ten a round and fold


def test_folds_fitted_by_jobs_do_not_share_a_threads_properties(spark, monkeypatch):
    wrap, wrapped = models.inheritable_thread_target, []

    def noted(session):
        def one(f):
            wrapped.append(f)
            return wrap(session)(f)

        return one

    monkeypatch.setattr(models, "inheritable_thread_target", noted)
    assert models.boosted(vectors_of(spark, [0, 1], 60), FEATURES, 2, task_vectors=0).count() == 120
    assert len(wrapped) == 2  # one wrapping for all threads failed at times: Cannot parse null string
