"""Learned models: risk forecast, clearance quantiles and their metrics."""

from __future__ import annotations

import threading
import weakref
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from datetime import timedelta
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbwise import settings as S
from kerbwise.functions.numbers import round_half_even
from kerbwise.functions.quantiles import exact_quantile, value_counts
from kerbwise.operators.boosting import DEPTH, LEAST_ROWS, MAX_BINS, PATIENCE, STEP, chosen_rounds, fitted
from kerbwise.operators.cleaning import US_PER_MIN
from kerbwise.operators.evaluate import capture_by_date, fold_count, mean_capture, walk_forward
from kerbwise.operators.surface import (
    CELL, LAT_ORIGIN_E7, LON_ORIGIN_E7, cell_date_panel, first_day, holdout_start, last_day, mean_from_offsets,
)
from kerbwise.session import cut, sized

RISK_FEATURES = ["lat", "lon", "dow", "month", "is_weekend", "hist_n", "hist_rate", "crit"]
FOLD_FEATURES = ["lat", "lon", "dow", "month", "is_weekend", "hist_n", "crit"]
CLEARANCE_FEATURES = ["cause_index", "high", "closure", "corridor_crit", "is_corridor"]
SEED = 7


# Most rounds of boosting: of the forecast, and of each weekly fit of the walk-forward.
RISK_ROUNDS, FOLD_ROUNDS = 400, 300
# Vectors of a fold up to which one task fits it; Spark's trees, a job per level, fit a larger one. The model is the same.
TASK_VECTORS = 500_000
# Weekly fits by Spark's trees at the same time. Each is a row of short jobs, so they wait for the driver rather than for cores.
FOLDS_AT_ONCE = 13
VECTOR = ["fold", *CELL, "dow", "month"]


def vectors(days: DataFrame, cells: DataFrame, starts: list[tuple]) -> DataFrame:
    """One row per fold, cell, weekday and month: the features with number, sum and sum of squares of the targets of the
    dates before the fold's start, zeros of quiet dates included.

    Features depend on the date by weekday and month only, so these rows say all that the cell-date panel of the fold
    says, and their number does not grow with the dates. A tenth of them, by a hash of cell, weekday and month, is held
    out. ``starts``: (fold, first date not trained on), a row per week.
    """
    spark = days.sparkSession
    table = F.broadcast(spark.createDataFrame(starts, "fold int, start date"))
    ends = days.agg(F.min("date").alias("first"), F.max("date").alias("last"))
    date = ends.select(F.explode(F.sequence("first", "last")).alias("date"))
    training = F.col("date") < F.col("start")
    parts = [F.weekday("date").alias("dow"), F.month("date").alias("month")]
    calendar = date.join(table).groupBy("fold", *parts).agg(F.count_if(training).alias("n"))  # dates x folds
    impact = F.col("impact_t").cast("double") / F.lit(10.0)
    listed = F.array(*[F.struct(F.lit(f).alias("fold"), F.lit(d).alias("start")) for f, d in starts])
    trained = F.explode(F.transform(F.filter(listed, lambda s: s["start"] > F.col("date")), lambda s: s["fold"])).alias("fold")
    actual = days.select(*CELL, *parts, impact.alias("y"), trained)
    summed = actual.groupBy(*VECTOR).agg(F.sum("y").alias("y"), F.sum(F.col("y") * F.col("y")).alias("yy"))
    rows = cells.join(F.broadcast(calendar), "fold").join(summed, VECTOR, "left")
    return rows.withColumns({
        "y": F.coalesce("y", F.lit(0.0)), "yy": F.coalesce("yy", F.lit(0.0)), "is_weekend": F.col("dow").isin(5, 6).cast("int"),
        "held": F.pmod(F.xxhash64(*CELL, "dow", "month"), F.lit(10)) == 0,
    })


def fit_risk(rows: DataFrame, features: list[str], rounds: int) -> tuple[VectorAssembler, GBTRegressionModel]:
    """Gradient-boosted trees on ``vectors`` of one fold, each weighing as many rows as it stands for. Spark's trees have no L2
    leaf penalty; a minimum leaf size regularises instead.

    The held-out vectors tell how many rounds to keep. Ceilings double until the stop rule holds within one, up to
    ``rounds``; the same rounds come first under each. The model is then fitted to all vectors with the rounds kept.
    Without vectors on either side ten rounds are fitted.
    """
    assembler = VectorAssembler(inputCols=features, outputCol="features")
    known = rows.filter("n > 0").withColumn("mean", F.col("y") / F.col("n"))
    known = cut(assembler.transform(known).select("features", "mean", F.col("n").cast("double").alias("n"), "held"))
    fitted, judged = known.filter("not held"), known.filter("held")

    def trees(most: int) -> GBTRegressor:
        return GBTRegressor(
            labelCol="mean", weightCol="n", featuresCol="features", predictionCol="raw", maxDepth=DEPTH,
            stepSize=STEP, maxIter=most, minInstancesPerNode=LEAST_ROWS, maxBins=MAX_BINS, seed=SEED,
        )

    kept = min(rounds, PATIENCE)
    if not fitted.isEmpty() and not judged.isEmpty():
        most = min(rounds, 4 * PATIENCE)
        while True:
            errors = trees(most).fit(fitted).evaluateEachIteration(judged, "squared")
            kept = chosen_rounds(errors)
            if kept or most >= rounds:
                break
            most = min(rounds, 2 * most)
        kept = kept or errors.index(min(errors)) + 1
    return assembler, trees(kept).fit(known)


def predict(rows: DataFrame, assembler: VectorAssembler, model: GBTRegressionModel) -> DataFrame:
    scored = model.transform(assembler.transform(rows))
    return scored.withColumn("pred", F.greatest(F.col("raw"), F.lit(0.0))).drop("features", "raw")


def boosted(rows: DataFrame, features: list[str], rounds: int, task_vectors: int = TASK_VECTORS) -> DataFrame:
    """VECTOR and ``pred`` of all stored ``vectors`` of each fold by ``fit_risk`` of that fold; folds without a known vector are
    left out.

    Every fold of up to ``task_vectors`` is fitted by a task of its own, all in one job; the cells of a city box stay below
    that whatever the log. Larger folds are fitted by jobs over all tasks, FOLDS_AT_ONCE at a time.
    """
    counts = rows.groupBy("fold").agg(F.count(F.lit(1)).alias("vectors"), F.count_if(F.col("n") > 0).alias("known"))
    sizes = {r["fold"]: r["vectors"] for r in counts.filter("known > 0").collect()}  # one a week
    own = sorted(k for k, n in sizes.items() if n <= task_vectors)
    schema = rows.select(*VECTOR, F.lit(0.0).alias("pred")).schema
    found = rows.sparkSession.createDataFrame([], schema)
    if own:
        task = F.array_position(F.array(*[F.lit(k) for k in own]), F.col("fold")).cast("int") - 1
        dealt = rows.filter(F.col("fold").isin(own)).select(*dict.fromkeys([*VECTOR, *features, "y", "n", "held"]))
        found = cut(dealt.repartitionById(len(own), task).mapInArrow(_folds_fit(features, rounds), schema))

    def fold(k: int) -> DataFrame:
        mine = rows.filter(F.col("fold") == k)
        return cut(predict(mine, *fit_risk(mine, features, rounds)).select(*VECTOR, "pred"))

    with ThreadPoolExecutor(FOLDS_AT_ONCE) as pool:
        # Wrapped once a fold: threads that share the properties of one wrapping take each other's query numbers.
        large = [pool.submit(inheritable_thread_target(rows.sparkSession)(fold), k) for k in sorted(set(sizes) - set(own))]
        return reduce(DataFrame.unionByName, [x.result() for x in large], found)


def _folds_fit(features: list[str], rounds: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The folds of one task, one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        # In the order of the vectors, so that sums do not depend on how they were stored.
        table = pa.Table.from_batches(parts).sort_by([(c, "ascending") for c in VECTOR])
        place = table["fold"].to_numpy()
        for k in np.unique(place):
            mine = table.slice(np.searchsorted(place, k), np.count_nonzero(place == k))
            if any(mine[c].null_count for c in features):
                raise ValueError("a feature of a cell has no value")
            values = np.stack([mine[c].to_numpy().astype(float) for c in features])
            n = mine["n"].to_numpy().astype(float)
            mean = mine["y"].to_numpy() / np.maximum(n, 1.0)
            raw = fitted(values, mean, n, mine["held"].to_numpy(), rounds)
            yield from mine.select(VECTOR).append_column("pred", pa.array(np.maximum(raw, 0.0))).to_batches()

    return run


def risk_forecast(days: DataFrame, rounds: int = RISK_ROUNDS, leaky: bool = False) -> DataFrame:
    """The panel with predicted impact; fitted on dates before the hold-out."""
    panel = cell_date_panel(days, leaky=leaky)
    start = days.select(holdout_start(days).alias("d")).first()["d"]
    if start is None:
        return panel.withColumn("pred", F.lit(0.0))
    features = ["lat", "lon", "hist_n", "hist_rate", "crit"]
    cells = panel.select(F.lit(0).alias("fold"), *CELL, *features).distinct()
    rows = cut(vectors(days, cells, [(0, start)]))
    if rows.filter("n > 0").isEmpty():
        return panel.withColumn("pred", F.lit(0.0))
    scored = boosted(rows, RISK_FEATURES, rounds)
    return panel.join(scored.select(*CELL, "dow", "month", "pred"), [*CELL, "dow", "month"])


def risk_surface_model(predicted: DataFrame) -> DataFrame:
    """Mean predicted impact per cell and weekday."""
    return predicted.groupBy(*CELL, "lat", "lon", "dow").agg(F.avg("pred").alias("exp_impact"))


def risk_metrics(predicted: DataFrame) -> DataFrame:
    """Mean absolute error and capture of the model on the hold-out, with cell count."""
    test = predicted.filter(F.col("date") >= holdout_start(predicted))
    captured = mean_capture(capture_by_date(test.withColumn("score", F.col("pred"))))
    error = test.agg(
        round_half_even(F.avg(F.abs(F.col("y") - F.col("pred"))), 1).alias("model_mae"),
        F.count_distinct(*CELL).alias("n_cells"),
    )
    values = error.agg(F.first(F.struct("model_mae", "n_cells")).alias("e")).scalar()
    return captured.select(
        F.col("capture_pct").alias("capture_top20_model"), values["model_mae"].alias("model_mae"),
        values["n_cells"].alias("n_cells"), F.lit(S.HOLDOUT_DAYS).alias("test_days"),
    )


def fold_cells(days: DataFrame, folds: int) -> DataFrame:
    """Cells and features of every weekly fold from the days before it, by one running sum over folds."""
    since = F.datediff(F.col("date"), first_day(days)) - S.WARMUP_DAYS
    fold = F.when(since < 0, F.lit(-1)).otherwise(F.floor(since / S.FOLD_DAYS).cast("int")).alias("fold")
    sums = ["n", "lat_off", "lon_off", "crit_e9"]
    per_fold = cut(days.groupBy(*CELL, fold).agg(*[F.sum(c).alias(c) for c in sums]))
    grid = per_fold.select(*CELL).distinct().withColumn("fold", F.explode(F.sequence(F.lit(-1), F.lit(folds - 1))))
    before = Window.partitionBy(*CELL).orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
    past = grid.join(per_fold, [*CELL, "fold"], "left").withColumns({c: F.sum(c).over(before) for c in sums})
    n = F.col("n")
    return past.filter((F.col("fold") >= 0) & (n >= S.PANEL_MIN_INCIDENTS)).select(
        "fold", *CELL, mean_from_offsets(F.col("lat_off"), n, LAT_ORIGIN_E7).alias("lat"),
        mean_from_offsets(F.col("lon_off"), n, LON_ORIGIN_E7).alias("lon"), n.alias("hist_n"),
        (F.col("crit_e9").cast("double") / n / F.lit(1e9)).alias("crit"),
    )


def walk_forward_scores_model(days: DataFrame, rounds: int = FOLD_ROUNDS) -> DataFrame:
    """Predicted impact of every (fold, cell, date) of the fold's week by a model of the days before it: fold, train_days, cell,
    date, y, score. The vectors of all folds are stored once."""
    dated = days.filter(F.col("date").isNotNull())
    found = dated.select(fold_count(dated).alias("f"), first_day(dated).alias("d")).first()
    folds = found["f"] if found and found["f"] else 0
    starts = [(k, found["d"] + timedelta(days=S.WARMUP_DAYS + S.FOLD_DAYS * k)) for k in range(folds)]
    if not folds:
        none = "fold int, train_days int, gy long, gx long, date date, y double, score double"
        return days.sparkSession.createDataFrame([], none)
    cells = cut(fold_cells(dated, folds))
    rows = cut(vectors(dated, cells, starts))

    scored = boosted(rows, FOLD_FEATURES, rounds).withColumnRenamed("pred", "score")
    offsets = F.explode(F.sequence(F.lit(0), F.lit(S.FOLD_DAYS - 1)))
    train_days = F.lit(S.WARMUP_DAYS) + F.lit(S.FOLD_DAYS) * F.col("fold")
    week = cells.select("fold", *CELL, train_days.alias("train_days"), offsets.alias("_d"))
    week = week.withColumn("date", F.date_add(F.lit(found["d"]), F.col("train_days") + F.col("_d"))).filter(F.col("date") <= last_day(dated))
    actual = dated.select(*CELL, "date", (F.col("impact_t").cast("double") / F.lit(10.0)).alias("y"))
    week = week.withColumns({"dow": F.weekday("date"), "month": F.month("date")}).join(actual, [*CELL, "date"], "left")
    return week.join(scored, VECTOR).select(
        "fold", "train_days", *CELL, "date", F.coalesce("y", F.lit(0.0)).alias("y"), "score"
    )


def walk_forward_model(days: DataFrame, rounds: int = FOLD_ROUNDS) -> DataFrame:
    """Walk-forward capture with a fresh fit per week on the past only; weeks are numbered over folds with a capture."""
    return walk_forward(walk_forward_scores_model(days, rounds))


def clearance_rows(enriched: DataFrame) -> DataFrame:
    """Incidents with a trusted duration below the modelling limit."""
    return enriched.filter(F.col("dur_trust_min") < S.MODEL_CLEARANCE_LIMIT_MIN).select(
        "t_event", "cause", "priority", "closure", "corridor_crit", "is_corridor", "dur_trust_us", "dur_trust_min",
        (F.col("priority") == "High").cast("int").alias("high"),
    )


def clearance_cut(rows: DataFrame) -> Column:
    """Last training instant: the hold-out length before the latest incident."""
    latest = rows.select(F.max("t_event").alias("t")).scalar()
    return latest - F.expr(f"INTERVAL {S.HOLDOUT_DAYS} DAYS")


class ClearanceForest:
    """Quantile regression forest: leaves of a random forest hold the exact quantiles
    of the training durations in them; a prediction averages its leaves.

    Leaf contents are counted per (tree, leaf, duration) across the cluster. Training
    rows are never gathered.
    """

    def __init__(self, trees: int = 20, depth: int = 5, quantiles: tuple[float, ...] = (0.5, 0.9)):
        self.trees, self.depth, self.quantiles = trees, depth, quantiles

    def fit(self, train: DataFrame, causes: DataFrame) -> "ClearanceForest":
        self.indexer = StringIndexer(
            inputCol="cause", outputCol="cause_index", stringOrderType="alphabetAsc", handleInvalid="keep"
        ).fit(causes)
        self.assembler = VectorAssembler(inputCols=CLEARANCE_FEATURES, outputCol="features")
        forest = RandomForestRegressor(
            labelCol="dur_trust_min", featuresCol="features", leafCol="leaves", numTrees=self.trees,
            maxDepth=self.depth, minInstancesPerNode=20, featureSubsetStrategy="all", maxBins=MAX_BINS, seed=SEED,
        )
        rows = self._features(train)
        self.model = forest.fit(rows)
        leaves = self._leaves(rows.select("features", "dur_trust_us"))
        counts = value_counts(leaves, ["tree", "leaf"], "dur_trust_us")
        table = None
        for q in self.quantiles:
            name = f"q{round(q * 100)}"
            one = exact_quantile(counts, ["tree", "leaf"], "dur_trust_us", q, name, coarse_width=US_PER_MIN)
            one = one.select("tree", "leaf", (F.col(name) / F.lit(float(US_PER_MIN))).alias(name))
            table = one if table is None else table.join(one, ["tree", "leaf"])
        # Trees x 2^depth rows.
        self.leaf_quantiles = sized(table)
        return self

    def predict(self, rows: DataFrame, key: str) -> DataFrame:
        """Average leaf quantiles per row; ``key`` identifies the rows."""
        scored = self._leaves(self._features(rows).select(key, "features"))
        names = [f"q{round(q * 100)}" for q in self.quantiles]
        found = scored.join(self.leaf_quantiles, ["tree", "leaf"])
        return found.groupBy(key).agg(*[F.avg(n).alias(n) for n in names])

    def _features(self, rows: DataFrame) -> DataFrame:
        # The index is a plain number: as a category it could take no more values than bins.
        indexed = self.indexer.transform(rows)
        return self.assembler.transform(indexed.withColumn("cause_index", F.col("cause_index") + F.lit(0.0)))

    def _leaves(self, rows: DataFrame) -> DataFrame:
        kept = [c for c in rows.columns if c != "features"]
        leaves = vector_to_array(F.col("leaves"))
        return self.model.transform(rows).select(*kept, F.posexplode(leaves).alias("tree", "leaf")).withColumn(
            "leaf", F.col("leaf").cast("int")
        )


PROFILE = ["cause", "high", "closure", "corridor_crit", "is_corridor"]


class ClearanceFit:
    """The modelled rows of a log, the last training instant and the forest of the rows up to it, computed when first asked for."""

    def __init__(self, enriched: DataFrame):
        self._enriched, self._lock, self._found = weakref.ref(enriched), threading.Lock(), None

    def get(self) -> tuple[DataFrame, Column, ClearanceForest]:
        with self._lock:
            if self._found is None:
                rows = cut(clearance_rows(self._enriched()))
                limit = clearance_cut(rows)
                train = cut(rows.filter(F.col("t_event") <= limit))
                self._found = rows, limit, ClearanceForest().fit(train, rows.select("cause").distinct())
            return self._found


# By the frame of the log, as long as it lives.
_FITS: weakref.WeakKeyDictionary[DataFrame, ClearanceFit] = weakref.WeakKeyDictionary()
_FITS_LOCK = threading.Lock()


def clearance_fit(enriched: DataFrame) -> tuple[DataFrame, Column, ClearanceForest]:
    """The fit of one log, made once however many tables, at the same time or later, ask for it."""
    with _FITS_LOCK:
        fit = _FITS.setdefault(enriched, ClearanceFit(enriched))
    return fit.get()


def clearance_predictions(enriched: DataFrame) -> DataFrame:
    """Test rows grouped by feature profile with their predicted quantiles.

    Rows with equal features have equal predictions, so profiles are scored once.
    """
    rows, limit, forest = clearance_fit(enriched)
    profiles = cut(
        rows.filter(F.col("t_event") > limit)
        .groupBy(*PROFILE, "dur_trust_us")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("profile", F.xxhash64(*PROFILE))
    )
    distinct = profiles.select("profile", *PROFILE).distinct()
    predicted = forest.predict(distinct, "profile")
    return profiles.join(predicted, "profile").withColumn(
        "dur_trust_min", F.col("dur_trust_us") / F.lit(float(US_PER_MIN))
    )


def clearance_quantiles(enriched: DataFrame) -> DataFrame:
    """Predicted P50 and P90 per feature profile of the hold-out."""
    return (
        clearance_predictions(enriched)
        .groupBy(*PROFILE)
        .agg(F.sum("n").alias("rows"), F.max("q50").alias("p50_min"), F.max("q90").alias("p90_min"))
    )


def clearance_metrics(enriched: DataFrame) -> DataFrame:
    """Error of the predicted median against the training median on the hold-out."""
    rows = clearance_predictions(enriched)
    weighted = F.sum(F.abs(F.col("dur_trust_min") - F.col("q50")) * F.col("n")) / F.sum("n")
    base = baseline_metrics(enriched).select("baseline_mae").scalar()
    return rows.agg(round_half_even(weighted, 1).alias("p50_mae")).select(
        "p50_mae",
        round_half_even(base, 1).alias("baseline_mae"),
        round_half_even(F.try_divide(F.lit(100.0) * (base - F.col("p50_mae")), base), 1).alias("lift_pct"),
    )


def baseline_metrics(enriched: DataFrame) -> DataFrame:
    """Mean absolute error of the training median on the hold-out."""
    rows = cut(clearance_rows(enriched).select("t_event", "dur_trust_us", "dur_trust_min"))
    limit = clearance_cut(rows)
    counts = value_counts(rows.filter(F.col("t_event") <= limit), [], "dur_trust_us")
    median = exact_quantile(counts, [], "dur_trust_us", 0.5, "m", coarse_width=US_PER_MIN).select("m").scalar()
    test = rows.filter(F.col("t_event") > limit).withColumn("median_us", median)
    # Half-microseconds keep the sum of errors whole.
    error = F.sum((F.abs(F.col("dur_trust_us") - F.col("median_us")) * 2).cast("long")).cast("double")
    return test.agg(
        F.count(F.lit(1)).alias("test_rows"),
        round_half_even(F.max("median_us") / F.lit(float(US_PER_MIN)), 4).alias("train_median_min"),
        round_half_even(error / 2 / F.count(F.lit(1)) / F.lit(float(US_PER_MIN)), 4).alias("baseline_mae"),
    )


def clearance_table(enriched: DataFrame, forest: ClearanceForest | None = None) -> DataFrame:
    """Predicted P50 and P90 per cause at one fixed profile."""
    rows, _, fitted_forest = clearance_fit(enriched) if forest is None else (cut(clearance_rows(enriched)), None, None)
    forest = forest or fitted_forest
    causes = cut(rows.select("cause").distinct())
    profile = causes.select(
        "cause", F.lit(1).alias("high"), F.lit(0).alias("closure"), F.lit(1.5).alias("corridor_crit"),
        F.lit(1).alias("is_corridor"),
    )
    return forest.predict(profile, "cause").select(
        "cause", F.rint("q50").alias("p50_min"), F.rint("q90").alias("p90_min")
    )


def clearance_by_cause(enriched: DataFrame) -> DataFrame:
    """Observed P50 and P90 of trusted minutes per cause (no model)."""
    counts = cut(value_counts(clearance_rows(enriched), ["cause"], "dur_trust_us"))

    def one(q: float, name: str) -> DataFrame:
        found = exact_quantile(counts, ["cause"], "dur_trust_us", q, name, coarse_width=US_PER_MIN)
        minutes = round_half_even(F.col(name) / F.lit(float(US_PER_MIN)), 4)
        return found.select("cause", minutes.alias(name), F.col(f"{name}_n").alias(f"{name}_n"))

    return one(0.5, "p50_min").join(one(0.9, "p90_min").drop("p90_min_n"), "cause").select(
        "cause", F.col("p50_min_n").alias("n"), "p50_min", "p90_min"
    )
