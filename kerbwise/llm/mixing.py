"""Mixing sources to target weights with hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbwise.llm.store import ordered_sums, small, stored

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, REPEATS = 1.5, 2
HASH_BITS, LEVEL_BITS = 60, 12


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def place(key: Column, text: Column) -> Column:
    """Place of a document in its source's order, 60 bits that key and text alone decide."""
    both = F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(both), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """source, source_size -> with target. Sources by code point (null last) take the weights in turn and
    split ``share`` of all sizes; targets stop at ``repeats`` times the source, the excess is shared anew
    by weight among the others until none is above. That fixed point gives each source the smaller of its
    stop and a common level times its weight; the level follows from running sums in order of stop / weight.
    """
    named = sizes.withColumn("_null", F.col("source").isNull())
    indexed = ordered_sums(named, ["_null", "source"], {"_index": F.lit(1)}, "sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_index") % len(weights) + 1).cast("int"))
    rated = indexed.withColumn("weight", weight).withColumn("stop", F.col("source_size") * F.lit(float(repeats)))
    rated = rated.withColumn("_ratio", F.col("stop") / F.col("weight"))
    level = stored(ordered_sums(rated, ["_ratio", "_null", "source"], {"_stops": F.col("stop"), "_weights": F.col("weight")}, "levels"), "levels")
    all_size, all_weight = level.agg(F.sum("source_size"), F.sum("weight")).first()
    budget = float(all_size or 0) * share
    full = (F.lit(budget) - F.col("_stops")) >= F.col("_ratio") * (F.lit(all_weight or 0.0) - F.col("_weights"))
    stops, gone = level.filter(full).agg(F.sum("stop"), F.sum("weight")).first()
    rest = (all_weight or 0.0) - (gone or 0.0)
    height = (budget - (stops or 0.0)) / rest if rest > 0 else 0.0
    target = F.when(full, F.col("stop")).otherwise(F.least(F.col("stop"), F.lit(height) * F.col("weight")))
    return level.select("source", F.col("source_size").cast("long").alias("source_size"), target.alias("target"))


def thresholds(docs: DataFrame, budgets: DataFrame) -> DataFrame:
    """For each source the largest threshold whose documents (place below it) stay within its budget.

    ``docs``: source_id, place, size; ``budgets``: source_id, budget. Words are summed by source and the
    leading bits of the place; the bucket in which the running sum passes the budget is refined by the
    next bits, for all sources at once, until it holds a single place. Returns source_id, threshold and
    the words below it; sources whose documents all fit get a threshold above every place.
    """
    state = stored(budgets.select("source_id", "budget", F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("prefix"), F.lit(None).cast("long").alias("threshold")), "budgets")
    for bits in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        open_ = small(stored(state.filter("threshold is null").drop("threshold"), "open"))
        inside = docs.join(open_, "source_id").filter(F.shiftright("place", bits + LEVEL_BITS) == F.col("prefix"))
        buckets = inside.groupBy("source_id", "budget", "words", F.shiftright("place", bits).alias("bucket")).agg(
            F.sum("size").alias("in_bucket"), F.min("place").alias("lo"), F.max("place").alias("hi")
        )
        running = Window.partitionBy("source_id").orderBy("bucket")  # at most 2 ** LEVEL_BITS buckets a source
        summed = buckets.withColumn("upto", F.col("words") + F.sum("in_bucket").over(running))
        passed = F.col("upto") > F.col("budget")
        edge = summed.groupBy("source_id").agg(
            F.min(F.when(passed, F.struct("bucket", "lo", "hi"))).alias("edge"), F.max(F.when(~passed, F.col("upto"))).alias("below")
        )
        fits = F.col("edge").isNull() & F.col("threshold").isNull()
        single = (F.col("edge.lo") == F.col("edge.hi")) | (F.lit(bits) == 0)
        state = stored(
            state.join(edge, "source_id", "left").select(
                "source_id", "budget", F.coalesce("below", "words").alias("words"), F.coalesce("edge.bucket", "prefix").alias("prefix"),
                F.coalesce("threshold", F.when(fits, F.lit(1 << HASH_BITS)), F.when(single, F.col("edge.lo"))).alias("threshold"),
            ),
            "edges",
        )
        if state.filter("threshold is null").isEmpty():
            break
    return state.select("source_id", "threshold", "words")


INTERVALS = "array<struct<low:bigint,high:bigint,most:double>>"


def source_id(source: Column) -> Column:
    return F.xxhash64(source.isNull(), F.coalesce(source.cast("string"), F.lit("")))


def plan_mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE, repeats: int = REPEATS, tolerance: float = 0.005,
) -> DataFrame:
    """What the mix takes of each source: source_id, source_size, target, rounds (whole passes over the source) and
    intervals of places (with the largest size that fits) that are taken once more.

    A partial round takes the documents whose place is below the source's threshold. Because the document at the
    threshold rarely fits, what is left of the budget goes to the later documents that still fit, by the same
    histograms, until at most ``tolerance`` of the target is left or nothing fits. A smaller budget takes a prefix
    of a larger one's first interval.
    """
    columns = [source_id(F.col(source)).alias("source_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size")]
    table = stored(docs.select(*columns, place(F.col(key), F.col(text)).alias("place")), "sizes")
    sizes = table.groupBy("source").agg(F.sum("size").alias("source_size"))
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    plan = stored(targets(sizes, weights, share, repeats).withColumns({"source_id": source_id(F.col("source")), "rounds": rounds}), "plan")
    left = stored(
        plan.select(
            "source_id", (F.col("target") - F.col("rounds") * F.col("source_size")).alias("budget"), (F.col("target") * tolerance).alias("enough"),
            F.lit(-1).cast("long").alias("after"),
        ),
        "left",
    )
    rows = table.filter("size > 0").select("source_id", "place", "size")
    taken = stored(left.limit(0).select("source_id", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high"), F.lit(0.0).alias("most")), "intervals")
    first = True
    while True:
        wanting = left.filter("budget > enough")
        if wanting.isEmpty():
            break
        most = F.lit(float("inf")) if first else F.col("budget")
        fitting = rows.join(small(wanting), "source_id").filter((F.col("place") > F.col("after")) & (F.col("size") <= most))
        fitting = stored(fitting.select("source_id", "place", "size"), "candidates")
        if fitting.isEmpty():
            break
        now = thresholds(fitting, wanting.select("source_id", "budget"))
        step = now.select("source_id", F.col("threshold").alias("upto"), F.col("words").alias("won"))
        found = wanting.join(step, "source_id").select("source_id", F.col("after").alias("low"), F.col("upto").alias("high"), most.alias("most"))
        taken = stored(taken.unionByName(found), "intervals")
        left = stored(
            left.join(step, "source_id", "left").select(
                "source_id", (F.col("budget") - F.coalesce("won", F.lit(0))).alias("budget"), "enough", F.coalesce("upto", "after").alias("after")
            ),
            "left",
        )
        first = False
    listed = taken.groupBy("source_id").agg(F.collect_list(F.struct("low", "high", "most")).alias("intervals"))  # one entry a pass
    whole = plan.join(listed, "source_id", "left").select(
        "source_id", "source_size", "target", "rounds", F.coalesce("intervals", F.array().cast(INTERVALS)).alias("intervals")
    )
    return stored(whole, "mix")


def apply_mix(docs: DataFrame, plan: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` with _size, _source_size, _target and _copies: how often the mix takes the whole document."""
    known = {"_source_id": source_id(F.col(source)), "_size": word_count(F.col(text)), "_place": place(F.col(key), F.col(text))}
    of = small(plan.select(*[F.col(c).alias(f"_{c}") for c in plan.columns]))
    joined = docs.withColumns(known).join(of, "_source_id")
    inside = F.exists("_intervals", lambda r: (F.col("_place") > r["low"]) & (F.col("_place") < r["high"]) & (F.col("_size") <= r["most"]))
    copies = F.when(F.col("_size") > 0, F.col("_rounds") + inside.cast("int")).otherwise(0).cast("int")
    return joined.withColumn("_copies", copies).drop("_source_id", "_place", "_rounds", "_intervals")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """Every row of ``docs`` with what the mix takes of it: ``key``, size, source_size, target, taken, copies.

    Size is the number of words (null text: 0). ``taken`` is copies * size: whole documents, at most ``repeats``
    times each. Place depends on key and text only, so reruns and other partitionings agree. Rows that repeat key
    and text share their place and are taken or left together. Null sources form one source, documents without
    words are never taken, and an empty table gives an empty result. Other columns are not read.
    """
    thin = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(source).alias("_source"))
    names = {"key": "_key", "text": "_text", "source": "_source"}
    out = apply_mix(thin, plan_mix(thin, **names, **options), **names)
    taken = (F.col("_copies") * F.col("_size")).cast("long").alias("taken")
    return out.select(F.col("_key").alias(key), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), taken, F.col("_copies").alias("copies"))
