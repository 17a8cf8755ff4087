"""Structured Streaming forms of scoring and of the gathering alarm."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from kerbwise import settings as S
from kerbwise.functions.geo import BUCKET_MARGIN, KM_PER_DEGREE, band_width, reach_boxes
from kerbwise.functions.numbers import round_half_even
from kerbwise.operators.bursts import is_burst, neighbourhood_figures
from kerbwise.operators.cleaning import clean
from kerbwise.operators.impact import score
from kerbwise.operators.neighbours import PLACE_TIME, SIDE, SLAB, label_codes, near_sums
from kerbwise.sources.event_log import incidents_from_events
from kerbwise.session import prepare

WATERMARK = "30 minutes"
WINDOW = "90 minutes"
SLIDE = "15 minutes"


def read_event_stream(spark: SparkSession, folder: str, schema, pattern: str = "events.parquet") -> DataFrame:
    """Raw incident rows from event files as they arrive in a folder."""
    prepare(spark)
    events = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    return incidents_from_events(spark, events)


def stream_enrich(raw: DataFrame, medians: DataFrame, criticality: DataFrame) -> DataFrame:
    """Clean and score incidents as they arrive, each id once.

    The lookup tables come from the last batch run; both joins are stream-static.
    Repeats of an id are dropped as long as they arrive within the watermark.
    """
    cleaned = clean(raw).withColumn("t_mark", F.coalesce("t_event", "t_modified", "t_closed", "t_resolved"))
    unique = cleaned.withWatermark("t_mark", WATERMARK).dropDuplicatesWithinWatermark(["id"])
    return score(unique, medians, criticality).drop("t_mark")


def windowed_bursts(incidents: DataFrame) -> DataFrame:
    """Gathering alarm per sliding window and square, two radii wide.

    Works on a stream and on a table. Squares overlap by one radius: an incident
    counts in its own step of the grid and in the steps below and to the left. Counts
    are kept per cause first and per square second, so the state holds numbers only.
    A square approximates the exact circle of the batch operator.
    """
    height = S.BURST_KM / KM_PER_DEGREE * BUCKET_MARGIN
    band = F.floor(F.col("lat") / F.lit(height)) - F.col("step.y")
    steps = F.explode(F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y in (0, 1) for x in (0, 1)]))
    per_cause = (
        incidents.filter(F.col("t_event").isNotNull())
        .withWatermark("t_event", WATERMARK)
        .withColumn("step", steps)
        .withColumns(
            {
                "sq_y": band,
                "sq_x": F.floor(F.col("lon") / band_width(band, S.BURST_KM)) - F.col("step.x"),
            }
        )
        .groupBy(F.window("t_event", WINDOW, SLIDE), "sq_y", "sq_x", "cause")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    per_square = per_cause.groupBy("window", "sq_y", "sq_x").agg(*neighbourhood_figures())
    return per_square.filter(is_burst()).select(
        F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("window_start"),
        F.date_format("window.end", "yyyy-MM-dd HH:mm").alias("window_end"),
        "sq_y", "sq_x", "size", "mix", "dom_cause",
    )


def circle_bursts(incidents: DataFrame) -> DataFrame:
    """Gathering alarm on the true circle: what follows an incident within the window and radius.

    Works on a stream and on a table; one row per second and place that qualifies, with the
    figures of the batch burst query. Incidents are offered to boxes of time and place that may hold an incident they
    follow, and a box compares its own with all it was offered, a block at a time. On a stream a box keeps its
    incidents, copies as one weighted row, until no open window needs them. An incident is reported once the watermark
    has passed the end of its window. Incidents that arrive behind the watermark, or without a time or place, take no part.
    """
    known = F.col("t_event").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull()
    marked = (
        incidents.filter(known)
        .select(F.date_trunc("second", "t_event").alias("t_mark"), "lat", "lon", "cause")
        .withWatermark("t_mark", WATERMARK)
        .withColumn("t_s", F.unix_seconds("t_mark"))
    )
    if not incidents.isStreaming:  # on a stream copies are combined in their box
        marked = marked.groupBy(*marked.columns).agg(F.count(F.lit(1)).alias("n"))
    first, last = (F.floor((F.col("t_s") - F.lit(back)) / F.lit(SLAB_SEC)) for back in (S.PAIR_WINDOW_SEC, 0))
    offered = reach_boxes(marked.withColumn("_bt", F.explode(F.sequence(first, last))), S.BURST_KM, SIDE)
    offered = offered.withColumn("_own", F.col("_own") & (F.col("_bt") == last))
    boxes = offered.groupBy("_bt", "_by", "_bx")
    if incidents.isStreaming:
        around = boxes.applyInPandasWithState(_box_stream, FIGURES, "rows binary, done long", "append", "EventTimeTimeout")
    else:
        around = boxes.applyInArrow(lambda rows: _figures(_combined(rows.select([*POINT, "n"])), None, None), FIGURES)
    return around.filter(is_burst()).select(
        "t_s", "lat", "lon", "size", "mix", "dom_cause",
        round_half_even(F.col("dom_n") / F.col("size"), 4).alias("dom_share"),
    )


# Length of a box in time; its sides are SIDE radii.
SLAB_SEC = SLAB * S.PAIR_WINDOW_SEC
POINT = ["t_s", "lat", "lon", "cause", "_own"]
FIGURES = "t_s long, lat double, lon double, size long, mix long, dom_n long, dom_cause string, live boolean"


def _combined(rows: pa.Table) -> pa.Table:
    """Rows with their number ``n``: copies as one, in order of time."""
    counts = ("n", "sum") if "n" in rows.column_names else ([], "count_all")
    found = rows.group_by(POINT).aggregate([counts])
    return found.rename_columns([c if c in POINT else "n" for c in found.column_names]).sort_by("t_s")


def _figures(points: pa.Table, after: int | None, until: int | None) -> pa.Table:
    """Figures of the box's own incidents whose window ends after ``after`` and up to ``until``, of all without them."""
    ends = pc.add(points["t_s"], S.PAIR_WINDOW_SEC)
    due = points["_own"]
    if until is not None:
        due = pc.and_(due, pc.and_(pc.greater(ends, after), pc.less_equal(ends, until)))
    anchors = points.filter(due).group_by(PLACE_TIME).aggregate([]).sort_by("t_s")
    names, (codes,) = label_codes(points["cause"])
    sides = [[t[c].to_numpy() for c in PLACE_TIME] for t in (anchors, points)]
    first = np.searchsorted(sides[1][0], sides[0][0], "left")
    last = np.searchsorted(sides[1][0], sides[0][0] + S.PAIR_WINDOW_SEC, "right")
    weight, live = points["n"].to_numpy(), np.isin(names.to_pylist(), S.LIVE_CAUSES)
    found = [np.zeros((0, 5), np.int64)]
    for _, sums in near_sums(*sides, first, last, codes, weight, max(1, len(names)), S.BURST_KM):
        kinds = sums > 0
        # labels are in order, and the first of the largest counts is taken
        found.append(np.stack([sums.sum(1), kinds.sum(1), sums.max(1), sums.argmax(1), (kinds & live).any(1)], axis=1))
    size, mix, most, code, any_live = np.concatenate(found).T
    return pa.table({
        **{c: anchors[c] for c in PLACE_TIME}, "size": size, "mix": mix, "dom_n": most,
        "dom_cause": names.take(pa.array(code)).cast(pa.string()), "live": any_live.astype(bool),
    })


def _box_stream(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One box of the stream: keep what open windows need, report the incidents whose window has ended."""
    kept, done = [], None
    if state.exists:
        rows, done = state.get
        kept.append(pa.ipc.open_stream(rows).read_all())
    if not state.hasTimedOut:
        for part in parts:
            new = pa.Table.from_pandas(part[POINT], POINT_SCHEMA, preserve_index=False)
            kept.append(_combined(new))
    points = _combined(pa.concat_tables(kept))
    mark = state.getCurrentWatermarkMs() // 1000
    since = -(2**62) if done is None else done
    found = _figures(points, since, mark)
    times = points["t_s"].to_numpy()
    own = times[points["_own"].to_numpy()] + S.PAIR_WINDOW_SEC
    open_ends = own[own > mark]
    # A box may still be offered incidents of its own until the watermark has passed its end.
    end = (key[0] + 1) * SLAB_SEC + S.PAIR_WINDOW_SEC
    if len(open_ends) or end > mark:
        points = points.filter(pa.array(times > mark - S.PAIR_WINDOW_SEC))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, points.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_table(points)
        state.update((sink.getvalue().to_pybytes(), mark))
        state.setTimeoutTimestamp(1000 * int(min(open_ends, default=end)) - 1)
    elif state.exists:
        state.remove()
    if found.num_rows:
        yield found.to_pandas()


POINT_SCHEMA = pa.schema([("t_s", pa.int64()), ("lat", pa.float64()), ("lon", pa.float64()), ("cause", pa.string()), ("_own", pa.bool_())])


def run_available(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Process everything that has arrived, append to ``out`` and read it back."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
