"""Exact deduplication with an extendible-hash index on shared files. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbwise.llm.store import small, stored, tasks
from kerbwise.session import BROADCAST_ROW_LIMIT

BUCKET_ENTRIES = 65_536
# Rows a group may have and still be looked up by a shuffle. It rises with the table, so that fewer
# groups than a broadcast may hold are larger.
HOT_ROWS = 4096
ENTRY = ["h", "sha"]


def normalised(text: Column) -> Column:
    """The text without blanks, tabs, line breaks, vertical tabs, form feeds; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def directory(entries: DataFrame, capacity: int = BUCKET_ENTRIES) -> tuple[DataFrame, int]:
    """Directory of the index: for every used cell of the directory (the first ``depth`` bits of
    the hash) its bucket, named by the first cell that points to it.

    A bucket with more than ``capacity`` hashes is split by one more bit. When a cell of the
    directory itself is overfull, the directory doubles (four times at once) and is drawn up anew.
    Only distinct hashes count, so copies of one text never make a bucket overfull.
    """
    hashes = entries.select("h").distinct()
    depth = min(60, max(1, (hashes.count() // capacity).bit_length() + 4))
    while True:
        cells = stored(hashes.groupBy(F.shiftrightunsigned("h", 64 - depth).alias("cell")).agg(F.count(F.lit(1)).alias("n")), "cells")
        if depth >= 60 or cells.filter(F.col("n") > capacity).isEmpty():
            break
        depth = min(60, depth + 4)
    levels = cells.select("cell", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("local"))
    first = F.expr(f"shiftleft(shiftright(cell, {depth} - local), {depth} - local)")
    levels = levels.withColumn("bucket", first)
    filled = levels.groupBy("local", "bucket").agg(F.sum("n").alias("load"))
    fits = levels.join(filled, ["local", "bucket"]).filter((F.col("load") <= capacity) | (F.col("local") == depth))
    return fits.groupBy("cell").agg(F.min_by("bucket", "local").alias("bucket")), depth


class Index:
    """Buckets on shared files: a directory (cell to bucket) and entries, each bucket whole in one file.

    An owner task holds a range of buckets and writes their entries in the order of bucket, hash and
    digest. Every entry is found by way of the directory: the cell of its hash names the bucket.
    """

    def __init__(self, entries: DataFrame, capacity: int = BUCKET_ENTRIES) -> None:
        cells, self.depth = directory(entries, capacity)
        self.cells = small(stored(cells, "directory"))
        owners = self.placed(entries).repartitionByRange(tasks(entries.sparkSession), "bucket")
        self.entries = stored(owners.sortWithinPartitions("bucket", *ENTRY), "index")
        self._verify(entries, capacity)

    def placed(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the bucket of their hash. The join drops no row: every hash has its cell."""
        return rows.withColumn("cell", F.shiftrightunsigned("h", 64 - self.depth)).join(self.cells, "cell").drop("cell")

    def _verify(self, entries: DataFrame, capacity: int) -> None:
        """Refuse an index with an overfull bucket, or one that lacks entries."""
        loads = self.entries.groupBy("bucket").agg(F.count_distinct("h").alias("hashes"), F.count(F.lit(1)).alias("n"))
        found = loads.agg(F.max("hashes").alias("most"), F.sum("n").alias("n")).first()
        if (found["n"] or 0) != entries.count() or (self.depth < 60 and (found["most"] or 0) > capacity):
            raise RuntimeError(f"the directory misplaces entries: {found['n']} found, {found['most']} hashes in a bucket")

    def answer(self, rows: DataFrame, groups: DataFrame, extra: list[str]) -> DataFrame:
        """``rows`` joined to those of ``groups`` (entries of this index, with ``bucket`` and ``group_size``)
        that have their hash, digest and ``extra`` columns.

        Up to 100,000 groups are sent to all rows. Of more, the hot ones are, which are too few
        to exceed that; what remains goes to the bucket that its hash names, as no group of it is large.
        """
        key = [*ENTRY, *extra]
        if groups.limit(BROADCAST_ROW_LIMIT + 1).count() <= BROADCAST_ROW_LIMIT:
            return rows.join(F.broadcast(groups.drop("bucket")), key)
        total = groups.agg(F.sum("group_size")).first()[0]
        edge = max(HOT_ROWS, total // BROADCAST_ROW_LIMIT)
        hot = F.broadcast(groups.filter(F.col("group_size") > edge).drop("bucket"))
        rest = self.placed(rows.join(hot.select(*key), key, "left_anti"))
        met = rest.join(groups.filter(F.col("group_size") <= edge), ["bucket", *key]).drop("bucket")
        return rows.join(hot, key).unionByName(met)


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = BUCKET_ENTRIES) -> DataFrame:
    """One row per row of ``docs``: ``key``, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised bytes are. Of equal texts the row with most code points
    in the original text stays, then the smallest key (null last); of rows that repeat a key and
    text, one stays. Null text counts as empty; an empty table gives an empty result. Other columns
    are not read, whatever their names.

    Rows are first combined by hash and digest where they lie, so that a text held by a third of all
    rows reaches its owner as one entry per map task. A text that occurs once is answered from its
    bucket file alone. Rows of repeated texts ask the index: rows of hot texts stay where they are, the
    others go to their bucket. Owners chain the entries of a hash; within a chain, rows of one digest are
    compared by their bytes (grouping on the bytes, again combined before they move), and a digest that
    stood for two texts is split.
    """
    norm = normalised(F.col(text))
    source = docs.select(F.col(key).alias("id"), norm.alias("norm"), F.char_length(F.coalesce(text, F.lit(""))).alias("points"))
    rows = stored(
        source.select(
            "id", "norm", F.xxhash64("norm").alias("h"), F.sha2("norm", 256).alias("sha"),
            F.struct((-F.col("points")).alias("p"), F.col("id").isNull().alias("n"), F.col("id").alias("id"), F.monotonically_increasing_id().alias("r")).alias("rank"),
        ),
        "rows",
    )
    entry = [F.count(F.lit(1)).alias("group_size"), F.min("rank").alias("best")]
    index = Index(stored(rows.groupBy(*ENTRY).agg(*entry), "entries"), capacity)

    repeated = index.entries.filter("group_size > 1").select("bucket", *ENTRY, "group_size")
    contested = index.answer(rows, repeated, []).drop("group_size")
    chain = stored(
        index.placed(contested.groupBy(*ENTRY, "norm").agg(*entry))
        .withColumn("links", F.count(F.lit(1)).over(Window.partitionBy("bucket", *ENTRY)))
        .select("bucket", *ENTRY, "group_size", "best", "links", F.when(F.col("links") > 1, F.col("norm")).alias("norm")),
        "chain",
    )
    alone = index.entries.filter("group_size = 1").select("best.id", F.col("best").alias("rank"), *ENTRY, "group_size", "best")
    thin = rows.select("id", "rank", *ENTRY)
    out = alone.unionByName(index.answer(thin, chain.filter("links = 1").drop("links", "norm"), []))
    if not chain.filter("links > 1").isEmpty():
        split = chain.filter("links > 1").drop("links")
        out = out.unionByName(index.answer(rows, split, ["norm"]).drop("norm"))
    return out.select(
        F.col("id").alias(key), F.col("best.id").alias("keep_id"), "group_size",
        (F.col("rank.r") == F.col("best.r")).alias("kept"), F.col("sha").alias("text_sha256"),
    )
