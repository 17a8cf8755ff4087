"""Sharding: minimax contiguous partition of atomic groups. DataFrame functions only.

The greedy check of a capacity runs on bounded histograms of the ordered groups: a few thousand
blocks at first, then, near the possible cuts only, ever finer ones down to single groups.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbwise.llm.store import ordered_sums, stored

BLOCKS, FINER_BITS = 4096, 6


def cuts(edges: list[int], total: int, capacity: int, shards: int, slack: list[bool] | None = None) -> list[int] | None:
    """Greedy cut points when no shard may hold more than ``capacity``; None if ``shards`` are too few.

    ``edges`` are the ordered places where a cut is known to be allowed. With ``slack``, a cut may also
    lie anywhere between edge i and the next where slack[i] is set: what a finer look could allow at best.
    """
    at, found = 0, []
    for _ in range(shards):
        reach = at + capacity
        if reach >= total:
            return found
        i = bisect_right(edges, reach) - 1
        nxt = reach if slack and slack[i] else edges[i]
        if nxt <= at:
            return None
        found.append(nxt)
        at = nxt
    return None


def smallest(edges: list[int], total: int, shards: int, slack: list[bool] | None = None) -> int:
    """Binary search for the smallest feasible capacity."""
    low, high = -(-total // shards), total
    while low < high:
        middle = (low + high) // 2
        if cuts(edges, total, middle, shards, slack) is None:
            low = middle + 1
        else:
            high = middle
    return low


def spread(edges: list[int], total: int, capacity: int, shards: int) -> list[int]:
    """Cuts at ``edges`` such that no shard is above ``capacity`` and the smallest shard is as large as it can be then;
    of those the cuts nearest to even places. No shard is empty, and only with fewer edges than shards are there fewer shards.

    ``capacity`` must be feasible. A further binary search finds the size of the smallest shard: its check keeps, for each cut, the
    edges that whole shards between the two sizes can reach.
    """
    shards = min(shards, len(edges))

    def any_between(places: list[int], low: int, high: int) -> bool:
        i = bisect_left(places, low)
        return i < len(places) and places[i] <= high

    def reachable(least: int) -> list[list[int]] | None:
        found = [[0]]
        for i in range(1, shards):
            before, after = found[-1], shards - i
            low = max(before[0] + least, total - after * capacity)
            high = min(before[-1] + capacity, total - after * least)
            open_ = edges[bisect_left(edges, low) : bisect_right(edges, high)]
            found.append([e for e in open_ if any_between(before, e - capacity, e - least)])
            if not found[-1]:
                return None
        return found if any_between(found[-1], total - capacity, total - least) else None

    low, high = 1, total // shards
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if reachable(middle) else (low, middle - 1)
    places, at, chosen = reachable(low), total, []
    for i in range(shards - 1, 0, -1):
        fitting = [e for e in places[i] if at - capacity <= e <= at - low]
        at = min(fitting, key=lambda e: (abs(e * shards - i * total), e))
        chosen.append(at)
    return chosen[::-1]


def minimax_cuts(groups: DataFrame, total: int, shards: int) -> list[int]:
    """Starts of shards 1, 2, ... in the running sum of sizes: the cut with the smallest largest shard, spread evenly within it.

    ``groups``: start (sum of the sizes before it in the order) and bytes (at least 1) of each atomic group.
    What reaches the driver is a histogram: at most 2 * BLOCKS cells, then 2 ** FINER_BITS cells for each block near a cut.
    """

    def histogram(rows: DataFrame, bits: int) -> dict[int, tuple[int, int]]:
        """First group of each cell of 2 ** bits bytes, with the cell's number of groups and its bits."""
        cells = rows.groupBy(F.shiftright("start", bits).alias("c")).agg(F.min("start").alias("start"), F.count(F.lit(1)).alias("n"))
        return {r["start"]: (r["n"], bits) for r in cells.collect()}

    edges = histogram(groups, max(0, (total // BLOCKS).bit_length() - 1))
    while True:
        starts = sorted(edges)
        slack = [edges[s][0] > 1 for s in starts]
        best = smallest(starts, total, shards)
        least = smallest(starts, total, shards, slack)
        ranges = list(zip(*cuts_within(starts, total, least, best, shards, slack)))
        ends = [*starts[1:], total]
        near = [s for s, e, open_ in zip(starts, ends, slack) if open_ and any(a <= e and s <= b for a, b in ranges)]
        if not near:
            return spread(starts, total, best, shards)
        for bits in {edges[s][1] for s in near}:
            cells = [s >> bits for s in near if edges[s][1] == bits]
            wanted = F.broadcast(groups.sparkSession.createDataFrame([(c,) for c in cells], "c long"))  # a bounded number of blocks
            inside = groups.withColumn("c", F.shiftright("start", bits)).join(wanted, "c", "left_semi")
            finer = histogram(inside, max(0, bits - FINER_BITS))
            edges = {s: v for s, v in edges.items() if v[1] != bits or s >> bits not in set(cells)} | finer


def cuts_within(edges: list[int], total: int, least: int, most: int, shards: int, slack: list[bool]) -> tuple[list[int], list[int]]:
    """For each cut, the range in which it lies for every capacity from ``least`` to ``most``."""
    at_low, at_high, low, high = 0, 0, [], []
    for _ in range(shards - 1):
        i = bisect_right(edges, min(at_low + least, total)) - 1
        at_low = max(edges[i], at_low)
        j = bisect_right(edges, min(at_high + most, total)) - 1
        at_high = min(at_high + most, total) if slack[j] else edges[j]
        low.append(at_low)
        high.append(max(at_high, at_low))
    return low, high


def oversized(groups: DataFrame, total: int, shards: int) -> list[str]:
    """Groups larger than an even share of what is left; each takes a shard of its own. Fewer than ``shards``."""
    found, left = [], total
    for r in groups.orderBy(F.desc("bytes"), "_first").limit(shards - 1).select("_sha", "bytes").collect():
        if r["bytes"] * (shards - len(found)) <= left:
            break
        found.append(r["_sha"])
        left -= r["bytes"]
    return found


def shard(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """Put every row into shards 0 .. shards - 1 of nearly equal bytes: ``key``, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``bytes``. Size is the UTF-8 length plus 1 (null text: 1, checksum 0). Rows with equal texts
    (null as empty) form an atomic group and share a shard. A group above an even share of the bytes gets a
    shard of its own, largest first; of all contiguous partitions of the other groups, in order of their
    smallest key (null last), the largest shard is smallest; within that size the smallest shard is as large as cuts at the
    histogram's cells allow, and no shard is empty while there are as many groups as shards. Slots number the rows of a shard from 0 without
    gaps, by group and key; rows that repeat a key and text get slots of their own. An empty table gives an
    empty result. With ``keep`` the other columns of ``docs`` are returned too, except those named like a
    result column.
    """
    content = F.coalesce(text, F.lit(""))
    columns = [
        F.col(key).alias("_id"), (F.octet_length(content) + F.lit(1)).cast("long").alias("_size"),
        F.crc32(content.cast("binary")).alias("_crc"), F.sha2(content, 256).alias("_sha"),
    ]
    results = {key, "size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    others = [c for c in docs.columns if c not in results]
    carried = [F.struct(*[F.col(f"`{c}`") for c in others]).alias("_row")] if keep and others else []
    rows = stored(docs.select(*columns, *carried, F.monotonically_increasing_id().alias("_r")), "rows")

    first = F.min(F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("id"), F.col("_r").alias("r"))).alias("_first")
    sized = stored(rows.groupBy("_sha").agg(first, F.sum("_size").alias("bytes"), F.count(F.lit(1)).alias("n")), "sizes")
    total = sized.agg(F.sum("bytes")).first()[0] or 0
    large = oversized(sized, total, shards) if total else []
    lead = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in large]), F.col("_sha")), F.lit(0)) if large else F.lit(0)
    lead = F.when(lead == 0, F.lit(len(large))).otherwise(lead - 1).cast("int")
    sums = {"start": F.col("bytes"), "before": F.col("n")}
    groups = stored(ordered_sums(sized.withColumn("_lead", lead), ["_lead", "_first"], sums, "ordered"), "groups")

    rest = groups.filter(F.col("_lead") == len(large))
    edge = [r["start"] for r in groups.filter(F.col("_lead") < len(large)).orderBy("_lead").collect()]  # fewer than shards
    base, size = rest.agg(F.min("start"), F.sum("bytes")).first()
    if size:
        shifted = rest.withColumn("start", F.col("start") - base)
        edge += [base, *[base + s for s in minimax_cuts(shifted, size, shards - len(large))]]
    at = F.array(*[F.lit(s).cast("long") for s in edge])
    placed = groups.withColumn("shard", F.size(F.filter(at, lambda s: s <= F.col("start"))) - 1)
    firsts = F.broadcast(placed.groupBy("shard").agg(F.min("before").alias("_base")))  # one row a shard

    grouped = placed.join(firsts, "shard").select("_sha", "_lead", "_first", "shard", "_base")
    order = ["_lead", "_first", F.col("_id").isNull(), "_id", "_r"]
    thin = ordered_sums(rows.drop("_row").join(grouped, "_sha"), order, {"_place": F.lit(1)}, "placed")
    out = thin.join(rows.select("_r", "_row"), "_r") if carried else thin
    return out.select(
        F.col("_id").alias(key), *([F.col(f"_row.`{c}`").alias(c) for c in others] if carried else []),
        F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("_place") - F.col("_base")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
