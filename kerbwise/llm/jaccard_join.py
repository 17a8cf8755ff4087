"""N-gram Jaccard self-join of documents, reported as linked components.

Index lists over word shingles with two kinds of skipping. Lists are cut into blocks by set size and
position of the shingle in the set; block pairs that cannot reach the similarity are skipped whole.
And a set's answers are taken over from a highly similar set's: every list is first answered for a few
pivot sets, sets already linked to each other are skipped together from then on, and two sets whose
distances to a common pivot differ too much are skipped by the triangle inequality.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbwise.llm import words as W
from kerbwise.llm.store import small, stored, tasks

_U = np.uint64
#: Part of the hash space whose shingles are counted; the others come after them in the order of a set.
COUNTED = int(0.4 * 2**64)
#: A shingle in this share of all sets is common: it comes last in the order and is not counted by list.
#: At most 1 / COMMON times the mean set size of shingles can be common.
COMMON = 0.02
#: Shingles that a worker holds before it hands them on, some 60 bytes each while they are sorted.
FLUSH = 1_000_000
POSITIONS = 16
PIVOTS = 8
CLOSE, FAMILY_BLOCK = 0.6, 512
#: Shingles of two blocks that a worker sorts at a time, some 70 bytes each.
AT_ONCE = 1 << 18


def pack(values: np.ndarray) -> bytes:
    """64-bit numbers as eight byte planes; planes of small or ordered numbers are runs that compress."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(_U).reshape(-1)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=_U(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=_U)


def set_ids(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64-bit identity of each set: equal sets, and only those but for hash collisions, share it."""
    total = np.zeros(len(values) + 1, _U)
    np.cumsum(W.mix(values + _U(0x5851F42D4C957F2D)), out=total[1:])
    return W.mix((total[bounds[1:]] - total[bounds[:-1]]) ^ (np.diff(bounds).astype(_U) * _U(0xD6E8FEB86659FD93)))


def _set_batches(batches: Iterator[pa.RecordBatch], k: int):
    """Per chunk: keys, set ids, sorted shingles, bounds."""
    for batch in batches:
        for w in W.words(batch.column(1), lower=True):
            values, bounds = W.shingle_sets(w, k)
            yield batch.column(0).slice(w.first, len(w)), set_ids(values, bounds), values, bounds


def describe_sets(docs: DataFrame, k: int, key: str, text: str) -> DataFrame:
    """Rows of two kinds: a document (id, n, set_id), and a shingle (token, seen) common in one task."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        tokens, held, sets = [], 0, 0

        def common():
            value, count = np.unique(np.concatenate(tokens), return_counts=True)
            often = count >= max(8, COMMON * sets)
            n = int(often.sum())
            return pa.RecordBatch.from_arrays(
                [pa.nulls(n, id_type), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(value[often].view(np.int64)), pa.array(count[often].astype(np.int64))],
                ["id", "n", "set_id", "token", "seen"],
            )

        for keys, ids, values, bounds in _set_batches(batches, k):
            id_type, m = keys.type, len(ids)
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(np.diff(bounds).astype(np.int64)), pa.array(ids.view(np.int64)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())],
                ["id", "n", "set_id", "token", "seen"],
            )
            tokens.append(values[values < _U(COUNTED)])
            held, sets = held + len(tokens[-1]), sets + m
            if held > FLUSH:
                yield common()
                tokens, held, sets = [], 0, 0
        if held:
            yield common()

    return docs.select(key, text).mapInArrow(W.tidy(run), f"id {kind}, n long, set_id long, token long, seen long")


def common_tokens(described: DataFrame) -> np.ndarray:
    """Sorted shingles of a share of all sets of at least COMMON. Their number is bounded by the mean set size."""
    sets = described.filter("set_id is not null").count()
    seen = described.filter("token is not null").groupBy("token").agg(F.sum("seen").alias("seen"))
    found = seen.filter(F.col("seen") >= max(64, int(COMMON * sets))).select("token").toArrow().column(0)
    return np.sort(found.combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64).view(_U)) if len(found) else np.zeros(0, _U)


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return np.where(n > 0, n + (-percent * n // 100) + 1, 0)


def _tokens_by_bucket(k: int, percent: int, common: np.ndarray, buckets: int, parts: int):
    """Map side: counted shingles with their sets, by ranges of the hash; and what a set is known by."""
    step = _U(COUNTED // buckets + 1)
    schema = pa.schema([("bucket", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary()), ("kind", pa.int32())])

    def flush(tokens, owners, facts):
        token, owner = np.concatenate(tokens), np.concatenate(owners)
        order = np.lexsort((owner, token))
        token, owner = token[order], owner[order]
        keep = np.ones(len(token), bool)
        keep[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
        token, owner = token[keep], owner[keep]
        edge = np.searchsorted(token // step, np.arange(buckets + 1, dtype=_U))
        rows = [(b, pack_sorted(token[i:j]), pack(owner[i:j]), b"", b"", 0) for b, (i, j) in enumerate(zip(edge[:-1], edge[1:])) if j > i]
        ids = np.concatenate([f[0] for f in facts])
        _, once = np.unique(ids, return_index=True)
        n, a, tail = (np.concatenate([f[i] for f in facts]) for i in (1, 2, 3))
        tails = np.concatenate([f[4] for f in facts])
        start = np.cumsum(tail) - tail
        part = (ids[once] % _U(parts)).astype(np.int64)
        for b in np.unique(part):
            own = once[part == b]
            rest = np.concatenate([tails[start[i] : start[i] + tail[i]] for i in own])
            rows.append((buckets + int(b), pack(ids[own]), pack(np.stack([n[own], a[own]]).astype(_U).reshape(-1)), pack(tail[own].astype(_U)), pack(rest), 1))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches):
        tokens, owners, facts, held = [], [], [], 0
        for _, ids, values, bounds in _set_batches(batches, k):
            n = np.diff(bounds)
            counted = values < _U(COUNTED)
            often = np.zeros(len(values), bool)
            if len(common):
                often = common[np.minimum(np.searchsorted(common, values), len(common) - 1)] == values
            light = counted & ~often
            upto = np.r_[0, np.cumsum(light)]
            a = upto[bounds[1:]] - upto[bounds[:-1]]
            tail = np.maximum(prefix_length(n, percent) - a, 0)
            tails = [np.zeros(0, _U)]
            for i in np.flatnonzero(tail):
                v, c, o = (x[bounds[i] : bounds[i + 1]] for x in (values, counted, often))
                tails.append(np.concatenate([v[~c], v[c & o]])[: tail[i]])
            tokens.append(values[light])
            owners.append(np.repeat(ids, n)[light])
            facts.append((ids, n, a, tail, np.concatenate(tails)))
            held += len(tokens[-1]) + len(ids)
            if held > FLUSH:
                yield flush(tokens, owners, facts)
                tokens, owners, facts, held = [], [], [], 0
        if facts:
            yield flush(tokens, owners, facts)

    return run


def _count_tokens(buckets: int, parts: int):
    """Per range of the hash: how many sets hold each shingle; those of at least two go on to their sets."""
    schema = pa.schema([("bucket", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary()), ("kind", pa.int32())])

    def run(table: pa.Table) -> pa.Table:
        first = table.column("bucket")[0].as_py()
        if first >= buckets:
            return table.set_column(0, "bucket", pa.array([first - buckets] * len(table), pa.int32()))
        token = np.concatenate([unpack_sorted(x.as_py()) for x in table.column("a")])
        owner = np.concatenate([unpack(x.as_py()) for x in table.column("b")])
        order = np.lexsort((owner, token))
        token, owner = token[order], owner[order]
        keep = np.ones(len(token), bool)
        keep[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
        token, owner = token[keep], owner[keep]
        start = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        df = np.diff(np.r_[start, len(token)])
        df = np.repeat(df, df)
        token, owner, df = token[df > 1], owner[df > 1], df[df > 1]
        part = (owner % _U(parts)).astype(np.int64)
        order = np.lexsort((token, part))
        token, owner, df, part = token[order], owner[order], df[order], part[order]
        edge = np.searchsorted(part, np.arange(parts + 1))
        rows = [
            (b, pack_sorted(token[i:j]), pack(owner[i:j]), pack(df[i:j].astype(_U)), b"", 0)
            for b, (i, j) in enumerate(zip(edge[:-1], edge[1:])) if j > i
        ]
        return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    return run


def _choose_prefix(percent: int):
    """Per range of sets: order each set's shingles (rarest first) and keep the prefix as index postings."""
    schema = pa.schema([("token", pa.int64()), ("set_id", pa.int64()), ("n", pa.int64()), ("pos", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        columns = {c: table.column(c).to_pylist() for c in ("a", "b", "c", "d", "kind")}
        rows = list(zip(*columns.values()))
        facts = [r for r in rows if r[4] == 1]
        ids, once = np.unique(np.concatenate([unpack(r[0]) for r in facts]), return_index=True)
        n, a = (np.concatenate([unpack(r[1]).reshape(2, -1)[i] for r in facts]).astype(np.int64)[once] for i in (0, 1))
        tail_all = np.concatenate([unpack(r[2]) for r in facts]).astype(np.int64)
        tails, start = np.concatenate([unpack(r[3]) for r in facts]), np.cumsum(tail_all) - tail_all
        tail, start = tail_all[once], start[once]
        p = prefix_length(n, percent)
        lists = [r for r in rows if r[4] == 0]
        token = np.concatenate([np.zeros(0, _U), *[unpack_sorted(r[0]) for r in lists]])
        owner = np.searchsorted(ids, np.concatenate([np.zeros(0, _U), *[unpack(r[1]) for r in lists]]))
        df = np.concatenate([np.zeros(0, _U), *[unpack(r[2]) for r in lists]])
        order = np.lexsort((token, df, owner))
        token, owner = token[order], owner[order]
        got = np.bincount(owner, minlength=len(ids))
        pos = np.arange(len(owner)) - (np.cumsum(got) - got)[owner] + (a - got)[owner]
        inside = pos < p[owner]
        token, owner, pos = token[inside], owner[inside], pos[inside]
        own = np.repeat(np.arange(len(ids)), tail)
        within = np.arange(len(own)) - np.repeat(np.cumsum(tail) - tail, tail)
        token = np.concatenate([token, tails[start[own] + within]])
        pos = np.concatenate([pos, a[own] + within])
        owner = np.concatenate([owner, own])
        return pa.table([pa.array(x.astype(np.int64) if x.dtype != _U else x.view(np.int64)) for x in (token, ids[owner], n[owner], pos)], schema=schema)

    return run


def index_lists(docs: DataFrame, k: int, percent: int, common: np.ndarray, text: str) -> DataFrame:
    """Postings (token, set_id, n, pos) of the lists with at least two sets. Two sets that reach the
    similarity share a shingle of both their prefixes, so they meet in a list."""
    parts = tasks(docs.sparkSession)
    buckets = 2 * parts
    blob = "bucket int, a binary, b binary, c binary, d binary, kind int"
    sent = docs.select(F.lit(None).cast("int").alias("_"), text).mapInArrow(W.tidy(_tokens_by_bucket(k, percent, common, buckets, parts)), blob)
    counted = sent.groupBy("bucket").applyInArrow(W.tidy_group(_count_tokens(buckets, parts)), blob)
    postings = stored(counted.groupBy("bucket").applyInArrow(W.tidy_group(_choose_prefix(percent)), "token long, set_id long, n long, pos long"), "postings")
    shared = postings.groupBy("token").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("token")
    return stored(postings.join(shared, "token", "left_semi"), "lists")


def set_table(docs: DataFrame, wanted: DataFrame, k: int, text: str) -> DataFrame:
    """Shingles of the sets with a posting: set_id, tokens."""

    def run(batches):
        for _, ids, values, bounds in _set_batches(batches, k):
            yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))], ["set_id", "tokens"])

    sets = docs.select(F.lit(None).cast("int").alias("_"), text).mapInArrow(W.tidy(run), "set_id long, tokens array<long>")
    return stored(sets.join(small(wanted), "set_id", "left_semi").groupBy("set_id").agg(F.first("tokens").alias("tokens")), "sets")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Exact similarity of each pair (a, b): a, b, distance, linked."""
    one = sets.select(F.col("set_id").alias("a"), F.col("tokens").alias("ta"))
    two = sets.select(F.col("set_id").alias("b"), F.col("tokens").alias("tb"))
    both = pairs.join(two, "b").join(one, "a")
    both = both.withColumn("common", F.size(F.array_intersect("ta", "tb"))).withColumn("union", F.size("ta") + F.size("tb") - F.col("common"))
    return stored(both.select("a", "b", (1 - F.col("common") / F.col("union")).alias("distance"), (100 * F.col("common") >= percent * F.col("union")).alias("linked")), "verified")


def merge(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(set_id, comp) after joining the components that the links (a, b) connect. Labels of neighbours
    are minimised and then followed, so that chains halve in every pass."""
    one = labels.select(F.col("set_id").alias("a"), F.col("comp").alias("ca"))
    two = labels.select(F.col("set_id").alias("b"), F.col("comp").alias("cb"))
    edges = links.join(one, "a").join(two, "b").filter("ca != cb").select(F.least("ca", "cb").alias("u"), F.greatest("ca", "cb").alias("v")).distinct()
    edges = stored(edges, "edges")
    if edges.isEmpty():
        return labels
    both = stored(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "edges")
    now = stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("label")), "labels")
    while True:
        near = both.join(now.select(F.col("u").alias("v"), F.col("label").alias("l")), "v").groupBy("u").agg(F.min("l").alias("l"))
        lowered = now.join(near, "u").select("u", "label", F.least("label", "l").alias("l"))
        jump = now.select(F.col("u").alias("l"), F.col("label").alias("further"))
        after = stored(lowered.join(jump, "l").select("u", F.least("l", "further").alias("label"), (F.least("l", "further") != F.col("label")).alias("moved")), "labels")
        if after.filter("moved").isEmpty():
            break
        now = after.drop("moved")
    comps = small(now.select(F.col("u").alias("comp"), "label"))
    return stored(labels.join(comps, "comp", "left").select("set_id", F.coalesce("label", "comp").alias("comp")), "comps")


def _possible(percent: int, n1, p1, n2, p2):
    """Whether two sets can reach the similarity when their first common shingle is at these positions."""
    need = F.ceil((n1 + n2) * percent / (100 + percent))
    return (F.least(n1 - p1, n2 - p2) >= need) & (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2))


def components(lists: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(set_id, comp) for the sets with postings: components of the links between them.

    Each round answers the open lists (those with sets of several components) for PIVOTS of their sets. Rounds
    go on while they leave at most three quarters of the pairs across components; then, or when few are left,
    all of those are answered.
    """
    labels = stored(lists.select("set_id").distinct().select("set_id", F.col("set_id").alias("comp")), "comps")
    done, rows, before = None, lists, None
    for step in count():
        placed = rows.join(small(labels), "set_id")
        held = placed.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("c"))
        shape = held.groupBy("token").agg(F.sum("c").alias("s"), F.sum(F.col("c").cast("double") * F.col("c")).alias("q"), F.count(F.lit(1)).alias("comps"))
        open_ = stored(shape.filter("comps > 1"), "open")  # lists within one component are answered
        across, postings = open_.agg(F.sum((F.col("s").cast("double") * F.col("s") - F.col("q")) / 2), F.sum("s")).first()
        if not postings:
            return labels
        rows = stored(placed.join(open_.select("token"), "token", "left_semi"), "rows")
        if across <= 2 * postings or (before is not None and across > 0.75 * before):
            break
        order = Window.partitionBy("token").orderBy(F.xxhash64("set_id", F.lit(step)), "set_id")
        pivots = rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= PIVOTS)
        pivots = pivots.select("token", *[F.col(c).alias(f"p_{c}") for c in ("set_id", "n", "pos", "comp")])
        near = rows.join(pivots, "token").filter((F.col("comp") != F.col("p_comp")) & _possible(percent, F.col("n"), F.col("pos"), F.col("p_n"), F.col("p_pos")))
        pairs = near.select(F.least("p_set_id", "set_id").alias("a"), F.greatest("p_set_id", "set_id").alias("b")).distinct()
        if done is not None:
            pairs = pairs.join(done.select("a", "b"), ["a", "b"], "left_anti")
        answers = verified(pairs, sets, percent)
        done = answers if done is None else done.unionByName(answers)
        labels, before = merge(labels, answers.filter("linked")), across
        rows = rows.select("token", "set_id", "n", "pos")
    if done is None:
        return merge(labels, verified(_across(rows, None, None, percent), sets, percent).filter("linked"))
    families = _families(rows, done, labels)
    inside = _family_links(families, sets, percent)
    across = verified(_across(rows, done, families, percent), sets, percent).filter("linked")
    return merge(labels, inside.unionByName(across.select("a", "b")))


def _families(rows: DataFrame, done: DataFrame, labels: DataFrame) -> DataFrame:
    """(set_id, family, comp): each open set joins, of itself and the sets it was compared with and is close to,
    the one compared most, so that a large group of similar sets has one pivot."""
    close = done.filter(F.col("distance") <= CLOSE)
    both = stored(close.select(F.col("a").alias("set_id"), F.col("b").alias("other")).unionByName(close.select(F.col("b").alias("set_id"), F.col("a").alias("other"))), "close")
    degree = stored(both.groupBy("set_id").agg(F.count(F.lit(1)).alias("degree")), "degree")
    seen = both.join(small(degree.withColumnRenamed("set_id", "other")), "other").select("set_id", "other", "degree")
    own = degree.select("set_id", F.col("set_id").alias("other"), "degree")
    chosen = seen.unionByName(own).groupBy("set_id").agg(F.max(F.struct("degree", "other")).alias("best")).select("set_id", F.col("best.other").alias("family"))
    needed = rows.select("set_id").distinct()
    return stored(chosen.join(needed, "set_id", "left_semi").join(small(labels), "set_id"), "families")


def _shared_tokens(lists: pa.ChunkedArray, most: int = AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Shingles that several rows of ``lists`` hold, numbered from 0, and their rows: one range of the hash after the other, of
    about ``most`` shingles, so that those of all rows are never sorted or copied at once."""
    parts, row = [], 0
    for chunk in lists.chunks:
        ends = np.cumsum(pa.compute.list_value_length(chunk).to_numpy(zero_copy_only=False))
        parts.append((chunk.flatten().to_numpy(zero_copy_only=False).view(_U), ends, row))
        row += len(chunk)
    bits = (sum(len(values) for values, _, _ in parts) // most).bit_length()
    for place in range(1 << bits):
        tokens, owners = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
        for values, ends, start in parts:
            at = np.flatnonzero(values >> _U(64 - bits) == _U(place)) if bits else np.arange(len(values))
            tokens.append(values[at])
            owners.append(start + np.searchsorted(ends, at, "right"))
        token, owner = np.concatenate(tokens), np.concatenate(owners)
        _, token, seen = np.unique(token, return_inverse=True, return_counts=True)
        shared = seen[token] > 1
        yield np.unique(token[shared], return_inverse=True)[1], owner[shared]


def _family_links(families: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between sets of one family and different components, one for each pair of components met in a task.

    A set is given by its difference to the pivot, and what two sets share follows from what the pivot shares with
    each: |x & y| = |p| - |p - x| - |p - y| + |(x ^ p) & (y ^ p)|. Only differences move, FAMILY_BLOCK sets to a block,
    and a task compares two blocks; families of any size split into blocks.
    """
    blocks = small(stored(families.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / FAMILY_BLOCK).cast("int").alias("blocks")), "blocks"))
    pivot = sets.select(F.col("set_id").alias("family"), F.col("tokens").alias("base"))
    own = families.join(sets, "set_id").join(pivot, "family").join(blocks, "family")
    missing = F.array_except("base", "tokens")
    own = own.select(
        "family", "set_id", "comp", F.size("tokens").alias("n"), F.size("base").alias("p"), F.size(missing).alias("m"),
        F.concat(missing, F.array_except("tokens", "base")).alias("difference"),
        F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"),
    )
    own = own.withColumns({"one": F.least("block", "other"), "two": F.greatest("block", "other")}).drop("other")

    def run(table: pa.Table) -> pa.Table:
        get = lambda name: table.column(name).combine_chunks().to_numpy(zero_copy_only=False)
        ids, comp, n, m, p, block = (get(c).astype(np.int64) for c in ("set_id", "comp", "n", "m", "p", "block"))
        first, second = get("one")[0], get("two")[0]
        x, y = np.flatnonzero(block == first), np.flatnonzero(block == second)
        common = np.zeros((len(x), len(y)), np.float32)
        for token, owner in _shared_tokens(table.column("difference")):
            for low in range(0, int(token.max(initial=-1)) + 1, 4096):
                part = (token >= low) & (token < low + 4096)
                held = np.zeros((len(ids), 4096), np.float32)
                held[owner[part], token[part] - low] = 1
                common += held[x] @ held[y].T
        inter = p[0] - m[x][:, None] - m[y][None, :] + common.astype(np.int64)
        linked = 100 * inter >= percent * (n[x][:, None] + n[y][None, :] - inter)
        i, j = np.nonzero(linked & (comp[x][:, None] != comp[y][None, :]))
        a, b = x[i], y[j]
        _, once = np.unique(np.stack([comp[a], comp[b]]), axis=1, return_index=True)
        return pa.table([pa.array(ids[a[once]]), pa.array(ids[b[once]])], ["a", "b"])

    return stored(own.groupBy("family", "one", "two").applyInArrow(W.tidy_group(run), "a long, b long"), "links")


def _across(rows: DataFrame, done: DataFrame | None, families: DataFrame | None, percent: int) -> DataFrame:
    """Pairs (a, b) of different components and families that the lists leave possible and no pivot has answered."""
    rows = rows.select("token", "set_id", "n", "pos", "comp")
    if done is None:
        rows = rows.withColumns({"pivot": F.lit(None).cast("long"), "away": F.lit(None).cast("double"), "family": F.lit(None).cast("long")})
    else:
        both = done.select(F.col("a").alias("set_id"), F.col("b").alias("a"), "distance").unionByName(done.select(F.col("b").alias("set_id"), "a", "distance"))
        near = stored(both.groupBy("set_id").agg(F.min(F.struct("distance", "a")).alias("near")), "near")
        rows = rows.join(near, "set_id", "left").select("token", "set_id", "n", "pos", "comp", F.col("near.a").alias("pivot"), F.col("near.distance").alias("away"))
        rows = rows.join(small(families.select("set_id", "family")), "set_id", "left")
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)))
    rows = stored(rows.withColumn("block", F.struct(band.alias("band"), F.floor(F.col("pos") / POSITIONS).alias("at"))), "blocks")
    blocks = stored(
        rows.groupBy("token", "block").agg(
            F.min("n").alias("n0"), F.max("n").alias("n1"), F.min("pos").alias("p0"), F.min("comp").alias("c0"), F.max("comp").alias("c1")
        ),
        "heads",
    )
    left, right = (blocks.select("token", *[F.col(c).alias(f"{side}_{c}") for c in ("block", "n0", "n1", "p0", "c0", "c1")]) for side in ("l", "r"))
    need = F.ceil((F.col("l_n0") + F.col("r_n0")) * percent / (100 + percent))
    kept = left.join(right, "token").filter(
        (F.col("l_block") <= F.col("r_block"))
        & (F.least(F.col("l_n1") - F.col("l_p0"), F.col("r_n1") - F.col("r_p0")) >= need)
        & (100 * F.col("l_n1") >= percent * F.col("r_n0")) & (100 * F.col("r_n1") >= percent * F.col("l_n0"))
        & ~((F.col("l_c0") == F.col("l_c1")) & (F.col("r_c0") == F.col("r_c1")) & (F.col("l_c0") == F.col("r_c0")))
    )
    x, y = (rows.select("token", *[F.col(c).alias(f"{side}_{c}") for c in ("block", "set_id", "n", "pos", "comp", "pivot", "away", "family")]) for side in ("l", "r"))
    pairs = kept.select("token", "l_block", "r_block").join(x, ["token", "l_block"]).join(y, ["token", "r_block"]).filter(
        (F.col("l_comp") != F.col("r_comp"))
        & ~F.coalesce(F.col("l_family") == F.col("r_family"), F.lit(False))
        & ((F.col("l_block") != F.col("r_block")) | (F.col("l_set_id") < F.col("r_set_id")))
        & _possible(percent, F.col("l_n"), F.col("l_pos"), F.col("r_n"), F.col("r_pos"))
        & ~F.coalesce((F.col("l_pivot") == F.col("r_pivot")) & (F.abs(F.col("l_away") - F.col("r_away")) > 1 - percent / 100 + 1e-9), F.lit(False))
    )
    pairs = pairs.select(F.col("l_set_id").alias("a"), F.col("r_set_id").alias("b"))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    if done is not None:
        pairs = pairs.join(done.select("a", "b"), ["a", "b"], "left_anti")
    return stored(pairs, "pairs")


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``key``, n_shingles, component_id.

    A set holds the distinct k-word shingles of the whole text (A-Z folded); a shorter text is one shingle, a
    text without words or null has the empty set and is linked with nothing. Two rows link when 100 * common >=
    percent * union; component_id is the smallest key reachable by links (its own for an empty set; null only
    if all keys of a component are). Rows with equal sets, repeated rows among them, are one set in the join.
    An empty table gives an empty result; other columns are not read. Shingles and sets are compared as
    64-bit hashes.
    """
    described = stored(describe_sets(docs, k, key, text), "described")
    lists = index_lists(docs, k, percent, common_tokens(described), text)
    rows = described.filter("set_id is not null").select("id", "n", "set_id")
    in_lists = stored(lists.select("set_id").distinct(), "wanted")
    sets = set_table(docs, in_lists, k, text)
    comps = components(lists, sets, percent)
    joined = rows.join(small(comps), "set_id", "left").withColumn("comp", F.coalesce("comp", "set_id"))
    least = stored(joined.filter("n > 0").groupBy("comp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("comp", "least"), "least")
    out = stored(joined, "joined").join(small(least), "comp", "left")
    own = F.when(F.col("n") > 0, F.coalesce("least", "id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), own.alias("component_id"))
