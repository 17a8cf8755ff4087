"""Alignment of two tokenizers' tokens over the same bytes, and corpus counts of the id pairs they link.

Arrow from end to end: token lists are flattened with the index of their document, lengths summed to ends per document, the
ends of both tokenizers joined by Acero on document-end keys, and pairs counted by ``Table.group_by``. What a task has counted
are partial counts, which Spark adds up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbwise.llm import encoding
from kerbwise.llm.store import stored

#: Different id pairs that a task counts before it hands its counts on; their number never changes a result.
PARTIAL_PAIRS = 1_000_000
#: Pairs whose totals travel to every task: those with the largest counts. The others are few links each and are joined by
#: a shuffle.
TABLE_PAIRS = 500_000


# One batch ------------------------------------------------------------------


def token_lists(byte_path: str, piece_path: str, texts: list[bytes]) -> list[pa.ListArray]:
    return [pa.ListArray.from_arrays(pa.array(at), pa.array(ids)) for ids, at in encoding.held_pair(byte_path, piece_path).both(texts)]


def spells(ids: pa.ListArray, token_bytes: pa.Array, texts: list[bytes]) -> np.ndarray:
    """Whether the bytes of a document's tokens, joined, are a blank and its text."""
    flat = pc.take(token_bytes, ids.values)
    _, offsets, data = flat.buffers()
    at = np.frombuffer(offsets, np.int32, len(flat) + 1)[np.asarray(ids.offsets)]
    data = memoryview(data).cast("B") if data is not None else memoryview(b"")
    return np.array([bool(t) and data[i:j] == b" " + t for i, j, t in zip(at[:-1], at[1:], texts)], bool)


def kept_lists(ids: pa.ListArray, good: np.ndarray) -> pa.ListArray:
    """The lists with those of other documents emptied."""
    if good.all():
        return ids
    lists = [ids[i].values if g else pa.array([], pa.int32()) for i, g in enumerate(good)]
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)]), pa.int32()), pa.concat_arrays(lists) if lists else pa.array([], pa.int32()))


def ends(ids: pa.ListArray, sizes: pa.Array, starts: pa.Array, side: str) -> pa.Table:
    """Tokens one after another: document-end key and place among all. The key is the end of the token in its document, a
    segmented cumulative sum of lengths, behind the start that all tokens of the document share on either side."""
    doc, run = pc.list_parent_indices(ids), pc.cumulative_sum(pc.take(sizes, pc.list_flatten(ids)))
    before = pc.take(pa.concat_arrays([pa.array([0], pa.int64()), run]), ids.offsets.slice(0, len(ids)))
    end = pc.subtract(run, pc.take(pc.subtract(before, starts), doc))
    return pa.table({"key": end, side: pa.array(np.arange(len(doc), dtype=np.int32))})


def align(a: pa.ListArray, b: pa.ListArray, size_a: pa.Array, size_b: pa.Array, starts: pa.Array) -> pa.Table:
    """One row per link, in order: doc, a, b (places among all tokens of a side) and ``both``, whether both tokens end with it.

    ``starts`` has a number for each document, larger by more than its bytes for the next. Between two neighbouring
    ends of either side lies one stretch of bytes, covered by one token of each; so the links are the different
    ends, each with the next token to end there or later on either side."""
    met = ends(a, size_a, starts, "a").join(ends(b, size_b, starts, "b"), "key", join_type="full outer", use_threads=False)
    met = met.take(pa.array(np.argsort(met.column("key").to_numpy())))
    ta, tb = met.column("a").combine_chunks(), met.column("b").combine_chunks()
    doc = np.searchsorted(starts.to_numpy(), met.column("key").to_numpy(), "left") - 1
    return pa.table({"doc": pa.array(doc), "a": pc.fill_null_backward(ta), "b": pc.fill_null_backward(tb), "both": pc.and_(pc.is_valid(ta), pc.is_valid(tb))})


def marked_ids(size: int) -> pa.Array:
    """Every id as text with a comma, a bar and a semicolon behind it."""
    return pa.array([f"{i}{mark}" for i in range(size) for mark in ",|;"], pa.string())


def group_texts(a: pa.ListArray, b: pa.ListArray, links: pa.Table, marked: pa.Array) -> list[bytes]:
    """For each document its groups as text: ids of a group joined by commas, the sides by a bar, groups by semicolons."""
    both = links.column("both").to_numpy()
    n, at, text = [len(x.values) for x in (a, b)], [], np.empty(len(a.values) + len(b.values), np.int64)
    last = [links.column(c).to_numpy()[both] for c in ("a", "b")]  # last tokens of each group
    upto = [np.r_[0, e + 1] for e in last]  # tokens of a side in the groups before
    for side in (0, 1):
        closed = np.zeros(n[side] + 1, np.int32)
        closed[last[side] + 1] = 1
        group = np.cumsum(closed[:-1])
        at.append(np.arange(n[side]) + upto[1 - side][group + side])
        mark = np.zeros(n[side], np.int64)
        mark[last[side]] = side + 1
        text[at[side]] = 3 * np.asarray((a, b)[side].values).astype(np.int64) + mark
    _, offsets, data = pc.take(marked, pa.array(text)).buffers()
    offsets = np.frombuffer(offsets, np.int32, len(text) + 1)
    first = np.asarray(a.offsets) + np.asarray(b.offsets)
    data = memoryview(data).cast("B") if data is not None else memoryview(b"")
    return [bytes(data[offsets[i] : max(offsets[i], offsets[j] - 1)]) for i, j in zip(first[:-1], first[1:])]


def count_pairs(tables: list[pa.Table]) -> pa.Table:
    """Partial counts (a, b, n) added up."""
    return pa.concat_tables(tables).group_by(["a", "b"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["a", "b", "n"])


# The corpus -----------------------------------------------------------------


def aligned(docs: DataFrame, byte_path: str, piece_path: str, key: str = "doc_id", text: str = "text", groups: bool = False) -> DataFrame:
    """Rows of two kinds, written once. A document: id, row (a number of its own), n_a, n_b, n_groups, n_links,
    groups_sha256, the groups themselves if ``groups``, and its different id pairs with the number of its links of
    each (pair_a, pair_b, pair_n). A partial count of a task, with a null row: a, b, n."""
    kind = docs.schema[key].dataType.simpleString()
    fields = [
        ("row", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()), ("groups", pa.string()),
        *[(c, pa.list_(pa.int32())) for c in ("pair_a", "pair_b", "pair_n")], ("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64()),
    ]
    schema = f"id {kind}, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, pair_a array<int>, pair_b array<int>, pair_n array<int>, a int, b int, n long"

    def batch_of(size: int, id_type: pa.DataType, **columns) -> pa.RecordBatch:
        full = [columns.get("id", pa.nulls(size, id_type)), *[columns.get(name, pa.nulls(size, t)) for name, t in fields]]
        return pa.RecordBatch.from_arrays(full, ["id", *[name for name, _ in fields]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [(encoding.ByteBpe, byte_path), (encoding.PieceBpe, piece_path)]
        spelt = [pa.array(encoding.held(k, p).token_bytes(), pa.binary()) for k, p in kinds]
        sizes = [pc.cast(pc.binary_length(s), pa.int64()) for s in spelt]
        marked = marked_ids(max(map(len, spelt)))
        counted, held, id_type = [], 0, None

        def counts() -> pa.RecordBatch:
            total = count_pairs(counted).combine_chunks()
            return batch_of(len(total), id_type, **{c: total.column(c).combine_chunks() for c in ("a", "b", "n")})

        for batch in batches:
            id_type = batch.schema.field(0).type
            for first, texts in encoding.runs(batch.column(1)):
                lists = token_lists(byte_path, piece_path, texts)
                good = spells(lists[0], spelt[0], texts) & spells(lists[1], spelt[1], texts)
                a, b = (kept_lists(x, good) for x in lists)
                starts = pa.array(np.cumsum([0, *[len(t) + 2 for t in texts]])[:-1])
                links = align(a, b, *sizes, starts)
                pairs = pa.table({"doc": links.column("doc"), "a": pc.take(a.values, links.column("a")), "b": pc.take(b.values, links.column("b"))})
                own = pairs.group_by(["doc", "a", "b"], use_threads=False).aggregate([([], "count_all")]).rename_columns(["doc", "a", "b", "n"])
                own = own.take(np.argsort(own.column("doc").to_numpy(), kind="stable")).combine_chunks()
                counted.append(count_pairs([own.select(["a", "b", "n"])]))
                held += len(counted[-1])
                doc = links.column("doc").to_numpy()
                places = pa.array(np.searchsorted(own.column("doc").to_numpy(), np.arange(len(texts) + 1)).astype(np.int32))
                text_of = group_texts(a, b, links, marked)
                count = lambda x: pa.array(np.bincount(x, minlength=len(texts)).astype(np.int64))
                yield batch_of(
                    len(texts), id_type, id=batch.column(0).slice(first, len(texts)), row=batch.column(2).slice(first, len(texts)),
                    n_a=pa.array(np.diff(np.asarray(a.offsets)).astype(np.int64)), n_b=pa.array(np.diff(np.asarray(b.offsets)).astype(np.int64)),
                    n_groups=count(doc[links.column("both").to_numpy()]), n_links=count(doc),
                    groups_sha256=pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in text_of]),
                    **({"groups": pa.array([g.decode() for g in text_of])} if groups else {}),
                    **{f"pair_{c}": pa.ListArray.from_arrays(places, pc.cast(own.column(c).combine_chunks(), pa.int32())) for c in ("a", "b", "n")},
                )
                if held > 2 * PARTIAL_PAIRS:
                    counted = [count_pairs(counted)]
                    held = len(counted[0])
                    if held > PARTIAL_PAIRS:
                        yield counts()
                        counted, held = [], 0
        if held:
            yield counts()

    source = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    return stored(source.mapInArrow(run, schema), "aligned")


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, a, b, n, best): links of each id pair in the corpus; ``best`` if no pair of its b has more. The highest counts
    are one row per id of a vocabulary, so they travel to every task."""
    pairs = stored(rows.filter("row is null").groupBy("a", "b").agg(F.sum("n").alias("n")), "pairs")
    highest = pairs.groupBy("b").agg(F.max("n").alias("highest"))
    pair = F.shiftleft(F.col("a").cast("long"), 32) + F.col("b")
    best = pairs.join(F.broadcast(highest), "b").select(pair.alias("pair"), "a", "b", "n", (F.col("n") == F.col("highest")).alias("best"))
    return stored(best, "counts")


def frequent_from(counts: DataFrame, limit: int) -> int:
    """Smallest power of two that at most ``limit`` pairs reach: counted by the bit lengths of their counts."""
    found = {r["bits"]: r["pairs"] for r in counts.groupBy(F.length(F.bin("n")).alias("bits")).agg(F.count(F.lit(1)).alias("pairs")).collect()}
    bits, total = 64, 0
    while bits > 1 and total + found.get(bits - 1, 0) <= limit:
        bits -= 1
        total += found.get(bits, 0)
    return 1 << (bits - 1)


def alignment(docs: DataFrame, byte_path: str, piece_path: str, key: str = "doc_id", text: str = "text", groups: bool = False, table_pairs: int = TABLE_PAIRS) -> DataFrame:
    """One row per row of ``docs``: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (and ``groups``).

    Side a is the byte-level tokenizer at ``byte_path`` over a blank and the text, side b the sentence pieces at
    ``piece_path``, which put the blank themselves. Groups end where tokens of both end; links are the pairs of tokens that
    share bytes; ``count_sum`` adds up, over a row's links, the corpus count of their id pair, ``n_best`` counts the links
    whose pair is a most frequent one of its b id (ties included). Null and empty texts, and those that either
    tokenizer does not spell back, have no tokens: zeros and an empty digest. Repeated rows and keys each count. A text
    is handled whole, about a megabyte of texts at a time, so memory follows the longest one. An empty table gives an
    empty result; other columns are not read, whatever their names.
    """
    rows = aligned(docs, byte_path, piece_path, key, text, groups)
    counts = pair_counts(rows)
    least = frequent_from(counts, table_pairs)
    of_docs = rows.filter("row is not null")
    one = F.explode(F.arrays_zip("pair_a", "pair_b", "pair_n")).alias("p")
    links = of_docs.select("row", one).select("row", (F.shiftleft(F.col("p.pair_a").cast("long"), 32) + F.col("p.pair_b")).alias("pair"), F.col("p.pair_n").alias("links"))
    often = F.broadcast(counts.filter(F.col("n") >= least).select("pair", "n", "best"))  # at most table_pairs rows
    summed = [F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("n")).alias("count_sum")]
    sums = links.join(often, "pair").groupBy("row").agg(*summed)
    rare = counts.filter(F.col("n") < least).select("pair", "n", "best")
    if not rare.isEmpty():
        few = links.join(often, "pair", "left_anti").join(rare, "pair").groupBy("row").agg(*summed)
        sums = sums.unionByName(few).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    joined = of_docs.drop("pair_a", "pair_b", "pair_n", "a", "b", "n").join(sums, "row", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return joined.select(F.col("id").alias(key), "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256", *(["groups"] if groups else []))
