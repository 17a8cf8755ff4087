"""Substring deduplication: repeated windows of words found with an FM-index per shard.

A shard is not a range of documents, which every document would have to be streamed past, but the passages
that share a range of seeds: the smallest hash among the word 6-grams of a window decides its shard, so
equal windows meet in one shard wherever they stand, and every document is streamed past few of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbwise.llm import store
from kerbwise.llm import words as W
from kerbwise.llm.fm_index import FMIndex
from kerbwise.llm.jaccard_join import pack, pack_sorted, unpack, unpack_sorted
from kerbwise.llm.store import stored, tasks

_U = np.uint64
GRAM = 6
FLUSH = 3_000_000
#: Cells of the filter for each seed met in two documents, and most cells of all (128 MB).
FILTER_LOAD, FILTER_BITS = 12, 30
BROADCAST_BYTES = 32 << 20
_BLOB = "bucket int, a binary, b binary, c binary, d binary, e binary, f binary, kind int"
_SCHEMA = pa.schema([("bucket", pa.int32()), *[(c, pa.binary()) for c in "abcdef"], ("kind", pa.int32())])


def _rows(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_SCHEMA)]


def squeeze(values: np.ndarray) -> bytes:
    """Small numbers as byte planes, entropy-coded."""
    data = np.ascontiguousarray(values.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes()
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def unsqueeze(data: bytes) -> np.ndarray:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view(np.uint32).reshape(-1)


def runs(w: W.Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of consecutive windows of one text with the same seed (of 48-bit words): text, first window, windows, seed."""
    gram = min(GRAM, size)
    grams = W.combine(w.hashes >> _U(16), gram)
    counts = np.maximum(np.diff(w.bounds) - size + 1, 0)
    text = np.repeat(np.arange(len(w)), counts)
    if not len(text):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, _U)
    at = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts - w.bounds[:-1], counts)
    best, place = grams[at], at.copy()
    for j in range(1, size - gram + 1):
        other = grams[at + j]
        lower = other < best
        best = np.where(lower, other, best)
        place[lower] = at[lower] + j
    new = np.ones(len(at), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    return text[first], at[first], np.diff(np.r_[first, len(at)]), best[first]


def seeds_met_twice(rows: DataFrame, size: int) -> np.ndarray:
    """Bit map over hashed seeds: set where two rows share the seed, and for few others.

    Seeds are counted exactly (by 48 bits) in ranges; each range then draws its slice of the map, FILTER_LOAD cells for every
    seed met twice but at most 2 ** FILTER_BITS cells in all. Beyond that the map fills and lets more passages
    through to the index for nothing, never fewer.
    """
    level = (tasks(rows.sparkSession) - 1).bit_length()
    parts = 1 << level

    def run(batches):
        cells, owners, held = [], [], 0

        def flush():
            cell, owner = np.concatenate(cells), np.concatenate(owners)
            order = np.argsort(cell, kind="stable")
            cell, owner = cell[order], owner[order]
            start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            several = np.minimum.reduceat(owner, start) != np.maximum.reduceat(owner, start)
            value = cell[start] * _U(2) + several.astype(_U)
            edge = np.searchsorted(cell[start] >> _U(48 - level), np.arange(parts + 1, dtype=_U))
            got = [(b, pack_sorted(value[i:j])) for b, (i, j) in enumerate(zip(edge[:-1], edge[1:])) if j > i]
            return pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.binary())], ["bucket", "seeds"])

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for w in W.words(batch.column(2)):
                text, _, _, seed = runs(w, size)
                cells.append(seed >> _U(16))
                owners.append(ids[w.first + text])
                held += len(seed)
                if held > FLUSH // 2:
                    yield flush()
                    cells, owners, held = [], [], 0
        if held:
            yield flush()

    def count(table: pa.Table) -> pa.Table:
        value = np.sort(np.concatenate([unpack_sorted(x.as_py()) for x in table.column("seeds")]))
        seed = value >> _U(1)
        start = np.flatnonzero(np.r_[True, seed[1:] != seed[:-1]])
        met = (np.diff(np.r_[start, len(seed)]) > 1) | np.bitwise_or.reduceat(value & _U(1), start).astype(bool)
        found = seed[start[met]]
        return pa.table([table.column("bucket")[:1], pa.array([pack_sorted(found)], pa.binary()), pa.array([len(found)], pa.int64())], ["bucket", "seeds", "met"])

    sent = rows.mapInArrow(run, "bucket int, seeds binary")
    counted = stored(sent.groupBy("bucket").applyInArrow(count, "bucket int, seeds binary, met long"), "seeds")
    met = counted.agg(F.sum("met")).first()[0] or 0
    bits = max(level + 3, min(FILTER_BITS, (FILTER_LOAD * met).bit_length()))
    span = 1 << (bits - level)

    def draw(batches):
        for batch in batches:
            for bucket, seeds in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                cells = np.zeros(span, bool)
                cells[(unpack_sorted(seeds) >> _U(48 - bits)).astype(np.int64) - bucket * span] = True
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([np.packbits(cells, bitorder="little").tobytes()], pa.binary())], ["bucket", "map"])

    whole = np.zeros(1 << (bits - 3), np.uint8)
    for r in counted.select("bucket", "seeds").mapInArrow(draw, "bucket int, map binary").toLocalIterator():  # at most 2 ** FILTER_BITS bits in all
        whole[r["bucket"] * span // 8 : (r["bucket"] + 1) * span // 8] = np.frombuffer(r["map"], np.uint8)
    return whole


def _passages(size: int, buckets: int, met: np.ndarray):
    """Map side: passages (runs of windows with a seed met twice) by shard. Of equal passages in a task the one
    in the smallest document goes to the shard; the others repeat it whole and go straight to their documents."""
    shift = _U(64 - (len(met) * 8).bit_length() + 1)

    def flush(held):
        words, lengths, seeds, row, doc, at = (np.concatenate(x) for x in zip(*held))
        start = np.cumsum(lengths) - lengths
        within = np.arange(len(words)) - np.repeat(start, lengths)
        code = np.add.reduceat(words * W.powers(int(lengths.max()))[within], start) if len(words) else words
        code = W.mix(code + lengths.astype(_U))
        order = np.lexsort((at, row, doc, code))
        head = np.ones(len(order), bool)
        head[1:] = code[order[1:]] != code[order[:-1]]
        lead = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
        copy = order[doc[order] > doc[lead]]
        lead = np.setdiff1d(order, copy, assume_unique=True)
        rows = []
        part = (row[copy].astype(_U) % _U(buckets)).astype(np.int64)
        for b in np.unique(part):
            own = copy[part == b]
            own = own[np.lexsort((at[own], row[own]))]
            full = (_U(1) << (lengths[own] - size + 1).astype(_U)) - _U(1)
            rows.append((buckets + int(b), pack(row[own].astype(_U)), squeeze(at[own]), squeeze(full), b"", b"", b"", 1))
        part = (seeds[lead] % _U(buckets)).astype(np.int64)
        lead = lead[np.argsort(part, kind="stable")]
        part = np.sort(part)
        for b in np.unique(part):
            own = lead[np.searchsorted(part, b) : np.searchsorted(part, b, "right")]
            flat = np.repeat(start[own], lengths[own]) + np.arange(lengths[own].sum()) - np.repeat(np.cumsum(lengths[own]) - lengths[own], lengths[own])
            vocabulary, index = np.unique(words[flat], return_inverse=True)
            rows.append((
                int(b), pack_sorted(vocabulary), squeeze(index), squeeze(lengths[own]), pack(row[own].astype(_U)), pack(doc[own].astype(_U)), squeeze(at[own]), 0,
            ))
        return pa.RecordBatch.from_arrays(_rows(rows), schema=_SCHEMA)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            docs = batch.column(1).to_numpy(zero_copy_only=False)
            for w in W.words(batch.column(2)):
                text, at, windows, seed = runs(w, size)
                cell = (seed >> shift).astype(np.int64)
                keep = (met[cell >> 3] >> (cell & 7)) & 1 == 1
                text, at, windows, seed = text[keep], at[keep], windows[keep], seed[keep]
                if not len(text):
                    continue
                lengths = windows + size - 1
                flat = np.repeat(at - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
                held.append((w.hashes[flat] >> _U(16), lengths, seed, ids[w.first + text], docs[w.first + text], at - w.bounds[text]))
                n += len(flat)
                if n > FLUSH:
                    yield flush(held)
                    held, n = [], 0
        if held:
            yield flush(held)

    return run


def _search_shard(size: int, buckets: int):
    """A shard: index its passages, stream them past the index, and find for every window the smallest
    document with it. Windows of a passage that also start in a smaller document are its answer."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        if bucket >= buckets:
            return table.set_column(0, "bucket", pa.array([bucket - buckets] * len(table), pa.int32()))
        blobs = list(zip(*[table.column(c).to_pylist() for c in "abcdef"]))
        words = np.concatenate([unpack_sorted(b[0])[unsqueeze(b[1])] for b in blobs])
        lengths = np.concatenate([unsqueeze(b[2]) for b in blobs]).astype(np.int64)
        row, doc = (np.concatenate([unpack(b[i]) for b in blobs]).view(np.int64) for i in (3, 4))
        at = np.concatenate([unsqueeze(b[5]) for b in blobs])
        start = np.cumsum(lengths) - lengths

        gram = min(GRAM, size)
        grams = W.combine(words, gram)
        grams = np.concatenate([grams, np.full(len(words) - len(grams), ~_U(0))])
        inside = np.arange(len(words)) - np.repeat(start, lengths) <= np.repeat(lengths, lengths) - gram
        seed = np.minimum.reduceat(np.where(inside, grams, ~_U(0)), start)
        order = np.argsort(seed, kind="stable")
        first = np.flatnonzero(np.r_[True, seed[order][1:] != seed[order][:-1]])
        differ = np.minimum.reduceat(doc[order], first) != np.maximum.reduceat(doc[order], first)
        alive = np.zeros(len(seed), bool)
        alive[order] = np.repeat(differ, np.diff(np.r_[first, len(order)]))
        if not alive.any():
            return _SCHEMA.empty_table()
        words, lengths, row, doc, at = words[np.repeat(alive, lengths)], lengths[alive], row[alive], doc[alive], at[alive]
        start = np.cumsum(lengths) - lengths

        within = np.arange(len(words)) - np.repeat(start, lengths)
        code = W.mix(np.add.reduceat(words * W.powers(int(lengths.max()))[within], start) + lengths.astype(_U))
        _, lead, which = np.unique(code, return_index=True, return_inverse=True)  # each passage is indexed once
        least = np.full(len(lead), np.iinfo(np.int64).max)
        np.minimum.at(least, which, doc)

        vocabulary, symbol = np.unique(words, return_inverse=True)
        long = lengths[lead]
        place = np.cumsum(long + 1) - long - 1
        text = np.zeros(int((long + 1).sum()), np.int64)
        spread = np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long)
        text[np.repeat(place, long) + spread] = symbol[np.repeat(start[lead], long) + spread] + 1
        index = FMIndex(text, len(vocabulary) + 1, size)
        windows = long - size + 1
        base = np.cumsum(windows) - windows
        starts = np.repeat(place, windows) + np.arange(windows.sum()) - np.repeat(base, windows)
        low, high = index.intervals(text, starts, size)
        holder = np.repeat(np.arange(len(lead)), long + 1)
        docs_in_order = np.append(least[holder[index.suffixes]], np.iinfo(np.int64).max)
        ulow, back = np.unique(low, return_inverse=True)
        uhigh = np.zeros(len(ulow), np.int64)
        uhigh[back] = high
        smallest = np.minimum.reduceat(docs_in_order, np.stack([ulow, uhigh], 1).reshape(-1))[::2][back]

        mine = windows[which]
        flat = np.repeat(base[which], mine) + np.arange(mine.sum()) - np.repeat(np.cumsum(mine) - mine, mine)
        hit = smallest[flat] < np.repeat(doc, mine)
        bit = _U(1) << (np.arange(mine.sum()) - np.repeat(np.cumsum(mine) - mine, mine)).astype(_U)
        mask = np.bitwise_or.reduceat(np.where(hit, bit, _U(0)), np.cumsum(mine) - mine)
        found = np.flatnonzero(mask)
        part = (row[found].astype(_U) % _U(buckets)).astype(np.int64)
        out = []
        for b in np.unique(part):
            own = found[part == b]
            own = own[np.lexsort((at[own], row[own]))]
            out.append((int(b), pack(row[own].astype(_U)), squeeze(at[own]), squeeze(mask[own]), b"", b"", b"", 1))
        return pa.table(_rows(out), schema=_SCHEMA)

    return run


def _spans(size: int):
    """Per range of rows: the covered words as spans, start and end by turns."""

    def run(table: pa.Table) -> pa.Table:
        row = np.concatenate([unpack(x.as_py()) for x in table.column("a")]).view(np.int64)
        at = np.concatenate([unsqueeze(x.as_py()) for x in table.column("b")]).astype(np.int64)
        mask = np.concatenate([unsqueeze(x.as_py()) for x in table.column("c")])
        hits = [np.flatnonzero(mask >> j & 1) for j in range(size)]
        place = np.concatenate([at[h] + j for j, h in enumerate(hits)])
        owner = np.concatenate([row[h] for h in hits])
        order = np.lexsort((place, owner))
        place, owner = place[order], owner[order]
        new = np.ones(len(place), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (place[1:] > place[:-1] + size)
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(place)] - 1
        spans = np.stack([place[first], place[last] + size], 1).reshape(-1)
        heads = np.flatnonzero(np.r_[True, owner[first][1:] != owner[first][:-1]])
        offsets = np.r_[heads, len(first)] * 2
        return pa.table([pa.array(owner[first[heads]]), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(spans))], ["row", "spans"])

    return run


def numbered(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Row number, key (null: largest) and text. The number is the same in every pass."""
    order = F.coalesce(F.col(key).cast("long"), F.lit(2**63 - 1))
    rows = store.numbered(docs, "row", order.alias("order"), F.col(text).alias("text"), F.col(key).alias("key"))
    return rows.select("row", "order", "text", "key")


def repeated_spans(rows: DataFrame, size: int) -> DataFrame:
    """(row, spans) for rows with words covered by a window that also starts in a row of smaller ``order``."""
    given = rows.select("row", "order", "text")
    buckets = 2 * tasks(rows.sparkSession)
    met = seeds_met_twice(given, size)
    sent = given.mapInArrow(_passages(size, buckets, met), _BLOB)
    answers = sent.groupBy("bucket").applyInArrow(_search_shard(size, buckets), _BLOB)
    return stored(answers.groupBy("bucket").applyInArrow(_spans(size), "row long, spans array<long>"), "spans")


def substring_dedup(docs: DataFrame, size: int = 13, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``key``, n_words, n_removed, spans (removed words: start and end by turns), kept
    (the kept words joined by one space).

    Words are runs without ASCII white space, unchanged. A window is ``size`` (at most 32) consecutive words of one row; words covered
    by a window whose words also start in a row with a smaller key are removed. Windows are judged on the input.
    Null keys count as larger than all others and as equal to each other; rows that repeat a key do not remove each
    other. Null text has no words. An empty table gives an empty result; other columns are not read.
    Windows are compared word by word as 48-bit hashes: a false match needs every word that differs to collide.
    """
    rows = numbered(docs, key, text)
    spans = repeated_spans(rows, size)
    held = spans.agg(F.sum(F.size("spans") * 8 + 64)).first()[0] or 0
    joined = rows.join(F.broadcast(spans) if held <= BROADCAST_BYTES else spans, "row", "left")
    kind = docs.schema[key].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            total, gone, kept = [], [], []
            for t, span in zip(texts, batch.column("spans").to_pylist()):
                words = (t or "").encode().split()
                total.append(len(words))
                if span:
                    left = []
                    for i, j in zip([0, *span[1::2]], [*span[::2], len(words)]):
                        left += words[i:j]
                    words = left
                gone.append(total[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), batch.column("spans"), pa.array(kept, pa.string())],
                [key, "n_words", "n_removed", "spans", "kept"],
            )

    return joined.select("key", "text", "spans").mapInArrow(cut, f"`{key}` {kind}, n_words long, n_removed long, spans array<long>, kept string")
