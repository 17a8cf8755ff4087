"""Token ids in binary shard files, compressed by a Re-Pair grammar, with random access.

A shard file holds the ids of a range of documents in ascending order of their keys::

    file   := "RPR1" block*
    block  := docs bytes, rules, symbols, width (4 unsigned 64-bit numbers), crc32 of the rest (one more)
              docs      Arrow IPC stream: key, n (ids of the document)
              rules     pairs of 32-bit symbols: nonterminal base + i stands for the i-th pair
              lengths   one 32-bit number a rule: ids it expands to
              symbols   the sequence, 16 or 32 bits each

All numbers are little-endian; ``base`` (the vocabulary's size) is part of the manifest. The sum of the symbols'
lengths says where any id lies, so a part of a block is decoded without the rest.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbwise.llm import encoding
from kerbwise.llm.store import fresh_path, stored, tasks
from kerbwise.llm.warc import file_system

MAGIC = b"RPR1"
HEAD = struct.Struct("<5Q")
BLOCK_IDS = 1 << 20
#: A pair becomes a rule from this many occurrences in a block on; a rule expands to at most MAX_LENGTH ids; the
#: grammar is done after ROUNDS rounds or when a round shortens the sequence by less than a hundredth.
MIN_COUNT, MAX_LENGTH, ROUNDS, BIN_BITS = 24, 255, 12, 18
END_ID = 2


# The grammar ----------------------------------------------------------------


class Grammar:
    """Rules over ids below ``base`` and the sequence of symbols that stands for a block."""

    def __init__(self, base: int, rules: np.ndarray, lengths: np.ndarray, symbols: np.ndarray):
        self.base, self.rules, self.lengths, self.symbols = base, rules, lengths, symbols

    def expansions(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all rules one after another, and where and how long each symbol's are. An id follows the rules'
        expansions as itself."""
        length = np.concatenate([np.ones(self.base, np.int64), self.lengths.astype(np.int64)])
        start = np.concatenate([np.arange(self.base), self.base + np.cumsum(self.lengths, dtype=np.int64) - self.lengths]).astype(np.int64)
        flat = np.empty(self.base + int(self.lengths.sum(dtype=np.int64)), np.uint32)
        flat[: self.base] = np.arange(self.base)
        for i, (a, b) in enumerate(self.rules.tolist()):
            at, n = start[self.base + i], length[a]
            flat[at : at + n] = flat[start[a] : start[a] + n]
            flat[at + n : at + n + length[b]] = flat[start[b] : start[b] + length[b]]
        return flat, start, length

    def decode(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids ``first`` to ``last`` of the block; only the symbols that cover them are expanded."""
        flat, start, length = self.expansions()
        ends = np.cumsum(length[self.symbols])
        total = int(ends[-1]) if len(ends) else 0
        last = total if last is None else min(last, total)
        if first >= last:
            return np.zeros(0, np.uint32)
        i, j = np.searchsorted(ends, first, "right"), np.searchsorted(ends, last, "left") + 1
        symbols = self.symbols[i:j]
        n = length[symbols]
        upto = np.cumsum(n)
        ids = flat[np.repeat(start[symbols] - (upto - n), n) + np.arange(upto[-1])]
        before = int(ends[i] - n[0])
        return ids[first - before : last - before]


def frequent_pairs(symbols: np.ndarray, length: np.ndarray, min_count: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, rank of the pair at each place, the pairs): pairs of neighbours met at least ``min_count`` times, the most
    frequent first. Pairs are counted in bins of a hash; of the pairs in a bin one is counted by itself. One that is
    not its bin's comes in a later round, when bins are others."""
    a, b = symbols[:-1], symbols[1:]
    bins = ((a * np.uint32(0x9E3779B1 + 2 * seed)) ^ (b * np.uint32(0x85EBCA77 + 4 * seed))) >> np.uint32(32 - BIN_BITS)
    often = np.bincount(bins, minlength=1 << BIN_BITS) >= min_count
    place = np.flatnonzero(often[bins])
    bins, code = bins[place], (a[place].astype(np.uint64) << np.uint64(32)) | b[place]
    of_bin = np.zeros(1 << BIN_BITS, np.uint64)
    of_bin[bins] = code
    own = code == of_bin[bins]
    place, bins = place[own], bins[own]
    count = np.bincount(bins, minlength=1 << BIN_BITS)
    left, right = (of_bin >> np.uint64(32)).astype(np.int64), (of_bin & np.uint64(0xFFFFFFFF)).astype(np.int64)
    chosen = np.flatnonzero((count >= min_count) & (length[left] + length[right] <= MAX_LENGTH))
    chosen = chosen[np.lexsort((of_bin[chosen], -count[chosen]))]
    rank = np.full(1 << BIN_BITS, -1, np.int32)
    rank[chosen] = np.arange(len(chosen))
    rank = rank[bins]
    kept = rank >= 0
    return place[kept], rank[kept], of_bin[chosen]


def repair(ids: np.ndarray, base: int, min_count: int = MIN_COUNT) -> Grammar:
    """Re-Pair, all frequent pairs of a round at once: where two chosen pairs overlap the more frequent one is
    replaced, in a run of one pair every other one. Rules that replaced too few places are taken back."""
    symbols = ids.astype(np.uint32)
    length = np.ones(base, np.int64)
    rules: list[np.ndarray] = []
    top = base
    for seed in range(ROUNDS):
        if len(symbols) < 2:
            break
        place, rank, pairs = frequent_pairs(symbols, length, min_count, seed)
        if not len(place):
            break
        near = np.diff(place) == 1
        same = near & (rank[1:] == rank[:-1])
        run = np.flatnonzero(np.r_[True, ~same])  # a run is a pair of equal ids, repeated
        size = np.diff(np.r_[run, len(place)])
        before = np.r_[False, near][run] & (np.r_[0, rank[:-1]][run] < rank[run])
        ends = run + size - 1
        after = np.r_[near, False][ends] & (np.r_[rank[1:], 0][ends] < rank[ends])
        free = np.repeat(~before & ~after, size)
        within = np.arange(len(place)) - np.repeat(run, size)
        taken = free & (within % 2 == 0)
        place, rank = place[taken], rank[taken]
        used = np.bincount(rank, minlength=len(pairs))
        good = used >= max(2, min_count // 4)
        room = (1 << 16) - top if top < 1 << 16 else 1 << 16
        kept = np.flatnonzero(good)[: max(0, room)]
        if not len(kept):
            break
        name = np.full(len(pairs), -1, np.int64)
        name[kept] = top + np.arange(len(kept))
        chosen = name[rank] >= 0
        place, rank = place[chosen], rank[chosen]
        new = np.stack([(pairs[kept] >> np.uint64(32)), pairs[kept] & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32)
        rules.append(new)
        length = np.concatenate([length, length[new[:, 0]] + length[new[:, 1]]])
        top += len(kept)
        size_before = len(symbols)
        symbols[place] = name[rank].astype(np.uint32)
        stay = np.ones(size_before, bool)
        stay[place + 1] = False
        symbols = symbols[stay]
        if len(symbols) > 0.99 * size_before:
            break
    return Grammar(base, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32), length[base:].astype(np.uint32), symbols)


# Blocks ---------------------------------------------------------------------


def pack_block(grammar: Grammar, docs: pa.Table) -> bytes:
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, docs.schema) as writer:
        writer.write_table(docs)
    table = sink.getvalue()
    width = 2 if grammar.base + len(grammar.rules) <= 1 << 16 else 4
    rest = b"".join([table, grammar.rules.astype("<u4").tobytes(), grammar.lengths.astype("<u4").tobytes(), grammar.symbols.astype(f"<u{width}").tobytes()])
    return HEAD.pack(len(table), len(grammar.rules), len(grammar.symbols), width, zlib.crc32(rest)) + rest


def unpack_block(data: bytes, base: int) -> tuple[Grammar, pa.Table]:
    table, rules, symbols, width, crc = HEAD.unpack_from(data)
    rest = memoryview(data)[HEAD.size :]
    if len(rest) != table + 12 * rules + width * symbols or zlib.crc32(rest) != crc:
        raise ValueError("a block of token ids is damaged")
    docs = pa.ipc.open_stream(rest[:table]).read_all()
    pairs = np.frombuffer(rest, "<u4", 2 * rules, table).reshape(-1, 2)
    lengths = np.frombuffer(rest, "<u4", rules, table + 8 * rules)
    return Grammar(base, pairs, lengths, np.frombuffer(rest, f"<u{width}", symbols, table + 12 * rules)), docs


# Writing and reading --------------------------------------------------------


def encoded(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """(key, ids, row): ids of each whole text and the end id, as bytes of 32-bit numbers."""
    kind = docs.schema[key].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding.held(encoding.WordBpe, path)
        for batch in batches:
            for first, texts in encoding.runs(batch.column(1)):
                ids = [np.frombuffer(encoder.encode(t) + end, "<u4") for t in texts]
                packed = [(x.astype("<u2") if encoder.size <= 1 << 16 else x).tobytes() for x in ids]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(packed, pa.binary()), batch.column(2).slice(first, len(texts))], ["id", "ids", "row"])

    source = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    return source.mapInArrow(run, f"id {kind}, ids binary, row long")


def write_ids(docs: DataFrame, path: str, folder: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Write the ids of ``docs`` to shard files in ``folder``, in ascending order of ``key``; returns the manifest, one
    row per block: path, part, place, first (ids of the part before it), offset, bytes, n_ids, base.

    ``path`` is the tokenizer's file. Null text counts as empty and gives the end id alone. Null keys come last; rows
    that repeat a key follow each other in any order. An empty table gives an empty manifest, other columns are not read,
    whatever their names. A document is never cut, so a block is as long as the longest document where that is
    longer than ``block_ids``. Rows are encoded and written once with a number of their own before they are dealt to
    ranges of the keys, so that a range holds no more than its share even if one key is repeated, and a task that
    is run again meets the same rows. Files carry a name of their own for each attempt, and only those of
    successful attempts are in the manifest.
    """
    spark = docs.sparkSession
    base = encoding.held(encoding.WordBpe, path).size
    width = 2 if base <= 1 << 16 else 4
    rows = stored(encoded(docs, path, key, text, end_id), "ids")
    rows = rows.withColumn("last", F.col("id").isNull())
    order = ["last", "id", "row"]
    dealt = rows.repartitionByRange(tasks(spark), *order).sortWithinPartitions(*order).select("id", "ids")
    schema = "path string, part int, place int, first long, offset long, bytes long, n_ids long, base int"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, plain = file_system(folder)
        system.create_dir(plain, recursive=True)
        part = TaskContext.get().partitionId()
        out, name, done, first = None, f"{part:06d}-{uuid.uuid4().hex}.rpr", [], 0
        keys, ids, held_ids = [], [], 0

        def flush():
            nonlocal out, first, keys, ids, held_ids
            if out is None:
                out = system.open_output_stream(f"{plain}/{name}", compression=None)
                out.write(MAGIC)
            lengths = [len(x) // width for x in ids]
            table = pa.table({"key": pa.concat_arrays(keys), "n": pa.array(lengths, pa.int64())})
            block = pack_block(repair(np.frombuffer(b"".join(ids), f"<u{width}"), base), table)
            done.append((f"{folder}/{name}", part, len(done), first, out.tell(), len(block), held_ids, base))
            out.write(block)
            first, keys, ids, held_ids = first + held_ids, [], [], 0

        for batch in batches:
            for i, x in enumerate(batch.column(1)):
                x = x.as_buffer().to_pybytes()
                keys.append(batch.column(0).slice(i, 1))
                ids.append(x)
                held_ids += len(x) // width
                if held_ids >= block_ids:
                    flush()
        if ids:
            flush()
        if out is not None:
            out.close()
        if done:
            types = [pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.int32()]
            names = ["path", "part", "place", "first", "offset", "bytes", "n_ids", "base"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names)

    return stored(dealt.mapInArrow(write, schema), "manifest")


def read_ids(manifest: DataFrame, key_type: str = "bigint") -> DataFrame:
    """One row per document, read back from the files: id, start (ids of all documents before it), n_tokens, ids (bytes of
    32-bit numbers). A task reads its blocks by their place in the file, one at a time."""
    totals = manifest.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))  # one row a shard
    blocks = manifest.join(F.broadcast(offsets), "part").select("path", "offset", "bytes", "base", (F.col("before") + F.col("first")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, offset, size, base, first in zip(*[c.to_pylist() for c in batch.columns]):
                system, plain = file_system(path)
                with system.open_input_file(plain) as file:
                    file.seek(offset)
                    grammar, docs = unpack_block(file.read(size), base)
                n = docs.column("n").to_numpy()
                ends = np.cumsum(n)
                ids = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(np.r_[0, 4 * ends].astype(np.int64)), pa.py_buffer(grammar.decode().astype("<u4"))])
                rows = pa.table({"id": docs.column("key"), "start": pa.array(first + ends - n), "n_tokens": docs.column("n"), "ids": ids.cast(pa.binary())})
                yield from rows.combine_chunks().to_batches()

    spread = blocks.repartition(max(1, tasks(manifest.sparkSession)), "path", "offset")
    return spread.mapInArrow(run, f"id {key_type}, start long, n_tokens long, ids binary")


def ids_between(block: dict, first: int, last: int) -> np.ndarray:
    """Ids ``first`` to ``last`` of one block (a row of the manifest), decoded without the rest."""
    system, plain = file_system(block["path"])
    with system.open_input_file(plain) as file:
        file.seek(block["offset"])
        grammar, _ = unpack_block(file.read(block["bytes"]), block["base"])
    return grammar.decode(first, last)


def token_files(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """``docs`` written to a fresh folder and read back: key, start, n_tokens, ids."""
    manifest = write_ids(docs, path, fresh_path(docs.sparkSession, "token-files"), key, text, end_id)
    return read_ids(manifest, docs.schema[key].dataType.simpleString()).withColumnRenamed("id", key)
