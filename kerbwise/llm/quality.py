"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbwise.llm import words as W
from kerbwise.llm.lang_id import list_rows

_U = np.uint64
BUCKETS = 1 << 16
FACTORS = 8
#: The classifier is fitted on at most this many labelled documents, those of smallest hash.
TRAIN_DOCS = 6000
EPOCHS, BATCH, RATE, DECAY = 10, 32, 0.05, 1e-4
STATISTICS = (
    "words", "bytes", "word_length", "digits", "capitals", "symbols", "beyond_ascii", "distinct_words", "distinct_lines", "words_a_line", "word_ends",
    "characters",
)
_DIGIT, _CAPITAL, _HIGH, _SYMBOL = (np.zeros(256, bool) for _ in range(4))
_DIGIT[48:58] = _CAPITAL[65:91] = _HIGH[128:] = True
_SYMBOL[[ord(c) for c in "#$%&*|!<>{}[]=+_~^@\\/"]] = True
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".,;:!?"]] = True


def features(texts: pa.Array, sizes: pa.Array | None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """First row, word buckets of all texts in a row, their bounds, statistics (texts x STATISTICS).

    ``sizes`` is the table's own count of characters, where it has one; null counts as 0.
    """
    given = np.nan_to_num(sizes.cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False)) if sizes is not None else None
    for w in W.words(texts, lower=False):
        data, m = w.data, len(w)
        counts = np.diff(w.bounds)
        owner = np.repeat(np.arange(m), counts)
        offsets = _offsets(w, texts)
        sized = np.diff(offsets)

        def share(table: np.ndarray) -> np.ndarray:
            upto = np.concatenate([[0], np.cumsum(table[data])])
            return (upto[offsets[1:]] - upto[offsets[:-1]]) / np.maximum(sized, 1)

        order = np.lexsort((w.hashes, owner))
        h, o = w.hashes[order], owner[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
        distinct = np.bincount(o[new], minlength=m)
        length = np.bincount(owner, weights=w.ends - w.starts, minlength=m)
        ended = np.bincount(owner, weights=_END[data[w.ends - 1]], minlength=m) if len(owner) else np.zeros(m)
        lines, distinct_lines = np.zeros(m), np.zeros(m)
        for i in range(m):
            found = data[offsets[i] : offsets[i + 1]].tobytes().split(b"\n")
            lines[i], distinct_lines[i] = len(found), len(set(found))
        one = np.maximum(counts, 1)
        stats = np.stack([
            np.log1p(counts), np.log1p(sized), length / one, share(_DIGIT), share(_CAPITAL), share(_SYMBOL), share(_HIGH), distinct / one,
            distinct_lines / lines, np.log1p(counts / lines), ended / one, np.log1p(np.maximum(given[w.first : w.first + m], 0)) if given is not None else np.zeros(m),
        ], 1)
        yield w.first, (w.hashes >> _U(48)).astype(np.int32), w.bounds, stats


def _offsets(w: W.Words, texts: pa.Array) -> np.ndarray:
    _, offsets = W.string_parts(texts)
    return offsets[w.first : w.first + len(w) + 1] - offsets[w.first]


class FactorisationMachine:
    """Score = bias + linear part + pairwise interactions of low rank, each active feature having a vector.

    The interactions of all pairs are half the square of the summed vectors minus the summed squares, so a text is
    scored in time linear in its words. Every occurrence of a word is an active feature of value 1 / words.
    """

    def __init__(self, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        self.size = BUCKETS + len(STATISTICS)
        self.bias, self.linear = 0.0, np.zeros(self.size)
        self.vectors = r.normal(0, 0.05, (self.size, FACTORS))
        self.mean, self.spread = np.zeros(len(STATISTICS)), np.ones(len(STATISTICS))

    def scaled(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.spread, -4, 4)

    def margins(self, feature: np.ndarray, bounds: np.ndarray, stats: np.ndarray) -> np.ndarray:
        x = self.scaled(stats)
        counts = np.diff(bounds)
        full = np.flatnonzero(counts)
        linear = x @ self.linear[BUCKETS:]
        summed, squares = x @ self.vectors[BUCKETS:], (x * x) @ (self.vectors[BUCKETS:] ** 2).sum(1)
        if len(full):
            n, at = counts[full].astype(float), bounds[full]
            linear[full] += np.add.reduceat(self.linear[feature], at) / n
            for f in range(FACTORS):
                summed[full, f] += np.add.reduceat(self.vectors[feature, f], at) / n
            squares[full] += np.add.reduceat((self.vectors**2).sum(1)[feature], at) / (n * n)
        return self.bias + linear + 0.5 * ((summed**2).sum(1) - squares)

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS) -> FactorisationMachine:
        """Adagrad on the log loss. A row is (buckets, counts, statistics)."""
        stats = np.stack([r[2] for r in rows])
        self.mean, self.spread = stats.mean(0), np.maximum(stats.std(0), 1e-6)
        x = self.scaled(stats)
        own = np.arange(BUCKETS, self.size)
        g_bias, g_linear, g_vectors = 1e-8, np.full(self.size, 1e-8), np.full((self.size, FACTORS), 1e-8)
        order = np.random.default_rng(11)
        for _ in range(epochs):
            for at in np.array_split(order.permutation(len(rows)), -(-len(rows) // BATCH)):
                feature = np.concatenate([np.concatenate([rows[i][0], own]) for i in at])
                value = np.concatenate([np.concatenate([rows[i][1] / max(1, rows[i][1].sum()), x[i]]) for i in at])
                alone = np.concatenate([np.concatenate([rows[i][1] / max(1, rows[i][1].sum()) ** 2, x[i] ** 2]) for i in at])
                size = np.array([len(rows[i][0]) + len(own) for i in at])
                start = np.cumsum(size) - size
                v, w = self.vectors[feature], self.linear[feature]
                summed = np.add.reduceat(v * value[:, None], start)
                squares = np.add.reduceat((v * v).sum(1) * alone, start)
                margin = self.bias + np.add.reduceat(w * value, start) + 0.5 * ((summed**2).sum(1) - squares)
                error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[at]) / len(at)
                e = np.repeat(error, size)
                active, place = np.unique(feature, return_inverse=True)
                pull = e[:, None] * (value[:, None] * np.repeat(summed, size, 0) - v * alone[:, None])
                d_vectors = np.stack([np.bincount(place, pull[:, f], len(active)) for f in range(FACTORS)], 1)
                d_linear = np.bincount(place, e * value, len(active)) + DECAY * self.linear[active]
                d_vectors += DECAY * self.vectors[active]
                g_bias += error.sum() ** 2
                self.bias -= RATE * error.sum() / np.sqrt(g_bias)
                g_linear[active] += d_linear**2
                self.linear[active] -= RATE * d_linear / np.sqrt(g_linear[active])
                g_vectors[active] += d_vectors**2
                self.vectors[active] -= RATE * d_vectors / np.sqrt(g_vectors[active])
        return self


def labelled(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", limit: int = TRAIN_DOCS) -> DataFrame:
    """``docs`` with the (at most ``limit``) labels of smallest hash; null or other labels are no labels."""
    sample = labels.filter(F.col(label).isin(0, 1)).select(key, label).orderBy(F.xxhash64(key), key, label).limit(limit)
    return docs.join(F.broadcast(sample), key)  # at most ``limit`` rows


def train(docs: DataFrame, text: str = "text", label: str = "quality", size: str | None = "n_chars", limit: int = TRAIN_DOCS) -> FactorisationMachine | None:
    """Fit on the (at most ``limit``) labelled rows of smallest hash; None without rows of both labels."""
    sizes = F.col(size).cast("double") if size else F.lit(None).cast("double")
    rows = docs.filter(F.col(label).isin(0, 1)).select(F.xxhash64(text, label).alias("h"), F.col(label).cast("double").alias("y"), sizes.alias("s"), F.col(text).alias("t"))
    edge = rows.select("h").orderBy("h").limit(limit).agg(F.max("h")).first()[0]
    if edge is None:
        return None

    def run(batches):
        for batch in batches:
            for first, feature, bounds, stats in features(batch.column(3), batch.column(2) if size else None):
                for i in range(len(stats)):
                    f, c = np.unique(feature[bounds[i] : bounds[i + 1]], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(first + i, 1), batch.column(1).slice(first + i, 1), pa.array([f], pa.list_(pa.int32())), pa.array([c], pa.list_(pa.int64())), pa.array([stats[i]], pa.list_(pa.float64()))],
                        ["h", "y", "f", "c", "s"],
                    )

    found = rows.filter(F.col("h") <= edge).mapInArrow(run, "h long, y double, f array<int>, c array<long>, s array<double>").toArrow()
    found = found.sort_by([("h", "ascending"), ("y", "ascending")]).slice(0, limit)
    labels = found.column("y").to_numpy()
    if len(set(labels.tolist())) < 2:
        return None
    data = list(zip(*(list_rows(found.column(n)) for n in ("f", "c", "s"))))
    return FactorisationMachine().fit(data, labels)


def score(docs: DataFrame, model: FactorisationMachine | None, key: str = "doc_id", text: str = "text", size: str | None = "n_chars") -> DataFrame:
    """One row per row of ``docs``: ``key``, score (0 to 1, higher: label 1 likelier).

    Whole texts and the table's character count (null: 0; no such column: pass None) decide. Null text counts as empty; empty texts are
    scored by their statistics; without a model every score is 0.5. Repeated rows are scored each; an empty table gives
    an empty result; other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    sizes = F.col(size).cast("double") if size else F.lit(None).cast("double")

    def run(batches):
        for batch in batches:
            out = np.full(len(batch), 0.5)
            if model is not None:
                for first, feature, bounds, stats in features(batch.column(2), batch.column(1) if size else None):
                    margin = model.margins(feature, bounds, stats)
                    out[first : first + len(stats)] = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], [key, "score"])

    return docs.select(F.col(key), sizes.alias("s"), F.col(text).alias("t")).mapInArrow(run, f"`{key}` {kind}, score double")
