"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained with follow-the-regularised-leader and elastic-net penalties, then calibrated with a temperature.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbwise.llm.words import CHUNK_BYTES, mix, string_parts, tidy

_U = np.uint64
FEATURES = 1 << 16
ORDERS = (1, 2, 3)
#: The classifier is fitted on at most this many different labelled texts, those of smallest hash.
TRAIN_DOCS = 4000
SCALE = 100.0
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 0.02, 0.01
UNKNOWN = "und"
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def has_letter(text: Column) -> Column:
    """Whether a text has one of ``letters()``; false for null."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], letters(), [False]]).astype(np.int8)))
    ranges = "".join(f"\\x{{{a:x}}}-\\x{{{b - 1:x}}}" for a, b in edge.reshape(-1, 2))
    return F.coalesce(text.rlike(f"[{ranges}]"), F.lit(False))


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key as text (null: of nothing), modulo ``modulus``."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


def grams(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Hashed character n-grams of whole lower-cased texts, every other character being one blank.

    Yields first row, features of all texts in a row, their bounds, and whether each text has a letter.
    """
    lower = pc.fill_null(pc.utf8_lower(texts), "")
    _, offsets = string_parts(lower)
    row = 0
    while row < len(lower):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES // 2, "right")) - 1)
        part = lower.slice(row, end - row)
        lengths = pc.utf8_length(part).to_numpy(zero_copy_only=False).astype(np.int64)
        data, spans = string_parts(part)
        code = np.frombuffer(data[spans[0] : spans[-1]].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        owner = np.repeat(np.arange(end - row), lengths)
        letter = letters()[code]
        code = np.where(letter, code, 32).astype(_U)
        lettered = np.bincount(owner[letter], minlength=end - row) > 0
        found, whose = [], []
        for n in ORDERS:
            m = len(code) - n + 1
            if m <= 0:
                continue
            key = np.full(m, n, _U)
            for j in range(n):
                key = key * _U(0x110000) + code[j : j + m]
            inside = (owner[:m] == owner[n - 1 :]) & (letter[:m] | letter[n - 1 :])
            found.append((mix(key[inside]) >> _U(64 - FEATURES.bit_length() + 1)).astype(np.int32))
            whose.append(owner[:m][inside])
        counts = [np.bincount(w, minlength=end - row) for w in whose] or [np.zeros(end - row, np.int64)]
        total = np.sum(counts, axis=0)
        bounds = np.concatenate([[0], np.cumsum(total)])
        feature = np.empty(int(bounds[-1]), np.int32)
        start = bounds[:-1].copy()
        for f, c in zip(found, counts):  # each order is already sorted by text
            at = np.repeat(start - (np.cumsum(c) - c), c) + np.arange(len(f))
            feature[at] = f
            start += c
        yield row, feature, bounds, lettered
        row = end


def document_frequencies(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """In how many texts each feature occurs, over all of ``docs``; and the number of texts."""

    def run(batches):
        seen, texts = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for _, feature, bounds, _ in grams(batch.column(0)):
                flag = np.zeros(FEATURES, bool)
                for i, j in zip(bounds[:-1], bounds[1:]):
                    own = feature[i:j]
                    flag[own] = True
                    seen += flag
                    flag[own] = False
                texts += len(bounds) - 1
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, used].astype(np.int32)), pa.array(np.r_[texts, seen[used]])], ["feature", "df"])

    out = np.zeros(FEATURES + 1, np.int64)
    total = docs.select(text).mapInArrow(tidy(run), "feature int, df long").groupBy("feature").agg(F.sum("df").alias("df")).toArrow()  # FEATURES rows at most
    np.add.at(out, total.column("feature").to_numpy().astype(np.int64), total.column("df").to_numpy())
    return out[:-1], int(out[-1])


def training_rows(docs: DataFrame, text: str, label: str, limit: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], list]:
    """Term frequencies of the (at most ``limit``) texts of smallest hash, with their labels, in that order.

    Copies of a text with the same label are one row, and texts without a letter, which train nothing, take no place.
    """
    lettered = docs.filter(has_letter(F.col(text)))
    hashed = lettered.select(F.xxhash64(text, label).alias("h"), F.col(text).alias("text"), F.col(label).cast("string").alias("label"))
    edge = hashed.select("h").distinct().orderBy("h").limit(limit).agg(F.max("h")).first()[0]
    if edge is None:
        return [], []
    # Copies are combined where they lie; beside one row a hash, only texts of one hash pass the edge.
    chosen = hashed.filter(F.col("h") <= edge).groupBy("h", "text", "label").agg(F.lit(1)).orderBy("h", "label", "text").limit(limit)

    def run(batches):
        for batch in batches:
            for row, feature, bounds, _ in grams(batch.column(1)):
                for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
                    if b > a:
                        f, c = np.unique(feature[a:b], return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).slice(row + i, 1), batch.column(2).slice(row + i, 1), pa.array([f], pa.list_(pa.int32())), pa.array([(c / (b - a)).astype(np.float32)], pa.list_(pa.float32()))],
                            ["h", "label", "feature", "tf"],
                        )

    rows = chosen.select("h", "text", "label").mapInArrow(tidy(run), "h long, label string, feature array<int>, tf array<float>").toArrow()
    order = pc.sort_indices(rows.select(["h", "label"]), [("h", "ascending"), ("label", "ascending")]).to_numpy()
    feature, tf = list_rows(rows.column("feature")), list_rows(rows.column("tf"))
    return [(feature[i], tf[i]) for i in order], rows.column("label").take(pa.array(order)).to_pylist()


def list_rows(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The rows of a list column as views of one array."""
    lists = column.combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    return np.split(lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(counts)[:-1]) if len(counts) else []


class Model:
    """Languages, weights of idf-scaled term frequencies (features x languages), bias and temperature."""

    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, temperature: float) -> None:
        self.languages, self.temperature, self.bias = languages, temperature, weights[-1]
        self.table = np.ascontiguousarray((weights[:-1] * idf[:, None] * SCALE).T)

    def logits(self, feature: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        counts = np.diff(bounds)
        out = np.tile(self.bias, (len(counts), 1))
        full = np.flatnonzero(counts)
        if len(full):
            for c, row in enumerate(self.table):
                out[full, c] += np.add.reduceat(row[feature], bounds[full]) / counts[full]
        return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def scaled(feature: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return tf * idf[feature] * SCALE


def follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, size: int, idf: np.ndarray | None = None) -> np.ndarray:
    """Proximal FTRL with L1 and L2 penalties: per-coordinate learning rates, exact zeros. The last row is the bias.

    With ``idf``, values are term frequencies and scaled where they are used, so that no scaled copy of all rows is held.
    """
    z, n = np.zeros((size + 1, classes)), np.zeros((size + 1, classes))

    def weights(zi, ni):
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for (feature, value), y in zip(rows, labels):
            at, x = np.append(feature, size), np.append(value if idf is None else scaled(feature, value, idf), 1.0)
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p[None, :]
            more = ni + g * g
            z[at] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / ALPHA * w
            n[at] = more
    return weights(z, n)


def best_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """Temperature of smallest log loss on documents the weights were not fitted on. Each counts one other
    language in n + 2 as possible, so that a sample without errors does not make every score 1."""
    if not len(labels):
        return 1.0
    truth = np.full(logits.shape, 1 / (len(labels) + 2) / max(1, logits.shape[1] - 1))
    truth[np.arange(len(labels)), labels] = 1 - 1 / (len(labels) + 2)
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 200))
    loss = [-(truth * np.log(np.maximum(softmax(logits / t), 1e-12))).sum(1).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def train(docs: DataFrame, text: str = "text", label: str = "lang", limit: int = TRAIN_DOCS) -> Model | None:
    """Fit on the rows of ``docs`` with a label; None without any. Inverse document frequencies count all of them.

    The temperature comes from rows the weights were not fitted on: every fifth in the order of their hashes. Of
    fewer than 50 rows none can be spared; each fifth is then judged by a fit on the others, for the temperature only.
    """
    labelled = docs.filter(F.col(label).isNotNull())
    rows, names = training_rows(labelled, text, label, limit)
    if not rows:
        return None
    df, texts = document_frequencies(labelled, text)
    idf = np.log((1 + texts) / (1 + df)) + 1
    languages = sorted(set(names))
    y = np.array([languages.index(x) for x in names])
    fifth = np.arange(len(rows)) % 5

    def fitted(at: np.ndarray) -> np.ndarray:
        return follow_the_leader([rows[i] for i in at], y[at], len(languages), FEATURES, idf)

    def judged(weights: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.array([scaled(f, t, idf) @ weights[f] + weights[-1] for f, t in (rows[i] for i in at)]).reshape(len(at), len(languages))

    if len(rows) >= 50:
        rest = np.flatnonzero(fifth == 4)
        weights = fitted(np.flatnonzero(fifth != 4))
        logits = judged(weights, rest)
    else:
        rest = np.concatenate([np.flatnonzero(fifth == k) for k in range(5)])
        weights = fitted(np.arange(len(rows)))
        logits = np.concatenate([judged(fitted(np.flatnonzero(fifth != k)), np.flatnonzero(fifth == k)) for k in range(5)])
    return Model(languages, idf, weights, best_temperature(logits, y[rest]))


def identify(docs: DataFrame, model: Model | None, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the language and its calibrated probability (0 to 1) in columns ``names``, which replace columns so named.

    Whole texts are read and nothing but the text decides. A text that is null or has no letter is ``und`` with score 0, as
    is every text without a model (no labelled row). Ties go to the first language in order. Repeated rows are judged
    each; an empty table gives an empty result; other columns are passed on.
    """
    passed = [c for c in docs.columns if c not in names]

    def run(batches):
        for batch in batches:
            languages, scores = [], [np.zeros(0)]
            for _, feature, bounds, lettered in grams(batch.column(0)):
                if model is None:
                    lettered = np.zeros(len(lettered), bool)
                    best, top = np.zeros(len(lettered), int), np.zeros(len(lettered))
                else:
                    p = softmax(model.logits(feature, bounds) / model.temperature)
                    best, top = p.argmax(1), p.max(1)
                languages += [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered)]
                scores.append(np.where(lettered, top, 0.0))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(languages, pa.string()), pa.array(np.concatenate(scores))], [*passed, *names]
            )

    given = docs.select(F.col(text).alias("_text_"), *[F.col(f"`{c}`") for c in passed])
    fields = [*docs.select(*[F.col(f"`{c}`") for c in passed]).schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]
    return given.mapInArrow(tidy(run), T.StructType(fields))
