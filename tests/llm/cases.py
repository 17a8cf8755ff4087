"""Odd documents that every operator must take, and brute-force versions of the operators."""

import hashlib
from collections import Counter, defaultdict

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators might use themselves
    *[T.StructField(c, T.StringType()) for c in ("h", "n", "row", "key", "size", "score", "shard", "_row", "_place", "rank", "token", "spans", "id")],
])
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
PASSAGE = " ".join(f"common{i}" for i in range(40))


def rows():
    texts = [
        None, "", " \t\n", "a", "A", "a b", "one two three four five", "ONE two three four five", "one  two\nthree four five", LONG, LONG,
        PASSAGE, "start " + PASSAGE, PASSAGE + " end of it", "ünïcode Ünïcode " * 9, "x y z no ascii blank", "same same same " * 30, "12 34 !!", None,
    ]
    ids = list(range(len(texts)))
    ids[5] = None
    out = [(i, t, "en", "s" if n % 3 else None, None if n % 4 == 0 else 7, *["clash"] * 13) for n, (i, t) in enumerate(zip(ids, texts))]
    return out + [out[6], out[6], out[9], out[0]]  # repeated rows


def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def folded(text):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()


def shingles(text, k):
    w = folded(text)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def components(docs, k, percent):
    """[(key, text)] -> [(key, set size, component)]; keys are distinct."""
    sets = {key: shingles(t, k) for key, t in docs}
    lists = defaultdict(list)
    for key, s in sets.items():
        for x in s:
            lists[x].append(key)
    parent = {key: key for key in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for key, s in sets.items():
        for other, n in Counter(o for x in s for o in lists[x] if o > key).items():
            if 100 * n >= percent * (len(s) + len(sets[other]) - n):
                a, b = find(key), find(other)
                parent[max(a, b)] = min(a, b)
    return sorted((key, len(s), find(key)) for key, s in sets.items())


def deduplicated(docs, size):
    """[(key, text)] -> [(key, words, removed, digest)]; a null key is larger than all others."""
    words = [(key if key is not None else 1 << 62, key, (t or "").encode().split()) for key, t in docs]
    first = {}
    for order, _, w in words:
        for p in range(len(w) - size + 1):
            x = tuple(w[p : p + size])
            first[x] = min(first.get(x, order), order)
    out = []
    for order, key, w in words:
        gone = [False] * len(w)
        for p in range(len(w) - size + 1):
            if first[tuple(w[p : p + size])] < order:
                gone[p : p + size] = [True] * size
        out.append((key, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return out
