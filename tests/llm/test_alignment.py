"""Alignment of two tokenizers against plain loops over tokens and bytes."""

import functools
import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from kerbwise.llm import alignment, encoding
from kerbwise.llm.queries import QUERIES
from tests.llm import cases
from tests.llm.test_token_files import ODD_TEXTS

SF = "/root/testdata/sf0.001"
BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@functools.cache
def tools():
    a = Tokenizer.from_file(BYTE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECE)


@functools.cache
def letters():
    return {c: b for b, c in encoding.byte_letters().items()}


def spans(tokens):
    out, at = [], 0
    for i, t in tokens:
        out.append((i, at, at + len(t)))
        at += len(t)
    return out, b"".join(t for _, t in tokens)


def both_sides(text):
    a, b = tools()
    side_a, bytes_a = spans([(i, bytes(letters()[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids])
    pieces = [(i, b.id_to_piece(i)) for i in b.encode(text)]
    side_b, bytes_b = spans([(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in pieces])
    expected = b" " + text.encode()
    return (side_a, side_b) if text and bytes_a == bytes_b == expected else ([], [])


def brute(rows):
    docs, counts = [], Counter()
    for key, text in rows:
        a, b = both_sides(text or "")
        links = [(i, k) for i, s, e in a for k, t, f in b if s < f and t < e] if len(a) < 400 else merged(a, b)
        counts.update(links)
        docs.append((key, a, b, links))
    top = defaultdict(int)
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    out = []
    for key, a, b, links in docs:
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, start = [], 0
        for cut in cuts:
            sides = [",".join(str(i) for i, s, e in side if start <= s and e <= cut) for side in (a, b)] if len(a) < 400 else None
            groups.append(sides)
            start = cut
        if len(a) >= 400:
            groups = fast_groups(a, b)
        text = ";".join("|".join(g) for g in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if text else ""
        out.append((key, len(a), len(b), len(cuts), len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), digest))
    return sorted(out, key=lambda r: (r[0] is None, r[0], r[1:]))


def merged(a, b):
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        out.append((a[i][0], b[j][0]))
        e, f = a[i][2], b[j][2]
        i, j = i + (e <= f), j + (f <= e)
    return out


def fast_groups(a, b):
    out, i, j, now = [], 0, 0, ([], [])
    while i < len(a) or j < len(b):
        if j >= len(b) or (i < len(a) and a[i][2] <= b[j][2]):
            now[0].append(a[i])
            i += 1
        else:
            now[1].append(b[j])
            j += 1
        if now[0] and now[1] and now[0][-1][2] == now[1][-1][2]:
            out.append([",".join(str(t[0]) for t in side) for side in now])
            now = ([], [])
    return out


def results(frame):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r) for r in frame.select(*names).collect()), key=lambda r: (r[0] is None, r[0], r[1:]))


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = results(QUERIES["op11_alignment"](spark, SF))
    assert got == brute(rows) and sum(r[3] < r[1] for r in got) > 100


def test_odd_texts_and_rare_pairs(spark):
    rows = [(i, t) for i, t, *_ in cases.rows() if t is not cases.LONG] + [(100 + i, t) for i, t in enumerate(ODD_TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    expected = brute(rows)
    for limit in (0, 40, 1 << 20):
        assert results(alignment.alignment(docs, BYTE, PIECE, table_pairs=limit)) == expected
    assert any(r[1] == 0 and t for r, (_, t) in zip(expected, rows))
    with_groups = alignment.alignment(docs, BYTE, PIECE, groups=True).filter("n_a > 0").collect()
    assert with_groups and all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 for r in with_groups)


def test_clashing_names_empty_table_and_flushes(spark, monkeypatch):
    assert alignment.alignment(cases.empty(spark), BYTE, PIECE).count() == 0
    rows = [(i, t) for i, t, *_ in cases.rows()]
    assert results(alignment.alignment(cases.odd(spark), BYTE, PIECE)) == brute(rows)


def test_counts_are_handed_on_before_they_grow(monkeypatch, spark):
    import pyarrow as pa

    tables = [pa.table({"a": pa.array([1, 1], pa.int32()), "b": pa.array([2, 3], pa.int32()), "n": pa.array([1, 4], pa.int64())})] * 3
    assert sorted(map(tuple, (r.values() for r in alignment.count_pairs(tables).to_pylist()))) == [(1, 2, 3), (1, 3, 12)]
    counts = spark.createDataFrame([(n,) for n in (1, 1, 1, 2, 3, 9)], "n long")
    assert [alignment.frequent_from(counts, k) for k in (0, 1, 3, 6)] == [16, 4, 2, 1]
