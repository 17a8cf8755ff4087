"""Token files: ids against the library on whole texts, the grammar's round trip, random access, odd rows."""

import functools
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kerbwise.llm import encoding, token_files
from kerbwise.llm.queries import QUERIES
from kerbwise.llm.store import fresh_path
from tests.llm import cases

SF = "/root/testdata/sf0.001"
WORD = public_tokenizers.path("word_bpe_49k.json")
ODD_TEXTS = [
    "", " ", "a", "It's WE'LL don't 'S '' ',' 's", "x<|endoftext|>y <|ENDOFTEXT|> <|startoftext|>", "tab\there\r\nand\n\nthere  two ", "é é ́x",
    "ΑΣ Σ ς İ ŉ ǅ", "½ ² 12 ٣", " x y z", "a\x1cb\x85c", "日本語 テキスト 👩‍👩‍👧 ok", "<0x41> ▁ ▁▁x <s> </s> <unk>", "a\x00b", "ﬁ ａ", " lead\n", "....!!! ... a.b.c",
]


library = functools.cache(Tokenizer.from_file)


def library_ids(text):
    return library(WORD).encode(text, add_special_tokens=False).ids


ALL = {
    encoding.WordBpe: WORD, encoding.ByteBpe: public_tokenizers.path("byte_bpe_50k.json"), encoding.PieceBpe: public_tokenizers.path("piece_bpe_32k.model"),
}


def same_as_whole(encoder, text):
    assert np.frombuffer(encoder.encode(text.encode()), "<u4").tolist() == list(encoder.whole(text.encode())), text


@pytest.mark.parametrize("kind", ALL)
def test_pieces_give_the_ids_of_whole_texts(kind, spark):
    encoder = encoding.held(kind, ALL[kind])
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()] + [t or "" for _, t, *_ in cases.rows()]
    for text in texts + ODD_TEXTS + [a + b for a in ODD_TEXTS for b in ODD_TEXTS]:
        same_as_whole(encoder, text)

    @settings(max_examples=300, deadline=None)
    @given(st.text(st.sampled_from(list("aAbéÉßſ'stllreve  \n\t.,!0½ ́▁<|>")), max_size=24))
    def short(text):
        same_as_whole(encoder, text)

    short()


def test_two_tokenizers_at_once_give_what_each_gives():
    pair = encoding.held_pair(ALL[encoding.ByteBpe], ALL[encoding.PieceBpe])
    texts = [t.encode() for t in ODD_TEXTS]
    for side, kind in ((0, encoding.ByteBpe), (1, encoding.PieceBpe)):
        ids, at = pair.both(texts)[side]
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == (list(encoding.held(kind, ALL[kind]).whole(t)) if t else [])


def test_a_full_memory_changes_nothing():
    encoder = encoding.WordBpe(WORD)
    encoder.known, encoder.runs = encoding.Remembered(encoder.piece, 6), encoding.Remembered(encoder.run, 4)
    for text in ["one two three four five six seven one two", "seven six one eight, nine. ten one"] * 2:
        same_as_whole(encoder, text)
        assert len(encoder.known) <= 3


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=300), st.integers(2, 5), st.integers(0, 300), st.integers(0, 300))
def test_grammar_round_trip_and_random_access(ids, min_count, first, last):
    ids = np.array(ids, np.uint32)
    grammar = token_files.repair(ids, 10, min_count)
    assert grammar.decode().tolist() == ids.tolist()
    assert grammar.decode(first, last).tolist() == ids[first : max(first, last)].tolist()
    assert int(grammar.expansions()[2][grammar.symbols].sum()) == len(ids)


def test_grammar_compresses_and_nests():
    ids = np.tile(np.array([5, 6, 7, 8, 5, 6, 9], np.uint32), 500)
    grammar = token_files.repair(ids, 10)
    assert len(grammar.symbols) < len(ids) / 20 and grammar.lengths.max() > 7 and (grammar.rules >= 10).any()
    assert (grammar.decode() == ids).all()
    same = np.full(1001, 3, np.uint32)
    assert (token_files.repair(same, 10).decode() == same).all() and len(token_files.repair(same, 10).symbols) < 200


def test_damaged_block_is_refused():
    import pyarrow as pa

    block = token_files.pack_block(token_files.repair(np.arange(50, dtype=np.uint32), 60), pa.table({"key": [1], "n": [50]}))
    assert token_files.unpack_block(block, 60)[1].to_pylist() == [{"key": 1, "n": 50}]
    with pytest.raises(ValueError):
        token_files.unpack_block(block[:-1] + bytes([block[-1] ^ 1]), 60)


def brute(rows):
    out, start = [], 0
    for key, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        ids = library_ids(text or "") + [2]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = [tuple(r) for r in QUERIES["op13_token_files"](spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert sorted(got) == brute(rows)


def test_odd_rows_small_blocks_and_parts_of_blocks(spark):
    docs = cases.odd(spark)
    manifest = token_files.write_ids(docs, WORD, fresh_path(spark, "token-files"), block_ids=500)
    read = token_files.read_ids(manifest).collect()
    got = {r.start: r for r in read}
    assert len(read) == docs.count() and manifest.filter("place > 0").count() > 0
    start, last = 0, -1
    for s in sorted(got):  # keys ascend, ranges are gapless
        row = got[s]
        assert s == start and (row.id is None or row.id >= last)
        start, last = start + row.n_tokens, row.id if row.id is not None else 1 << 62
    texts = {(i, t) for i, t, *_ in cases.rows()}
    expected = sorted(np.array(library_ids(t or "") + [2], "<u4").tobytes() for i, t in [(i, t) for i, t, *_ in cases.rows()])
    assert sorted(bytes(r.ids) for r in read) == expected and len(texts) < len(read)
    whole = np.concatenate([np.frombuffer(got[s].ids, "<u4") for s in sorted(got)])
    before = 0
    for block in sorted((r.asDict() for r in manifest.collect()), key=lambda b: (b["part"], b["place"])):
        n = block["n_ids"]
        assert (token_files.ids_between(block, n // 3, n // 2) == whole[before + n // 3 : before + n // 2]).all()
        before += n
    assert token_files.token_files(cases.empty(spark), WORD).count() == 0


def test_text_keys(spark):
    docs = spark.createDataFrame([("b", "two words"), ("a", None), ("c", "x")], "doc_id string, text string")
    got = [(r.doc_id, r.start, r.n_tokens) for r in token_files.token_files(docs, WORD).orderBy("start").collect()]
    assert [g[0] for g in got] == ["a", "b", "c"] and got[0][1:] == (0, 1)
