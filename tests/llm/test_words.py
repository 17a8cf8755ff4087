import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kerbwise.llm import words as W
from kerbwise.llm.fm_index import FMIndex
from kerbwise.llm.jaccard_join import pack, pack_sorted, unpack, unpack_sorted
from kerbwise.llm.substring_dedup import squeeze, unsqueeze


@settings(deadline=None, max_examples=60)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbé \t\n\x0b\x0c\r ", max_size=30)), max_size=8))
def test_words_are_runs_without_ascii_space(texts):
    got, want = [], []
    for w in W.words(pa.array(texts, pa.string())):
        for i in range(len(w)):
            got.append([w.data[s:e].tobytes() for s, e in zip(w.starts[w.bounds[i] : w.bounds[i + 1]], w.ends[w.bounds[i] : w.bounds[i + 1]])])
    want = [(t or "").encode().split() for t in texts]
    assert got == want


def test_equal_words_and_only_those_share_a_hash():
    texts = ["the cat the dog", "dog  cat", "hot dogma"]
    w = next(W.words(pa.array(texts)))
    names = [w.data[s:e].tobytes() for s, e in zip(w.starts, w.ends)]
    assert len(set(zip(names, w.hashes.tolist()))) == len(set(names)) == len(set(w.hashes.tolist()))


def test_chunks_do_not_change_hashes(monkeypatch):
    texts = pa.array([f"doc {i} " + "word " * i for i in range(50)] + [None, ""])
    whole = np.concatenate([w.hashes for w in W.words(texts)])
    monkeypatch.setattr(W, "CHUNK_BYTES", 64)
    parts = [w for t in [texts] for row, *_ in [(0,)] for w in W.words(t)]
    assert np.array_equal(np.concatenate([w.hashes for w in parts]), whole)


def test_shingle_sets_follow_the_short_text_rule():
    w = next(W.words(pa.array(["a b", "a b", "a b c", "", None, "a b c a b c"]), lower=True))
    values, bounds = W.shingle_sets(w, 3)
    sets = [set(values[i:j].tolist()) for i, j in zip(bounds, bounds[1:])]
    assert [len(s) for s in sets] == [1, 1, 1, 0, 0, 3]
    assert sets[0] == sets[1] and not sets[0] & sets[2] and sets[2] < sets[5]


def test_packing_round_trips():
    x = np.sort(np.random.default_rng(1).integers(0, 2**63, 100).astype(np.uint64))
    assert np.array_equal(unpack(pack(x)), x) and np.array_equal(unpack_sorted(pack_sorted(x)), x)
    y = np.arange(70_000) % 65_537
    assert np.array_equal(unsqueeze(squeeze(y)), y)


@pytest.mark.parametrize("sigma", [2, 5, 300])
def test_fm_index_counts_patterns(sigma):
    text = np.random.default_rng(sigma).integers(0, sigma, 3000)
    text[-6:] = 0
    index = FMIndex(text, sigma, 5)
    starts = np.array([s for s in range(0, 2900, 7) if (text[s : s + 5] > 0).all()])
    low, high = index.intervals(text, starts, 5)
    for s, a, b in zip(starts, low, high):
        want = {i for i in range(2996) if np.array_equal(text[i : i + 5], text[s : s + 5])}
        assert set(index.suffixes[a:b].tolist()) == want
