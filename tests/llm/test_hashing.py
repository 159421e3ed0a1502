import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spectraloom.llm import hashing as H

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \t\n\x0b\x1cé", max_size=40), max_size=8))
def test_word_hashes_agree_with_words(texts):
    raw = [t.encode() for t in texts]
    hashes, counts = H.word_hashes([memoryview(t) for t in raw])
    words = [w for t in raw for w in WORD.findall(t)]
    assert counts.tolist() == [len(WORD.findall(t)) for t in raw]
    by_hash = {}
    for w, h in zip(words, hashes.tolist()):
        assert by_hash.setdefault(h, w) == w
    assert len(by_hash) == len(set(words))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "c"]), max_size=12), max_size=5), st.integers(1, 4))
def test_window_hashes(docs, n):
    words, counts = H.word_hashes([memoryview(" ".join(d).encode()) for d in docs])
    hashes, starts = H.window_hashes(words, counts, n)
    want, at = [], 0
    for d in docs:
        want += [(at + i, tuple(d[i : i + n])) for i in range(len(d) - n + 1)]
        at += len(d)
    assert starts.tolist() == [i for i, _ in want]
    assert len({w for _, w in want}) == len({(w, h) for (_, w), h in zip(want, hashes.tolist())}) == len(set(hashes.tolist()))


def test_long_text_is_cut_between_words(monkeypatch):
    monkeypatch.setattr(H, "CHUNK", 64)
    text = b" ".join(b"w%d" % (i % 50) for i in range(400)) + b" " + b"x" * 500 + b" end"
    hashes, counts = H.word_hashes([memoryview(text)])
    monkeypatch.undo()
    whole, n = H.word_hashes([memoryview(text)])
    assert counts.tolist() == n.tolist() and hashes.tolist() == whole.tolist()


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=50))
def test_packing_round_trip(values):
    v = np.sort(np.array(values, dtype=np.uint64))
    assert H.unpack_sorted(H.pack_sorted(v)).tolist() == v.tolist()
    small = v % np.uint64(1000)
    assert H.unpack_counts(H.pack_counts(small)).tolist() == small.tolist()
    flags = (v % np.uint64(2)).astype(bool)
    assert H.unpack_bits(H.pack_bits(flags), len(flags)).tolist() == flags.tolist()
    edges = H.bucket_edges(v, 7)
    assert edges[0] == 0 and edges[-1] == len(v) and (np.diff(edges) >= 0).all()


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_text_bytes_of_nulls_and_slices(kind):
    a = pa.chunked_array([pa.array(["x", None, "", "yé"], kind).slice(1), pa.array([], kind)])
    assert [bytes(t) for t in H.text_bytes(a)] == [b"", b"", "yé".encode()]
