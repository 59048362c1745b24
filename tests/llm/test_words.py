import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quadrille.llm import words
from quadrille.llm.words import ALNUM, WHITE, Words, slices, windows

TEXT = st.one_of(st.none(), st.text(alphabet="aBé \t\n\x0b.Ñ1", max_size=40))


@settings(max_examples=80, deadline=None)
@given(st.lists(TEXT, max_size=8))
def test_words_are_runs(texts):
    w = Words(pa.array(texts, pa.string()), ~WHITE, prefix=3)
    want = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in texts]
    assert np.diff(w.first).tolist() == [len(x) for x in want]
    assert [bytes(w.raw[s:e]) for s, e in zip(w.start, w.end)] == [x for row in want for x in row]
    low = [x.lower() for row in want for x in row]
    by_word = dict(zip(low, w.hashes.tolist()))
    assert [by_word[x] for x in low] == w.hashes.tolist() and len(set(by_word.values())) == len(by_word)


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT, max_size=6), st.integers(1, 9))
def test_hashes_do_not_depend_on_chunks(texts, size):
    whole, before = Words(pa.array(texts, pa.string()), ~WHITE, prefix=3), words.CHUNK
    try:
        words.CHUNK = size
        cut = Words(pa.array(texts, pa.string()), ~WHITE, prefix=3)
    finally:
        words.CHUNK = before
    assert cut.hashes.tolist() == whole.hashes.tolist() and cut.prefixes.tolist() == whole.prefixes.tolist()


def test_hash_does_not_depend_on_place():
    one = Words(pa.array(["x the Cat"]), ALNUM).hashes
    two = Words(pa.array(["", "the", "CAT, x"]), ALNUM).hashes
    assert one.tolist() == [two[2], two[0], two[1]]


def test_windows_and_slices():
    h = np.arange(1, 6, dtype=np.uint64)
    assert len(windows(h, 3)) == 3 and len(windows(h, 6)) == 0
    same = windows(np.array([1, 9, 3, 1, 7, 3], np.uint64), 3, (0, 2))
    assert same[0] == same[3] and len(set(same.tolist())) == 3
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 30, "", "c"])], ["text"])
    assert [s.num_rows for s in slices(batch, max_bytes=16)] == [3, 2]
    assert list(slices(batch.slice(0, 0))) == []
