"""Vectorised scanning against plain Python."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from geodiag.llm.words import SPACED, chunks, hash_spans, shingles, text_buffer, word_spans

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbB é\n\t-漢", max_size=40)), max_size=8))
def test_spans_and_hashes(texts):
    buf, off = text_buffer(pa.array(texts, pa.string()))
    starts, stops, doc = word_spans(buf, off, SPACED)
    want = [(i, w) for i, t in enumerate(texts) for w in WORD.findall(t or "")]
    got = [(int(d), buf[a:b].tobytes().decode()) for a, b, d in zip(starts, stops, doc)]
    assert got == want
    h = hash_spans(buf, starts, stops)
    fold = [w.translate({c: c + 32 for c in range(65, 91)}) for _, w in want]
    assert len(set(h.tolist())) == len(set(fold)) and len(set(zip(h.tolist(), fold))) == len(set(fold))


def test_hash_is_the_same_anywhere():
    words = ["alpha", "x", "longer-word"] * 1000
    a, oa = text_buffer(pa.array([" ".join(words)]))
    b, ob = text_buffer(pa.array(["  " + "\n".join(words)]))
    ha, hb = (hash_spans(x, *word_spans(x, o, SPACED)[:2]) for x, o in ((a, oa), (b, ob)))
    assert (ha == hb).all() and (ha[:3] == ha[3:6]).all()


def test_sliced_arrays_and_chunks():
    arr = pa.array(["a b", None, "", "c", "d e f"]).slice(1)
    buf, off = text_buffer(arr)
    assert buf.tobytes() == b"cd e f" and off.tolist() == [0, 0, 0, 1, 6]
    assert [j for _, j in chunks(off, 2)][-1] == 4 and sum(j - i for i, j in chunks(off, 2)) == 4


def test_shingles_of_short_texts():
    buf, off = text_buffer(pa.array(["a b", "a b c d", "", "a b"]))
    s, e, d = word_spans(buf, off, SPACED)
    x, doc = shingles(hash_spans(buf, s, e), d, 4, 3)
    assert sorted(doc.tolist()) == [0, 1, 1, 3]
    by = {k: x[doc == k] for k in (0, 3)}
    assert (by[0] == by[3]).all() and len(np.unique(x)) == 3
