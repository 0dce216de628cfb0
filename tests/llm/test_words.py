import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewise.llm import words

TEXT = st.text(st.sampled_from("aAbB \n\té\x0b\x1c1.#"), max_size=40)


def brute(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6))
def test_word_hashes_are_equal_exactly_for_equal_words(texts):
    h, at = words.word_hashes(*words.buffers(pa.array(texts, pa.string())))
    got = [h[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
    want = [brute(t) for t in texts]
    assert [len(g) for g in got] == [len(w) for w in want]
    pairs = {(x, y) for g, w in zip(got, want) for x, y in zip(g, w)}
    assert len(pairs) == len({x for x, _ in pairs}) == len({y for _, y in pairs})


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5))
def test_shingle_sets(texts):
    want = []
    for t in texts:
        w = brute(t)
        want.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    got = dict(words.shingle_sets(pa.array(texts)))
    assert [len(got[i]) for i in range(len(texts))] == [len(s) for s in want]
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert len(np.intersect1d(got[i], got[j])) == len(want[i] & want[j])


def test_slices_keep_whole_texts(monkeypatch):
    texts = pa.array(["ab cd " * 50, None, "", "x y z " * 30, "q"])
    want = [s.tolist() for _, s in words.shingle_sets(texts)]
    monkeypatch.setattr(words, "SLICE_BYTES", 16)
    assert [s.tolist() for _, s in words.shingle_sets(texts)] == want
    sliced = pa.concat_arrays([pa.array(["zz"]), texts]).slice(1)
    assert [s.tolist() for _, s in words.shingle_sets(sliced)] == want
