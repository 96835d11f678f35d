import re

import numpy as np
import pyarrow as pa

from railweave.llm.text import Words, shingles

TEXTS = ["a b c", "", "  x\ty\nz ", "Foo foo FOO bar", "é ü\x0bß", "one", "the cat sat on the mat again", "THE cat\tsat on the mat  again"]


def test_words_and_hashes():
    w = Words(pa.array(TEXTS))
    for t, a, b in zip(TEXTS, w.first, w.first[1:], strict=False):
        assert [bytes(w.data[s:e]).decode() for s, e in zip(w.starts[a:b], w.ends[a:b], strict=True)] == re.findall("[^\x20\x09-\x0d]+", t)
    low = Words(pa.array(TEXTS), lower=True)
    at = low.first[3]
    assert low.hashes[at] == low.hashes[at + 1] == low.hashes[at + 2] != low.hashes[at + 3]


def test_shingles_do_not_depend_on_slices():
    long = " ".join(f"w{i % 997}" for i in range(300_000))
    alone = shingles(pa.array([long]), 5)[0]
    among = shingles(pa.array(["x", long, "y z"]), 5)[1]
    assert np.array_equal(alone, among) and len(alone) == 997
    same = shingles(pa.array(TEXTS[-2:]), 5)
    assert np.array_equal(same[0], same[1]) and len(same[0]) == 3
    assert [len(s) for s in shingles(pa.array(["", "  ", "a b"]), 5)] == [0, 0, 1]
