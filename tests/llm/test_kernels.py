"""Numpy kernels against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa

from terrane.llm import kernels as K
from terrane.llm.collection_bwt import Collection
from terrane.llm.fm_index import FMIndex
from terrane.llm.language_crf import Crf, marginals, word_marginals
from terrane.llm.minhash import shingle_sets, sketches
from terrane.llm.suffix_dedup import repeated_windows


def _texts(seed=0, n=40):
    rng = random.Random(seed)
    return [" ".join(rng.choice(["a", "bé", "Ccc", "\t", "\n\n", "dd.", "x" * 700]) for _ in range(rng.randint(0, 30))) for _ in range(n)] + ["", " ", None]


def test_words_and_codes():
    texts = _texts()
    buf, offs = K.text_bytes(pa.array(texts))
    words = K.find_words(buf, offs)
    want = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    got = [[buf[s:e].tobytes().decode() for s, e in zip(words.start[a:b], words.end[a:b], strict=True)] for a, b in zip(words.first, words.first[1:], strict=False)]
    assert got == want
    codes, seen = K.word_codes(buf, words), {}
    for word, code in zip([w for ws in want for w in ws], codes, strict=True):
        assert seen.setdefault(word, code) == code
    assert len(set(seen.values())) == len(seen)


def test_windows_and_slices():
    v = np.random.default_rng(0).integers(0, 50, 200).astype(np.uint64)
    for w in (1, 2, 3, 7, 64):
        assert (K.window_min(v, w) == [v[i : i + w].min() for i in range(201 - w)]).all()
    offs = np.array([0, 5, 5, 500, 505, 900])
    assert list(K.slices(offs, 10)) == [(0, 2), (2, 3), (3, 4), (4, 5)]
    assert K.ranges(np.array([3, 9]), np.array([2, 3])).tolist() == [3, 4, 9, 10, 11]


def test_collection_transform():
    rng = np.random.default_rng(1)
    for _ in range(60):
        strs = [bytes(rng.integers(97, 97 + rng.integers(1, 4), rng.integers(0, 12)).astype(np.uint8)) for _ in range(rng.integers(1, 6))]
        c = Collection(np.frombuffer(b"".join(strs), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in strs])]))
        pos, bwt, lcp = c.suffix_order()
        want = sorted((s[i:] + b"\0", j) for j, s in enumerate(strs) for i in range(len(s) + 1))
        owner = np.searchsorted(c.end, pos)
        assert [(strs[j][p - c.begin[j] :] + b"\0", j) for p, j in zip(pos, owner, strict=True)] == want
        for k in range(1, len(want)):
            a, b = want[k - 1][0][:-1], want[k][0][:-1]
            assert lcp[k] == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_repeated_windows():
    rng = random.Random(5)
    base = "".join(rng.choice("ab") for _ in range(60))
    strs = [base[rng.randint(0, 20) :][:30].encode() for _ in range(12)] + [b"z" * 25]
    offs = np.concatenate([[0], np.cumsum([len(s) for s in strs])])
    doc, start = np.array([rng.randint(0, 3) for _ in strs]), np.arange(len(strs)) * 100
    s, o = repeated_windows(np.frombuffer(b"".join(strs), np.uint8), offs, doc, start, 10)
    seen, want = {}, set()
    for _, _, i, k in sorted((doc[i], start[i] + k, i, k) for i, t in enumerate(strs) for k in range(len(t) - 9)):
        if strs[i][k : k + 10] in seen:
            want.add((i, k))
        seen[strs[i][k : k + 10]] = 1
    assert set(zip(s.tolist(), o.tolist(), strict=True)) == want


def test_backward_search():
    rng = np.random.default_rng(2)
    text = rng.integers(1, 6, 300).astype(np.uint16)
    offs = np.array([0, 100, 100, 250, 300])
    index = FMIndex(text, offs)
    query = rng.integers(1, 8, 60).astype(np.uint16)
    ends = np.arange(1, 61)
    matched, low, high = index.matching_statistics(query, ends, 9)
    parts = [text[a:b].tolist() for a, b in zip(offs, offs[1:], strict=False)]
    places = lambda q: sum(p[i : i + len(q)] == q for p in parts for i in range(len(p) - len(q) + 1))
    for e, m, lo, hi in zip(ends, matched, low, high, strict=True):
        assert m == max((k for k in range(min(9, e) + 1) if k == 0 or places(query[e - k : e].tolist())), default=0)
        if m:
            assert hi - lo == places(query[e - m : e].tolist())


def test_sketches_are_full_and_estimate():
    words = [f"w{i}" for i in range(400)]
    texts = ["one", "one two three four five six", " ".join(words), " ".join(words[40:] + [f"v{i}" for i in range(40)])]
    buf, offs = K.text_bytes(pa.array(texts))
    row, code = shingle_sets(buf, offs)
    sig = sketches(row, code, len(texts), 200)
    assert (sig != np.uint64(2**64 - 1)).all()
    a, b = set(code[row == 2].tolist()), set(code[row == 3].tolist())
    assert abs((sig[2] == sig[3]).mean() - len(a & b) / len(a | b)) < 0.12


def test_block_marginals_equal_plain():
    rng = np.random.default_rng(0)
    crf = Crf(["a", "b", "c"], np.zeros((1, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    e, first = rng.normal(size=(150, 3)), np.array([0, 1, 1, 70, 150])
    out = word_marginals(crf, e, first)
    for a, b in zip(first, first[1:], strict=False):
        if b > a:
            assert np.allclose(marginals(e[None, a:b], crf.transition, crf.start)[0][0], out[a:b])
