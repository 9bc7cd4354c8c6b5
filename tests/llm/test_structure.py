"""Periodic runs, conversation repair and line dedup against plain Python."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrane.llm import conversation_repair as C
from terrane.llm import line_dedup, periodic_runs
from terrane.workspace import Workspace

DOCS = "doc_id long, text string, start int, key string, doc string, at string, keep string, n_words string"
CONVERSATIONS = "conv_id long, turn long, role string, text string, kind int, copy int, letters string, head string, audit int, c int"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def brute_runs(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, q, e - s) for (s, e), q in found.items())


@pytest.mark.parametrize("seed", range(40))
def test_runs_by_grammar(seed):
    rng = random.Random(seed)
    docs = []
    for _ in range(12):
        alphabet = rng.choice([1, 2, 3, 5, 20])
        words = [rng.randint(0, alphabet) for _ in range(rng.randint(0, 70))]
        for _ in range(rng.randint(0, 4)):
            unit = [rng.randint(0, alphabet) for _ in range(rng.randint(1, 9))]
            words[len(words) // 2 : len(words) // 2] = unit * rng.randint(2, 8) + unit[: rng.randint(0, len(unit))]
        docs.append(words)
    first = np.concatenate([[0], np.cumsum([len(w) for w in docs])])
    codes = np.array([x for w in docs for x in w], np.uint64) * np.uint64(77777) + np.uint64(5)
    s, e, p = periodic_runs.runs(codes, first)
    for k, words in enumerate(docs):
        own = (s >= first[k]) & (s < first[k + 1])
        assert [(a - first[k], c, b - a) for a, b, c in zip(s[own], e[own], p[own], strict=True)] == brute_runs(words)


def brute_periodic(i, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(i).encode()) if i is not None else 1, len(w)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (k - a) % p] for k in range(a, n)]
    runs = brute_runs(w)
    gone = {k for s, q, length in runs for k in range(s + q, s + length)}
    best = min(((-length, s, q) for s, q, length in runs), default=None)
    named = (best[1], -best[0], best[2], -1000 * best[0] // best[2]) if best else (None,) * 4
    return (i, n, len(runs), *named, sha("".join(f"{s},{length},{q}\n" for s, q, length in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_periodic_runs(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["a", "b", "the", "of", f"w{rng.randint(0, 300)}"]) for _ in range(rng.choice([5, 40, 300])))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " \n "), (203, "ha " * 3000), (203, "ha " * 3000), (204, "x\ty\n" * 9), (205, "é " * 5 + "b"), (206, "a b " * 4 + "c d " * 4), (None, "la la la la la la la"), (207, "one " + "two three four " * 700)]
    odd = [(*r, 1, "k", "d", "a", "z", "n") for r in rows]
    docs = spark.createDataFrame(odd, DOCS).repartition(3)
    key = lambda r: [(x is None, x) for x in map(str, r)]
    got = sorted((tuple(r) for r in periodic_runs.op11(docs).collect()), key=key)
    assert got == sorted((brute_periodic(*r) for r in rows), key=key)
    assert periodic_runs.op11(docs.limit(0)).count() == 0


def brute_lines(rows, min_chars=40, min_docs=5):
    strip = " \t\n\x0b\x0c\r"
    lower = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s.strip(strip))
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(lower(line)) >= min_chars:
                holders.setdefault(lower(line), set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if i is None or len(holders.get(lower(x), ())) < min_docs or i == max(holders[lower(x)])]
        out.append((i, len(lines), len(lines) - len(left), sha("\n".join(left))))
    return out


def line_rows():
    rng = random.Random(5)
    common = ["Copyright by the Owners, all rights are reserved here", "é" * 40, "ß" * 39, "short", "Lines of some forty-odd characters and more", "   padded line, which is long enough to be a key \t"]
    rows = []
    for i in range(60):
        lines = [f"own line {i} {k} " + "x" * rng.randint(0, 60) for k in range(rng.randint(0, 6))]
        for c in common:
            if rng.random() < 0.4:
                lines.insert(rng.randint(0, len(lines)), rng.choice([c, c.upper() if c.isascii() else c, f"\t{c}\r"]))
        lines += [common[0]] * rng.choice([0, 0, 3])
        rows.append((i, "\n".join(lines)))
    four = "this line of forty characters is in four documents"
    rows += [(70 + i, f"{four}\nand\n\n") for i in range(4)] + [(80, None), (81, ""), (82, "\n\n"), (83, common[0] + "\n" + "z" * 100_000), (84, rows[3][1]), (84, rows[3][1]), (None, common[0] + "\nx"), (-7, common[0])]
    return rows


def test_line_dedup(spark):
    rows = line_rows()
    docs = spark.createDataFrame([(*r, 1, "k", "d", "a", "z", "n") for r in rows], DOCS).repartition(3)
    key = lambda r: [(x is None, x) for x in map(str, r)]
    got = sorted((tuple(r) for r in line_dedup.op13(docs).collect()), key=key)
    assert got == sorted(brute_lines(rows), key=key)
    assert line_dedup.op13(docs.limit(0)).count() == 0


def test_line_bitmaps():
    at = np.array([0, 3, 17])
    keep = line_dedup.unpacked(line_dedup.packed(at), 40)
    assert (np.flatnonzero(~keep) == at).all() and len(keep) == 40


@pytest.mark.parametrize("seed", range(30))
def test_line_ranges(seed):
    """Keys cut over ranges and batches at any place."""
    rng = random.Random(seed)
    rows = sorted(((rng.randint(0, 4), 7, rng.randint(0, 9), k) for k in range(rng.randint(1, 90))), key=lambda r: (r[0], r[1], -r[2], r[3]))
    holders = {}
    for h, _, d, _ in rows:
        holders.setdefault(h, set()).add(d)
    want = {(d, k) for h, _, d, k in rows if len(holders[h]) >= 5 and d < max(holders[h])}
    # Ranges are cut between documents of a key, batches anywhere.
    ranges = [[[rows[0]]]]
    for before, row in itertools.pairwise(rows):
        if before[:3] != row[:3] and rng.random() < 0.2:
            ranges.append([[row]])
        elif rng.random() < 0.3:
            ranges[-1].append([row])
        else:
            ranges[-1][-1].append(row)
    told = []
    for r in ranges:
        stream = (pa.RecordBatch.from_arrays([pa.array([x[c] for x in b], pa.int64()) for c in range(4)], names=["h1", "h2", "doc", "at"]) for b in r)
        for out in line_dedup.streamed(stream):
            told += list(zip(*(c.to_pylist() for c in out.columns), strict=True))
    counts, tops = {}, {}
    for kind, h1, _, doc, at in told:
        if kind == line_dedup.COUNT:
            counts[h1], tops[h1] = counts.get(h1, 0) + at, max(doc, tops.get(h1, doc))
    got = [(doc, at) for kind, h1, _, doc, at in told if kind == line_dedup.DROP or (kind == line_dedup.OPEN and counts[h1] >= 5 and doc < tops[h1])]
    assert len(got) == len(set(got)) and set(got) == want


def cheapest(rows):
    """Every string of edits by cost, then by letters, until one fits: plain search."""
    import heapq

    heap, seen = [(0, "", 0, 0)], set()
    while heap:
        cost, edits, i, state = heapq.heappop(heap)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        if i == len(rows) and state in (0, 3):
            return cost, edits
        expected, to = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}[state]
        heapq.heappush(heap, (cost + 2, edits + "I", i, to))
        if i < len(rows):
            role, fault = rows[i]
            heapq.heappush(heap, (cost + 3, edits + "D", i + 1, state))
            if fault in ("none", "truncated"):
                extra = fault == "truncated"
                if role[:1] == expected:
                    heapq.heappush(heap, (cost + extra, edits + "K", i + 1, to))
                if role[:1] == "s" and state == 0:
                    heapq.heappush(heap, (cost + extra, edits + "K", i + 1, 1))
                heapq.heappush(heap, (cost + 2 + extra, edits + "R", i + 1, to))
    raise AssertionError


def brute_conversation(rows):
    """rows: (conv_id, turn, role, text) of one conversation, before damage."""
    after = []
    for conv, turn, role, text in rows:
        say = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20
        role, text = say(role), say(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        after += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
    faults, seen = [], set()
    for _, role, text in after:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "none")
        seen.add((role, text))
    cost, edits = cheapest([(r[1], f) for r, f in zip(after, faults, strict=True)])
    turns = [r[0] for r in after if r[0] is not None]
    fixed = [f"{r}:{t}" for r, t in C.repaired(iter(edits), iter([r[1:] for r in after]))]
    roles = "".join(line[0] for line in fixed)
    assert re.fullmatch("(s?(ua)+)?", roles)
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(after))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (rows[0][0], gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, edits, sha("\n".join(fixed)))


def conversation_rows():
    rng = random.Random(9)
    rows = []
    for c in range(150):
        for t in range(rng.randint(1, 9)):
            role = rng.choice(["system"] if t == 0 and rng.random() < 0.3 else ["user", "assistant", "user", "assistant", "tool", "system"])
            rows.append((c, t * rng.choice([1, 1, 2]), role, rng.choice(["Hello there.", "So it ends", f"Say {t}!", "  \n", f"Well {c}? \t", "Hello there.", ""])))
    rows += [(None, 0, "user", "Who."), (None, None, "assistant", "Me."), (900, None, None, None), (900, None, "user", "a."), (901, 5, "", "x."), (902, 1, "user", "b."), (902, 1, "user", "b."), (903, 1, "system", "only.")]
    rows += [(950, t, "user" if t % 2 else "assistant", f"Line {t % 400}." + "y" * (t % 7)) for t in range(3000)]
    rows += [(960 + k, 0, "user", "q.") for k in range(60)]
    return rows


def test_conversation_repair(spark):
    rows = conversation_rows()
    df = spark.createDataFrame([(*r, 1, 2, "l", "h", 3, 4) for r in rows], CONVERSATIONS).repartition(5)
    own = {}
    for r in rows:
        own.setdefault(r[0], []).append(r)
    got = {r.conv_id: tuple(r) for r in C.op12(df).collect()}
    assert got == {c: brute_conversation(v) for c, v in own.items()}
    assert C.op12(df.limit(0)).count() == 0


def test_signature_pieces(spark, monkeypatch):
    """A conversation over many ranges has one signature."""
    rows = [(1, t, "user" if t % 2 else "assistant", f"T {t}.") for t in range(2000)] + [(2, 1, "user", "x.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    ws = Workspace(spark, "signature-test")
    monkeypatch.setattr(C, "partitions", lambda _: 16)
    got = {r.conv_id: r.letters for r in C.signatures(df, ws).collect()}
    assert got == {1: "au" * 1000, 2: "u"}
    edits = {r.letters: (r.cost, r.audit) for r in C.cheapest_edits(C.signatures(df, ws)).collect()}
    assert edits == {w: cheapest([({"u": "user", "a": "assistant"}[x], "none") for x in w]) for w in got.values()}
    assert df.filter(F.col("conv_id") == 2).count() == 1
    ws.close()
