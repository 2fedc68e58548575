import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from channelgraph.llm import periodic

WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"


def brute(words):
    """Every stretch with a period of its own, tried one period after the other."""
    out = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def drawn(rng, most, letters):
    words = [rng.randrange(letters) for _ in range(rng.randrange(most))]
    if words and rng.random() < 0.6:
        a = rng.randrange(len(words))
        p = 1 + (len(words) - a) // rng.randrange(3, 10)
        for i in range(a, len(words)):
            words[i] = words[a + (i - a) % p]
    return words


@pytest.mark.parametrize("piece", [1, 7, 64, 1 << 18])
def test_streams_in_pieces(monkeypatch, piece):
    monkeypatch.setattr(periodic, "PIECE", piece)
    rng = random.Random(piece)
    for _ in range(400):
        words = drawn(rng, 150, rng.choice([1, 2, 3, 6]))
        start, end, period = periodic.runs_in(np.array(words, dtype=np.int64))
        assert list(zip(start.tolist(), (end - start).tolist(), period.tolist())) == brute(words)


def test_words_that_come_one_by_one():
    words = [0, 1, 1, 2] * 30 + [5] + [3] * 9 + [7, 8] * 2
    catcher = periodic.RunCatcher()
    for w in words:
        catcher.append(np.array([w]))
    start, end, period = catcher.finish()
    assert list(zip(start.tolist(), (end - start).tolist(), period.tolist())) == brute(words) == [(0, 120, 4), (121, 9, 1)]


def test_a_name_that_misleads_is_found_out(monkeypatch):
    """All names of a level are equal at first: the words are compared and the stream is read again."""
    real, tries = periodic.mixed, []

    def bad(x):
        if len(x) == 1 and x[0] <= 3:
            tries.append(int(x[0]))
        return np.ones_like(x) if len(tries) == 1 and len(x) > 1 else real(x)

    monkeypatch.setattr(periodic, "mixed", bad)
    words = [0, 1, 2, 3, 4, 5, 6, 7] * 4
    start, end, period = periodic.runs_in(np.array(words))
    assert (start.tolist(), end.tolist(), period.tolist()) == ([0], [32], [8])
    assert len(tries) > 1


def test_long_constant_and_long_period():
    start, end, period = periodic.runs_in(np.zeros(300_000, dtype=np.int64))
    assert (start.tolist(), end.tolist(), period.tolist()) == ([0], [300_000], [1])
    unit = np.random.default_rng(0).permutation(60_000)
    start, end, period = periodic.runs_in(np.concatenate([[70_000], np.tile(unit, 5), [70_001]]))
    assert (start.tolist(), end.tolist(), period.tolist()) == ([1], [300_001], [60_000])


ROWS = [
    (1, "a a a a a a"), (2, "a a a a a"), (3, None), (4, ""), (5, " \t\n\x0b\x0c\r "), (6, "x y " * 50_000), (None, "b\tb\nb b b b b"), (None, None),
    (7, "é é é é " * 6), (8, "A a " * 8), (1, "a a a a a a"), (9, "w1 w2 w3 " * 4 + "z " * 7), (10, "p q r s"),
]


def test_documents(docs_of, clashing):
    rng = random.Random(4)
    more = [(100 + i, " ".join(f"w{w}" for w in drawn(rng, 300, rng.choice([2, 3, 9])))) for i in range(150)]
    for df in (docs_of(ROWS + more), clashing(docs_of(ROWS + more)).repartition(5)):
        got = periodic.periodic_runs(df).collect()
        want = []
        for i, text in ROWS + more:
            words = (text or "").encode().split()
            runs = brute(words) if len(words) < 1000 else [(0, len(words), 2)]
            want.append((i or 0, len(words), runs, collapse(words, runs).decode()))
        assert sorted((r["id"] or 0, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got) == sorted(want)


def test_query(spark, docs_of, small):
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{w}" for w in drawn(rng, 120, rng.choice([2, 4, 30])))) for i in range(300)] + ROWS
    got = periodic.op13_dyadic_runs(spark, small(documents=docs_of(rows))).collect()
    want, planted = [], 0
    for i, text in rows:
        words = (text or "").encode().split()
        h = zlib.crc32(str(i).encode()) if i is not None else 0
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
            planted += 1
        runs = brute(words) if n < 1000 else [(0, n, 2)]
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        milli = 1000 * best[1] // best[2] if runs else None
        want.append((i, len(runs), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapse(words, runs)).hexdigest()))
    order = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)
    assert planted > 20


def test_empty_table(spark, docs_of, small):
    assert periodic.periodic_runs(docs_of([])).collect() == []
    assert periodic.op13_dyadic_runs(spark, small(documents=docs_of([]))).collect() == []
