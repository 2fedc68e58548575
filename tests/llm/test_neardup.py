import random
import re

import numpy as np
import pytest

from channelgraph.llm import neardup
from channelgraph.llm.components import components


def sets_of(texts, size):
    out = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        out.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    return out


def brute(ids, texts, size, percent=80):
    """Group (index of its first row) of each row, by all pairs."""
    sets = sets_of(texts, size)
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(ids))], sets


def words(draw, n):
    return ["".join(draw.choice("abcdefghij") for _ in range(draw.randrange(1, 7))) for _ in range(n)]


def edited(draw, text, share):
    return [w if draw.random() > share else words(draw, 1)[0] for w in text]


def corpus(seed=3):
    draw = random.Random(seed)
    base, boiler = words(draw, 90), words(draw, 60)
    texts = [" ".join(words(draw, draw.randrange(1, 120))) for _ in range(40)]
    texts += [" ".join(edited(draw, base, draw.choice([0, 0.01, 0.02, 0.04, 0.07]))) for _ in range(70)]
    texts += [" ".join(boiler + words(draw, draw.randrange(2, 12))) for _ in range(40)]
    texts += [" ".join(edited(draw, t.split(), 0.02)) for t in texts[:15]]
    texts += [texts[0].upper(), texts[1].replace(" ", "\n\t"), texts[2], "one two", "one two", "ONE  two", "one", "É é x y z", "é é x y z", None, "", "  \n", "\x1cq", "q"]
    texts += [" ".join(words(draw, 30_000))]
    texts += [texts[-1] + " more"]
    return texts


@pytest.mark.parametrize(("size", "rare", "block"), [(4, 16, 1024), (5, 16, 1024), (5, 4, 16)])
def test_groups_against_all_pairs(docs_of, clashing, monkeypatch, size, rare, block):
    """Small limits send most rows the way of common values, over several blocks."""
    monkeypatch.setattr(neardup, "RARE", rare)
    monkeypatch.setattr(neardup, "BLOCK_NODES", block)
    texts = corpus()
    ids = list(range(100, 100 + len(texts)))
    want, sets = brute(ids, texts, size)
    rows = sorted(neardup.near_groups(clashing(docs_of(list(zip(ids, texts)))), size).collect(), key=lambda r: r["id"])
    assert [r["n_shingles"] for r in rows] == [len(s) for s in sets]
    assert [r["component_id"] for r in rows] == [ids[w] for w in want]
    assert all((r["group"] is None) == (not s) for r, s in zip(rows, sets))


def test_one_of_each_group_stays(docs_of, clashing):
    texts = corpus(8)[:170] + [None, "", "a b c d e f", "a b c d e f"]
    ids = list(range(len(texts)))
    want, sets = brute(ids, texts, 5)
    df = clashing(docs_of(list(zip(ids, texts))))
    out = neardup.near_dedup(df)
    assert out.columns == df.columns
    assert sorted(r["doc_id"] for r in out.collect()) == sorted({i for i, w in zip(ids, want) if w == i})


def test_repeated_rows_and_null_ids(docs_of):
    rows = [(1, "a b c d e f g")] * 3 + [(None, "a b c d e f g"), (None, "p q r s t u"), (None, "p q r s t u"), (4, None), (4, None)]
    got = neardup.near_groups(docs_of(rows)).collect()
    assert sorted(str(r["component_id"]) for r in got) == ["1"] * 4 + ["4", "4", "None", "None"]
    kept = [(r["doc_id"], r["text"]) for r in neardup.near_dedup(docs_of(rows)).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [(1, "a b c d e f g"), (None, "p q r s t u"), (4, None), (4, None)]))


def test_empty_table(docs_of):
    assert neardup.near_groups(docs_of([])).collect() == [] and neardup.near_dedup(docs_of([])).collect() == []


def test_block_links_against_all_pairs():
    draw = np.random.default_rng(1)
    sets = [np.unique(draw.integers(0, 40 if i % 2 else 4000, draw.integers(1, 60))).astype(np.int64) for i in range(80)]
    sets += [s[:-1] if len(s) > 5 else s for s in sets[:30]]
    u, v = neardup.block_links(np.arange(len(sets)), sets, 80)
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in zip(u.tolist(), v.tolist()):
        root[find(a)] = find(b)
    want = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = want[i], want[j]
                want = [min(a, b) if w in (a, b) else w for w in want]
    assert all((find(i) == find(j)) == (want[i] == want[j]) for i in range(len(sets)) for j in range(i))


@pytest.mark.parametrize("n", [10, 45, 90, 900])
def test_links_just_at_the_threshold_are_not_lost_by_sketches(n):
    """120 000 pairs of sets of n values with a similarity of 0.8 (0.82 for ten), through both ways in which pairs meet."""
    pairs, alone = 30_000, max(1, n // 9)
    draw = np.random.default_rng(n)
    few = min(neardup.COMMON, n * 20 // 100 + 1)
    lost = 0
    for _ in range(4):
        # of all values of a pair only the smallest K of each side matter
        both = draw.integers(0, 2**63, (pairs, n - alone), dtype=np.uint64)
        sides = []
        for _ in range(2):
            own = draw.integers(0, 2**63, (pairs, alone), dtype=np.uint64)
            sides.append(np.sort(np.concatenate([both, own], axis=1), axis=1)[:, : neardup.K])
        kept = [np.pad((x >> np.uint64(31)).astype(np.uint32), ((0, 0), (0, neardup.K - x.shape[1])), constant_values=neardup.PAD) for x in sides]
        close = neardup.union_estimate(*kept) >= neardup.LEAST_ESTIMATE
        first = [x[:, : neardup.INDEXED] for x in sides]

        def met(width, first=first):
            """Which pairs have one of their first values in common, and how many."""
            together = np.sort(np.concatenate([f[:, :width] for f in first], axis=1), axis=1)
            return (together[:, 1:] == together[:, :-1]).sum(axis=1)

        shared = met(neardup.INDEXED)
        # a pair whose shared values are all common has at least that many, enough to enter common lists, and meets in one
        enough = shared >= neardup.COMMON_SHARE * min(neardup.INDEXED, n)
        in_lists = enough & (met(few) > 0)
        lost += int((~(close & (shared > 0))).sum() + (~in_lists).sum())
    assert lost == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7), (2000, 1999), (1999, 2000)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(50)}, 1999: 1999, 2000: 1999}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_patterned_words_are_told_apart(docs_of):
    """A word after Thue and Morse and its complement cancel in sums of powers, whatever the base."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    two = "".join("ba"[bin(i).count("1") % 2] for i in range(1024))
    rows = neardup.near_groups(docs_of([(1, one), (2, two), (3, f"{one} x y z w"), (4, f"{two} x y z w")])).collect()
    assert sorted((r["id"], r["component_id"]) for r in rows) == [(1, 1), (2, 2), (3, 3), (4, 4)]


def test_texts_of_rows_without_id(spark, docs_of):
    """Each of many rows without id is read for itself, not for every other one."""
    draw = random.Random(8)
    texts = [" ".join(words(draw, 30)) for _ in range(400)]
    texts += [t + " tail" for t in texts]
    found = neardup.near_groups(docs_of([(None, t) for t in texts]))
    groups = {}
    for r in found.collect():
        groups.setdefault(r["group"], []).append(r["n_shingles"])
    assert len(groups) == 400 and all(len(g) == 2 for g in groups.values())
