import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from channelgraph.llm import substrings
from channelgraph.llm.suffixes import sharing


def brute(texts, least):
    """Kept bytes and removed runs of each text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + least] for b in data for i in range(len(b) - least + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - least + 1):
            if seen[b[i : i + least]] > 1:
                gone[i : i + least] = True
        runs = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]]))).reshape(-1, 2)
        out.append((bytes(np.frombuffer(b, np.uint8)[~gone]), [tuple(r) for r in runs.tolist()]))
    return out


@pytest.mark.parametrize("letters", [1, 2, 3, 250])
def test_sharing_against_all_windows(letters):
    draw = random.Random(letters)
    for _ in range(60):
        texts = [bytes(draw.randrange(letters) for _ in range(draw.randrange(60))) for _ in range(draw.randrange(1, 9))]
        texts += [texts[0][3:] + texts[-1], texts[-1]] if draw.random() < 0.5 else []
        for least in (1, 3, 8, 20):
            seen = Counter(t[i : i + least] for t in texts for i in range(len(t) - least + 1))
            want = [x for t in texts for x in [*(i + least <= len(t) and seen[t[i : i + least]] > 1 for i in range(len(t))), False]]
            assert sharing(texts, least).tolist() == want


def words(draw, n):
    return " ".join("".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randrange(1, 9))) for _ in range(n))


def corpus():
    draw = random.Random(5)
    passage, other = words(draw, 70), words(draw, 55)
    texts = [words(draw, draw.randrange(0, 200)) for _ in range(30)]
    texts += [f"{words(draw, 20)} {passage} {words(draw, 9)}" for _ in range(25)]
    texts += [texts[0], texts[1].upper(), texts[2] + " tail", passage, passage + passage, f"{other} {other}"]
    texts += [None, "", "é" * 150, "é" * 150, "x" * 1000, "ab" * 300, "x" * 199, words(draw, 4000)]
    texts += [texts[-1][1000:9000], texts[-1]]
    return texts


def compare(rows, texts, least=200):
    for (kept, runs), r in zip(brute(texts, least), rows, strict=True):
        assert bytes(r["kept"]) == kept
        assert [(s["start"], s["end"]) for s in r["spans"]] == runs


def test_against_all_windows(docs_of, clashing):
    texts = corpus()
    docs = clashing(docs_of(list(enumerate(texts))))
    compare(sorted(substrings.without_repeats(docs).collect(), key=lambda r: r["id"]), texts)


def test_crowded_anchors_are_divided(docs_of, monkeypatch):
    """The same rows when an anchor may hold two different texts only."""
    texts = corpus()
    monkeypatch.setattr(substrings, "TOGETHER", 2)
    compare(sorted(substrings.without_repeats(docs_of(list(enumerate(texts)))).collect(), key=lambda r: r["id"]), texts)


def test_repeated_rows_and_null_ids(docs_of):
    text = words(random.Random(1), 80)
    rows = substrings.without_repeats(docs_of([(1, text), (1, text), (None, text + "z"), (2, None)])).collect()
    assert len(rows) == 4
    assert sorted(bytes(r["kept"]) for r in rows) == [b"", b"", b"", b"z"]


def test_empty_table(docs_of):
    assert substrings.without_repeats(docs_of([])).collect() == []


def test_query(spark, small, docs_of):
    texts = corpus()
    rows = substrings.op2_bwt_substrings(spark, small(documents=docs_of(list(enumerate(texts))))).collect()
    for (kept, runs), r in zip(brute(texts, 200), sorted(rows, key=lambda r: r["doc_id"]), strict=True):
        got = (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])
        n = len((texts[r["doc_id"]] or "").encode())
        assert got == (n, n - len(kept), len(runs), hashlib.sha256(kept).hexdigest())


def test_patterned_texts_are_told_apart(docs_of):
    """Texts after Thue and Morse and their complements cancel in sums of powers: only bytes that repeat go."""
    def pattern(n, letters):
        return "".join(letters[bin(i).count("1") % 2] for i in range(n))

    draw = random.Random(2)
    anchor = words(draw, 60)[:240]
    texts = [pattern(512, "ab"), pattern(512, "ba"), pattern(1024, "cd"), pattern(1024, "dc")]
    texts += [pattern(256, x) + anchor + pattern(256, y) for x in ("ef", "fe") for y in ("gh", "hg")]
    rows = substrings.without_repeats(docs_of(list(enumerate(texts)))).collect()
    compare(sorted(rows, key=lambda r: r["id"]), texts)
