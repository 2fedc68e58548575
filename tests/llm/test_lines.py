import random
from collections import defaultdict

import pytest

from channelgraph.llm import lines

LONG = "this line is long enough to be a key of its own: "
WHITE = " \t\n\x0b\x0c\r"


def lowered(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line)


def brute(rows, least_chars=40, least_docs=5):
    held = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            held[lowered(line.strip(WHITE))].add(i)
    out = []
    for i, text in rows:
        own = (text or "").split("\n")
        kept = []
        for line in own:
            docs = held[lowered(line.strip(WHITE))]
            top = max((d for d in docs if d is not None), default=None)
            if len(lowered(line.strip(WHITE))) < least_chars or len(docs) < least_docs or top == i:
                kept.append(line)
        out.append((-1 if i is None else i, len(own), len(own) - len(kept), "\n".join(kept)))
    return sorted(out)


def result(df):
    return sorted((-1 if r["id"] is None else r["id"], r["n_lines"], r["n_dropped"], r["text"]) for r in df.collect())


def corpus(n, seed=0):
    rng = random.Random(seed)
    shared = [LONG + str(k) for k in range(30)] + ["É" * 40, "k" * 39, "K" * 40, "K" * 40, "İ" * 41]
    rows = []
    for i in range(n):
        own = []
        for _ in range(rng.randrange(0, 12)):
            line = rng.choice(shared) if rng.random() < 0.6 else f"{LONG} own {i} {rng.random()}"
            line = rng.choice([line, line.upper() if line.isascii() else line, f"\t {line}\r", f"{line} \x0b\x0c"])
            own.append(line)
        rows.append((i, "\n".join(own) if own else rng.choice([None, "", "\n\n"])))
    return rows


EDGES = [
    (None, LONG), (None, f"x\n{LONG}"), (1000, f"{LONG}\n\n{LONG}"), (1001, LONG), (1001, f"{LONG}\nother text of this id"), (1002, LONG), (1003, LONG.upper()),
    (1004, "\n".join([LONG] * 50_000)), (1003, LONG.upper()), (1005, " " + "n" * 39), (1006, f"{LONG}\r\n{LONG}\r\n"), (1004, "short\nlines\n"),
]


@pytest.mark.parametrize("hot", [4096, 10])
def test_against_brute_force(docs_of, clashing, monkeypatch, hot):
    """With HOT at 4096 every hash of so small a table is dealt out over slots, with 10 only the most frequent."""
    monkeypatch.setattr(lines, "HOT", hot)
    rows = corpus(400) + EDGES
    for df in (docs_of(rows), clashing(docs_of(rows)).repartition(7)):
        assert result(lines.without_shared_lines(df)) == brute(rows)


def test_no_hash_is_hot(docs_of, monkeypatch):
    monkeypatch.setattr(lines, "HOT", 1)
    rows = corpus(200, 1) + EDGES
    assert result(lines.without_shared_lines(docs_of(rows))) == brute(rows)


def test_a_line_in_a_third_of_all_lines(docs_of):
    rows = [(i, f"{LONG}common\n{LONG}{i}\n{LONG}{i}b") for i in range(6000)]
    df = docs_of(rows)
    assert lines.hot_hashes(lines.long_lines(df, 40, "doc_id", "text")).count() == 1
    assert result(lines.without_shared_lines(df)) == brute(rows)
    cells = lines.dropped_lines(df)
    assert cells.count() == 5999


def test_parameters(docs_of):
    rows = corpus(200, 2)
    assert result(lines.without_shared_lines(docs_of(rows), 50, 2)) == brute(rows, 50, 2)
    assert result(lines.without_shared_lines(docs_of(rows), 1, 3)) == brute(rows, 1, 3)


def test_bitmaps_hold_only_words_with_a_gap(docs_of):
    text = "\n".join("own" if i not in (3, 700) else LONG for i in range(1000))
    rows = [(1, text)] + [(i, LONG) for i in range(2, 7)]
    got = {r["id"]: [tuple(w) for w in r["words"]] for r in lines.keep_bitmaps(docs_of(rows)).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5]
    assert got[1] == [(0, ~(1 << 3)), (9, ~(1 << 60))]


def test_nothing_runs_in_python(docs_of):
    df = lines.without_shared_lines(docs_of(corpus(20)))
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_table(spark, docs_of, small):
    assert lines.without_shared_lines(docs_of([])).collect() == []
    assert lines.op12_shared_lines(spark, small(documents=docs_of([]))).collect() == []
