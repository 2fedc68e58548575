"""Lists of closest inputs give the scores of a full recount after any additions and deletions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from channelgraph.functions.scores import ScopeParams
from channelgraph.operators import input_lists, knn, scope

VECTORS, INPUTS = "phash string, embedding array<double>", "id long, embedding array<double>"


def made(n, dim=6, seed=0):
    return np.random.default_rng(seed).normal(size=(n, dim)).tolist()


def check(vectors, lists, inputs):
    want = scope.image_scores(vectors, inputs, ScopeParams(tau=0.05))
    want = {} if want is None else {r["phash"]: (round(r["s"], 9), round(r["r"], 9), r["version"]) for r in want.collect()}
    got = {r["phash"]: (round(r["s"], 9), round(r["r"], 9), r["version"]) for r in input_lists.scores(lists, ScopeParams(tau=0.05)).collect()}
    assert got == want


def test_additions_and_deletions_in_turn(spark, monkeypatch):
    vectors = spark.createDataFrame([(f"{i:016x}", v) for i, v in enumerate(made(120))] + [("none", None), ("zero", [0.0] * 6)], VECTORS)
    pool = dict(enumerate(made(40, seed=1)))
    pool[40], pool[41] = pool[0], [0.0] * 6  # the same input twice, and one without direction

    def frame(ids):
        return spark.createDataFrame([(i, pool[i]) for i in ids], INPUTS)

    rescans = []
    build = input_lists.build
    monkeypatch.setattr(input_lists, "build", lambda v, i, kept=8: rescans.append(v.count()) or build(v, i, kept))
    draw, held = np.random.default_rng(3), list(range(10))
    lists = input_lists.build(vectors, frame(held), kept=3)
    check(vectors, lists, frame(held))
    for turn in range(6):
        free = sorted(set(pool) - set(held))
        new = draw.choice(free, size=min(len(free), 7), replace=False).tolist()
        lists = input_lists.add(lists, vectors, frame(held), frame(new), kept=3)
        held += new
        check(vectors, lists, frame(held))
        gone = draw.choice(held, size=5 if turn < 5 else len(held), replace=False).tolist()
        held = [i for i in held if i not in gone]
        lists = input_lists.remove(lists, vectors, frame(held), frame(gone).select("id"), kept=3)
        check(vectors, lists, frame(held))
        assert all(len(r["best"]) <= 3 for r in lists.collect())
    # some lists ran out, and never were all images compared again while inputs were left
    assert len(rescans) > 1 and all(0 < n < 60 for n in rescans[1:-1])
    lists = input_lists.add(lists, vectors, frame([]), frame([3]), kept=3)
    check(vectors, lists, frame([3]))


def test_images_that_come_later_and_nothing_to_change(spark):
    rows = [(f"{i:016x}", v) for i, v in enumerate(made(20))]
    inputs = spark.createDataFrame(list(enumerate(made(9, seed=2))), INPUTS)
    old, vectors = spark.createDataFrame(rows[:12], VECTORS), spark.createDataFrame(rows, VECTORS)
    lists = input_lists.build(old, inputs.filter("id < 6"), kept=2)
    check(vectors, input_lists.add(lists, vectors, inputs.filter("id < 6"), inputs.filter("id >= 6"), kept=2), inputs)
    check(old, input_lists.add(lists, vectors, inputs.filter("id < 6"), inputs.limit(0), kept=2), inputs.filter("id < 6"))
    check(old, input_lists.remove(lists, old, inputs.filter("id < 6"), inputs.limit(0).select("id"), kept=2), inputs.filter("id < 6"))
    assert input_lists.build(vectors, inputs.limit(0)).collect() == []


def test_lists_over_several_blocks(spark, monkeypatch):
    vectors = spark.createDataFrame([(f"{i:016x}", v) for i, v in enumerate(made(30))], VECTORS)
    inputs = spark.createDataFrame(list(enumerate(made(25, seed=4))), INPUTS)
    whole = {r["phash"]: [(p["input"], round(p["s"], 9)) for p in r["best"]] for r in knn.best_inputs(vectors, inputs, "phash", 4).collect()}
    monkeypatch.setattr(knn.query_blocks, "__defaults__", (6,))
    parts = {r["phash"]: [(p["input"], round(p["s"], 9)) for p in r["best"]] for r in knn.best_inputs(vectors, inputs, "phash", 4).collect()}
    assert parts == whole and all(len(v) == 4 for v in whole.values())
