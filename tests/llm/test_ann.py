import math

import numpy as np
import pytest

from channelgraph.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=10):
    good = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for q, x in good:
        if q % 100 == 0:
            near = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(x, y))), i) for i, y in good if i != q)[:k]
            out += [(q, n, i, s) for n, (s, i) in enumerate(near, 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], SCHEMA)


def vectors(n, dim, seed=0):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(7, dim))
    return [(i, (centres[i % 7] + 0.3 * draw.normal(size=dim)).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("dim", [1, 3, 64, 70])
def test_all_neighbours_are_found(spark, dim):
    rows = vectors(900, dim)
    got = sorted(map(tuple, ann.nearest(table(spark, rows)).collect()))
    want = brute(rows)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-14, atol=0)


def search(data, asked, ids, centre, k, batch=2000):
    """The passes of the operator over one block, without Spark: seeds, their bounds, marks, rerank."""
    turn, places = ann.rotation(data.shape[1]), range(0, len(data), batch)
    codes = {a: ann.encode(data[a : a + batch] - centre, turn) for a in places}
    number = np.arange(len(data))
    block = ann.QueryPlanes(ids, asked, centre)
    seeds = ann.Seeds(block, k)
    for a in places:
        seeds.add(number[a : a + batch], number[a : a + batch], *codes[a])
    within = np.sqrt(((data[seeds.row] - asked[None]) ** 2).sum(axis=2)).max(axis=0)
    within = np.where((seeds.row >= 0).all(axis=0), within, np.inf)
    found, compared = ann.Rerank(ids, asked, k), 0
    for a in places:
        marked = ann.marks(block, within, number[a : a + batch], *codes[a])
        compared += marked.sum()
        found.add(number[a : a + batch], data[a : a + batch], marked)
    return found, compared


def test_codes_leave_most_vectors_out():
    draw = np.random.default_rng(1)
    data = draw.normal(size=(20, 128))[draw.integers(0, 20, 8000)] + 0.2 * draw.normal(size=(8000, 128))
    found, compared = search(data, data[:10], np.arange(10), data.mean(axis=0), 10)
    exact = np.sqrt(((data[:10, None] - data[None]) ** 2).sum(axis=2))
    np.fill_diagonal(exact, np.inf)
    assert (found.found == np.argsort(exact, axis=1)[:, :10]).all()
    assert compared < 0.15 * 80_000


@pytest.mark.parametrize("dim", [1, 3, 64, 70, 130])
def test_counted_bits_are_inner_products_with_codes(dim):
    draw = np.random.default_rng(dim)
    data, asked = draw.normal(size=(50, dim)), draw.normal(size=(9, dim))
    block, turn = ann.QueryPlanes(np.arange(9), asked, np.zeros(dim)), ann.rotation(dim)
    code, length, fit = ann.encode(data, turn)
    signs = np.where(data @ turn >= 0, 1, -1) / math.sqrt(dim)
    exact = signs @ (asked / np.linalg.norm(asked, axis=1)[:, None] @ turn).T
    assert (np.abs(block.with_code(code) - exact) <= block.off[None] + 1e-12).all()
    assert block.off.max() < 0.1
    # the smallest possible distance is never above the true one
    true = ((data[:, None] - asked[None]) ** 2).sum(axis=2)
    assert (block.squares(code, length, fit)[1] <= true + 1e-9).all()


def test_passes_over_codes_read_no_vectors(spark):
    index, _, _ = ann.build_index(table(spark, vectors(50, 8)))
    read = index.select(*ann.CODES)._jdf.queryExecution().executedPlan().toString()
    assert "code" in read and "vector" not in read


def test_a_neighbour_five_deviations_off_its_estimate_is_found():
    dim, off = 64, 0.68  # 0.68 * sqrt(63): 5.4 deviations
    turn, draw = ann.rotation(dim), np.random.default_rng(2)
    signs = np.where(draw.random(dim) < 0.5, -1.0, 1.0)
    near = np.abs(draw.normal(size=dim)) * signs
    near /= np.linalg.norm(near)
    code = signs / math.sqrt(dim)
    # what the code of the vector leaves out, and a direction apart from both
    rest = near - (near @ code) * code
    rest /= np.linalg.norm(rest)
    apart = draw.normal(size=dim)
    apart -= (apart @ code) * code + (apart @ rest) * rest
    apart /= np.linalg.norm(apart)
    asked = off * rest + math.sqrt(1 - off**2) * apart
    other = asked - (np.linalg.norm(asked - near) + 0.005) * apart
    data = np.stack([near, other]) @ turn.T
    found, _ = search(data, (asked @ turn.T)[None], np.array([-1]), np.zeros(dim), 1)
    assert found.found.tolist() == [[0]]
    block = ann.QueryPlanes(np.array([-1]), (asked @ turn.T)[None], np.zeros(dim))
    assert ann.marks(block, np.array([np.linalg.norm(asked - other)]), np.array([0, 1]), *ann.encode(data, turn))[0, 0]


def test_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "QUERY_BLOCK", 4)
    rows = [(i * 10, v) for i, v in vectors(300, 8)]
    assert [g[:3] for g in sorted(map(tuple, ann.nearest(table(spark, rows)).collect()))] == [w[:3] for w in brute(rows)]


def test_rows_that_take_no_part_and_ties(spark):
    rows = vectors(60, 4) + [(100, None), (200, [0, 0, 0, 0]), (300, [1, None, 2, 3]), (400, [1, float("nan"), 2, 3]), (500, [1, float("inf"), 2, 3])]
    rows += [(600, []), (700, [1, 2]), (None, [1, 2, 3, 4]), (800, [5, 5, 5, 5]), (801, [5, 5, 5, 6]), (802, [5, 5, 5, 4]), (803, [5, 5, 5, 6])]
    # those of another length than most take no part
    want = brute([r for r in rows if r[0] != 700])
    got = sorted(map(tuple, ann.nearest(table(spark, rows)).collect()))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[2] for g in got if g[0] == 800][:3] == [801, 802, 803]


def test_few_rows(spark):
    assert ann.nearest(table(spark, [])).collect() == []
    assert ann.nearest(table(spark, [(100, [1, 2])])).collect() == []
    assert [tuple(r)[:3] for r in ann.nearest(table(spark, [(100, [1, 2]), (1, [1, 3])])).collect()] == [(100, 1, 1)]
