import math

import numpy as np
import pytest

from channelgraph.llm import feast, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], SCHEMA)


def vectors(n, dim, seed=0):
    draw = np.random.default_rng(seed)
    return [(i, (draw.normal(size=dim) * np.linspace(0.1, 1, dim)).astype(np.float32).tolist()) for i in range(n)]


def brute(rows, components=16):
    """vec_id -> whitened values by a full eigendecomposition, deviation in whole numbers; the values and n."""
    good = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in good})
    n, total = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array([[c - s / n for c, s in zip(x, total)] for x in fit])
    cov = y.T @ y / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    out = []
    for i, x in good:
        z = np.array([c - s / n for c, s in zip(x, total)]) @ axes / np.sqrt(values)
        out.append((i, z, sum((n * c - s) ** 2 for c, s in zip(x, total))))
    return out, values / np.trace(cov), n


@pytest.mark.parametrize("dim", [1, 2, 5, 64])
def test_against_a_full_decomposition(spark, dim):
    rows = vectors(400, dim) + [(7, vectors(1, dim)[0][1]), (8, None), (9, [float("nan")] * dim), (10, [None] * dim), (11, [float("inf")] * dim), (None, [0.5] * dim), (12, [0.0] * dim)]
    got = whitening.whiten(table(spark, rows)).collect()
    want, shares, n = brute(rows)
    count = min(16, dim)
    assert len(got) == len(want) * count and {r["n"] for r in got} == {n}
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-10
    axes = {}
    for r in got:
        axes.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r["whitened"])
        assert abs(r["explained"] / shares[r["component"] - 1] - 1) < 1e-10
    signs = None
    for i, z, deviation in want:
        own = np.array([axes[i, deviation][c][0] for c in range(1, count + 1)])
        signs = np.sign(own * z) if signs is None else signs
        assert np.allclose(own, z * signs, atol=1e-8)


def test_most_common_length_counts(spark, clashing):
    rows = vectors(50, 8) + [(100, [1.0] * 3), (101, [])]
    df = clashing(table(spark, rows))
    got = whitening.whiten(df, 2).collect()
    assert len(got) == 100 and {r["vec_id"] for r in got} == set(range(50))


def test_no_variance(spark):
    assert whitening.whiten(table(spark, [])).collect() == []
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    assert whitening.whiten(table(spark, [(1, None), (2, [])])).collect() == []
    # vectors on a line have one component
    rows = [(i, [float(i), 2.0 * i, -1.0 * i]) for i in range(20)]
    got = whitening.whiten(table(spark, rows)).collect()
    assert len(got) == 20 and abs(got[0]["explained"] - 1) < 1e-12 and got[0]["identity_error"] < 1e-12


def test_very_large_entries(spark):
    rows = vectors(40, 4) + [(50, [1e12, 0.0, 0.0, 0.0]), (51, [1e30, 0.0, 0.0, 0.0])]
    got = whitening.whiten(table(spark, rows), 4).collect()
    assert {r["vec_id"] for r in got} == {*range(40), 50}
    # (n * x - S) ** 2 is past a long for these
    assert {r["deviation"] for r in got if r["vec_id"] == 50} == {None}


def test_deviations_in_whole_numbers():
    draw = np.random.default_rng(3)
    x = draw.integers(999_000, 1_001_000, (20, 5))
    total = x.sum(axis=0)
    for n in (20, 1_000_003, 50_000_000):
        want = [sum((n * int(c) - int(s) * (n // 20)) ** 2 for c, s in zip(row, total)) for row in x]
        got = whitening.deviations(x, n, total * (n // 20)).to_pylist()
        assert got == [w if w < 2**63 else None for w in want]


def symmetric(n, values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, n)))
    return q @ np.diag(values) @ q.T


@pytest.mark.parametrize(
    "v",
    [
        symmetric(30, np.arange(30.0)), symmetric(40, np.repeat([5.0, 3.0, 3.0, 1.0], 10)), symmetric(20, 10.0 ** -np.arange(20)), np.eye(25), np.zeros((9, 9)),
        symmetric(24, np.r_[np.ones(3), np.zeros(21)]), symmetric(26, 1 + 1e-10 * np.arange(26)), np.diag([4.0, 4.0, 1.0]), symmetric(20, np.linspace(-3, 3, 20)), symmetric(64, 1e-200 * np.arange(64)),
    ],
)
def test_leading_pairs(v):
    values, axes = feast.leading(v, 16)
    size = np.abs(v).sum(axis=1).max() or 1
    count = min(16, len(v))
    assert np.allclose(values / size, np.linalg.eigvalsh(v / size)[::-1][:count], atol=1e-13)
    assert np.abs(v / size @ axes - axes * (values / size)).max() < 1e-12
    assert np.allclose(axes.T @ axes, np.eye(count), atol=1e-12)


def test_inertia_counts():
    v = symmetric(50, np.r_[np.arange(10), -np.arange(40)] / 40)
    shifts = np.array([-2, -0.5125, 0.0125, 0.1, 0.2125, 2])
    above = feast.count_above(*feast.tridiagonal(v), shifts)
    assert above.tolist()[:3] + above.tolist()[4:] == [50, 31, 9, 1, 0]
