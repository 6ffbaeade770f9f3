import numpy as np
import pytest
from pyspark.sql import functions as F

from scorekit.llm import whitening as X

SCHEMA = "vec_id long, embedding array<float>, label int"


def scatter(x):
    c = x - x.mean(axis=0)
    return c.T @ c


def near(spectrum, x):
    want = scatter(x)
    made = spectrum.vectors * spectrum.values @ spectrum.vectors.T
    assert np.abs(made - want).max() <= 1e-11 * max(1, np.abs(want).max())
    assert np.abs(spectrum.vectors.T @ spectrum.vectors - np.eye(x.shape[1])).max() < 1e-12
    assert (np.diff(spectrum.values) >= 0).all()


@pytest.mark.parametrize("dims, rows", [(1, 4), (2, 30), (7, 3), (12, 200), (64, 300)])
def test_rows_one_by_one_and_spectra_combined(dims, rows):
    dice = np.random.default_rng(dims)
    x = np.floor(dice.normal(0, 9, (rows, dims)))
    x[rows // 2:] = np.where(dice.random((rows - rows // 2, 1)) < 0.3, x[0], x[rows // 2:])  # one vector many times
    states = []
    for part in (x[:rows // 3], x[rows // 3:rows // 2], x[rows // 2:], x[:0]):
        state = X.Spectrum(dims)
        for r in part:
            state.add(r)
        if len(part):
            near(state, part)
        states.append(state)
    whole = states[0]
    for other in states[1:]:
        whole.merge(other)
    assert whole.count == rows
    near(whole, x)


def test_secular_roots_with_close_poles_and_tiny_weights():
    dice = np.random.default_rng(2)
    for _ in range(200):
        n = int(dice.integers(1, 20))
        d = np.sort(np.concatenate([dice.normal(0, 1, n), [1.0, 1 + 1e-9]]))
        z2 = 10.0 ** dice.uniform(-12, 0, len(d))
        rho = 10.0 ** dice.uniform(-3, 3)
        pole, shift = X.secular_roots(d, z2, rho)
        want = np.linalg.eigvalsh(np.diag(d) + rho * np.sqrt(np.outer(z2, z2)))
        assert np.allclose(d[pole] + shift, want, rtol=0, atol=1e-12 * max(1, rho * z2.sum()))


def plain(rows, components):
    kept = [(i, v) for i, v in rows if v and all(e is not None and np.isfinite(e) for e in v)]
    x = np.array([[int(np.floor(64 * float(e))) + 1_000_000 for e in v] for _, v in kept], dtype=object)
    n, s = len(x), x.sum(axis=0)
    centred = ((n * x - s) / n).astype(float)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return ([i for i, _ in kept], n, [sum(int(e) ** 2 for e in n * r - s) for r in x],
            (centred @ vectors / np.sqrt(np.maximum(values, 1e-300)))[:, :components], values / values.sum())


@pytest.mark.parametrize("dims, rows, parts", [(3, 50, 1), (40, 400, 20), (64, 200, 3)])
def test_equals_a_direct_decomposition(spark, dims, rows, parts):
    dice = np.random.default_rng(rows)
    made = [(i, [float(np.float32(e)) for e in dice.normal(0, 1 + np.arange(dims) / 9)]) for i in range(rows)]
    df = spark.createDataFrame([(*r, 0) for r in made], SCHEMA).repartition(parts)
    out = X.whiten(df).toPandas()
    ids, n, deviation, whitened, explained = plain(made, 32)
    used = min(32, dims)
    assert len(out) == rows * used and set(out.component) == set(range(1, used + 1)) and set(out.n) == {n}
    got = out.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    sign = np.sign((got * whitened[:, :used]).sum(axis=0))
    assert np.abs(got * sign - whitened[:, :used]).max() < 1e-8
    assert np.allclose(out.groupby("component").explained.first(), explained[:used], rtol=1e-10)
    assert out[out.component == 1].set_index("vec_id").deviation.loc[ids].tolist() == deviation
    assert out.identity_error.nunique() == 1 and out.identity_error[0] < 1e-9
    cov = got.T @ got / n - np.outer(got.mean(axis=0), got.mean(axis=0))
    assert np.abs(cov - np.eye(used)).max() < 1e-9


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 0.25]), (1, [0.5, 0.25]), (1, [-0.5, 1.0]), (None, [0.0, 0.0]), (2, None), (4, [1.0, None]),
            (5, [nan, 1.0]), (6, [-inf, 0.0]), (7, []), (8, [100.0, -100.0])]
    df = spark.createDataFrame([(*r, None) for r in rows], SCHEMA)
    clash = df.withColumns({c: F.lit("clash") for c in ("x", "v", "n", "component", "place", "total", "size", "part")})
    out = X.whiten(clash).toPandas()
    ids, n, deviation, whitened, _ = plain(rows, 2)
    assert n == 5 and len(out) == 10 and out.identity_error[0] < 1e-10
    assert sorted(out[out.component == 2].deviation) == sorted(deviation)
    assert np.allclose(sorted(out[out.component == 1].whitened.abs()), sorted(np.abs(whitened[:, 0])))
    other = X.whiten(df.unionByName(spark.createDataFrame([(9, [1.0, 2.0, 3.0], 0)], SCHEMA))).toPandas()
    assert len(other) == 10 and 9 not in set(other.vec_id)  # another length than most
    nothing = X.whiten(df.where("false"))
    assert nothing.collect() == [] and nothing.columns == out.columns.tolist()
    assert X.whiten(df.where("vec_id = 8")).collect() == []          # one row has no spread
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0], 0) for i in range(6)], SCHEMA)
    assert {r["component"] for r in X.whiten(flat).collect()} == {1}  # one direction only


def test_deviations_too_large_for_a_long_are_null():
    x = np.array([[0], [1 << 33]], dtype=np.int64)
    assert X.deviations(x, 2, np.array([1 << 32]), np.array([0])) == [None, None]
    assert list(X.deviations(np.array([[0], [4]]), 2, np.array([2]), np.array([0]))) == [16, 16]
