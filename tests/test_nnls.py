from itertools import combinations

import numpy as np
import pytest

from bandnet.operators import gram_matrix, nnls_by_group, nnls_fit, solve_nonnegative, unmix


def brute_force(gram, rhs):
    """The best of all active sets."""
    n = len(rhs)
    best, best_value = np.zeros(n), 0.0
    for size in range(1, n + 1):
        for free in combinations(range(n), size):
            x = np.zeros(n)
            x[list(free)] = np.linalg.lstsq(gram[np.ix_(free, free)], rhs[list(free)], rcond=None)[0]
            value = 0.5 * x @ gram @ x - rhs @ x
            if (x >= -1e-12).all() and value < best_value - 1e-12:
                best, best_value = x, value
    return best


@pytest.mark.parametrize("seed", range(8))
def test_solver_equals_brute_force(seed):
    gen = np.random.default_rng(seed)
    a = gen.normal(size=(12, 5))
    rhs = gen.normal(size=(20, 12)) @ a
    got = solve_nonnegative(a.T @ a, rhs)
    np.testing.assert_allclose(got, [brute_force(a.T @ a, b) for b in rhs], atol=1e-8)


def test_solver_edge_cases():
    assert not solve_nonnegative(np.eye(3), np.zeros((2, 3))).any()
    assert not solve_nonnegative(np.eye(2), np.array([[-1.0, -2.0]])).any()
    assert solve_nonnegative(np.eye(2), np.empty((0, 2))).shape == (0, 2)
    same = np.ones((2, 2))
    x = solve_nonnegative(same, np.array([[3.0, 3.0]]))[0]
    assert abs(x.sum() - 3) < 1e-9 and (x >= 0).all()


@pytest.fixture()
def table(spark):
    gen = np.random.default_rng(3)
    x = gen.normal(size=(90, 3))
    y = x @ [1.0, -2.0, 0.5] + gen.normal(size=90) * 0.1
    groups = ["big"] * 80 + ["small"] * 10
    rows = [(g, *map(float, r), float(t)) for g, r, t in zip(groups, x, y)]
    df = spark.createDataFrame([*rows, ("big", None, 1.0, 1.0, 1.0)], "g string, a double, b double, c double, y double")
    return df.repartition(4), x, y


def test_fits_over_tables(table):
    df, x, y = table
    sums = gram_matrix(df, ["a", "b", "c"], "y").first()
    np.testing.assert_allclose(np.reshape(sums.ata, (3, 3)), x.T @ x)
    np.testing.assert_allclose(sums.atb, x.T @ y)
    np.testing.assert_allclose(nnls_fit(df, ["a", "b", "c"], "y").first().x, brute_force(x.T @ x, x.T @ y), atol=1e-8)
    found = {r.g: r.x for r in nnls_by_group(df, ["g"], ["a", "b", "c"], "y").collect()}
    for name, part in (("big", slice(0, 80)), ("small", slice(80, 90))):
        np.testing.assert_allclose(found[name], brute_force(x[part].T @ x[part], x[part].T @ y[part]), atol=1e-8)


def test_unmixing_recovers_abundances(make_rows):
    gen = np.random.default_rng(4)
    members = gen.uniform(size=(3, 8))
    shares = np.maximum(gen.normal(size=(40, 3)), 0)
    found = unmix(make_rows(shares @ members, range(40)), members).collect()
    for r in found:
        np.testing.assert_allclose(r.abundance, shares[int(r.label)], atol=1e-8)
