"""Fields on graphs against dense algebra."""

import numpy as np
import pytest

from tremorloom.operators import fields


def grid_graph(n=10, seed=3):
    rng = np.random.default_rng(seed)
    w = np.zeros((n * n, n * n))
    for i in range(n * n):
        for j in (i + 1, i + n):
            if j < n * n and (j != i + 1 or j % n):
                w[i, j] = w[j, i] = rng.uniform(0.1, 2)
    w[:, 17] = w[17, :] = 0.0  # without edges
    return w


def table(spark, w):
    return spark.createDataFrame([(int(i), int(j), float(w[i, j])) for i, j in zip(*np.nonzero(w), strict=True)], "src int, dst int, weight double")


@pytest.mark.parametrize(("smoothness", "tolerance"), [(4.0, 1e-6), (0.0, 1e-6)])
def test_inverse_root_gives_the_covariance(spark, smoothness, tolerance):
    w = grid_graph()
    d = w.sum(1)
    root = np.where(d > 0, 1 / np.sqrt(np.where(d > 0, d, 1)), 0)
    precision = np.eye(100) + smoothness * (np.eye(100) - root[:, None] * w * root[None, :])
    units = spark.createDataFrame([(i, j, float(i == j)) for i in range(100) for j in range(100)], "particle int, node int, value double")
    m = np.zeros((100, 100))
    for r in fields.inverse_root(units, table(spark, w), smoothness, tolerance).collect():
        m[r["node"], r["particle"]] = r["value"]
    assert np.abs(m @ m.T - np.linalg.inv(precision)).max() < 3 * tolerance and np.abs(m - m.T).max() < 2 * tolerance


def test_coefficients_bound_the_error():
    for s in (0.5, 4.0, 30.0):
        c = fields.coefficients(s, 1e-9)
        y = np.linspace(-1, 1, 501)
        assert np.abs(np.polynomial.chebyshev.chebval(y, c) - 1 / np.sqrt(1 + s + s * y)).max() < 1e-9
    with pytest.raises(ValueError, match="smoothness"):
        fields.coefficients(-1.0, 1e-9)


def test_ensemble_is_conditioned_and_reproducible(spark):
    w = grid_graph()
    nodes = spark.range(100).selectExpr("cast(id as int) AS node")
    masks = spark.range(6000).selectExpr("cast(id div 100 as int) AS particle", "cast(id % 100 as int) AS node").where("node % 3 <> particle % 3")
    a, b = (fields.ensemble(nodes.repartition(p), table(spark, w).repartition(p), 60, seed=5, tolerance=1e-5, masks=masks).orderBy("particle", "node").toPandas() for p in (1, 5))
    assert np.abs(a["margin"] - b["margin"]).max() < 1e-9 and len(a) == 6000
    inside = (a["node"] % 3 != a["particle"] % 3).to_numpy()
    assert (a.loc[~inside, ["stress", "strength", "margin"]] == 0).all().all()
    per = a[inside].groupby("particle")["margin"]
    assert np.abs(per.mean()).max() < 1e-9 and np.abs(per.std(ddof=0) - 1).max() < 1e-9
    # neighbours agree more than far nodes do
    stress = a.pivot(index="particle", columns="node", values="stress").to_numpy()
    near = np.mean([np.corrcoef(stress[:, i], stress[:, i + 1])[0, 1] for i in range(0, 99, 7) if w[i, i + 1] > 0.5])
    assert near > 0.15
    with pytest.raises(Exception, match="fewer than two"):
        fields.conditioned(fields.ensemble(nodes, table(spark, w), 2, tolerance=1e-2), masks.where("node = 1")).collect()
    with pytest.raises(ValueError, match="particles"):
        fields.ensemble(nodes, table(spark, w), 1)
    with pytest.raises(Exception, match="negative"):
        fields.normalised(table(spark, -w)).collect()
