"""The forest that the scores are means over."""

import inspect

import numpy as np

from opslens.operators import models


def test_forest_has_300_trees(spark):
    assert inspect.signature(models.isolation_scores).parameters["trees"].default == 300
    rows = spark.createDataFrame([(i, [float(i % 7), float(i * i % 31)]) for i in range(500)], "id long, v array<double>")
    grown, size = models.grow_forest(rows, "id", "v", 300, 256, 42)
    assert len(grown) == 300 and size == 256 and len({tuple(t) for t in grown}) > 290
    again = models.grow_forest(rows.repartition(3), "id", "v", 300, 256, 42)
    assert again == (grown, size)
    scored = {r.id: r.score for r in models.isolation_scores(rows, "id", "v").collect()}
    x = np.array([[float(i % 7), float(i * i % 31)] for i in range(500)])
    want = 2.0 ** (-models.path_lengths(grown, x) / models.normal_path(size))
    assert np.allclose([scored[i] for i in range(500)], want)


def test_principal_components(spark):
    x = np.random.default_rng(2).normal(size=(200, 6)) @ np.random.default_rng(3).normal(size=(6, 6))
    x[:, 5] = 1.0  # no variance
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    found, shares = models.reduced(rows.repartition(3), "id", "v", most=3)
    got = np.array([r.vector for r in found.orderBy("id").collect()])
    z = (x - x.mean(axis=0)) / np.where(x.std(axis=0) > 0, x.std(axis=0), 1)
    _, s, v = np.linalg.svd(z, full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(z @ v[:3].T)) and np.allclose(shares, (s**2 / (s**2).sum())[:3])
    assert models.reduced(rows.limit(0), "id", "v")[0].count() == 0


def _dense_one_class(x, nu, steps=4000):
    """The dual of a one-class machine with the exact kernel, by steps along its linear parts: scores, high outside."""
    gamma = 1 / (x.shape[1] * x.var())
    squares = (x**2).sum(axis=1)
    kernel = np.exp(-gamma * np.maximum(squares[:, None] + squares[None] - 2 * x @ x.T, 0))
    alpha, most = np.full(len(x), 1 / len(x)), nu * len(x)
    for step in range(1, steps + 1):
        order = np.argsort(kernel @ alpha)
        corner = np.zeros(len(x))
        corner[order[: int(most)]] = 1 / most
        corner[order[int(most)]] = 1 - int(most) / most
        alpha += 2 / (step + 2) * (corner - alpha)
    return -(kernel @ alpha)


def test_one_class_machine_beside_a_dense_solver(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(240, 5)), rng.normal(3, 0.5, size=(245, 5)), rng.uniform(-6, 8, size=(15, 5))])
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None)], "id long, v array<double>")
    found = {r.id: r.score for r in models.one_class_scores(rows.repartition(3), "id", "v", nu=0.1, features=1024).collect()}
    assert sorted(found) == list(range(500)) and 0.08 <= np.mean([s > 0 for s in found.values()]) <= 0.12
    rank = lambda v: np.argsort(np.argsort(v))
    assert np.corrcoef(rank([found[i] for i in range(500)]), rank(_dense_one_class(x, 0.1)))[0, 1] >= 0.9
    assert np.mean([found[i] for i in range(485, 500)]) > np.mean([found[i] for i in range(485)])
    assert models.one_class_scores(rows.limit(0), "id", "v").count() == 0
