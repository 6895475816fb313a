"""The nested ladder against a direct search, and distributions by class."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veracal.functions.scores import ladder
from veracal.operators import calibration

# Labels, probabilities, q' -> regions.
CASES = [
    ([0, 0, 0, 1, 1, 1], [[0.95, 0.05], [0.85, 0.15], [0.7, 0.3], [0.04, 0.96], [0.14, 0.86], [0.29, 0.71]], [3.0, 2.0, 1.0, 3.0, 2.0, 1.0],
     [(0.9, 3.0, [0.95, 0.96]), (0.8, 2.0, [0.85, 0.86]), (0.7, 1.0, [0.7, 0.71])]),
    ([0, 0, 1, 1], [[0.85, 0.15], [0.86, 0.14], [0.16, 0.84], [0.13, 0.87]], [1.0] * 4, [(0.8, 1.0, [0.85, 0.84])]),
    ([0, 0], [[0.99, 0.01], [0.98, 0.02]], [2.0, 1.0], []),
]


def frame(spark, labels, p, q, predictions):
    rows = [(int(y), int(k), [float(v) for v in r], float(x)) for y, k, r, x in zip(labels, predictions, p, q)]
    return spark.createDataFrame(rows, "label int, prediction int, sdm array<double>, q_prime double")


def close(a, b):
    assert [x[0] for x in a] == [x[0] for x in b]
    for x, y in zip(a, b):
        assert x[1] == pytest.approx(y[1], rel=1e-6) and x[2] == pytest.approx(y[2], rel=1e-6)


@pytest.mark.parametrize("labels, p, q, expected", CASES)
def test_regions(spark, labels, p, q, expected):
    predictions = np.argmax(p, 1)
    close(calibration.nested_regions(frame(spark, labels, p, q, predictions), 2, 0.1), expected)
    close(calibration.nested_regions(frame(spark, labels, p, q, predictions), 2, 0.1, local_rows=0), expected)
    close(calibration.nested_regions_local(p, q, labels, predictions, 2, 0.1), expected)


def direct(p, q, y, k, classes, resolution, ood):
    """Each cutoff tried by itself."""
    p, q = np.asarray(p, np.float32), np.asarray(q, np.float32)
    left, out = np.floor(q) > ood, []
    for alpha in ladder(resolution):
        for cut in np.unique(q[left]):
            inside = left & (q >= cut)
            t = []
            for c in range(classes):
                own = np.sort(p[inside & (y == c), c])
                t.append(float(own[min(int(round(1 - alpha, 10) * len(own)), len(own) - 1)]) if len(own) else 0.0)
            if all(np.float32(v) >= np.float32(alpha) for v in t):
                out.append((alpha, float(cut), t))
                reach = p >= np.asarray(t, np.float32)
                left &= ~((q >= cut) & (reach.sum(1) == 1) & reach[np.arange(len(p)), k])
                break
        if not left.any():
            break
    return out


@pytest.mark.parametrize("seed", range(12))
def test_random_local(seed):
    g = np.random.default_rng(seed)
    for classes in (2, 3, 5):
        for resolution in (0.05, 0.1, 0.2):
            p = g.dirichlet([0.55] * classes, 137)
            y = np.array([g.choice(classes, p=r) for r in p])
            q = np.round(g.random(137) * 12) / 4
            k = p.argmax(1)
            close(calibration.nested_regions_local(p, q, y, k, classes, resolution, seed % 2), direct(p, q, y, k, classes, resolution, seed % 2))


def test_random_frame(spark):
    g = np.random.default_rng(5)
    p = g.dirichlet([0.3] * 3, 120)
    y = np.array([g.choice(3, p=r) for r in p])
    q, k = np.round(g.random(120) * 12) / 4, p.argmax(1)
    close(calibration.nested_regions(frame(spark, y, p, q, k), 3, 0.1), direct(p, q, y, k, 3, 0.1, 0))
    close(calibration.nested_regions(frame(spark, y, p, q, k), 3, 0.1, local_rows=0), direct(p, q, y, k, 3, 0.1, 0))


def test_class_values_and_ranks(spark):
    df = spark.createDataFrame([(0, 2.0, 1), (0, 1.0, 3), (1, 5.0, 0)], "label int, d0 double, q int")
    got = {r["class"]: r["values"] for r in calibration.distance_cdfs(df, 3).collect()}
    assert got == {0: [1.0, 2.0], 1: [], 2: []}
    points = spark.createDataFrame([(0, 1.0), (0, 2.0), (0, 2.0), (1, 4.0)], "class int, v double")
    rows = spark.createDataFrame([(7, 2.0), (8, 0.5)], "row_idx long, d0 double")
    below = {(r["row_idx"], r["class"]): r["n"] for r in calibration.range_counts(rows, "d0", points, False).collect()}
    most = {(r["row_idx"], r["class"]): r["n"] for r in calibration.range_counts(rows, "d0", points, True).collect()}
    assert below == {(7, 0): 1, (7, 1): 0, (8, 0): 0, (8, 1): 0} and most[7, 0] == 3


def test_literal_ladder(spark):
    got = spark.range(1).select(calibration.regions_column([(0.9, 1.0, [0.9, 0.95])]).alias("r"), calibration.regions_column([]).alias("e")).first()
    assert got["r"][0]["alpha"] == 0.9 and got["e"] == []
    assert math.isclose(spark.range(1).select(F.lit(0.9)).first()[0], 0.9)
