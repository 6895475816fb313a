"""Scalar expressions against values worked out for the definitions."""

import math

import pytest
from pyspark.sql import functions as F

from veracal.functions import scores
from veracal.operators.calibration import regions_column

# Logits, q, d -> prediction, probabilities, q'.
ACTIVATION = [
    ([2.0, -1.0], 0, 0.75, 0, [0.8262932300567627, 0.1737067550420761], 0.0),
    ([0.5, 0.5], 1, 0.0, 0, [0.5, 0.5], 1.0),
    ([-2.0, 3.0], 3, 1.0, 1, [0.0003198975755367428, 0.9996801614761353], 3.0),
    ([-4.0, 6.0], 5, 0.0, 1, [0.5, 0.5], 2.6457512378692627),
]
CDFS = [
    ([[1.0, 2.0, 2.0, 4.0], [0.5, 3.0]], [0.0, 0.5, 2.0, 2.1, 4.0, 5.0], [1.0, 1.0, 0.5, 0.25, 0.0, 0.0]),
    ([[1.0, 2.0], []], [0.0, 1.0, 3.0], [0.0, 0.0, 0.0]),
]
SIZES = ([[0.0, 1.0, 1.0, 2.5], [0.0, 0.0, 3.0]], [0.0, 1.0, 2.0, 3.0], [[1, 2], [3, 2], [3, 2], [4, 3]])
REGIONS = [(0.9, 3.0, [0.95, 0.96]), (0.8, 2.0, [0.85, 0.86]), (0.7, 1.0, [0.7, 0.71])]
INFERENCE = [([0.95, 0.05], 3.0, 0, 0.9), ([0.94, 0.06], 3.0, 0, 0.8), ([0.1, 0.9], 2.0, 1, 0.8), ([0.25, 0.75], 1.0, 1, 0.7), ([0.6, 0.4], 3.0, 0, 0.0), ([0.99, 0.01], 0.0, 0, 0.0)]


def test_activation(spark):
    df = spark.createDataFrame([(i, *a[:3]) for i, a in enumerate(ACTIVATION)], "i int, z array<double>, q int, d double")
    df = df.withColumn("k", scores.argmax(F.col("z"))).withColumn("p", scores.probabilities(F.col("z"), F.col("q"), F.col("d")))
    df = df.withColumn("qp", scores.rescaled_similarity(F.col("q"), F.col("p"), F.col("k")))
    for r, (_, _, _, k, p, qp) in zip(df.orderBy("i").collect(), ACTIVATION):
        assert r["k"] == k and r["p"] == pytest.approx(p, abs=1e-6) and r["qp"] == pytest.approx(qp, rel=1e-5)


@pytest.mark.parametrize("cdfs, queries, expected", CDFS)
def test_distance_quantile(spark, cdfs, queries, expected):
    df = spark.createDataFrame([(i, q, cdfs) for i, q in enumerate(queries)], "i int, d0 double, c array<array<double>>")
    got = df.orderBy("i").select(scores.distance_quantile(F.col("d0"), F.col("c")).alias("d")).collect()
    assert [r["d"] for r in got] == expected


def test_sample_sizes(spark):
    cdfs, queries, expected = SIZES
    df = spark.createDataFrame([(i, q, cdfs) for i, q in enumerate(queries)], "i int, q double, c array<array<double>>")
    assert [r[0] for r in df.orderBy("i").select(scores.sample_sizes(F.col("q"), F.col("c"))).collect()] == expected


def test_dkw_band(spark):
    df = spark.createDataFrame([([3, 2], 0.9, 0.9), ([0, 50], 0.95, 0.75)], "n array<int>, alpha double, d double")
    df = df.withColumn("e", scores.dkw_errors(F.col("n"), F.col("alpha"))).withColumn("b", scores.distance_band(F.col("d"), F.col("e")))
    a, b = df.orderBy("alpha").collect()
    assert a["e"] == pytest.approx([0.7066036462783813, 0.8654091954231262], rel=1e-5)
    assert a["b"]["lower"] == pytest.approx(0.0345908045768738, abs=1e-6) and a["b"]["upper"] == 1.0
    assert max(b["e"]) == 1.0 and b["b"]["lower"] == 0.0 and b["b"]["upper"] == 1.0


def test_assignment(spark):
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(INFERENCE)], "i int, p array<double>, q double, k int")
    got = df.orderBy("i").select(scores.assigned_alpha(F.col("p"), F.col("q"), F.col("k"), regions_column(REGIONS)).alias("a")).collect()
    assert [r["a"] for r in got] == [r[3] for r in INFERENCE]


def test_region_needs_the_predicted_class_alone(spark):
    rows = [([0.8, 0.2], 1.0, 0, True), ([0.75, 0.25], 2.0, 0, False), ([0.85, 0.15], 0.0, 0, False), ([0.2, 0.8], 1.0, 0, False)]
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "i int, p array<double>, q double, k int")
    region = F.struct(F.lit(1.0).alias("q_min"), F.array(F.lit(0.8), F.lit(0.8)).alias("thresholds"))
    got = df.orderBy("i").select(scores.accepts(F.col("p"), F.col("q"), F.col("k"), region)).collect()
    assert [r[0] for r in got] == [r[3] for r in rows]


def test_ladder():
    assert scores.ladder(0.05) == [0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.55]
    assert scores.ladder(0.1)[-1] == 0.6
    for bad in (0.5, 0.0, 0.00001):
        with pytest.raises(ValueError):
            scores.ladder(bad)


def test_decisions(spark):
    rows = [(0.95, 0.5), (0.0, 3.0), (0.8, 3.0), (0.95, 3.0)]
    df = spark.createDataFrame(rows, "a double, q double")
    got = df.select(scores.decision(F.col("a"), F.col("q"), 0.9).alias("d")).collect()
    assert [r["d"]["reason"] for r in got] == ["zero-similarity", "no-calibrated-region", "below-required-alpha", "accepted"]
    assert [r["d"]["action"] for r in got] == ["review"] * 3 + ["allow"]


def test_margin_and_finite(spark):
    df = spark.createDataFrame([([1.0, 4.0, 2.5],), ([3.0],), ([math.inf, 1.0],)], "z array<double>")
    got = df.select(scores.logit_margin(F.col("z")).alias("m"), scores.is_finite(F.col("z")).alias("f")).collect()
    assert [r["m"] for r in got][:2] == [1.5, 3.0] and [r["f"] for r in got] == [True, True, False]
