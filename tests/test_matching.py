"""Both matching strategies against each other and against sorting all distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veracal.operators import knn

SUPPORT = [[0.0, 0.0], [0.0, 2.0], [2.0, 0.0], [2.0, 2.0]]


def frame(spark, vectors, name):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], f"{name} long, exemplar array<double>")


def lists(n):
    out = {}
    for r in n.orderBy("row_idx", "rank").collect():
        out.setdefault(r["row_idx"], []).append((r["support_idx"], round(r["d2"], 6)))
    return out


@pytest.mark.parametrize("strategy", ["sql", "arrow", "tiled"])
def test_order_and_ties(spark, strategy, monkeypatch):
    if strategy == "tiled":
        monkeypatch.setattr(knn, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(knn, "TILE", 3)
        strategy = "arrow"
    q, s = frame(spark, [[0.0, 1.0], [2.0, 1.0], [1.0, 1.0]], "row_idx"), frame(spark, SUPPORT, "support_idx")
    got = lists(knn.knn(q, s, 4, strategy))
    assert [[i for i, _ in got[r]] for r in range(3)] == [[0, 1, 2, 3], [2, 3, 0, 1], [0, 1, 2, 3]]


@pytest.mark.parametrize("strategy", ["sql", "arrow"])
def test_exclusion_comes_before_the_cut(spark, strategy):
    q = spark.createDataFrame([(0, [0.0, 2.0], 1), (1, [0.0, 2.0], None)], "row_idx long, exemplar array<double>, own long")
    got = lists(knn.knn(q, frame(spark, SUPPORT, "support_idx"), 4, strategy, exclude="own"))
    assert [i for i, _ in got[0]] == [0, 3, 2] and [i for i, _ in got[1]] == [1, 0, 3, 2]
    nine = frame(spark, [[0.0, 0.0]] * 9, "support_idx")
    q = spark.createDataFrame([(0, [0.0, 0.0], 4)], "row_idx long, exemplar array<double>, own long")
    assert [i for i, _ in lists(knn.knn(q, nine, 20, strategy, exclude="own"))[0]] == [0, 1, 2, 3, 5, 6, 7, 8]


@pytest.mark.parametrize("tiled", [False, True])
def test_random_against_sorting(spark, tiled, monkeypatch):
    if tiled:
        monkeypatch.setattr(knn, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(knn, "TILE", 11)
        monkeypatch.setattr(knn, "QUERY_BLOCK", 5)
    g = np.random.default_rng(3)
    s, q = g.integers(0, 4, (97, 5)), g.integers(0, 4, (23, 5))
    d2 = ((q[:, None, :] - s[None]) ** 2).sum(2)
    want = {r: [(int(i), float(d2[r, i])) for i in np.lexsort((np.arange(97), d2[r]))[:13]] for r in range(23)}
    for strategy in ("sql", "arrow"):
        assert lists(knn.knn(frame(spark, q, "row_idx"), frame(spark, s, "support_idx"), 13, strategy)) == want


def test_leading_run(spark):
    s = spark.createDataFrame([(i, v, label, p) for i, (v, label, p) in enumerate(zip(SUPPORT, [0, 0, 1, 1], [0, 0, 1, 0]))], "support_idx long, exemplar array<double>, label int, predicted_label int")
    q = spark.createDataFrame([(0, [0.0, 1.0], 0), (1, [2.0, 1.0], 1), (2, [1.0, 1.0], 0)], "row_idx long, exemplar array<double>, prediction int")
    got = knn.similarity(knn.knn(q, s, 4), q, s).orderBy("row_idx").collect()
    assert [(r["q"], r["d0"]) for r in got] == [(2, 1.0), (1, 1.0), (2, 2.0)]
    assert [r["nearest"] for r in got] == [0, 2, 0]


@pytest.mark.parametrize("size", [4, 24])
def test_leading_runs_leave_the_task_without_neighbours(spark, size, monkeypatch):
    """Signals of each query as from the joined neighbours, with unknown labels and own rows, and without a shuffle."""
    monkeypatch.setattr(knn, "BOX", 8)
    monkeypatch.setattr(knn, "NEAR_QUERIES", 4)
    monkeypatch.setattr(knn, "HELD", 10)
    g = np.random.default_rng(8)
    v = g.integers(0, 3, (120, size)).tolist()
    some = lambda i, n: None if i % n == 0 else int(g.integers(0, 2))
    s = spark.createDataFrame([(3 * i, [float(x) for x in a], some(i, 13), 0 if i % 3 else some(i, 11)) for i, a in enumerate(v)], "support_idx long, exemplar array<double>, label int, predicted_label int")
    q = spark.createDataFrame([(i, [float(x) for x in a], 3 * i if i % 2 else None, some(i, 17)) for i, a in enumerate(v)], "row_idx long, exemplar array<double>, own long, prediction int")
    columns = ("row_idx", "q", "d0", "nearest")
    for k, exclude in ((5, None), (5, "own"), (1, "own")):
        got = knn.signals(q, s, k, exclude=exclude).select(*columns)
        assert "Exchange" not in _plan(got) and "Join" not in _plan(got)
        joined = q.join(knn.similarity(knn.knn(q, s, k, exclude=exclude), q, s), "row_idx", "left")
        want = joined.select("row_idx", F.coalesce("q", F.lit(0)), F.coalesce("d0", F.lit(0.0)), "nearest")
        assert sorted(got.collect()) == sorted(want.collect()) if k > 1 else sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))


def test_signals_of_repeated_and_odd_rows(spark):
    s = spark.createDataFrame([(i, v, 0, 0) for i, v in enumerate(SUPPORT)], "support_idx long, exemplar array<double>, label int, predicted_label int")
    q = spark.createDataFrame([(0, [0.0, 1.0], 0), (0, [2.0, 1.0], 0), (1, None, 0)], "row_idx long, exemplar array<double>, prediction int")
    joined = q.join(knn.similarity(knn.knn(q, s, 2), q, s), "row_idx", "left").select("row_idx", "q", "d0", "nearest")
    text = lambda df: sorted(map(str, map(tuple, df.select("row_idx", "q", F.coalesce("d0", F.lit(0.0)), "nearest").collect())))
    assert text(knn.signals(q, s, 2)) == text(joined)


def test_empty_sides(spark):
    none = spark.createDataFrame([], "row_idx long, exemplar array<double>")
    assert knn.knn(none, frame(spark, SUPPORT, "support_idx"), 3).count() == 0
    assert knn.knn(none, frame(spark, SUPPORT, "support_idx"), 3, "arrow").count() == 0
    with pytest.raises(ValueError):
        knn.knn(none, none.withColumn("support_idx", F.lit(1)), 3, "other")


def _plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("size", [4, 24])
def test_summed_distances_make_no_table_of_pairs(spark, size, monkeypatch):
    """Boxes and products against all distances, with copies, own rows and shared lists; nothing but k rows a query leaves."""
    monkeypatch.setattr(knn, "BOX", 8)
    monkeypatch.setattr(knn, "NEAR_QUERIES", 4)
    g = np.random.default_rng(5)
    s = np.r_[g.normal(size=(150, size)), np.repeat(g.normal(size=(1, size)), 60, 0), -0.0 * np.ones((2, size)), np.zeros((2, size))]
    q = spark.createDataFrame([(i, [float(x) for x in v], i if i % 2 else None) for i, v in enumerate(s)], "row_idx long, exemplar array<double>, own long")
    d2 = np.zeros((len(s), len(s)))
    for c in range(size):
        d2 += (s[:, None, c] - s[None, :, c]) ** 2
    got = knn.knn(q, frame(spark, s, "support_idx"), 7, exclude="own")
    assert "NestedLoopJoin" not in _plan(got) and "CartesianProduct" not in _plan(got) and "Window" not in _plan(got)
    found = {}
    for r in got.orderBy("row_idx", "rank").collect():
        found.setdefault(r["row_idx"], []).append((r["support_idx"], r["d2"]))
    for r in range(len(s)):
        order = [i for i in np.lexsort((np.arange(len(s)), d2[r])) if not (r % 2 and i == r)][: 7 - r % 2]
        assert found[r] == [(i, d2[r, i]) for i in order]


def test_odd_vectors_are_ranked_as_sql_ranks_them(spark):
    rows = [(0, [0.0, 1.0]), (1, None), (2, [float("nan"), 0.0]), (3, [1.0]), (4, [2.0, None]), (5, [2.0, 2.0]), (5, [3.0, 3.0])]
    q = spark.createDataFrame(rows, "row_idx long, exemplar array<double>")
    s = q.withColumnRenamed("row_idx", "support_idx")
    pairs = q.withColumn("_own", F.lit(None).cast("long")).select("row_idx", "_own", F.col("exemplar").alias("_q")).crossJoin(s.select("support_idx", F.col("exemplar").alias("_s")))
    want = knn._ranked(pairs.select("row_idx", "_own", "support_idx", knn.squared_distance(F.col("_q"), F.col("_s")).alias("d2")), 4)
    text = lambda df: sorted(map(str, df.select("row_idx", "rank", "support_idx", "d2").collect()))
    assert text(knn.knn(q, s, 4)) == text(want)


def test_quantiles_and_sizes_search_sorted_values(spark):
    """Counts by bisection are those of all comparisons, and no row carries the values."""
    from veracal.functions import scores
    from veracal.operators import calibration
    from veracal.plans import model

    g = np.random.default_rng(6)
    rows = [(i, int(i % 2), float(v), float(g.integers(0, 9)), 2, [0.5, 0.25], 0) for i, v in enumerate(g.integers(0, 20, 80))]
    df = spark.createDataFrame(rows, "row_idx long, label int, d0 double, q_prime double, q int, z array<double>, prediction int")
    near, alike = calibration.distance_cdfs(df, 2), calibration.similarity_cdfs(df, 2)
    got = model.with_sizes(model.with_probabilities(df, near).drop("q_prime").join(df.select("row_idx", "q_prime"), "row_idx"), alike)
    assert "NestedLoopJoin" not in _plan(got)
    arrays = lambda c: calibration.as_arrays(c)
    want = df.crossJoin(arrays(near)).select("row_idx", "q_prime", scores.distance_quantile(F.col("d0"), F.col("cdfs")).alias("d"))
    want = want.crossJoin(arrays(alike)).select("row_idx", "d", scores.sample_sizes(F.col("q_prime"), F.col("cdfs")).alias("n"))
    assert sorted(got.select("row_idx", "d", "n").collect()) == sorted(want.collect())
