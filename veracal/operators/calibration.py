"""Calibration: empirical distributions by class and the nested ladder of regions.

A region at alpha admits rows that are similar enough (q' at least the cutoff) and whose predicted class alone reaches its
threshold.  The cutoff is the least q' at which, among the rows left, every class has rows and at most int(tail * n) of them
give their own class less than alpha; the threshold of a class is the order statistic at that index.  Rows that a region admits
leave before the next, lower alpha is tried; an alpha without a region removes nothing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scores

#: Rows up to which the ladder is fitted over arrays on the driver; more are fitted by aggregates for each alpha.
LOCAL_ROWS = 200_000

REGION = T.StructType(
    [T.StructField("alpha", T.DoubleType()), T.StructField("q_min", T.DoubleType()), T.StructField("thresholds", T.ArrayType(T.DoubleType()))]
)


def class_values(df: DataFrame, value: str, classes: int, where: str = "true") -> DataFrame:
    """(class, values ascending), one row for each class; classes without rows have none."""
    spark = df.sparkSession
    have = df.where(where).groupBy(F.col("label").alias("class")).agg(F.sort_array(F.collect_list(value)).alias("values"))
    every = spark.range(classes).select(F.col("id").cast("int").alias("class"))
    return every.join(have, "class", "left").select("class", F.coalesce("values", F.array().cast("array<double>")).alias("values"))


def distance_cdfs(df: DataFrame, classes: int, ood_limit: int = scores.OOD_LIMIT) -> DataFrame:
    """Nearest distances by true class, of rows with enough similarity."""
    return class_values(df, "d0", classes, f"q > {ood_limit}")


def similarity_cdfs(df: DataFrame, classes: int) -> DataFrame:
    """Rescaled similarities by true class, of all rows."""
    return class_values(df, "q_prime", classes)


def as_arrays(cdfs: DataFrame) -> DataFrame:
    """One row with ``cdfs``, the values of all classes in order."""
    return cdfs.agg(F.transform(F.sort_array(F.collect_list(F.struct("class", "values"))), lambda x: x["values"]).alias("cdfs"))


def range_counts(df: DataFrame, value: str, points: DataFrame, inclusive: bool) -> DataFrame:
    """For large distributions: (row_idx, class, n), how many ``points`` (class, v) of a class are below a row's value (or at
    most it).  Points and rows are sorted together, class by class and range by range, so no list of points is broadcast."""
    classes = points.select("class").distinct()
    asked = df.select("row_idx", F.col(value).alias("v")).join(F.broadcast(classes))
    first = 0 if inclusive else 1
    both = points.select("class", "v", F.lit(None).cast("long").alias("row_idx"), F.lit(first).alias("_o")).unionByName(
        asked.select("class", "v", "row_idx", F.lit(1 - first).alias("_o"))
    )
    w = Window.partitionBy("class").orderBy("v", "_o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = both.withColumn("n", F.count(F.when(F.col("row_idx").isNull(), 1)).over(w))
    return counted.where("row_idx is not null").select("row_idx", "class", "n")


def _candidate(rest: DataFrame, alpha: float, classes: int) -> tuple | None:
    """(q' cutoff, thresholds) of the region at alpha among the residual rows."""
    tail = round(1 - alpha, 10)
    own = [F.count_if(F.col("label") == c).alias(f"n{c}") for c in range(classes)]
    low = [F.count_if((F.col("label") == c) & (F.col("_own") < F.lit(alpha).cast("float"))).alias(f"m{c}") for c in range(classes)]
    steps = rest.groupBy("_q").agg(*own, *low)
    w = Window.orderBy(F.desc("_q")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = steps.select("_q", *[F.sum(c).over(w).alias(c) for x in range(classes) for c in (f"n{x}", f"m{x}")])
    ok = F.lit(True)
    for c in range(classes):
        ok = ok & (F.col(f"n{c}") > 0) & (F.col(f"m{c}") <= F.floor(F.lit(tail) * F.col(f"n{c}")))
    cutoff = sums.where(ok).agg(F.min("_q")).first()[0]
    if cutoff is None:
        return None
    inside = rest.where(F.col("_q") >= F.lit(cutoff).cast("float"))
    n = F.count("*").over(Window.partitionBy("label"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy("_own"))
    at = F.least(F.floor(F.lit(tail) * n), n - 1) + 1
    got = inside.withColumn("_hit", rank == at).where("_hit").select("label", F.greatest("_own", F.lit(0).cast("float")).alias("t")).collect()
    return cutoff, [dict((r["label"], float(r["t"])) for r in got).get(c, 0.0) for c in range(classes)]


def nested_regions(df: DataFrame, classes: int, resolution: float = 0.05, ood_limit: int = scores.OOD_LIMIT, local_rows: int | None = None) -> list[tuple]:
    """[(alpha, q_min, thresholds)] from calibration rows (label, prediction, sdm, q_prime), from the highest alpha down.

    Up to ``local_rows`` rows (``LOCAL_ROWS``) take one job.  With more, each alpha costs two aggregates, and only cutoffs and
    thresholds come to the driver."""
    most = LOCAL_ROWS if local_rows is None else local_rows
    p = F.transform("sdm", lambda x: x.cast("float"))
    few = df.select("label", "prediction", p.alias("sdm"), "q_prime").limit(most + 1).toPandas()
    if len(few) <= most:
        if not len(few):
            return []
        columns = (few[c].to_numpy() for c in ("q_prime", "label", "prediction"))
        return nested_regions_local(np.array(few["sdm"].tolist(), np.float32), *columns, classes, resolution, ood_limit)
    rest = df.select("label", "prediction", p.alias("sdm"), F.col("q_prime").cast("float").alias("_q")).where(F.floor("_q") > ood_limit)
    rest = held = rest.withColumn("_own", F.get("sdm", F.col("label"))).persist()
    out = []
    for alpha in scores.ladder(resolution):
        found = _candidate(rest, alpha, classes)
        if found is None:
            continue
        cutoff, thresholds = found
        out.append((alpha, float(cutoff), thresholds))
        region = F.struct(F.lit(float(cutoff)).alias("q_min"), F.array(*[F.lit(t) for t in thresholds]).alias("thresholds"))
        rest = rest.where(~scores.accepts(F.col("sdm"), F.col("_q"), F.col("prediction"), region, ood_limit))
        if rest.isEmpty():
            break
    held.unpersist()
    return out


def nested_regions_local(p: np.ndarray, q_prime: np.ndarray, labels: np.ndarray, predictions: np.ndarray, classes: int, resolution: float = 0.05, ood_limit: int = 0) -> list[tuple]:
    """The same over arrays, for a fit inside one task."""
    p, q = np.asarray(p, np.float32), np.asarray(q_prime, np.float32)
    labels, predictions = np.asarray(labels), np.asarray(predictions)
    left, out = np.floor(q) > ood_limit, []
    for alpha in scores.ladder(resolution):
        if not left.any():
            break
        tail, a = round(1 - alpha, 10), np.float32(alpha)
        own = p[np.arange(len(p)), labels]
        cuts = np.unique(q[left])
        ok = np.ones(len(cuts), bool)
        for c in range(classes):
            mine = left & (labels == c)
            n = mine.sum() - np.searchsorted(np.sort(q[mine]), cuts)
            bad = mine & (own < a)
            m = bad.sum() - np.searchsorted(np.sort(q[bad]), cuts)
            ok &= (n > 0) & (m <= np.floor(tail * n))
        if not ok.any():
            continue
        cutoff = cuts[np.flatnonzero(ok)[0]]
        thresholds = []
        for c in range(classes):
            v = np.sort(own[left & (labels == c) & (q >= cutoff)])
            thresholds.append(max(0.0, float(v[min(int(tail * len(v)), len(v) - 1)])))
        out.append((alpha, float(cutoff), thresholds))
        reach = p >= np.array(thresholds, np.float32)
        admitted = (q >= cutoff) & (reach.sum(1) == 1) & reach[np.arange(len(p)), predictions]
        left &= ~admitted
    return out


def regions_frame(spark, regions: list[tuple]) -> DataFrame:
    """(ord, alpha, q_min, thresholds)."""
    rows = [(i, float(a), float(q), [float(t) for t in ts]) for i, (a, q, ts) in enumerate(regions)]
    return spark.createDataFrame(rows, T.StructType([T.StructField("ord", T.IntegerType()), *REGION.fields]))


def regions_column(regions: list[tuple]):
    """The ladder as an array literal."""
    if not regions:
        return F.array().cast(T.ArrayType(REGION))
    one = lambda r: F.struct(F.lit(float(r[0])).alias("alpha"), F.lit(float(r[1])).alias("q_min"), F.array(*[F.lit(float(t)) for t in r[2]]).alias("thresholds"))
    return F.array(*[one(r) for r in regions])
