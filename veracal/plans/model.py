"""A fitted model and the scoring plan: project, match, signals, probabilities, regions, one DataFrame from end to end."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..operators import calibration, features, knn

#: Calibration values that may be sent along as arrays; more are ranked by a sort (calibration.range_counts).  In tables: those
#: that are sent to the tasks and searched by bisection.
CDF_POINTS, SENT_POINTS = 100_000, 4_000_000


@dataclass
class Model:
    """Everything scoring needs.  ``support`` has support_idx, id, label, predicted_label, exemplar, document; ``calibration``
    (optional) cal_idx, id, label, prediction, sdm, q_prime, q, d0, d, z."""

    class_names: list[str]
    support: DataFrame
    distance_cdfs: list[list[float]]
    similarity_cdfs: list[list[float]]
    regions: list[tuple]
    weights: dict[str, np.ndarray] | None = None
    mean: float = 0.0
    std: float = 1.0
    k: int = 2048
    q_offset: float = scores.Q_OFFSET
    ood_limit: int = scores.OOD_LIMIT
    resolution: float = 0.05
    fingerprint: str = ""
    model_id: str = field(default_factory=lambda: str(uuid.uuid4()))
    calibration: DataFrame | None = None
    metadata: dict = field(default_factory=dict)
    representation: dict = field(default_factory=dict)
    created_at: str | None = None

    @property
    def classes(self) -> int:
        return len(self.class_names)

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` (with x) with exemplar and z."""
        if self.weights is None:
            raise ValueError("the model has no adaptor")
        return features.project(df, self.weights, self.mean, self.std)

    def check(self, fingerprint: str | None) -> None:
        if fingerprint is not None and self.fingerprint and fingerprint != self.fingerprint:
            raise ValueError(f"the rows are represented as {fingerprint!r}, the model needs {self.fingerprint!r}")

    def score(self, df: DataFrame, strategy: str = "arrow", nearest: int = 0, exclude: str | None = None, fingerprint: str | None = None) -> DataFrame:
        """Score rows that have row_idx and x (or exemplar and z already)."""
        self.check(fingerprint)
        if "z" not in df.columns:
            df = self.transform(df)
        return score(self, df, strategy, nearest, exclude)

    def recalibrated(self, resolution: float) -> Model:
        """The ladder refitted from the saved calibration rows; everything else stays.  A new model with its origin noted."""
        if self.calibration is None:
            raise ValueError("the model holds no calibration rows")
        regions = calibration.nested_regions(self.calibration, self.classes, resolution, self.ood_limit)
        origin = {"sourceModelID": self.model_id, "previousAlphaResolution": self.resolution, "alphaResolution": resolution}
        return replace(self, regions=regions, resolution=resolution, model_id=str(uuid.uuid4()), created_at=None, metadata={**self.metadata, "recalibration": origin})


def with_signals(df: DataFrame, support: DataFrame, k: int, strategy: str = "sql", exclude: str | None = None) -> DataFrame:
    """``df`` (row_idx, exemplar, z) with prediction, q, d0, nearest."""
    df = df.withColumn("prediction", scores.argmax(F.col("z")))
    return knn.signals(df, support, k, strategy, exclude=exclude)


def with_probabilities(df: DataFrame, cdfs: list[list[float]] | DataFrame, q_offset: float = scores.Q_OFFSET) -> DataFrame:
    """``df`` with d, sdm and q_prime; ``cdfs`` are distances by class."""
    if isinstance(cdfs, DataFrame):
        df, sizes = _counted(df, "d0", cdfs, False, "_below")
        each = [1 - F.get("_below", c) / n for c, n in enumerate(sizes)]
        df = df.withColumn("d", F.array_min(F.array(*each)) if all(sizes) else F.lit(0.0)).drop("_below")
    elif sum(map(len, cdfs)) <= CDF_POINTS:
        df = df.withColumn("d", scores.distance_quantile(F.col("d0"), _literal(cdfs)))
    else:
        df = _ranked(df, "d0", cdfs, False, "_below").withColumn("d", _least(cdfs)).drop("_below")
    df = df.withColumn("sdm", scores.probabilities(F.col("z"), F.col("q"), F.col("d"), q_offset))
    return df.withColumn("q_prime", scores.rescaled_similarity(F.col("q"), F.col("sdm"), F.col("prediction"), q_offset))


def with_sizes(df: DataFrame, cdfs: list[list[float]] | DataFrame) -> DataFrame:
    """``df`` with n, the effective sample size of each class."""
    if isinstance(cdfs, DataFrame):
        return _counted(df, "q_prime", cdfs, True, "n")[0]
    if sum(map(len, cdfs)) <= CDF_POINTS:
        return df.withColumn("n", scores.sample_sizes(F.col("q_prime"), _literal(cdfs)))
    return _ranked(df, "q_prime", cdfs, True, "n")


def _counted(df: DataFrame, value: str, cdfs: DataFrame, inclusive: bool, name: str) -> tuple[DataFrame, list[int]]:
    """``df`` with how many values of each class are below a row's (or at most it), and the number of values of each class."""
    sizes = [r["n"] for r in sorted(cdfs.select("class", F.size("values").alias("n")).collect(), key=lambda r: r["class"])]
    if sum(sizes) > SENT_POINTS:
        points = cdfs.select("class", F.explode("values").alias("v"))
        per = calibration.range_counts(df, value, points, inclusive)
        lists = per.groupBy("row_idx").agg(F.map_from_entries(F.collect_list(F.struct("class", F.col("n").cast("int")))).alias("_m"))
        each = F.array(*[F.coalesce(F.element_at("_m", c), F.lit(0)) for c in range(len(sizes))])
        return df.join(lists, "row_idx", "left").withColumn(name, each).drop("_m"), sizes
    rows = cdfs.orderBy("class").select("values").toPandas()["values"]  # bounded: its values were counted
    sent = df.sparkSession.sparkContext.broadcast([np.array(v, np.float64) for v in rows])

    @F.pandas_udf("array<int>")
    def counts(v: pd.Series) -> pd.Series:
        per = [np.searchsorted(c, v.to_numpy(np.float64), "right" if inclusive else "left") for c in sent.value]
        return pd.Series(list(np.column_stack(per).astype(np.int32)))

    none = F.array(*[F.lit(0)] * len(sizes))
    return df.withColumn(name, F.when(F.col(value).isNotNull(), counts(F.col(value))).otherwise(none)), sizes


def _literal(cdfs: list[list[float]]):
    import json

    return F.from_json(F.lit(json.dumps([[float(v) for v in c] for c in cdfs])), "array<array<double>>")


def _ranked(df: DataFrame, value: str, cdfs: list[list[float]], inclusive: bool, name: str) -> DataFrame:
    spark = df.sparkSession
    points = spark.createDataFrame([(c, float(v)) for c, vs in enumerate(cdfs) for v in vs], "class int, v double")
    per = calibration.range_counts(df, value, points, inclusive)
    lists = per.groupBy("row_idx").agg(F.map_from_entries(F.collect_list(F.struct("class", F.col("n").cast("int")))).alias("_m"))
    each = F.array(*[F.coalesce(F.element_at("_m", c), F.lit(0)) for c in range(len(cdfs))])
    return df.join(lists, "row_idx", "left").withColumn(name, each).drop("_m")


def _least(cdfs: list[list[float]]):
    if not all(cdfs):
        return F.lit(0.0)
    return F.array_min(F.array(*[1 - F.get("_below", c) / len(v) for c, v in enumerate(cdfs)]))


def with_regions(df: DataFrame, regions, q_offset: float = scores.Q_OFFSET, ood_limit: int = scores.OOD_LIMIT) -> DataFrame:
    """``df`` with centroid_alpha, the lower estimate's columns and lower_alpha."""
    ladder = calibration.regions_column(regions) if isinstance(regions, list) else regions
    c = F.col
    df = df.withColumn("centroid_alpha", scores.assigned_alpha(c("sdm"), c("q_prime"), c("prediction"), ladder, ood_limit))
    low = scores.lower_estimate(c("z"), c("q"), c("d"), c("n"), c("prediction"), ladder, q_offset, ood_limit)
    df = df.withColumn("_l", low)
    fields = ("errors", "d_lower", "d_upper", "sdm_lower", "sdm_upper", "q_prime_lower")
    return df.withColumn("lower_alpha", c("_l.alpha")).withColumns({f: c(f"_l.{f}") for f in fields}).drop("_l")


def score(model: Model, df: DataFrame, strategy: str = "arrow", nearest: int = 0, exclude: str | None = None) -> DataFrame:
    """All columns of ``df`` and the score's.  ``nearest`` adds a list of so many nearest support rows for display; the list
    never changes a score."""
    out = with_signals(df, model.support, model.k, strategy, exclude)
    out = with_probabilities(out, model.distance_cdfs, model.q_offset)
    out = with_sizes(out, model.similarity_cdfs)
    out = with_regions(out, model.regions, model.q_offset, model.ood_limit)
    top = max([0.0, *(r[0] for r in model.regions)])
    out = out.withColumn("in_top_region", (F.col("centroid_alpha") == top) & (F.lit(top) > 0))
    out = out.withColumn("in_top_region_lower", (F.col("lower_alpha") == top) & (F.lit(top) > 0))
    names = model.support.select(F.col("support_idx").alias("nearest"), F.col("id").alias("nearest_id"))
    out = out.join(names, "nearest", "left")
    if nearest:
        out = out.join(matches(out, model.support, nearest, strategy, exclude), "row_idx", "left")
    return out


def matches(df: DataFrame, support: DataFrame, nearest: int, strategy: str = "arrow", exclude: str | None = None) -> DataFrame:
    """(row_idx, matches): the nearest support rows with their attributes, by distance, then index."""
    extra = 1 if exclude else 0  # an excluded row takes no place in the list
    n = knn.knn(df, support, nearest + extra, strategy, exclude=exclude).where(F.col("rank") <= nearest)
    s = support.select("support_idx", "id", "label", "predicted_label", *(["document"] if "document" in support.columns else []))
    entry = F.struct("rank", "support_idx", *[c for c in s.columns if c != "support_idx"], "d2")
    return n.join(s, "support_idx").groupBy("row_idx").agg(F.sort_array(F.collect_list(entry)).alias("matches"))


def fit_calibration(calibration_rows: DataFrame, classes: int, resolution: float = 0.05, q_offset: float = scores.Q_OFFSET, ood_limit: int = scores.OOD_LIMIT) -> tuple:
    """(distance CDFs, similarity CDFs, regions, scored calibration rows) from rows with label, prediction, z, q, d0."""
    d = calibration.distance_cdfs(calibration_rows, classes, ood_limit)
    rows = with_probabilities(calibration_rows, d, q_offset).persist()
    s = calibration.similarity_cdfs(rows, classes)
    regions = calibration.nested_regions(rows, classes, resolution, ood_limit)
    lists = lambda x: [r["values"] for r in sorted(x.collect(), key=lambda r: r["class"])]
    return lists(d), lists(s), regions, rows
