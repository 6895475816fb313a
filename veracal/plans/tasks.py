"""The geometric task on the ``embeddings`` table: four components, two classes, centroid logits that need no training.

Rows with vec_id % 3 = 0 are support, 1 calibration, 2 queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

K = 25
CLASSES = 2
DIMENSIONS = 4
RESOLUTION = 0.05


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    x = F.array(*[F.get("embedding", i).cast("double") * 8 for i in range(DIMENSIONS)])
    label = (F.get("embedding", 0).cast("double") + F.get("embedding", 1).cast("double") > 0).cast("int")
    return e.select(F.col("vec_id").alias("row_idx"), (F.col("vec_id") % 3).alias("part"), x.alias("x"), x.alias("exemplar"), label.alias("label"))


def centroids(rows: DataFrame) -> DataFrame:
    """(label, mu): class means of the support."""
    mu = F.array(*[F.round(F.avg(F.get("x", i)), 9) for i in range(DIMENSIONS)])
    return rows.where("part = 0").groupBy("label").agg(mu.alias("mu"))


def with_logits(rows: DataFrame) -> DataFrame:
    """z_c = 2 x mu_c - |mu_c|^2, and the prediction."""
    fold = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    mus = centroids(rows).agg(F.transform(F.sort_array(F.collect_list(F.struct("label", "mu"))), lambda m: m["mu"]).alias("mus"))
    z = F.transform("mus", lambda m: 2 * fold(F.zip_with("x", m, lambda a, b: a * b)) - fold(F.transform(m, lambda v: v * v)))
    from ..functions.scores import argmax

    return rows.join(F.broadcast(mus)).withColumn("z", z).drop("mus").withColumn("prediction", argmax(F.col("z")))


def support(rows: DataFrame) -> DataFrame:
    return rows.where("part = 0").select(
        (F.col("row_idx") / 3).cast("long").alias("support_idx"), F.col("row_idx").cast("string").alias("id"), "label",
        F.col("prediction").alias("predicted_label"), "exemplar",
    )


def whole_vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(queries, support): all rows with all of their components, as both."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("row_idx"), F.transform("embedding", lambda v: v.cast("double")).alias("exemplar"))
    return e, e.withColumnRenamed("row_idx", "support_idx")


class Geo:
    """The stages of the task; each query takes what it needs."""

    def __init__(self, spark: SparkSession, sf_dir: str, strategy: str = "sql"):
        from . import model

        self.m, self.strategy = model, strategy
        self.rows = with_logits(vectors(spark, sf_dir))
        self.support = support(self.rows)

    def signals(self) -> DataFrame:
        """Calibration and query rows with q and d0."""
        return self.m.with_signals(self.rows.where("part > 0"), self.support, K, self.strategy).drop("x", "exemplar")

    def distance_cdfs(self, signals: DataFrame) -> DataFrame:
        from ..operators.calibration import distance_cdfs

        return distance_cdfs(signals.where("part = 1"), CLASSES)

    def probabilities(self) -> DataFrame:
        s = self.signals().persist()
        return self.m.with_probabilities(s, self.distance_cdfs(s))

    def similarity_cdfs(self, p: DataFrame) -> DataFrame:
        from ..operators.calibration import similarity_cdfs

        return similarity_cdfs(p.where("part = 1"), CLASSES)

    def sizes(self) -> DataFrame:
        p = self.probabilities().persist()
        return self.m.with_sizes(p, self.similarity_cdfs(p))

    def regions(self, p: DataFrame) -> list[tuple]:
        from ..operators.calibration import nested_regions

        return nested_regions(p.where("part = 1"), CLASSES, RESOLUTION)

    def scored(self) -> DataFrame:
        """Query rows with all score columns."""
        p = self.sizes().persist()
        return self.m.with_regions(p.where("part = 2"), self.regions(p))
