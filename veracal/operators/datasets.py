"""Whole-dataset operators: validation, inspection, pooling and splitting, and export of a saved membership."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UNLABELLED, OUTSIDE = -1, -99


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, document): quality labels where there are any, else unlabelled."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").alias("document"))
    one = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    out = d.join(one, "doc_id", "left")
    return out.select(F.col("doc_id").cast("string").alias("id"), F.coalesce("quality", F.lit(UNLABELLED)).alias("label"), "document")


def label_histogram(df: DataFrame) -> DataFrame:
    return df.groupBy("label").agg(F.count("*").alias("n"), F.count("document").alias("n_documents"))


def validation(df: DataFrame) -> DataFrame:
    """One row of facts that decide whether (id, label, embedding) rows are a valid dataset."""
    bad_label = (F.col("label") < 0) & ~F.col("label").isin(UNLABELLED, OUTSIDE)
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return df.agg(
        F.count("*").alias("n"),
        F.count_distinct("id").alias("n_ids"),
        F.count_if(F.coalesce(F.col("id"), F.lit("")) == "").alias("empty_ids"),
        F.count_if(bad_label).alias("bad_labels"),
        F.min(F.size("embedding")).alias("least_dimension"),
        F.max(F.size("embedding")).alias("most_dimension"),
        F.count_if(~F.coalesce(finite, F.lit(True))).alias("not_finite"),
    )


class DatasetError(ValueError):
    """Rows that are no valid dataset."""


def require_valid(df: DataFrame) -> None:
    """Raise if ids repeat or are empty, labels are out of their domain, dimensions differ or values are not finite."""
    r = validation(df).first()
    faults = []
    if r["n"] == 0:
        faults.append("there are no rows")
    if r["n_ids"] != r["n"]:
        faults.append("ids repeat or are missing")
    if r["empty_ids"]:
        faults.append("ids are empty")
    if r["bad_labels"]:
        faults.append("labels must be class indices, -1 or -99")
    if r["least_dimension"] != r["most_dimension"]:
        faults.append("feature dimensions differ")
    if r["not_finite"]:
        faults.append("features are not finite")
    if faults:
        raise DatasetError("; ".join(faults))


def pool(training: DataFrame, calibration: DataFrame) -> DataFrame:
    """Both sets together, the training rows first; pool_index counts from 0 in that order (by row_idx within a set)."""
    both = training.withColumn("_s", F.lit(0)).unionByName(calibration.withColumn("_s", F.lit(1)))
    return with_index(both, "pool_index", "_s", "row_idx").drop("_s")


def with_index(df: DataFrame, name: str, *order: str) -> DataFrame:
    """``df`` with a dense index from 0 in the given order, without a global window: counts of ranges are added up first."""
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    local = parts.withColumn("_row", F.monotonically_increasing_id() % F.lit(1 << 33)).persist()
    counts = local.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))  # one row a partition
    return local.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_row")).drop("_part", "_row", "_start")


def split(df: DataFrame, seed: int) -> DataFrame:
    """(id, label, pool_index, selected_split, selected_index): a repeatable random half for training, the rest (with an odd
    row) for calibration.  The order is that of MD5(seed:id), which other engines share."""
    drawn = df.select("id", "label", F.md5(F.concat_ws(":", F.lit(str(seed)), "id")).alias("_o"))
    placed = with_index(drawn, "_at", "_o", "id")
    placed = with_index(placed.withColumn("_len", F.length("id")), "pool_index", "_len", "id")  # numbers by value
    n = df.count()
    half = n // 2
    first = F.col("_at") < half
    return placed.select(
        "id", "label", "pool_index", F.when(first, "training").otherwise("calibration").alias("selected_split"),
        F.when(first, F.col("_at")).otherwise(F.col("_at") - half).alias("selected_index"),
    )


def export(sources: DataFrame, members: DataFrame, role: str) -> DataFrame:
    """Source rows of one role of a saved membership, in its order; each member must have its source, with the same label.
    The membership's other columns stay, in place of those of the sources with their names."""
    m = members.where(F.col("selected_split") == role).withColumnRenamed("label", "_label")
    out = m.join(sources.drop(*[c for c in m.columns if c != "id"]), "id", "left")
    same = F.assert_true(F.coalesce(F.col("label") == F.col("_label"), F.lit(False)), F.concat(F.lit("source missing or label changed: "), "id"))
    checked = out.withColumn("selected_index", F.when(same.isNull(), F.col("selected_index")))
    return checked.drop("_label").orderBy("selected_index")


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """How many ids two sets share."""
    return a.select("id").join(b.select("id"), "id", "left_semi").agg(F.count("*").alias("shared"))


def missing_classes(df: DataFrame, classes: int) -> list[int]:
    """Classes without a row."""
    have = {r[0] for r in df.where(F.col("label").between(0, classes - 1)).select("label").distinct().collect()}
    return [c for c in range(classes) if c not in have]
