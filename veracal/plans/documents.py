"""Scored documents: source rows with their scores, for storage and exchange, and exports of a model's own sources."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import datasets
from .model import Model

# Fixed values of the exchange format.
SCORE_VERSION, MATCHING_VERSION = 1, 2
COMPACT = {
    "prediction": "prediction", "q": "q", "d0": "d0", "d": "d", "qPrime": "q_prime", "nearestSupportIndex": "nearest", "nearestSupportID": "nearest_id",
    "centroidRegionAlpha": "centroid_alpha", "lowerRegionAlpha": "lower_alpha", "isInMostConservativeRegion": "in_top_region",
    "isInMostConservativeRegionLower": "in_top_region_lower",
}
FULL = {
    "zPrime": "z", "sdm": "sdm", "cumulativeEffectiveSampleSizes": "n", "effectiveSampleSizeErrors": "errors", "dLower": "d_lower", "dUpper": "d_upper",
    "sdmLower": "sdm_lower", "sdmUpper": "sdm_upper", "qPrimeLower": "q_prime_lower",
}


def score_documents(model: Model, rows: DataFrame, detail: str = "full", nearest: int = 25, exclude: str | None = None, strategy: str = "arrow") -> DataFrame:
    """(row_idx, value): each source row (columns of the bundle schema and x) with its score, as one JSON object.

    Score fields of the source are replaced.  With ``exclude``, a column with the support index that a row is, that row's label
    and projection must agree with the support's, and the exclusion is recorded."""
    scored = model.score(rows, strategy, nearest, exclude)
    names = COMPACT | (FULL if detail == "full" else {})
    if nearest:
        one = lambda m: F.struct(
            m["support_idx"].alias("supportIndex"), m["id"].alias("id"), m["label"].alias("label"), m["predicted_label"].alias("predictedLabel"),
            m["d2"].alias("squaredDistance"), *([m["document"].alias("document")] if "document" in model.support.columns else []),
        )
        scored = scored.withColumn("matches", F.transform("matches", one))
        names = names | {"nearestSupportMatches": "matches"}
    if exclude:
        s = model.support.select(F.col("support_idx").alias(exclude), F.col("id").alias("_xid"), F.col("label").alias("_xl"), F.col("exemplar").alias("_xe"))
        scored = scored.join(s, exclude, "left")
        near = F.forall(F.zip_with("exemplar", "_xe", lambda a, b: F.abs(a - b) <= 2e-4 * F.greatest(F.lit(1.0), F.abs(b))), lambda x: x)
        ok = F.col(exclude).isNull() | (F.coalesce(F.col("_xl") == F.col("label"), F.lit(False)) & F.coalesce(near, F.lit(False)))
        scored = scored.withColumn("prediction", F.when(F.assert_true(ok, "an excluded support row is not the row").isNull(), F.col("prediction")))
        names = names | {"excludedSupportIndex": exclude, "excludedSupportID": "_xid"}
    fields = [F.lit(model.model_id).alias("modelID"), *[F.col(v).alias(k) for k, v in names.items()]]
    fields += [F.lit(SCORE_VERSION).alias("scoreSchemaVersion"), F.lit(MATCHING_VERSION).alias("matchingSemanticsVersion"), F.lit(model.fingerprint).alias("representationFingerprint")]
    score = F.to_json(F.struct(*fields), {"ignoreNullFields": "true"})
    source = [c for c in ("id", "label", "document", "prompt", "embedding", "attributes") if c in rows.columns]
    base = F.to_json(F.struct(*source), {"ignoreNullFields": "true"})
    stale = [*COMPACT, *FULL, "modelID", "nearestSupportMatches", "scoreSchemaVersion", "matchingSemanticsVersion", "representationFingerprint", "excludedSupportIndex", "excludedSupportID"]

    @F.pandas_udf("string")
    def merged(base, score, metadata, extra):
        import pandas as pd

        out = []
        for b, s, m, e in zip(base, score, metadata, extra):
            o = json.loads(b) | ({"metadata": json.loads(m)} if m is not None else {})
            o |= {k: v for k, v in json.loads(e).items() if k not in stale} if e is not None else {}
            out.append(json.dumps(o | json.loads(s), ensure_ascii=False))
        return pd.Series(out)

    metadata, extra = (F.col(c) if c in rows.columns else F.lit(None).cast("string") for c in ("metadata", "extra"))
    return scored.select("row_idx", merged(base, score, metadata, extra).alias("value"))


def write_scored(scored: DataFrame, path: str) -> None:
    """Scored documents in row order as JSON Lines, in place only when complete; '-' prints them."""
    import uuid

    rows = (r["value"] for r in scored.orderBy("row_idx").toLocalIterator(prefetchPartitions=True))
    if path == "-":
        for r in rows:
            print(r)
        return
    target = Path(path)
    stage = target.parent / f".{target.name}-{uuid.uuid4().hex}"
    try:
        with open(stage, "w", encoding="utf-8") as out:
            for r in rows:
                out.write(r + "\n")
        stage.replace(target)
    finally:
        stage.unlink(missing_ok=True)


def membership(model: Model) -> DataFrame:
    """(id, label, pool_index, selected_split, selected_index) of a model's support and calibration rows."""
    spark = model.support.sparkSession
    splits = model.metadata.get("bestIterationSplits")
    parts = [model.support.select("id", "label", F.lit("training").alias("selected_split"), F.col("support_idx").alias("selected_index"))]
    if model.calibration is not None:
        parts.append(model.calibration.select("id", "label", F.lit("calibration").alias("selected_split"), F.col("cal_idx").alias("selected_index")))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    if not splits:
        return out.withColumn("pool_index", F.lit(None).cast("long"))
    pairs = [("training", i, p) for i, p in enumerate(splits["trainingIndices"])] + [("calibration", i, p) for i, p in enumerate(splits["calibrationIndices"])]
    if sorted(p for *_, p in pairs) != list(range(len(pairs))):
        raise ValueError("the saved splits do not partition the pool")
    return out.join(spark.createDataFrame(pairs, "selected_split string, selected_index long, pool_index long"), ["selected_split", "selected_index"], "left")


def export_sources(model: Model, sources: DataFrame, role: str) -> DataFrame:
    """The source rows of a role (original or selected, training or calibration) of the model, in its order, each bound to its
    place by ``metadata``."""
    kind, _, split = role.partition("-")
    if kind not in ("original", "selected") or split not in ("training", "calibration"):
        raise ValueError(f"unknown role {role!r}")
    members = membership(model)
    if kind == "original":
        first = (model.metadata.get("bestIterationSplits") or {}).get("originalTrainingCount")
        if first is None:
            raise ValueError("the model does not say which rows it was given")
        inside = F.col("pool_index") < first
        members = members.where(inside if split == "training" else ~inside).withColumn("_at", F.col("pool_index") - (0 if split == "training" else first))
        members = members.withColumns({"_split": F.lit(role), "_index": F.col("_at")}).drop("_at")
    else:
        members = members.where(F.col("selected_split") == split).withColumns({"_split": F.lit(role), "_index": F.col("selected_index")})
    facts = members.select("id", "label", "pool_index", F.col("selected_split").alias("_s"), F.col("selected_index").alias("_i"), F.col("_split").alias("selected_split"), F.col("_index").alias("selected_index"))
    out = datasets.export(sources.drop("row_idx"), facts, role)
    place = F.to_json(F.struct(F.col("pool_index").alias("poolIndex"), F.col("_s").alias("selectedSplit"), F.col("_i").alias("selectedIndex")))
    return out.withColumn("source_place", place).withColumnRenamed("selected_index", "row_idx").drop("selected_split", "pool_index", "_s", "_i")
