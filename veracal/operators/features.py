"""Feature vectors: composition, validation, one global normalisation and the two affine layers of the adaptor."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMPOSITIONS = ("auto", "embedding", "attributes", "embedding+attributes")


def compose(df: DataFrame, composition: str = "auto") -> DataFrame:
    """``df`` with ``x``: the embedding, the attributes or both (embedding first); ``auto`` takes what each row has."""
    e, a = (F.col(c) if c in df.columns else F.lit(None).cast("array<float>") for c in ("embedding", "attributes"))
    both = F.concat(e, a)
    of = {"embedding": e, "attributes": a, "embedding+attributes": both, "auto": F.coalesce(both, e, a)}
    if composition not in of:
        raise ValueError(f"composition must be one of {COMPOSITIONS}")
    return df.withColumn("x", of[composition])


def normalization(df: DataFrame, vector: str = "x") -> tuple[float, float]:
    """(mean, sample standard deviation) of all entries of all vectors together."""
    r = df.select(F.explode(vector).alias("v")).agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s")).first()
    return float(r["m"]), float(r["s"] or 1.0)


def affine(x: Column, weight: list[list[float]], bias: list[float]) -> Column:
    """Each row of the weight times x, plus the bias."""
    rows = F.array(*[F.struct(F.array(*[F.lit(float(v)) for v in w]).alias("w"), F.lit(float(b)).alias("b")) for w, b in zip(weight, bias)])
    return F.transform(rows, lambda r: F.aggregate(F.zip_with(x, r["w"], lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) + r["b"])


def project(df: DataFrame, weights: dict[str, np.ndarray], mean: float = 0.0, std: float = 1.0) -> DataFrame:
    """``df`` with ``exemplar`` (first layer) and ``z`` (second layer) of the normalised ``x``; by matrix products in numpy.

    weights: w1 (M, D), b1 (M), w2 (C, M), b2 (C).  There is nothing between the layers."""
    sent = df.sparkSession.sparkContext.broadcast({k: np.asarray(v, np.float64) for k, v in weights.items()})

    @F.pandas_udf("exemplar array<double>, z array<double>")
    def run(x: pd.Series) -> pd.DataFrame:
        w = sent.value
        m = (np.array(x.tolist(), np.float64) - mean) / std
        e = m @ w["w1"].T + w["b1"]
        return pd.DataFrame({"exemplar": list(e), "z": list(e @ w["w2"].T + w["b2"])})

    return df.withColumn("_a", run("x")).withColumn("exemplar", F.col("_a.exemplar")).withColumn("z", F.col("_a.z")).drop("_a")


def digest(vector) -> str:
    """SHA-256 of the little-endian single-precision bytes, with negative zero as zero."""
    v = np.asarray(vector, "<f4") + np.float32(0)
    if not np.isfinite(v).all():
        raise ValueError("features must be finite")
    return hashlib.sha256(v.astype("<f4").tobytes()).hexdigest()


@F.pandas_udf(T.StringType())
def feature_digest(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None else digest(v))
