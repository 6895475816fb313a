"""Streams: a stateless scorer, and monitoring over event time.

Ranking windows are not allowed on streams, so matching runs in an Arrow kernel against the broadcast support; the expressions
after it are those of the batch plan.  A support larger than ``knn.BROADCAST_BYTES`` is scored by micro-batch instead
(``foreachBatch`` with the tiled join)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scores
from ..operators import knn
from ..plans.model import Model, with_probabilities, with_regions, with_sizes


def with_matching(df: DataFrame, model: Model) -> DataFrame:
    """``df`` (exemplar, z) with prediction, q, d0, nearest; row by row, so that it holds on streams."""
    if knn._bytes(model.support, "exemplar") > knn.BROADCAST_BYTES:
        raise ValueError("the support is too large to send along; score by micro-batch")
    rows = model.support.orderBy("support_idx").select("exemplar", "label", "predicted_label").toPandas()
    s = np.array(rows["exemplar"].tolist(), np.float64)
    right, predicted = (rows["label"] == rows["predicted_label"]).to_numpy(), rows["predicted_label"].to_numpy()
    sent, k = df.sparkSession.sparkContext.broadcast((s, right, predicted)), model.k
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t in (("prediction", T.IntegerType()), ("q", T.IntegerType()), ("d0", T.DoubleType()), ("nearest", T.LongType()))]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s, right, predicted = sent.value
        ids = np.arange(len(s))
        for b in batches:
            if not len(b):
                continue
            z = np.array(b["z"].tolist(), np.float64)
            prediction = z.argmax(1)
            d, at = knn.top_k(knn.distances(np.array(b["exemplar"].tolist(), np.float64), s), ids, min(k, len(ids)))
            good = right[at] & (predicted[at] == prediction[:, None])
            yield b.assign(prediction=prediction.astype(np.int32), q=np.logical_and.accumulate(good, 1).sum(1).astype(np.int32), d0=d[:, 0], nearest=at[:, 0])

    return df.mapInPandas(run, schema)


def score_stream(df: DataFrame, model: Model) -> DataFrame:
    """Score a stream of rows with x (or exemplar and z); append mode."""
    if "z" not in df.columns:
        df = model.transform(df)
    out = with_sizes(with_probabilities(with_matching(df, model), model.distance_cdfs, model.q_offset), model.similarity_cdfs)
    return with_regions(out, model.regions, model.q_offset, model.ood_limit)


def score_by_batch(model: Model, sink: Callable[[DataFrame, int], None], strategy: str = "arrow") -> Callable[[DataFrame, int], None]:
    """A function for ``writeStream.foreachBatch``: the batch plan on each micro-batch, then the sink."""

    def run(batch: DataFrame, epoch: int) -> None:
        sink(model.score(batch, strategy), epoch)

    return run


def windowed_summary(df: DataFrame, value: str, by: str, time: str = "ts", width: str = "5 minutes", slide: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """Count, range and mean of a value in windows of event time, for batches and streams; late rows are waited for so long."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    out = df.withWatermark(time, lateness).groupBy(w.alias("w"), by)
    v = F.col(value)
    out = out.agg(F.count("*").alias("n"), F.min(v).alias("least"), F.max(v).alias("most"), F.avg(v).alias("mean"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n", "least", "most", "mean")


def admission_over_time(scored: DataFrame, time: str = "ts", width: str = "5 minutes", lateness: str = "10 minutes", minimum_alpha: float = 0.9) -> DataFrame:
    """The share of scored rows that a policy admits, and the mean similarity, in windows of event time."""
    d = scores.decision(F.col("centroid_alpha"), F.col("q_prime"), minimum_alpha)
    out = scored.withWatermark(time, lateness).groupBy(F.window(time, width).alias("w"))
    out = out.agg(F.count("*").alias("n"), F.avg((d["action"] == "allow").cast("double")).alias("admission"), F.avg("q").alias("mean_q"))
    return out.select(F.col("w.start").alias("start"), "n", "admission", "mean_q")
