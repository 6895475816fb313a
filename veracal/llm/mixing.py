"""Mixing sources to target weights along a time-varying curriculum.

Every source gets a target of words: its weight's share of all words, at most ``MAX_REPEATS`` times its own words, the
excess reshared by weight (water filling).  A source also has a schedule: a piecewise-linear weight over training time
[0, 1].  The integral of the schedule, scaled to the target, is the source's cumulative token demand D(t).  A source's
documents stand in a fixed pseudo-random order (MD5 of the id) and are read in that order again and again; the copy that
begins after c words of the source gets the training position D^-1(c).  The mix takes the first ``target`` words of that
stream, so that at most one document of a source is taken in part.

Nulls: a null source is a source of its own, the last one; a null text has size 0; null ids order as the empty string.
Equal rows are kept and interchangeable.  An empty table gives an empty result.
Scale: only ids, sources and sizes are shuffled.  Running sums within a source go over ``16**BUCKET_HEX`` hash buckets, so a
source with a third of all rows is spread over all tasks; only bucket sums and the table of sources are ever in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Hexadecimal digits of the order key that make a bucket: 4096 buckets a source.
BUCKET_HEX = 3
#: Schedule by weight: knots (time, factor), linear between them.  Heavy sources come early, light ones late.
SCHEDULES = {5: ((0.0, 1.5), (1.0, 0.5)), 2: ((0.0, 1.0), (1.0, 1.0)), 1: ((0.0, 0.5), (0.5, 0.75), (1.0, 2.0))}


def _cumulative(knots: tuple) -> list[tuple[float, float, float, float, float]]:
    """(t0, t1, w0, w1, share of the integral before t0) for each segment, with the whole integral as 1."""
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:])]
    total, out, seen = sum(areas), [], 0.0
    for ((t0, w0), (t1, w1)), a in zip(zip(knots, knots[1:]), areas):
        out.append((t0, t1, w0 / total, w1 / total, seen))
        seen += a / total
    return out


def demand_inverse(share: Column, knots: tuple) -> Column:
    """The time at which the schedule's integral reaches ``share`` (0 to 1) of its whole."""
    out = F.lit(1.0)
    for t0, t1, w0, w1, before in reversed(_cumulative(knots)):
        slope = (w1 - w0) / (t1 - t0)
        y = F.greatest(share - F.lit(before), F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * y, F.lit(0.0)))
        at = F.lit(t0) + 2 * y / (F.lit(w0) + root)
        end = before + (t1 - t0) * (w0 + w1) / 2
        out = F.when(share <= F.lit(end), F.least(at, F.lit(t1))).otherwise(out)
    return out


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size) -> + weight, target.  One row a source, so the windows over all sources are small."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    ahead = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    cap = F.lit(max_repeats) * F.col("source_size")
    s = sizes.withColumn("weight", w).withColumn("_cap", cap.cast("double")).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    # with the i lowest caps reached, the rest share what is left by weight; the first level below its own cap holds
    s = s.withColumn("_level", (F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(ahead), F.lit(0.0))) / F.sum("weight").over(after))
    s = s.withColumn("_hold", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_level"))).over(every)["_level"])
    target = F.when(F.col("_hold").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_hold") * F.col("weight")))
    return s.select("source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, max_repeats: int = MAX_REPEATS, schedules: dict | None = None) -> DataFrame:
    """doc_id, size, source, source_size, target, taken, position (time of the first copy; null if nothing is taken), copies
    (taken words and position of each)."""
    schedules = schedules or SCHEDULES
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    # the sizes are computed once and kept: counting words is the only pass over the texts
    rows = common.written(
        docs.select("doc_id", "source", common.n_words(common.text_of()).alias("size"), key.alias("_key")), "mix-sizes"
    ).withColumn("_bucket", F.substring("_key", 1, BUCKET_HEX))
    sums = rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    per_source = targets(sums.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, max_repeats)
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    starts = starts.alias("b").join(per_source.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source"))).select(
        F.col("b.source").alias("source"), "_bucket", "_before", "source_size", "weight", "target"
    )
    inner = Window.partitionBy("source", "_bucket").orderBy("_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_inner", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    out = placed.alias("d").join(
        starts.alias("b"), F.col("d.source").eqNullSafe(F.col("b.source")) & (F.col("d._bucket") == F.col("b._bucket"))
    ).select("d.doc_id", "d.source", "d.size", "b.source_size", "b.weight", "b.target", (F.col("_before") + F.col("_inner")).alias("_start"))
    whole = F.round("target").cast("long")

    def copy(e: int) -> Column:
        """The words taken of the document's e-th copy, and where it stands in training."""
        begin = F.col("source_size") * e + F.col("_start")
        share = F.when(F.col("target") > 0, begin / F.col("target")).otherwise(F.lit(0.0))
        at = F.lit(None).cast("double")
        for w, knots in schedules.items():
            at = F.when(F.col("weight") == w, demand_inverse(share, knots)).otherwise(at)
        return F.struct(F.greatest(F.lit(0), F.least(F.col("size"), whole - begin)).cast("long").alias("taken"), at.alias("position"))

    copies = F.filter(F.array(*[copy(e) for e in range(max_repeats)]), lambda c: c["taken"] > 0)
    out = out.withColumn("copies", copies)
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["taken"])
    return out.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), F.get("copies", 0)["position"].alias("position"), "copies")


def curriculum(docs: DataFrame, **options) -> DataFrame:
    """``docs`` in training order: each copy of a document that the mix takes, in whole or in part, as one row of the whole
    document, range-sorted by the copy's training position.  Columns: those of ``docs``."""
    m = mix(docs, **options).select("doc_id", F.col("copies.position").alias("_at"))
    m = m.groupBy("doc_id").agg(F.max(F.struct(F.size("_at"), "_at"))["_at"].alias("_at"))  # rows with one id: alike
    kept = docs.alias("d").join(m.alias("m"), F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")))
    row = F.struct(*[F.col(f"d.`{c}`") for c in docs.columns]).alias("_row")
    placed = kept.select(row, F.explode("m._at").alias("_position"))
    return placed.orderBy("_position", "_row.doc_id").select("_row.*")
