"""Evaluation and distribution summaries of scored rows, as long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def known(df: DataFrame, classes: int) -> DataFrame:
    """Rows with a label of a class; -1 (unlabelled) and -99 (outside all classes) are not evaluated."""
    return df.where(F.col("label").between(0, classes - 1))


def totals(df: DataFrame, classes: int) -> DataFrame:
    """How many rows there are, are known, unlabelled and labelled as outside."""
    inside = F.col("label").between(0, classes - 1)
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(inside).alias("known"),
        F.count_if(F.col("label") == -1).alias("unlabelled"),
        F.count_if(F.col("label") == -99).alias("outside"),
    )


def cells(df: DataFrame, classes: int, by: list[str] | None = None) -> DataFrame:
    """Count, correct and accuracy: of all known rows, by true class and by predicted class; every class has its cells.

    Columns: those of ``by``, kind ('marginal', 'label', 'prediction'), class (null for marginal), n, correct, accuracy (null
    where the cell is empty)."""
    spark, names = df.sparkSession, by or []
    rows = known(df, classes)
    right = F.count_if(F.col("label") == F.col("prediction"))
    sets = [F.lit("marginal"), F.lit("label"), F.lit("prediction")]
    keyed = rows.select(
        *names,
        "label",
        "prediction",
        F.explode(
            F.array(
                F.struct(sets[0].alias("kind"), F.lit(None).cast("int").alias("class")),
                F.struct(sets[1].alias("kind"), F.col("label").cast("int").alias("class")),
                F.struct(sets[2].alias("kind"), F.col("prediction").cast("int").alias("class")),
            )
        ).alias("c"),
    )
    got = keyed.groupBy(*names, F.col("c.kind").alias("kind"), F.coalesce("c.class", F.lit(-1)).alias("class")).agg(F.count("*").alias("n"), right.alias("correct"))
    every = spark.createDataFrame([("marginal", -1)] + [(k, c) for k in ("label", "prediction") for c in range(classes)], "kind string, class int")
    if names:
        every = rows.select(*names).distinct().join(F.broadcast(every))
    out = every.join(got, [*names, "kind", "class"], "left")
    n, ok = F.coalesce("n", F.lit(0)), F.coalesce("correct", F.lit(0))
    return out.select(*names, "kind", F.when(F.col("class") >= 0, F.col("class")).alias("class"), n.alias("n"), ok.alias("correct"), F.try_divide(ok, n).alias("accuracy"))


def conditional_minima(cell_rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """For 'label' and 'prediction' the least accuracy over defined cells, and over all cells (null unless all are defined)."""
    rows = cell_rows.where("kind <> 'marginal'")
    every = F.bool_and(F.col("accuracy").isNotNull())
    return rows.groupBy(*(by or []), "kind").agg(F.min("accuracy").alias("minimum"), F.when(every, F.min("accuracy")).alias("complete_minimum"))


def alphas_of(df: DataFrame, classes: int) -> DataFrame:
    """The distinct positive alphas that known rows were assigned, by either estimator."""
    a = known(df, classes).select(F.explode(F.array("centroid_alpha", "lower_alpha")).alias("alpha"))
    return a.where("alpha > 0").distinct()


def cumulative(df: DataFrame, classes: int, alphas: list[float] | None = None) -> DataFrame:
    """Admission and accuracy at each alpha: rows assigned that alpha or a higher one, by estimator.

    (estimator, alpha, known, admitted, admission, correct, accuracy)."""
    rows = known(df, classes)
    if alphas is not None:
        if any(not (a == 0 or 0.5 < a < 1) for a in alphas):
            raise ValueError("alphas lie between one half and one")
        levels = df.sparkSession.createDataFrame([(float(a),) for a in sorted({*alphas} - {0.0})], "alpha double")
    else:
        levels = alphas_of(df, classes)
    long = rows.select(
        (F.col("label") == F.col("prediction")).alias("right"),
        F.explode(F.array(F.struct(F.lit("centroid").alias("estimator"), F.col("centroid_alpha").alias("a")), F.struct(F.lit("lower").alias("estimator"), F.col("lower_alpha").alias("a")))).alias("e"),
    ).select("right", "e.estimator", "e.a")
    counts = long.groupBy("estimator", "a").agg(F.count("*").alias("n"), F.count_if("right").alias("c"))
    whole = counts.groupBy("estimator").agg(F.sum("n").alias("known"))
    grid = whole.join(F.broadcast(levels)).join(counts, "estimator")
    over = F.col("a") >= F.col("alpha")
    out = grid.groupBy("estimator", "alpha", "known").agg(F.sum(F.when(over, F.col("n")).otherwise(0)).alias("admitted"), F.sum(F.when(over, F.col("c")).otherwise(0)).alias("correct"))
    return out.select("estimator", "alpha", "known", "admitted", F.try_divide("admitted", "known").alias("admission"), "correct", F.try_divide("correct", "admitted").alias("accuracy"))


def rejected(df: DataFrame, classes: int) -> DataFrame:
    """(estimator, n, correct) of known rows that no region admits."""
    rows = known(df, classes)
    right = F.col("label") == F.col("prediction")
    parts = [
        rows.where(F.col(c) == 0).agg(F.lit(n).alias("estimator"), F.count("*").alias("n"), F.count_if(right).alias("correct"))
        for n, c in (("centroid", "centroid_alpha"), ("lower", "lower_alpha"))
    ]
    return parts[0].unionByName(parts[1])


def balanced_mean(df: DataFrame, value: Column, classes: int) -> DataFrame:
    """The mean over classes of the mean within a class; every class must have rows."""
    per = known(df, classes).groupBy("label").agg(F.avg(value).alias("m"))
    return per.agg(F.when(F.count("*") == classes, F.avg("m")).alias("value"))


def signals(df: DataFrame) -> DataFrame:
    """(signal, v): nine numbers of each scored row, in long form."""
    from ..functions.scores import logit_margin

    p = F.col("prediction")
    pairs = {
        "predicted_logit": F.get("z", p),
        "logit_margin": logit_margin(F.col("z")),
        "predicted_sdm": F.get("sdm", p),
        "q": F.col("q").cast("double"),
        "q_prime": F.col("q_prime"),
        "d": F.col("d"),
        "d0": F.col("d0"),
        "centroid_alpha": F.col("centroid_alpha"),
        "lower_alpha": F.col("lower_alpha"),
    }
    long = F.array(*[F.struct(F.lit(k).alias("signal"), v.cast("double").alias("v")) for k, v in pairs.items()])
    return df.select(F.explode(long).alias("s")).select("s.signal", "s.v")


def quantiles(long: DataFrame) -> DataFrame:
    """(signal, n, least, most, mean, quantiles), exact, interpolated."""
    return long.groupBy("signal").agg(
        F.count("v").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.avg("v").alias("mean"),
        F.percentile("v", [float(x) for x in QUANTILES]).alias("quantiles"),
    )


def histogram(long: DataFrame, bins: int = 10) -> DataFrame:
    """(signal, bin, lo, hi, n): equal widths between least and most, the last bin closed; constant data fill one bin of
    width 1 around the value.  Bins without rows are listed."""
    ends = long.groupBy("signal").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    counts = long.join(F.broadcast(ends), "signal").groupBy("signal", at.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    grid = ends.withColumn("bin", F.explode(F.when(F.col("hi") > F.col("lo"), F.sequence(F.lit(0), F.lit(bins - 1))).otherwise(F.array(F.lit(0)))))
    out = grid.join(counts, ["signal", "bin"], "left")
    flat = F.col("hi") == F.col("lo")
    return out.select(
        "signal", "bin",
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo") + F.col("bin") * width).alias("lo"),
        F.when(flat, F.col("lo") + 0.5).when(F.col("bin") == bins - 1, F.col("hi")).otherwise(F.col("lo") + (F.col("bin") + 1) * width).alias("hi"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def prediction_frequencies(df: DataFrame, classes: int) -> DataFrame:
    """(prediction, n, share), classes without predictions included."""
    every = df.sparkSession.range(classes).select(F.col("id").cast("int").alias("prediction"))
    got = df.groupBy("prediction").agg(F.count("*").alias("n"))
    whole = df.agg(F.count("*").alias("all"))
    out = every.join(got, "prediction", "left").crossJoin(F.broadcast(whole))  # one row
    return out.select("prediction", F.coalesce("n", F.lit(0)).alias("n"), F.try_divide(F.coalesce("n", F.lit(0)), "all").alias("share"))
