"""Quality rules with risk-controlled thresholds.

Base rules are fixed.  On top, each metric (higher is worse) gets a cutoff in each stratum (language), selected on a
labelled holdout so that it falsely rejects few good documents: for a cutoff, k of the n good holdout documents of the
stratum are rejected; the cutoff is admissible if an exact binomial test says that the false-rejection rate is at most
``RISK / metrics``, that is if P(Bin(n, RISK / metrics) <= k) <= ``DELTA / (strata * metrics)``.  This is the exact
(Clopper-Pearson) upper bound compared with the limit.  Corrections: Bonferroni over strata and metrics; within a metric the
fixed grid is tested from lenient to strict and stops at the first failure (fixed sequence), which needs no further share; the
limit is split over the metrics, so all cutoffs together reject at most ``RISK`` of a stratum's good documents, with
probability ``1 - DELTA`` over all strata at once.  A stratum with too few labels gets no cutoff and rejects nothing.

Everything is DataFrame expressions: texts are read in the JVM, once for the metrics.  Only ids and numbers are shuffled; the
counts that calibration needs are one row for each stratum, metric and grid step.

Nulls: a null text has no words (and fails the base rules), a null language is the stratum '', a null quality is no label;
of several labels for one id the lowest counts.  Without labels (or without documents) no cutoffs result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
RISK = 0.05
DELTA = 0.05
STEPS = 48

#: The fixed grid of each metric: from lenient to strict, (first, last), equal ratios between.
GRIDS = {
    "symbol_rate": (4.0, 0.005),
    "dup_line_rate": (1.0, 0.02),
    "repeat_rate": (1.0, 0.02),
    "long_words": (60.0, 6.0),
    "short_words": (1.0, 0.2),
    "same_words": (1.0, 0.1),
}
METRICS = tuple(GRIDS)


def grid(metric: str) -> list[float]:
    first, last = GRIDS[metric]
    return [round(first * (last / first) ** (i / (STEPS - 1)), 6) for i in range(STEPS)]


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, as a lambda variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """How many words lie in 3-word windows that occur twice or more in the text.

    Windows are compared by a 64-bit hash.  Only if two are equal, they are sorted with their places, and the words of
    those with an equal neighbour are counted once each."""

    def hashed(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def count(s: Column) -> Column:
            same = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
            return F.size(F.array_distinct(F.flatten(F.transform(same, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

        return let(placed, count)

    def windows(w: Column) -> Column:
        return let(hashed(w), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0)))

    return F.when(F.size(words) >= 4, windows(words)).otherwise(F.lit(0))


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a column ``_q``: base statistics and metrics of the whole text."""
    t = common.text_of(text)
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    letters = F.regexp_replace(t, common.GAP, "")

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
        )

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    symbols = F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", ""))
    return docs.withColumn(
        "_q",
        F.struct(
            F.length(letters).cast("long").alias("word_chars"),
            symbols.cast("long").alias("n_symbols"),
            let(F.regexp_extract_all(t, F.lit(common.WORD), F.lit(0)), of_words).alias("w"),
            let(lines, of_lines).alias("l"),
        ),
    )


def statistics() -> list[Column]:
    """The columns of a row with ``_q``: base statistics, base verdict and metrics."""
    q, n = F.col("_q"), F.col("_q.w.n_words")
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    repeat = q["w"]["n_repeat_words"]
    failed = (n < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n)
    return [
        n.alias("n_words"),
        q["word_chars"].alias("word_chars"),
        q["n_symbols"].alias("n_symbols"),
        q["l"]["n_dup_lines"].alias("n_dup_lines"),
        repeat.alias("n_repeat_words"),
        failed.alias("base_failed"),
        F.array(
            rate(q["n_symbols"], n),
            rate(q["l"]["n_dup_lines"], q["l"]["n_lines"]),
            rate(repeat, n),
            rate(q["word_chars"], n),
            rate(n, q["word_chars"]),
            F.when(n > 0, 1 - q["w"]["n_distinct"] / n).otherwise(F.lit(0.0)),
        ).alias("_metrics"),
    ]


def _lgamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1: Stirling's series at x + 8, and eight steps down."""
    z = x + 8
    series = (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    for i in range(8):
        series = series - F.log(x + i)
    return series


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k) for k up to the mean n * p, beyond which 1 stands (no test is passed there).

    The terms are summed from k down by their ratios, which are below 1; after 12 standard deviations nothing is left."""
    k, n = k.cast("double"), n.cast("double")
    first = _lgamma(n + 1) - _lgamma(k + 1) - _lgamma(n - k + 1) + k * F.log(F.lit(p)) + (n - k) * F.log1p(F.lit(-p))
    steps = F.least(k, 60 + F.ceil(12 * F.sqrt(n * p)).cast("double")).cast("int")

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] * F.greatest(k - i + 1, F.lit(0.0)) / (n - k + i) * ((1 - p) / p)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    down = F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(down, F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")), add, lambda a: a["sum"])
    return F.when(k > n * p, F.lit(1.0)).otherwise(F.exp(first + F.log(total)))


def calibrate(measured: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Cutoffs: one row for each stratum with an array ``_cutoffs`` in the order of METRICS (null: none).

    ``measured`` has doc_id, _stratum, base_failed and _metrics; ``labels`` has doc_id and quality (1: good)."""
    one = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    held = measured.where("not base_failed").join(one.where("_quality = 1"), "doc_id")
    grids = F.array(*[F.array(*[F.lit(c) for c in grid(m)]) for m in METRICS])
    # the first step of the grid at which the document is rejected; STEPS if none does
    step = lambda v, g: F.size(F.filter(g, lambda c: v <= c))
    steps = held.select("_stratum", F.posexplode(F.zip_with("_metrics", grids, step)).alias("_metric", "_step"))
    counts = steps.groupBy("_stratum", "_metric", "_step").agg(F.count("*").alias("_n"))
    per = counts.groupBy("_stratum", "_metric").agg(F.sum("_n").alias("_all"), F.collect_list(F.struct("_step", "_n")).alias("_at"))
    rejected = lambda s: F.aggregate("_at", F.lit(0).cast("long"), lambda a, x: a + F.when(x["_step"] <= s, x["_n"]).otherwise(0))
    tried = per.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(STEPS - 1)))).withColumn("_k", rejected(F.col("_s")))
    strata = held.select("_stratum").distinct().agg(F.count("*").alias("_strata"))
    tested = tried.crossJoin(F.broadcast(strata))  # one row
    passes = binomial_cdf(F.col("_k"), F.col("_all"), risk / len(METRICS)) <= delta / (F.col("_strata") * len(METRICS))
    best = tested.groupBy("_stratum", "_metric").agg(F.coalesce(F.min(F.when(~passes, F.col("_s"))), F.lit(STEPS)).alias("_stop"))
    cutoff = F.get(F.element_at(grids, F.col("_metric") + 1), F.col("_stop") - 1)
    best = best.select("_stratum", F.struct("_metric", F.when(F.col("_stop") > 0, cutoff).alias("_c")).alias("_m"))
    ordered = F.transform(F.sort_array(F.collect_list("_m")), lambda x: x["_c"])
    return best.groupBy("_stratum").agg(ordered.alias("_cutoffs"))


def stratum(lang: str = "lang") -> Column:
    return F.coalesce(F.col(lang), F.lit(""))


def judge(measured: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``measured`` with ``kept`` and ``rejected_by`` (names of the metrics over their cutoffs)."""
    over = lambda v, c: F.coalesce(v > c, F.lit(False))
    out = measured.join(common.maybe_broadcast(cutoffs), "_stratum", "left")
    bad = F.coalesce(F.zip_with("_metrics", "_cutoffs", over), F.array().cast("array<boolean>"))
    names = F.array(*[F.lit(m) for m in METRICS])
    why = F.filter(F.transform(bad, lambda b, i: F.when(b, F.get(names, i))), lambda x: x.isNotNull())
    out = out.withColumn("rejected_by", why)
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)).drop("_cutoffs")


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, _stratum, base statistics, base_failed, _metrics; one pass over the texts."""
    return with_statistics(docs.select("doc_id", "text", stratum().alias("_stratum"))).select("doc_id", "_stratum", *statistics())


def assess(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """One row for each document: base statistics, base_failed, kept, rejected_by."""
    measured = common.written(measure(docs), "quality")
    cutoffs = common.written(calibrate(measured, labels, risk, delta), "cutoffs")
    return judge(measured, cutoffs).drop("_stratum", "_metrics")


def keep(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The documents that are kept, with their own columns.  The texts are measured a second time where they lie instead
    of being shuffled to a join with the verdicts."""
    measured = common.written(measure(docs), "quality")
    cutoffs = common.written(calibrate(measured, labels, risk, delta), "cutoffs")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    again = with_statistics(docs.select(row, F.col("text"), stratum().alias("_stratum"))).select("_row", "_stratum", *statistics())
    return judge(again, cutoffs).where("kept").select("_row.*")
