"""Column expressions of the estimator: every scalar step between neighbours and decisions.

All work on arrays indexed by class and stay in the JVM.  ``q`` is the similarity, ``d`` the distance quantile, ``z`` the
logits, ``p`` the rescaled probabilities and ``q'`` the rescaled similarity.  Gates compare in single precision.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Q_OFFSET = 2.0
OOD_LIMIT = 0


def ladder(resolution: float) -> list[float]:
    """The alphas 1 - k * resolution above one half, from the top, rounded to ten places."""
    if not 0.00005 <= resolution < 0.5:
        raise ValueError("the alpha resolution must be at least 0.00005 and under 0.5")
    out, k = [], 1
    while (alpha := round(1 - k * resolution, 10)) > 0.5:
        out.append(alpha)
        k += 1
    return out


def argmax(z: Column) -> Column:
    """The class with the greatest value, the lowest of equal ones; from 0."""
    return (F.array_position(z, F.array_max(z)) - 1).cast("int")


def scaled_softmax(z: Column, scale: Column) -> Column:
    """softmax(z * scale), shifted by the greatest value."""
    raised = F.transform(z, lambda x: F.exp((x - F.array_max(z)) * scale))
    return F.element_at(F.transform(F.array(raised), lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))), 1)


def probabilities(z: Column, q: Column, d: Column, q_offset: float = Q_OFFSET) -> Column:
    """softmax(z * d * ln(q_offset + q))."""
    return scaled_softmax(z, d * F.log(F.lit(q_offset) + q))


def rescaled_similarity(q: Column, p: Column, prediction: Column, q_offset: float = Q_OFFSET) -> Column:
    """min(q, (q_offset + q) ^ p[prediction])."""
    return F.least(q.cast("double"), F.pow(F.lit(q_offset) + q, F.get(p, prediction)))


def count_below(sorted_values: Column, v: Column) -> Column:
    return F.size(F.filter(sorted_values, lambda x: x < v))


def distance_quantile(d0: Column, cdfs: Column) -> Column:
    """The least over classes of 1 - (share of the class's distances below d0); 0 if any class has none."""
    per_class = F.transform(cdfs, lambda c: F.when(F.size(c) > 0, 1 - count_below(c, d0) / F.size(c)).otherwise(F.lit(0.0)))
    return F.when(F.exists(cdfs, lambda c: F.size(c) == 0), F.lit(0.0)).otherwise(F.array_min(per_class))


def sample_sizes(q_prime: Column, cdfs: Column) -> Column:
    """For each class how many of its calibration values are at most q'."""
    return F.transform(cdfs, lambda c: F.size(F.filter(c, lambda x: x <= q_prime)))


def dkw_errors(n: Column, alpha: Column | float) -> Column:
    """Half-widths of the Dvoretzky-Kiefer-Wolfowitz band at confidence alpha: 1 where there are no values."""
    alpha = F.lit(alpha) if isinstance(alpha, float) else alpha
    return F.transform(n, lambda x: F.when(x > 0, F.sqrt(F.log(2 / (1 - alpha)) / (2 * x))).otherwise(F.lit(1.0)))


def distance_band(d: Column, errors: Column) -> Column:
    """struct(lower, upper): d less and plus the greatest error, within [0, 1]."""
    e = F.array_max(errors)
    return F.struct(F.greatest(d - e, F.lit(0.0)).alias("lower"), F.least(d + e, F.lit(1.0)).alias("upper"))


def accepts(p: Column, q_prime: Column, prediction: Column, region: Column, ood_limit: int = OOD_LIMIT) -> Column:
    """Whether the region admits the row: similar enough, and exactly the predicted class reaches its threshold."""
    reached = F.zip_with(p, region["thresholds"], lambda a, b: a.cast("float") >= b.cast("float"))
    single = F.size(F.filter(reached, lambda x: x)) == 1
    return (
        (F.floor(q_prime) > ood_limit)
        & (q_prime.cast("float") >= region["q_min"].cast("float"))
        & single
        & F.coalesce(F.get(reached, prediction), F.lit(False))
    )


def assigned_alpha(p: Column, q_prime: Column, prediction: Column, regions: Column, ood_limit: int = OOD_LIMIT) -> Column:
    """The greatest alpha among the accepting regions, 0 if there is none."""
    fit = F.filter(regions, lambda r: accepts(p, q_prime, prediction, r, ood_limit))
    return F.coalesce(F.array_max(F.transform(fit, lambda r: r["alpha"])), F.lit(0.0))


def lower_estimate(
    z: Column, q: Column, d: Column, n: Column, prediction: Column, regions: Column, q_offset: float = Q_OFFSET, ood_limit: int = OOD_LIMIT
) -> Column:
    """The conservative estimate: struct(alpha, errors, d_lower, d_upper, sdm_lower, sdm_upper, q_prime_lower).

    At each region the distance band at its alpha replaces d by the lower end; the first region that accepts the row so
    scored is assigned and its band kept.  A row that no region accepts has errors of 1 and the band [0, 1]."""

    def at(alpha: Column, errors: Column) -> Column:
        band = distance_band(d, errors)
        low, high = probabilities(z, q, band["lower"], q_offset), probabilities(z, q, band["upper"], q_offset)
        return F.struct(
            alpha.alias("alpha"),
            errors.alias("errors"),
            band["lower"].alias("d_lower"),
            band["upper"].alias("d_upper"),
            low.alias("sdm_lower"),
            high.alias("sdm_upper"),
            rescaled_similarity(q, low, prediction, q_offset).alias("q_prime_lower"),
        )

    tried = F.transform(
        regions,
        lambda r: F.struct(at(r["alpha"], dkw_errors(n, r["alpha"])).alias("s"), r.alias("r")),
    )
    fit = F.filter(tried, lambda t: accepts(t["s"]["sdm_lower"], t["s"]["q_prime_lower"], prediction, t["r"], ood_limit))
    none = at(F.lit(0.0), F.transform(n, lambda x: F.lit(1.0)))
    return F.coalesce(F.get(F.transform(F.array_sort(fit, lambda a, b: F.when(a["s"]["alpha"] > b["s"]["alpha"], -1).when(a["s"]["alpha"] < b["s"]["alpha"], 1).otherwise(0)), lambda t: t["s"]), 0), none)


def is_finite(x: Column) -> Column:
    """Every value of a float array is a number and stays finite in single precision."""
    return F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("float")) < float("inf"))), F.lit(False))


def decision(
    alpha: Column, q_prime: Column, minimum_alpha: float, accepted: str = "allow", rejected: str = "review", ood_limit: int = OOD_LIMIT
) -> Column:
    """struct(action, reason, observed_alpha, required_alpha) of a selection policy."""
    reason = (
        F.when(F.floor(q_prime) <= ood_limit, F.lit("zero-similarity"))
        .when(alpha == 0, F.lit("no-calibrated-region"))
        .when(alpha < minimum_alpha, F.lit("below-required-alpha"))
        .otherwise(F.lit("accepted"))
    )
    return F.struct(
        F.when(reason == "accepted", F.lit(accepted)).otherwise(F.lit(rejected)).alias("action"),
        reason.alias("reason"),
        alpha.alias("observed_alpha"),
        F.lit(float(minimum_alpha)).alias("required_alpha"),
    )


def logit_margin(z: Column) -> Column:
    """The greatest less the second logit; of a single class, the logit."""
    s = F.sort_array(z, asc=False)
    return F.when(F.size(z) == 1, F.get(s, 0)).otherwise(F.get(s, 0) - F.get(s, 1))
