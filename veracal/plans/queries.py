"""Queries over the driver's tables, one for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores
from ..operators import calibration, datasets, evaluation, features, knn
from . import model, tasks
from .tasks import CLASSES, K, Geo

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def r6(c: str) -> Column:
    return F.round(c, 6).alias(c)


@query
def score_flagship(spark, sf_dir):
    return Geo(spark, sf_dir).scored().select(
        F.col("row_idx").alias("vec_id"), "prediction", "q", r6("d0"), r6("d"), r6("q_prime"), r6("centroid_alpha"), r6("lower_alpha")
    )


@query
def knn_topk(spark, sf_dir):
    q, s = tasks.whole_vectors(spark, sf_dir)
    return knn.knn(q, s, K).select("row_idx", "rank", "support_idx", r6("d2"))


@query
def knn_topk_arrow(spark, sf_dir):
    q, s = tasks.whole_vectors(spark, sf_dir)
    return knn.knn(q, s, K, "arrow").select("row_idx", "rank", "support_idx", r6("d2"))


@query
def knn_self_excluded(spark, sf_dir):
    q, s = tasks.whole_vectors(spark, sf_dir)
    return knn.knn(q.withColumn("own", F.col("row_idx")), s, K, exclude="own").select("row_idx", "rank", "support_idx", r6("d2"))


@query
def knn_mixed_exclusion(spark, sf_dir):
    """Only even rows are left out of their own lists, and get one neighbour less."""
    q, s = tasks.whole_vectors(spark, sf_dir)
    q = q.withColumn("own", F.when(F.col("row_idx") % 2 == 0, F.col("row_idx")))
    return knn.knn(q, s, K, "arrow", exclude="own").select("row_idx", "rank", "support_idx", r6("d2"))


@query
def nearest_matches(spark, sf_dir):
    """The nearest support rows with their attributes, for display."""
    g = Geo(spark, sf_dir)
    m = model.matches(g.rows.where("part = 2"), g.support, 3).select("row_idx", F.explode("matches").alias("m"))
    return m.select("row_idx", "m.rank", "m.support_idx", "m.id", "m.label", "m.predicted_label", F.round("m.d2", 6).alias("d2"))


@query
def similarity_q(spark, sf_dir):
    return Geo(spark, sf_dir).signals().select("row_idx", "q")


@query
def nearest_distance_d0(spark, sf_dir):
    return Geo(spark, sf_dir).signals().select("row_idx", r6("d0"), "nearest")


@query
def class_centroid_logits(spark, sf_dir):
    return Geo(spark, sf_dir).rows.select("row_idx", F.round(F.get("z", 0), 6).alias("z0"), F.round(F.get("z", 1), 6).alias("z1"))


@query
def argmax_prediction(spark, sf_dir):
    return Geo(spark, sf_dir).rows.select("row_idx", "label", "prediction")


@query
def global_normalization(spark, sf_dir):
    """Over all components of all rows."""
    rows = features.compose(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "embedding")
    mean, std = features.normalization(rows)
    return rows.agg(F.sum(F.size("x")).alias("n")).select(F.lit(round(mean, 6)).alias("mean"), F.lit(round(std, 6)).alias("std"), "n")


@query
def feature_composition(spark, sf_dir):
    """Embedding first, then attributes; a row without one of them has what there is."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", F.array(F.col("label").cast("float")).alias("attributes"))
    e = e.withColumn("attributes", F.when(F.col("vec_id") % 2 == 0, F.col("attributes")))
    x = features.compose(e).select("vec_id", F.size("x").alias("n"), F.get("x", 0).cast("double").alias("a"), F.element_at("x", -1).cast("double").alias("b"))
    return x.select("vec_id", "n", F.round("a", 6).alias("first"), F.round("b", 6).alias("last"))


@query
def adaptor_projection(spark, sf_dir):
    """Both layers over the normalised vectors, with small fixed weights."""
    w = {"w1": [[((i + j) % 5 - 2) / 4 for i in range(64)] for j in range(3)], "b1": [0.1, -0.2, 0.3], "w2": [[1.0, -0.5, 0.25], [0.5, 1.0, -1.0]], "b2": [0.0, 0.125]}
    e = features.compose(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "embedding")
    p = features.project(e, w, 0.5, 2.0)
    names = [("exemplar", i, f"e{i}") for i in range(3)] + [("z", i, f"z{i}") for i in range(2)]
    return p.select("vec_id", *[F.round(F.get(c, i), 6).alias(n) for c, i, n in names])


@query
def pooled_rows(spark, sf_dir):
    """Training rows first, then calibration rows, with one index."""
    rows = Geo(spark, sf_dir).rows.select("row_idx", "part", "label")
    return datasets.pool(rows.where("part = 0"), rows.where("part = 1")).select("pool_index", "row_idx", "part", "label")


@query
def class_coverage(spark, sf_dir):
    """Classes of the labels 0 to 11 that no row has."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("label")
    return spark.createDataFrame([(c,) for c in datasets.missing_classes(rows, 12)], "missing int")


@query
def recalibrated_regions(spark, sf_dir):
    """The ladder refitted from the calibration rows at another resolution."""
    g = Geo(spark, sf_dir)
    found = calibration.regions_frame(spark, calibration.nested_regions(g.probabilities().where("part = 1"), CLASSES, 0.1))
    return found.select("ord", r6("alpha"), r6("q_min"), F.round(F.get("thresholds", 0), 6).alias("t0"), F.round(F.get("thresholds", 1), 6).alias("t1"))


@query
def distance_cdf(spark, sf_dir):
    g = Geo(spark, sf_dir)
    return g.distance_cdfs(g.signals()).select("class", F.posexplode("values").alias("pos", "v")).select("class", "pos", r6("v"))


@query
def distance_quantile(spark, sf_dir):
    return Geo(spark, sf_dir).probabilities().select("row_idx", r6("d"))


@query
def distance_quantile_ranked(spark, sf_dir):
    """The same by a sort, as for distributions too large to send along."""
    s = Geo(spark, sf_dir).signals().persist()
    points = s.where("part = 1 and q > 0").select(F.col("label").alias("class"), F.col("d0").alias("v"))
    n = points.groupBy("class").agg(F.count("*").alias("all"))
    below = calibration.range_counts(s, "d0", points, False).join(F.broadcast(n), "class")
    d = below.groupBy("row_idx").agg(F.min(1 - F.col("n") / F.col("all")).alias("d"), F.count("*").alias("c"))
    return d.select("row_idx", F.round(F.when(F.col("c") == CLASSES, F.col("d")).otherwise(0.0), 6).alias("d"))


@query
def sdm_probability(spark, sf_dir):
    return Geo(spark, sf_dir).probabilities().select("row_idx", F.round(F.get("sdm", 0), 6).alias("p0"), F.round(F.get("sdm", 1), 6).alias("p1"))


@query
def rescaled_similarity(spark, sf_dir):
    return Geo(spark, sf_dir).probabilities().select("row_idx", r6("q_prime"))


@query
def qprime_cdf(spark, sf_dir):
    g = Geo(spark, sf_dir)
    return g.similarity_cdfs(g.probabilities()).select("class", F.posexplode("values").alias("pos", "v")).select("class", "pos", r6("v"))


@query
def effective_sample_size(spark, sf_dir):
    return Geo(spark, sf_dir).sizes().select("row_idx", F.get("n", 0).alias("n0"), F.get("n", 1).alias("n1"))


@query
def dkw_band(spark, sf_dir):
    e = scores.dkw_errors(F.col("n"), 0.9)
    rows = Geo(spark, sf_dir).sizes().withColumn("e", e).withColumn("b", scores.distance_band(F.col("d"), F.col("e")))
    return rows.select("row_idx", F.round(F.array_max("e"), 6).alias("error"), F.round("b.lower", 6).alias("d_lower"), F.round("b.upper", 6).alias("d_upper"))


@query
def nested_regions(spark, sf_dir):
    g = Geo(spark, sf_dir)
    found = calibration.regions_frame(spark, g.regions(g.probabilities()))
    return found.select("ord", r6("alpha"), r6("q_min"), F.round(F.get("thresholds", 0), 6).alias("t0"), F.round(F.get("thresholds", 1), 6).alias("t1"))


@query
def alpha_rung_candidate(spark, sf_dir):
    """The first region of the ladder."""
    return nested_regions(spark, sf_dir).where("ord = 0").drop("ord")


@query
def region_assignment(spark, sf_dir):
    return Geo(spark, sf_dir).scored().select("row_idx", r6("centroid_alpha"))


@query
def lower_region_assignment(spark, sf_dir):
    return Geo(spark, sf_dir).scored().select("row_idx", r6("lower_alpha"), r6("d_lower"), r6("d_upper"), r6("q_prime_lower"))


@query
def policy_decisions(spark, sf_dir):
    d = scores.decision(F.col("centroid_alpha"), F.col("q_prime"), 0.9)
    return Geo(spark, sf_dir).scored().withColumn("d_", d).select("row_idx", F.col("d_.action").alias("action"), F.col("d_.reason").alias("reason"))


@query
def evaluate_conditional_cells(spark, sf_dir):
    c = evaluation.cells(Geo(spark, sf_dir).scored(), CLASSES)
    return c.select("kind", F.coalesce("class", F.lit(-1)).alias("class"), "n", "correct", r6("accuracy"))


@query
def evaluate_minima(spark, sf_dir):
    c = evaluation.conditional_minima(evaluation.cells(Geo(spark, sf_dir).scored(), CLASSES))
    return c.select("kind", r6("minimum"), r6("complete_minimum"))


@query
def evaluate_overall(spark, sf_dir):
    return evaluation.totals(Geo(spark, sf_dir).scored(), CLASSES)


@query
def evaluate_cumulative_admission(spark, sf_dir):
    c = evaluation.cumulative(Geo(spark, sf_dir).scored(), CLASSES)
    return c.select("estimator", r6("alpha"), "known", "admitted", r6("admission"), "correct", r6("accuracy"))


@query
def evaluate_rejected(spark, sf_dir):
    return evaluation.rejected(Geo(spark, sf_dir).scored(), CLASSES)


@query
def balanced_accuracy(spark, sf_dir):
    right = (F.col("label") == F.col("prediction")).cast("double")
    return evaluation.balanced_mean(Geo(spark, sf_dir).rows.where("part > 0"), right, CLASSES).select(F.round("value", 6).alias("balanced_accuracy"))


@query
def balanced_loss(spark, sf_dir):
    """Log-loss to the base 2 + q, averaged within each class, then over classes."""
    p = Geo(spark, sf_dir).probabilities()
    loss = -F.log(F.greatest(F.get("sdm", F.col("label")), F.lit(1e-300))) / F.log(2.0 + F.col("q"))
    return evaluation.balanced_mean(p, loss, CLASSES).select(F.round("value", 6).alias("balanced_loss"))


@query
def signal_quantiles(spark, sf_dir):
    q = evaluation.quantiles(evaluation.signals(Geo(spark, sf_dir).scored()))
    each = [F.round(F.get("quantiles", i), 6).alias(f"p{int(x * 100):02d}") for i, x in enumerate(evaluation.QUANTILES)]
    return q.select("signal", "n", r6("least"), r6("most"), r6("mean"), *each)


@query
def signal_histogram(spark, sf_dir):
    h = evaluation.histogram(evaluation.signals(Geo(spark, sf_dir).scored()).where("signal in ('q', 'd', 'centroid_alpha', 'd0')"), 10)
    return h.select("signal", "bin", r6("lo"), r6("hi"), "n")


@query
def prediction_frequencies(spark, sf_dir):
    return evaluation.prediction_frequencies(Geo(spark, sf_dir).scored(), CLASSES).select("prediction", "n", r6("share"))


@query
def dataset_inspect(spark, sf_dir):
    return datasets.label_histogram(datasets.labelled_documents(spark, sf_dir))


@query
def unlabeled_sentinels(spark, sf_dir):
    return evaluation.totals(datasets.labelled_documents(spark, sf_dir).withColumn("prediction", F.lit(0)), 2)


@query
def dimension_validation(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("id"), "label", "embedding")
    return datasets.validation(rows)


@query
def pool_split_membership(spark, sf_dir):
    return datasets.split(datasets.labelled_documents(spark, sf_dir).where("label >= 0"), 7).select("id", "pool_index", "selected_split", "selected_index")


@query
def source_membership_export(spark, sf_dir):
    rows = datasets.labelled_documents(spark, sf_dir)
    members = datasets.split(rows.where("label >= 0"), 7)
    out = datasets.export(rows, members, "calibration")
    return out.select("selected_index", "id", "label", F.length("document").cast("long").alias("n_chars"))


@query
def id_disjointness(spark, sf_dir):
    members = datasets.split(datasets.labelled_documents(spark, sf_dir).where("label >= 0"), 7)
    return datasets.overlap(members.where("selected_split = 'training'"), members.where("selected_split = 'calibration'"))


@query
def feature_digest(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select("vec_id", features.feature_digest("embedding").alias("digest"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return dict(ORACLES)
