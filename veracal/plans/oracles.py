"""The same queries in SQL, built from shared common table expressions.

They follow the definitions independently of the Spark code: explicit sums, counted ranks and one block of expressions for
each alpha of the ladder."""

from __future__ import annotations

from ..functions.scores import ladder
from .tasks import K, RESOLUTION

_X = range(1, 5)


def _dot(a: str, b: str) -> str:
    return " + ".join(f"{a}{i} * {b}{i}" for i in _X)


_ROWS = f"""
f AS (SELECT vec_id AS row_idx, vec_id % 3 AS part, {", ".join(f"embedding[{i}]::DOUBLE * 8 AS x{i}" for i in _X)},
             (embedding[1]::DOUBLE + embedding[2]::DOUBLE > 0)::INT AS label FROM embeddings),
mu AS (SELECT label, {", ".join(f"round(avg(x{i}), 9) AS m{i}" for i in _X)} FROM f WHERE part = 0 GROUP BY label),
p AS (SELECT f.*, 2 * ({_dot("f.x", "a.m")}) - ({_dot("a.m", "a.m")}) AS z0, 2 * ({_dot("f.x", "b.m")}) - ({_dot("b.m", "b.m")}) AS z1
      FROM f, (SELECT * FROM mu WHERE label = 0) a, (SELECT * FROM mu WHERE label = 1) b),
pr AS (SELECT *, CASE WHEN z0 >= z1 THEN 0 ELSE 1 END AS prediction FROM p),
sp AS (SELECT row_idx // 3 AS support_idx, label, prediction AS predicted_label, x1, x2, x3, x4 FROM pr WHERE part = 0)"""


def _knn(where: str, exclude: bool = False) -> str:
    d2 = " + ".join(f"(q.x{i} - s.x{i}) * (q.x{i} - s.x{i})" for i in _X)
    own = " AND s.support_idx <> q.row_idx // 3" if exclude else ""
    return f"""
n AS (SELECT q.row_idx, q.prediction, s.support_idx, s.label, s.predicted_label, {d2} AS d2,
             row_number() OVER (PARTITION BY q.row_idx ORDER BY {d2}, s.support_idx) AS rank
      FROM pr q, sp s WHERE {where}{own} QUALIFY rank <= {K - exclude})"""


_SIGNALS = f"""{_ROWS},{_knn("q.part > 0")},
g AS (SELECT row_idx, min(CASE WHEN label <> predicted_label OR predicted_label <> prediction THEN rank END) AS stop, count(*) AS n,
             min_by(d2, rank) AS d0, min_by(support_idx, rank) AS nearest FROM n GROUP BY row_idx),
si AS (SELECT pr.*, coalesce(stop - 1, n)::INT AS q, greatest(d0, 0) AS d0, nearest FROM pr JOIN g USING (row_idx)),
dc AS (SELECT label, d0 AS v FROM si WHERE part = 1 AND q > 0)"""


def _below(c: int) -> str:
    return f"(SELECT count(*) FROM dc WHERE label = {c} AND v < si.d0)::DOUBLE / (SELECT count(*) FROM dc WHERE label = {c})"


_PROBABILITIES = f"""{_SIGNALS},
dq AS (SELECT *, CASE WHEN (SELECT count(DISTINCT label) FROM dc) < 2 THEN 0.0::DOUBLE ELSE least(1 - {_below(0)}, 1 - {_below(1)}) END AS d FROM si),
ex AS (SELECT *, exp((z0 - greatest(z0, z1)) * (d * ln(2.0::DOUBLE + q))) AS e0, exp((z1 - greatest(z0, z1)) * (d * ln(2.0::DOUBLE + q))) AS e1 FROM dq),
sm AS (SELECT *, e0 / (e0 + e1) AS p0, e1 / (e0 + e1) AS p1 FROM ex),
pb AS (SELECT *, least(q::DOUBLE, pow(2.0::DOUBLE + q, CASE prediction WHEN 0 THEN p0 ELSE p1 END)) AS qp FROM sm)"""

_SIZES = f"""{_PROBABILITIES},
sc AS (SELECT label, qp AS v FROM pb WHERE part = 1),
sz AS (SELECT *, (SELECT count(*) FROM sc WHERE label = 0 AND v <= pb.qp) AS n0, (SELECT count(*) FROM sc WHERE label = 1 AND v <= pb.qp) AS n1 FROM pb)"""


def _admits(a: str, p0: str, p1: str, qp: str, r: str) -> str:
    reach = f"(({p0})::FLOAT >= {r}.t0)::INT + (({p1})::FLOAT >= {r}.t1)::INT = 1"
    mine = f"CASE {a}.prediction WHEN 0 THEN ({p0})::FLOAT >= {r}.t0 ELSE ({p1})::FLOAT >= {r}.t1 END"
    return f"(floor({qp}) > 0 AND ({qp})::FLOAT >= {r}.q_min AND {reach} AND {mine})"


def _ladder(resolution: float = RESOLUTION) -> str:
    """For each alpha: the cutoff and thresholds among the rows left, as r0, r1, ..; then the rows left after it."""
    out = [
        f"{_SIZES}",
        "l0 AS (SELECT row_idx, label, prediction, p0::FLOAT AS p0, p1::FLOAT AS p1, qp::FLOAT AS qp,"
        " (CASE label WHEN 0 THEN p0 ELSE p1 END)::FLOAT AS own FROM pb WHERE part = 1 AND floor(qp::FLOAT) > 0)",
    ]
    for i, alpha in enumerate(ladder(resolution)):
        tail = round(1 - alpha, 10)
        out.append(
            f"c{i} AS (SELECT min(qp) AS cut FROM (SELECT a.qp, count(*) FILTER (b.label = 0) AS k0, count(*) FILTER (b.label = 1) AS k1,"
            f" count(*) FILTER (b.label = 0 AND b.own < {alpha}::FLOAT) AS m0, count(*) FILTER (b.label = 1 AND b.own < {alpha}::FLOAT) AS m1"
            f" FROM (SELECT DISTINCT qp FROM l{i}) a JOIN l{i} b ON b.qp >= a.qp GROUP BY a.qp)"
            f" WHERE k0 > 0 AND k1 > 0 AND m0 <= floor({tail}::DOUBLE * k0) AND m1 <= floor({tail}::DOUBLE * k1))"
        )
        out.append(
            f"t{i} AS (SELECT label, list(own ORDER BY own) AS v FROM l{i}, c{i} WHERE qp >= cut GROUP BY label)"
        )
        pick = lambda c: f"(SELECT greatest(v[least(floor({tail}::DOUBLE * len(v)), len(v) - 1)::INT + 1], 0) FROM t{i} WHERE label = {c})"  # noqa: E731,B023
        out.append(f"r{i} AS (SELECT {i} AS rung, {alpha}::DOUBLE AS alpha, cut AS q_min, {pick(0)} AS t0, {pick(1)} AS t1 FROM c{i} WHERE cut IS NOT NULL)")
        out.append(f"l{i + 1} AS (SELECT x.* FROM l{i} x LEFT JOIN r{i} r ON true WHERE r.alpha IS NULL OR NOT {_admits('x', 'x.p0', 'x.p1', 'x.qp', 'r')})")
    union = " UNION ALL ".join(f"SELECT * FROM r{i}" for i in range(len(ladder(resolution))))
    out.append(f"rg AS (SELECT row_number() OVER (ORDER BY alpha DESC) - 1 AS ord, * FROM ({union}))")
    return ",\n".join(out)


def _scored() -> str:
    low = "greatest(s.d - e, 0)"
    e = "greatest(CASE WHEN n0 > 0 THEN sqrt(ln(2 / (1 - r.alpha)) / (2 * n0)) ELSE 1 END, CASE WHEN n1 > 0 THEN sqrt(ln(2 / (1 - r.alpha)) / (2 * n1)) ELSE 1 END)"
    return f"""{_ladder()},
qs AS (SELECT * FROM sz WHERE part = 2),
ca AS (SELECT s.row_idx, coalesce(max(r.alpha), 0) AS centroid_alpha FROM qs s LEFT JOIN rg r ON {_admits("s", "s.p0", "s.p1", "s.qp", "r")} GROUP BY s.row_idx),
lb AS (SELECT s.*, r.alpha, r.q_min, r.t0, r.t1, {e} AS e FROM qs s, rg r),
lx AS (SELECT *, {low.replace("s.", "")} AS dl, least(d + e, 1) AS du FROM lb),
le AS (SELECT *, exp((z0 - greatest(z0, z1)) * (dl * ln(2.0::DOUBLE + q))) AS f0, exp((z1 - greatest(z0, z1)) * (dl * ln(2.0::DOUBLE + q))) AS f1 FROM lx),
lp AS (SELECT *, f0 / (f0 + f1) AS w0, f1 / (f0 + f1) AS w1 FROM le),
lq AS (SELECT *, least(q::DOUBLE, pow(2.0::DOUBLE + q, CASE prediction WHEN 0 THEN w0 ELSE w1 END)) AS ql FROM lp),
la AS (SELECT row_idx, max(alpha) AS lower_alpha, max_by(dl, alpha) AS dl, max_by(du, alpha) AS du, max_by(ql, alpha) AS ql
       FROM lq WHERE {_admits("lq", "w0", "w1", "ql", "lq")} GROUP BY row_idx),
zz AS (SELECT s.*, centroid_alpha, coalesce(lower_alpha, 0) AS lower_alpha, coalesce(dl, 0) AS d_lower, coalesce(du, 1) AS d_upper,
              coalesce(ql, least(q::DOUBLE, pow(2.0::DOUBLE + q, 0.5::DOUBLE))) AS q_prime_lower
       FROM qs s JOIN ca USING (row_idx) LEFT JOIN la USING (row_idx))"""


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


_SCORED = _scored()
_CELLS = """,
ce AS (SELECT 'marginal' AS kind, -1 AS class, count(*) AS n, count(*) FILTER (label = prediction) AS correct FROM zz
       UNION ALL SELECT 'label', c, count(z.row_idx), count(*) FILTER (z.label = z.prediction) FROM (VALUES (0), (1)) v(c) LEFT JOIN zz z ON z.label = c GROUP BY c
       UNION ALL SELECT 'prediction', c, count(z.row_idx), count(*) FILTER (z.label = z.prediction) FROM (VALUES (0), (1)) v(c) LEFT JOIN zz z ON z.prediction = c GROUP BY c)"""
_LONG = """,
sg AS (SELECT unnest(['predicted_logit', 'logit_margin', 'predicted_sdm', 'q', 'q_prime', 'd', 'd0', 'centroid_alpha', 'lower_alpha']) AS signal,
              unnest([CASE prediction WHEN 0 THEN z0 ELSE z1 END, greatest(z0, z1) - least(z0, z1), CASE prediction WHEN 0 THEN p0 ELSE p1 END,
                      q::DOUBLE, qp, d, d0, centroid_alpha, lower_alpha]) AS v FROM zz)"""
_DOCS = """ld AS (SELECT d.doc_id::VARCHAR AS id, coalesce(l.quality, -1) AS label, d.text AS document FROM documents d LEFT JOIN labels l USING (doc_id))"""
_SPLIT = f"""{_DOCS},
dr AS (SELECT id, label, row_number() OVER (ORDER BY md5('7:' || id), id) - 1 AS k, row_number() OVER (ORDER BY length(id), id) - 1 AS pool_index FROM ld WHERE label >= 0),
mb AS (SELECT id, label, pool_index, CASE WHEN k < h THEN 'training' ELSE 'calibration' END AS selected_split, CASE WHEN k < h THEN k ELSE k - h END AS selected_index
       FROM dr, (SELECT count(*) // 2 AS h FROM dr))"""

_SQUARES = "list_sum([(q.embedding[i]::DOUBLE - s.embedding[i]::DOUBLE) * (q.embedding[i]::DOUBLE - s.embedding[i]::DOUBLE) for i in range(1, 65)])"


def _whole_knn(excluded: str) -> str:
    """All rows against all rows; rows that meet the condition are left out of their own lists."""
    return f"""SELECT row_idx, rank, support_idx, round(d2, 6) AS d2 FROM (
  SELECT *, row_number() OVER (PARTITION BY row_idx ORDER BY d2, support_idx) AS rank FROM (
    SELECT q.vec_id AS row_idx, s.vec_id AS support_idx, {_SQUARES} AS d2, ({excluded}) AS own FROM embeddings q, embeddings s
    WHERE NOT (({excluded}) AND q.vec_id = s.vec_id))) WHERE rank <= {K} - own::INT"""


def _weight(j: int) -> str:
    return f"list_sum([((i - 1 + {j}) % 5 - 2) / 4.0::DOUBLE * (embedding[i]::DOUBLE - 0.5) / 2.0 for i in range(1, 65)])"


ORACLES: dict[str, str] = {
    "knn_topk": _whole_knn("false"),
    "knn_topk_arrow": _whole_knn("false"),
    "knn_self_excluded": _whole_knn("true"),
    "knn_mixed_exclusion": _whole_knn("q.vec_id % 2 = 0"),
    "nearest_matches": _with(_ROWS + "," + _knn("q.part = 2"), "SELECT row_idx, rank, support_idx, (support_idx * 3)::VARCHAR AS id, label, predicted_label, round(d2, 6) AS d2 FROM n WHERE rank <= 3"),
    "global_normalization": "SELECT round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, count(*) AS n FROM (SELECT unnest(embedding)::DOUBLE AS v FROM embeddings)",
    "feature_composition": "SELECT vec_id, (len(embedding) + CASE WHEN vec_id % 2 = 0 THEN 1 ELSE 0 END)::INT AS n, round(embedding[1]::DOUBLE, 6) AS first, round(CASE WHEN vec_id % 2 = 0 THEN label::DOUBLE ELSE embedding[len(embedding)]::DOUBLE END, 6) AS last FROM embeddings",
    "adaptor_projection": f"WITH e AS (SELECT vec_id, {_weight(0)} + 0.1 AS e0, {_weight(1)} - 0.2 AS e1, {_weight(2)} + 0.3 AS e2 FROM embeddings) SELECT vec_id, round(e0, 6) AS e0, round(e1, 6) AS e1, round(e2, 6) AS e2, round(e0 - 0.5 * e1 + 0.25 * e2, 6) AS z0, round(0.5 * e0 + e1 - e2 + 0.125, 6) AS z1 FROM e",
    "pooled_rows": _with(_ROWS, "SELECT row_number() OVER (ORDER BY part, row_idx) - 1 AS pool_index, row_idx, part, label FROM f WHERE part < 2"),
    "class_coverage": "SELECT c::INT AS missing FROM range(12) t(c) WHERE c NOT IN (SELECT label FROM embeddings)",
    "recalibrated_regions": _with(_ladder(0.1), "SELECT ord, round(alpha, 6) AS alpha, round(q_min::DOUBLE, 6) AS q_min, round(t0::DOUBLE, 6) AS t0, round(t1::DOUBLE, 6) AS t1 FROM rg"),
    "score_flagship": _with(_SCORED, "SELECT row_idx AS vec_id, prediction, q, round(d0, 6) AS d0, round(d, 6) AS d, round(qp, 6) AS q_prime, round(centroid_alpha, 6) AS centroid_alpha, round(lower_alpha, 6) AS lower_alpha FROM zz"),
    "similarity_q": _with(_SIGNALS, "SELECT row_idx, q FROM si"),
    "nearest_distance_d0": _with(_SIGNALS, "SELECT row_idx, round(d0, 6) AS d0, nearest FROM si"),
    "class_centroid_logits": _with(_ROWS, "SELECT row_idx, round(z0, 6) AS z0, round(z1, 6) AS z1 FROM pr"),
    "argmax_prediction": _with(_ROWS, "SELECT row_idx, label, prediction FROM pr"),
    "distance_cdf": _with(_SIGNALS, "SELECT label AS class, row_number() OVER (PARTITION BY label ORDER BY v) - 1 AS pos, round(v, 6) AS v FROM dc"),
    "distance_quantile": _with(_PROBABILITIES, "SELECT row_idx, round(d, 6) AS d FROM pb"),
    "distance_quantile_ranked": _with(_PROBABILITIES, "SELECT row_idx, round(d, 6) AS d FROM pb"),
    "sdm_probability": _with(_PROBABILITIES, "SELECT row_idx, round(p0, 6) AS p0, round(p1, 6) AS p1 FROM pb"),
    "rescaled_similarity": _with(_PROBABILITIES, "SELECT row_idx, round(qp, 6) AS q_prime FROM pb"),
    "qprime_cdf": _with(_SIZES, "SELECT label AS class, row_number() OVER (PARTITION BY label ORDER BY v) - 1 AS pos, round(v, 6) AS v FROM sc"),
    "effective_sample_size": _with(_SIZES, "SELECT row_idx, n0, n1 FROM sz"),
    "dkw_band": _with(_SIZES + ", eb AS (SELECT *, greatest(CASE WHEN n0 > 0 THEN sqrt(ln(2 / (1 - 0.9::DOUBLE)) / (2 * n0)) ELSE 1 END, CASE WHEN n1 > 0 THEN sqrt(ln(2 / (1 - 0.9::DOUBLE)) / (2 * n1)) ELSE 1 END) AS e FROM sz)", "SELECT row_idx, round(e, 6) AS error, round(greatest(d - e, 0), 6) AS d_lower, round(least(d + e, 1), 6) AS d_upper FROM eb"),
    "nested_regions": _with(_ladder(), "SELECT ord, round(alpha, 6) AS alpha, round(q_min::DOUBLE, 6) AS q_min, round(t0::DOUBLE, 6) AS t0, round(t1::DOUBLE, 6) AS t1 FROM rg"),
    "alpha_rung_candidate": _with(_ladder(), "SELECT round(alpha, 6) AS alpha, round(q_min::DOUBLE, 6) AS q_min, round(t0::DOUBLE, 6) AS t0, round(t1::DOUBLE, 6) AS t1 FROM rg WHERE ord = 0"),
    "region_assignment": _with(_SCORED, "SELECT row_idx, round(centroid_alpha, 6) AS centroid_alpha FROM zz"),
    "lower_region_assignment": _with(_SCORED, "SELECT row_idx, round(lower_alpha, 6) AS lower_alpha, round(d_lower, 6) AS d_lower, round(d_upper, 6) AS d_upper, round(q_prime_lower, 6) AS q_prime_lower FROM zz"),
    "policy_decisions": _with(_SCORED, "SELECT row_idx, CASE WHEN reason = 'accepted' THEN 'allow' ELSE 'review' END AS action, reason FROM (SELECT row_idx, CASE WHEN floor(qp) <= 0 THEN 'zero-similarity' WHEN centroid_alpha = 0 THEN 'no-calibrated-region' WHEN centroid_alpha < 0.9 THEN 'below-required-alpha' ELSE 'accepted' END AS reason FROM zz)"),
    "evaluate_conditional_cells": _with(_SCORED + _CELLS, "SELECT kind, class, n, correct, round(CASE WHEN n > 0 THEN correct / n END, 6) AS accuracy FROM ce"),
    "evaluate_minima": _with(_SCORED + _CELLS, "SELECT kind, round(min(a), 6) AS minimum, round(CASE WHEN bool_and(n > 0) THEN min(a) END, 6) AS complete_minimum FROM (SELECT *, CASE WHEN n > 0 THEN correct / n END AS a FROM ce WHERE kind <> 'marginal') GROUP BY kind"),
    "evaluate_overall": _with(_ROWS, "SELECT count(*) AS total, count(*) FILTER (label IN (0, 1)) AS known, count(*) FILTER (label = -1) AS unlabelled, count(*) FILTER (label = -99) AS outside FROM f WHERE part = 2"),
    "evaluate_cumulative_admission": _with(_SCORED + """,
lo AS (SELECT 'centroid' AS estimator, centroid_alpha AS a, label = prediction AS ok FROM zz UNION ALL SELECT 'lower', lower_alpha, label = prediction FROM zz),
lv AS (SELECT DISTINCT a AS alpha FROM lo WHERE a > 0)""", "SELECT estimator, round(alpha, 6) AS alpha, count(*) AS known, count(*) FILTER (a >= alpha) AS admitted, round(count(*) FILTER (a >= alpha) / count(*), 6) AS admission, count(*) FILTER (ok AND a >= alpha) AS correct, round(CASE WHEN count(*) FILTER (a >= alpha) > 0 THEN count(*) FILTER (ok AND a >= alpha) / count(*) FILTER (a >= alpha) END, 6) AS accuracy FROM lo, lv GROUP BY estimator, alpha"),
    "evaluate_rejected": _with(_SCORED, "SELECT 'centroid' AS estimator, count(*) AS n, count(*) FILTER (label = prediction) AS correct FROM zz WHERE centroid_alpha = 0 UNION ALL SELECT 'lower', count(*), count(*) FILTER (label = prediction) FROM zz WHERE lower_alpha = 0"),
    "balanced_accuracy": _with(_ROWS, "SELECT round(avg(m), 6) AS balanced_accuracy FROM (SELECT avg((label = prediction)::INT) AS m FROM pr WHERE part > 0 GROUP BY label)"),
    "balanced_loss": _with(_PROBABILITIES, "SELECT round(avg(m), 6) AS balanced_loss FROM (SELECT avg(-ln(greatest(CASE label WHEN 0 THEN p0 ELSE p1 END, 1e-300::DOUBLE)) / ln(2.0::DOUBLE + q)) AS m FROM pb GROUP BY label)"),
    "signal_quantiles": _with(_SCORED + _LONG, "SELECT signal, count(v) AS n, round(min(v), 6) AS least, round(max(v), 6) AS most, round(avg(v), 6) AS mean, " + ", ".join(f"round(quantile_cont(v, {x}), 6) AS p{int(x * 100):02d}" for x in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) + " FROM sg GROUP BY signal"),
    "signal_histogram": _with(_SCORED + _LONG + """,
en AS (SELECT signal, min(v) AS lo, max(v) AS hi FROM sg WHERE signal IN ('q', 'd', 'centroid_alpha', 'd0') GROUP BY signal),
gr AS (SELECT en.*, b FROM en, range(10) t(b) WHERE hi > lo OR b = 0),
hc AS (SELECT signal, CASE WHEN hi > lo THEN least(floor((v - lo) / ((hi - lo) / 10)), 9) ELSE 0 END::INT AS b, count(*) AS n FROM sg JOIN en USING (signal) GROUP BY ALL)""", "SELECT gr.signal, gr.b::INT AS bin, round(CASE WHEN hi = lo THEN lo - 0.5 ELSE lo + gr.b * ((hi - lo) / 10) END, 6) AS lo, round(CASE WHEN hi = lo THEN lo + 0.5 WHEN gr.b = 9 THEN hi ELSE lo + (gr.b + 1) * ((hi - lo) / 10) END, 6) AS hi, coalesce(n, 0) AS n FROM gr LEFT JOIN hc ON gr.signal = hc.signal AND gr.b = hc.b"),
    "prediction_frequencies": _with(_ROWS, "SELECT c AS prediction, count(x.row_idx) AS n, round(count(x.row_idx) / (SELECT count(*) FROM pr WHERE part = 2), 6) AS share FROM (VALUES (0), (1)) v(c) LEFT JOIN (SELECT * FROM pr WHERE part = 2) x ON x.prediction = c GROUP BY c"),
    "dataset_inspect": _with(_DOCS, "SELECT label, count(*) AS n, count(document) AS n_documents FROM ld GROUP BY label"),
    "unlabeled_sentinels": _with(_DOCS, "SELECT count(*) AS total, count(*) FILTER (label IN (0, 1)) AS known, count(*) FILTER (label = -1) AS unlabelled, count(*) FILTER (label = -99) AS outside FROM ld"),
    "dimension_validation": "SELECT count(*) AS n, count(DISTINCT vec_id) AS n_ids, 0::BIGINT AS empty_ids, count(*) FILTER (label < 0 AND label NOT IN (-1, -99)) AS bad_labels, min(len(embedding)) AS least_dimension, max(len(embedding)) AS most_dimension, count(*) FILTER (list_contains(embedding, 'nan'::FLOAT) OR list_contains(embedding, 'inf'::FLOAT)) AS not_finite FROM embeddings",
    "pool_split_membership": _with(_SPLIT, "SELECT id, pool_index, selected_split, selected_index FROM mb"),
    "source_membership_export": _with(_SPLIT, "SELECT selected_index, mb.id, mb.label, length(document) AS n_chars FROM mb JOIN ld USING (id) WHERE selected_split = 'calibration'"),
    "id_disjointness": _with(_SPLIT, "SELECT count(*) AS shared FROM mb a JOIN mb b USING (id) WHERE a.selected_split = 'training' AND b.selected_split = 'calibration'"),
}
