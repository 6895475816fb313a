"""DuckDB SQL for the queries that SQL can express."""

#: Words of a text: runs of characters other than ASCII white space.
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

MIXING = rf"""
WITH d AS (SELECT doc_id, source, len({WORDS}) AS size, md5(coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM d GROUP BY source),
r AS (SELECT *, 3.0::DOUBLE * source_size / weight AS ratio FROM s),
l AS (SELECT *, ((SELECT sum(source_size) FROM s) - coalesce(sum(3.0::DOUBLE * source_size) OVER b, 0)) / sum(weight) OVER a AS lev
      FROM r WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                    a AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
h AS (SELECT arg_min(lev, ratio) AS hold FROM l WHERE lev <= ratio),
t AS (SELECT source, source_size, weight, least(3.0::DOUBLE * source_size, coalesce(hold * weight, 3.0::DOUBLE * source_size)) AS target FROM r, h),
p AS (SELECT d.*, t.source_size, t.weight, t.target,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c0
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
g AS (SELECT *, (greatest(0, least(size, round(target)::BIGINT - c0)) + greatest(0, least(size, round(target)::BIGINT - source_size - c0))
              + greatest(0, least(size, round(target)::BIGINT - 2 * source_size - c0)))::BIGINT AS taken,
             CASE WHEN target > 0 THEN c0 / target ELSE 0 END AS y FROM p)
SELECT doc_id, size, source_size::BIGINT AS source_size, round(target, 3) AS target, taken,
       CASE WHEN taken > 0 THEN round(CASE weight
              WHEN 5 THEN 2 * y / (1.5 + sqrt(greatest(2.25 - 2 * y, 0)))
              WHEN 2 THEN y
              ELSE CASE WHEN y <= 0.3125 THEN 2 * y / (0.5 + sqrt(0.25 + y))
                        ELSE 0.5 + 2 * (y - 0.3125) / (0.75 + sqrt(0.5625 + 5 * (y - 0.3125))) END END, 6) END AS position
FROM g
"""

#: The words of every document, with places from 1.
PLACED = rf"""
w AS (SELECT doc_id, {WORDS} AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w WHERE len(w) > 0)"""


def _quality() -> str:
    """Base statistics, levels of the grid, exact binomial tests and the verdict; constants come from the operator."""
    from . import quality as q

    grid = ", ".join(f"({m}, {i}, {c}::DOUBLE)" for m, name in enumerate(q.METRICS) for i, c in enumerate(q.grid(name)))
    names = ", ".join(f"'{m}'" for m in q.METRICS)
    p = q.RISK / len(q.METRICS)
    return rf"""
WITH {PLACED},
n AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(list_distinct(w)) AS n_distinct FROM w),
t AS (SELECT doc_id, p.i, concat_ws(' ', word, lead(word) OVER o, lead(word, 2) OVER o) AS win, lead(word, 2) OVER o AS last FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS c FROM t WHERE last IS NOT NULL) WHERE c > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, range(3) x(k) GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x FROM documents),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines FROM ln WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
b AS (SELECT d.doc_id, coalesce(d.lang, '') AS s, n_words, word_chars, n_distinct, length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS n_symbols,
             coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM documents d JOIN n USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id)),
f AS (SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM b),
v AS (SELECT doc_id, s, base_failed, unnest([0, 1, 2, 3, 4, 5]) AS m, unnest([
        CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END, CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END,
        CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END,
        CASE WHEN word_chars > 0 THEN n_words / word_chars ELSE 0 END, CASE WHEN n_words > 0 THEN 1 - n_distinct / n_words ELSE 0 END]) AS x FROM f),
g AS (SELECT * FROM (VALUES {grid}) y(m, step, cut)),
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
h AS (SELECT v.* FROM v JOIN good USING (doc_id) WHERE NOT base_failed),
k AS (SELECT s, g.m, step, cut, count(*) AS n, count(*) FILTER (x > cut) AS k FROM h JOIN g ON g.m = h.m GROUP BY s, g.m, step, cut),
e AS (SELECT *, CASE WHEN k > n * {p} THEN 1 ELSE (SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({p}) + (n - j) * ln(1 - {p}))) FROM range(k + 1) z(j)) END AS cdf FROM k),
o AS (SELECT *, cdf <= {q.DELTA} / ((SELECT count(DISTINCT s) FROM h) * {len(q.METRICS)}) AS ok FROM e),
u AS (SELECT s, m, coalesce(min(step) FILTER (NOT ok), {q.STEPS}) AS stop FROM o GROUP BY s, m),
z AS (SELECT u.s, u.m, cut FROM u JOIN g ON g.m = u.m AND g.step = u.stop - 1),
y AS (SELECT doc_id, string_agg([{names}][v.m + 1], ',' ORDER BY v.m) AS why FROM v JOIN z ON v.s = z.s AND v.m = z.m AND x > cut GROUP BY doc_id)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND why IS NULL AS kept, coalesce(why, '') AS rejected_by
FROM f LEFT JOIN y USING (doc_id)
"""


SUBSTRINGS = rf"""
WITH {PLACED},
v AS (SELECT p.doc_id, i, array_to_string(w[i:i + 34], ' ') AS win FROM p JOIN w USING (doc_id) WHERE i + 34 <= len(w)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY win) AS c FROM v) WHERE c > 1),
g AS (SELECT DISTINCT doc_id, i + k AS i FROM r, range(35) x(k)),
k AS (SELECT p.doc_id, count(*) FILTER (g.i IS NOT NULL) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY p.i) FILTER (g.i IS NULL), '') AS kept
      FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.i = g.i GROUP BY p.doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""

NEAR_DUPLICATES = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i, len(w) AS n FROM w WHERE len(w) > 0),
q AS (SELECT DISTINCT doc_id, CASE WHEN n = 1 THEN word ELSE word || ' ' || after END AS x
      FROM (SELECT *, lead(word) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM p) WHERE n = 1 OR after IS NOT NULL),
z AS (SELECT doc_id, count(*) AS n FROM q GROUP BY doc_id),
l AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM q a JOIN q b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM l JOIN z a ON a.doc_id = u JOIN z b ON b.doc_id = v WHERE 100 * k >= 80 * (a.n + b.n - k)),
b AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
t AS (SELECT u, v FROM b UNION SELECT t.u, b.v FROM t JOIN b ON t.v = b.u)
SELECT w.doc_id, coalesce(z.n, 0) AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id, w.doc_id <= coalesce(m, w.doc_id) AS kept
FROM w LEFT JOIN z USING (doc_id) LEFT JOIN (SELECT u AS doc_id, min(v) AS m FROM t GROUP BY u) USING (doc_id)
"""

ORACLES: dict[str, str] = {"op1_quality": _quality(), "op4_substrings": SUBSTRINGS, "op8_mixing": MIXING, "op9_near_duplicates": NEAR_DUPLICATES}
