"""Exact k-nearest-neighbour join by squared Euclidean distance, ties by the lower support index; and ``signals``, which needs
no more of the k neighbours than their leading run and returns that with each query, without a shuffle.

Two strategies give the same rows: ``sql`` adds squared differences up component by component (batch-invariant, comparable with
other engines); ``arrow`` multiplies blocks of queries with tiles of the support in numpy.  Both run in numpy and return the k
rows of each query only, so no table of pairs is sorted or written.  ``sql`` finds the rows that may be among the k first: of up
to ``BOX_DIMENSIONS`` components by boxes of the support that are near a block of queries, of more by products with their bound
of error.  Of equal support vectors the k least indexes are kept, the others can be in no list.  Vectors that are null, hold
nulls or no numbers, or differ in length are compared in the JVM, as SQL orders them.

The support is cut into tiles; a support of at most ``BROADCAST_BYTES`` (counted first) is sent to all tasks as one table, a
larger one is dealt tile by tile to blocks of queries, and the partial results of the tiles are merged by rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 << 20
TILE = 16_384
QUERY_BLOCK = 4_096
#: Components up to which the support is divided into boxes, rows of a box, queries that look for boxes together, and queries
#: that are put in order at once.
BOX_DIMENSIONS, BOX, NEAR_QUERIES, HELD = 8, 256, 64, 65_536
#: Absolute values from which squares are left to the JVM.
HUGE = 1e150


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def _plain(vector: str, size: int) -> Column:
    """Whether a vector has so many components and all are numbers."""
    v = F.col(vector)
    return F.coalesce((F.size(v) == size) & F.forall(v, lambda x: F.coalesce(F.abs(x) < HUGE, F.lit(False))), F.lit(False))


def _most(support: DataFrame, vector: str) -> tuple[int, int]:
    """(rows, most components)."""
    r = support.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("m")).first()
    return int(r["n"]), max(0, int(r["m"] or 0))


def _bytes(support: DataFrame, vector: str) -> int:
    n, m = _most(support, vector)
    return n * m * 8


def top_k(d2: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the k least distances with their ids, ordered by both; equal ones at the edge are settled by id."""
    n = d2.shape[1]
    if n > k:
        edge = np.partition(d2, k - 1, axis=1)[:, k - 1 : k]
        out_d, out_i = np.empty((len(d2), k)), np.empty((len(d2), k), np.int64)
        for r in range(len(d2)):
            at = np.flatnonzero(d2[r] <= edge[r])
            order = at[np.lexsort((ids[at], d2[r, at]))[:k]]
            out_d[r], out_i[r] = d2[r, order], ids[order]
        return out_d, out_i
    order = np.lexsort((np.broadcast_to(ids, d2.shape), d2), axis=1)
    return np.take_along_axis(d2, order, 1), ids[order]


def distances(q: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Squared distances from norms and products, after moving the first support row to the origin; never negative."""
    q, s = q - s[0], s - s[0]
    return np.maximum((q * q).sum(1)[:, None] + (s * s).sum(1)[None, :] - 2 * (q @ s.T), 0)


def knn(queries: DataFrame, support: DataFrame, k: int, strategy: str = "sql", vector: str = "exemplar", exclude: str | None = None) -> DataFrame:
    """(row_idx, rank from 1, support_idx, d2).

    ``queries`` has row_idx and the vector, ``support`` support_idx and the vector.  ``exclude`` names a column of queries with
    the support index that a row itself is (or null): it is left out before ranking, and such a row gets k - 1 neighbours."""
    own = F.col(exclude) if exclude else F.lit(None).cast("long")
    q = queries.select("row_idx", own.alias("_own"), F.col(vector).alias("_q"))
    s = support.select("support_idx", F.col(vector).alias("_s"))
    if strategy not in ("sql", "arrow"):
        raise ValueError(f"unknown strategy {strategy!r}")
    n, m = _most(s, "_s")
    if strategy == "arrow":
        return _small(q, s, k) if n * m * 8 <= BROADCAST_BYTES else _tiled(q, s, k, False)
    odd_q, odd_s = q.where(~_plain("_q", m)), s.where(~_plain("_s", m))
    some_q, some_s = not odd_q.isEmpty(), not odd_s.isEmpty()
    again = not q.groupBy("row_idx").agg(F.count("*").alias("n")).where("n > 1").isEmpty()  # rows of one index share a list
    near = (_boxed if n * m * 8 <= BROADCAST_BYTES else _tiled)(q.where(_plain("_q", m)), s.where(_plain("_s", m)), k)
    if not (some_q or some_s or again):
        return near
    near = near.join(q.groupBy("row_idx").agg(F.max("_own").alias("_own")), "row_idx").select("row_idx", "_own", "support_idx", "d2")
    if some_q:
        near = near.unionByName(_pairs(odd_q, s))
    if some_s:
        near = near.unionByName(_pairs(q.where(_plain("_q", m)), odd_s))
    return _ranked(near, k)


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("row_idx").orderBy("d2", "support_idx")
    ranked = pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.where(F.col("rank") <= k - F.col("_own").isNotNull().cast("int")).select("row_idx", "rank", "support_idx", "d2")


def _pairs(q: DataFrame, s: DataFrame) -> DataFrame:
    """(row_idx, _own, support_idx, d2) of all pairs."""
    pairs = q.join(s, F.coalesce(F.col("_own") != F.col("support_idx"), F.lit(True)), "inner")
    return pairs.select("row_idx", "_own", "support_idx", squared_distance(F.col("_q"), F.col("_s")).alias("d2"))


SCHEMA = "row_idx long, rank int, support_idx long, d2 double"


def _neighbours(rows: pd.DataFrame, ids: np.ndarray, s: np.ndarray, k: int) -> pd.DataFrame:
    out = []
    for i in range(0, len(rows), 256):
        some = rows.iloc[i : i + 256]
        q = np.array(some["_q"].tolist(), np.float64)
        d2 = distances(q, s)
        own = some["_own"].to_numpy(dtype=float, na_value=np.nan)
        for r in np.flatnonzero(~np.isnan(own)):
            d2[r, ids == int(own[r])] = np.inf
        d, at = top_k(d2, ids, min(k, len(ids)))
        rank = np.broadcast_to(np.arange(1, d.shape[1] + 1), d.shape)
        keep = np.isfinite(d) & (rank <= (k - ~np.isnan(own)[:, None]))
        idx = np.broadcast_to(some["row_idx"].to_numpy()[:, None], d.shape)
        out.append(pd.DataFrame({"row_idx": idx[keep], "rank": rank[keep].astype(np.int32), "support_idx": at[keep], "d2": d[keep]}))
    return pd.concat(out) if out else pd.DataFrame({"row_idx": [], "rank": [], "support_idx": [], "d2": []})


def first_copies(ids: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows in ascending order of ids, of equal vectors the first k only."""
    order = np.argsort(ids, kind="stable")
    ids, v = ids[order], np.ascontiguousarray(v[order] + 0.0)  # one zero
    _, of, n = np.unique(v.view(np.dtype((np.void, v.itemsize * v.shape[1]))).ravel(), return_inverse=True, return_counts=True)
    if n.max() > k:
        at = np.argsort(of, kind="stable")
        rank = np.empty(len(of), np.int64)
        rank[at] = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        ids, v = ids[rank < k], v[rank < k]
    return ids, v


def boxes(v: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): rows that lie together, in parts of at most ``size``, by halves along the widest component."""
    order, starts, todo = np.arange(len(v)), [], [(0, len(v))]
    while todo:
        i, j = todo.pop()
        if j - i <= size:
            starts.append(i)
            continue
        part = v[order[i:j]]
        c, half = int(np.argmax(part.max(0) - part.min(0))), (j - i) // 2
        order[i:j] = order[i:j][np.argpartition(part[:, c], half)]
        todo += [(i, i + half), (i + half, j)]
    return order, np.sort(np.array(starts))


def summed(q: np.ndarray, s: np.ndarray) -> np.ndarray:
    """``squared_distance`` of rows that are aligned or broadcast, added up in the same order."""
    out = 0.0
    for c in range(q.shape[-1]):
        d = q[..., c] - s[..., c]
        out = out + d * d
    return out


def _best(row: np.ndarray, d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, rank from 0, d, id) of the k first of each row."""
    order = np.lexsort((ids, d, row))
    row, d, ids = row[order], d[order], ids[order]
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]][: len(row)])
    rank = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
    return row[rank < k], rank[rank < k], d[rank < k], ids[rank < k]


def _by_boxes(q: np.ndarray, own: np.ndarray, support: tuple, k: int) -> tuple:
    """``_best`` of a block of queries: boxes in the order of their least distance from the block, as long as one can hold a
    row of any list.  (Rounding keeps the order of a box's distance and of those within, as both are added up alike.)"""
    ids, s, starts, lo, hi = support
    ends = np.r_[starts[1:], len(ids)]
    zero = np.zeros_like(lo)
    least = summed(np.maximum(np.maximum(lo - q.max(0), q.min(0) - hi), 0.0), zero)
    order = np.argsort(least, kind="stable")
    row, d, of = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
    edge, at, take = np.full(len(q), np.inf), 0, 1 + 2 * k // BOX
    while at < len(order) and least[order[at]] <= edge.max():
        some = order[at : at + take]
        some = np.sort(some[least[some] <= edge.max()])
        pick = np.concatenate([np.arange(starts[b], ends[b]) for b in some])
        new = summed(q[:, None], s[pick][None])
        new[ids[pick][None] == own[:, None]] = np.inf
        r, c = np.nonzero((new <= edge[:, None]) & (new < np.inf))
        row, rank, d, of = _best(np.r_[row, r], np.r_[d, new[r, c]], np.r_[of, ids[pick][c]], k)
        edge[row[rank == k - 1]] = d[rank == k - 1]
        at, take = at + take, min(2 * take, 64)
    return _best(row, d, of, k)


def _by_products(q: np.ndarray, own: np.ndarray, ids: np.ndarray, s: np.ndarray, k: int) -> tuple:
    """``_best`` of a block of queries: what products with their error of rounding cannot rule out is summed up."""
    d2 = distances(q, s)
    d2[ids[None] == own[:, None]] = np.inf
    edge = np.partition(d2, k - 1, axis=1)[:, k - 1] if len(ids) > k else np.full(len(q), np.finfo(float).max)
    reach = np.sqrt(((s - s[0]) ** 2).sum(1).max()) + np.sqrt(((q - s[0]) ** 2).sum(1))
    error = 4 * (q.shape[1] + 8) * np.finfo(float).eps * reach**2
    r, c = np.nonzero((d2 <= (edge + 2 * error)[:, None]) & (d2 < np.inf))
    return _best(r, summed(q[r], s[c]), ids[c], k)


def _summed(rows: pd.DataFrame, ids: np.ndarray, s: np.ndarray, k: int, cut: tuple | None = None) -> pd.DataFrame:
    """The neighbours of plain queries in plain support rows; ``cut`` is (starts, least, most) of the support's boxes."""
    q = np.array(rows["_q"].tolist(), np.float64).reshape(len(rows), s.shape[1])
    idx, held = rows["row_idx"].to_numpy(), rows["_own"].notna().to_numpy()
    own = np.where(held, rows["_own"].fillna(0).astype(np.int64), np.iinfo(np.int64).min)
    order, starts = boxes(q, NEAR_QUERIES) if cut else (np.arange(len(q)), np.arange(0, len(q), 64))
    out = []
    for i, j in zip(starts, np.r_[starts[1:], len(q)]):
        at = order[i:j]
        row, rank, d, of = _by_boxes(q[at], own[at], (ids, s, *cut), k) if cut else _by_products(q[at], own[at], ids, s, k)
        row = at[row]
        ok = rank < k - held[row]
        out.append(pd.DataFrame({"row_idx": idx[row[ok]], "rank": (rank[ok] + 1).astype(np.int32), "support_idx": of[ok], "d2": d[ok]}))
    return pd.concat(out)


def _in_boxes(rows: pd.DataFrame, k: int) -> tuple:
    """(ids, vectors, their boxes or None) of plain support rows."""
    ids, v = first_copies(rows["support_idx"].to_numpy(np.int64), np.array(rows["_s"].tolist(), np.float64).reshape(len(rows), -1), k)
    if v.shape[1] > BOX_DIMENSIONS:
        return ids, v, None
    order, starts = boxes(v, BOX)
    ids, v = ids[order], v[order]
    return ids, v, (starts, np.minimum.reduceat(v, starts), np.maximum.reduceat(v, starts))


def _boxed(q: DataFrame, s: DataFrame, k: int) -> DataFrame:
    rows = s.toPandas()  # bounded: its bytes were counted
    if not len(rows) or k < 1:
        return q.sparkSession.createDataFrame([], SCHEMA)
    sent = q.sparkSession.sparkContext.broadcast(_in_boxes(rows, k))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, v, cut = sent.value
        held: list[pd.DataFrame] = []
        for b in batches:
            held.append(b)
            if not cut or sum(map(len, held)) >= HELD:
                b, held = pd.concat(held), []
                if len(b):
                    yield _summed(b, ids, v, k, cut)
        if sum(map(len, held)):
            yield _summed(pd.concat(held), ids, v, k, cut)

    return q.mapInPandas(run, SCHEMA)


def _small(q: DataFrame, s: DataFrame, k: int) -> DataFrame:
    rows = s.orderBy("support_idx").toPandas()  # bounded: its bytes were counted
    ids, v = rows["support_idx"].to_numpy(np.int64), np.array(rows["_s"].tolist(), np.float64)
    sent = q.sparkSession.sparkContext.broadcast((ids, v))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, v = sent.value
        for b in batches:
            if len(ids) and len(b):
                yield _neighbours(b, ids, v, k)

    return q.mapInPandas(run, SCHEMA)


def _tiled(q: DataFrame, s: DataFrame, k: int, exact: bool = True) -> DataFrame:
    tiles = int(s.count() // TILE) + 1
    blocks = int(q.count() // QUERY_BLOCK) + 1
    q = q.withColumn("_block", F.pmod(F.xxhash64("row_idx"), F.lit(blocks))).withColumn("_tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    s = s.withColumn("_tile", F.pmod(F.xxhash64("support_idx"), F.lit(tiles)).cast("int")).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("support_idx")
        if not len(left) or not len(right):
            return pd.DataFrame({"row_idx": [], "rank": [], "support_idx": [], "d2": [], "own": []})
        ids, v = right["support_idx"].to_numpy(np.int64), np.array(right["_s"].tolist(), np.float64)
        out = _summed(left, *first_copies(ids, v, k), k) if exact else _neighbours(left, ids, v, k)
        out["own"] = out["row_idx"].isin(left.loc[left["_own"].notna(), "row_idx"])
        return out

    part = q.groupBy("_block", "_tile").cogroup(s.groupBy("_block", "_tile")).applyInPandas(run, SCHEMA + ", own boolean")
    w = Window.partitionBy("row_idx").orderBy("d2", "support_idx")
    merged = part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k - F.col("own").cast("int"))
    return merged.select("row_idx", "rank", "support_idx", "d2")


def similarity(neighbours: DataFrame, predictions: DataFrame, support: DataFrame) -> DataFrame:
    """(row_idx, q, d0, nearest): the length of the leading run of neighbours that are predicted rightly and like the row
    itself, the nearest one's distance, and its index.  Support attributes: support_idx, label, predicted_label."""
    s = support.select("support_idx", (F.col("label") == F.col("predicted_label")).alias("_right"), F.col("predicted_label").alias("_p"))
    n = neighbours.join(s, "support_idx").join(predictions.select("row_idx", "prediction"), "row_idx")
    good = F.col("_right") & (F.col("_p") == F.col("prediction"))
    run = F.coalesce(F.min(F.when(~good, F.col("rank"))) - 1, F.count("*"))
    return n.groupBy("row_idx").agg(run.cast("int").alias("q"), F.greatest(F.min_by("d2", "rank"), F.lit(0.0)).alias("d0"), F.min_by("support_idx", "rank").alias("nearest"))


def _leading(found: pd.DataFrame, rows: int, prediction: np.ndarray, ids: np.ndarray, right: np.ndarray, predicted: np.ndarray) -> pd.DataFrame:
    """``similarity`` of the queries 0 to ``rows`` from their neighbours; ids ascend, right is -1 and predictions are NaN where
    they are null."""
    q, d0, nearest, have = np.zeros(rows, np.int32), np.zeros(rows), np.zeros(rows, np.int64), np.zeros(rows, bool)
    if len(found):
        row, of, d2 = (found[c].to_numpy() for c in ("row_idx", "support_idx", "d2"))
        at = np.searchsorted(ids, of)
        p, own = predicted[at], prediction[row]
        bad = (right[at] == 0) | (p != own) & ~np.isnan(p) & ~np.isnan(own)
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        q[row[first]] = np.minimum.reduceat(np.where(bad, np.arange(len(row)), len(row)), first).clip(max=np.r_[first[1:], len(row)]) - first
        d0[row[first]], nearest[row[first]], have[row[first]] = np.maximum(d2[first], 0.0), of[first], True
    return pd.DataFrame({"q": q, "d0": d0, "nearest": nearest, "_found": have})


def signals(df: DataFrame, support: DataFrame, k: int, strategy: str = "sql", vector: str = "exemplar", exclude: str | None = None) -> DataFrame:
    """``df`` (row_idx, prediction, the vector) with q, d0 and nearest of ``similarity``; 0, 0 and null without neighbours.

    With a support that is sent to the tasks, plain vectors and indexes that are not repeated, each query's neighbours are looked
    at where they are found and nothing is shuffled; otherwise the neighbours are joined."""
    own = F.col(exclude) if exclude else F.lit(None).cast("long")
    n, m = _most(support, vector)
    direct = strategy == "sql" and 0 < n * m * 8 <= BROADCAST_BYTES and k > 0
    for rows, name in ((df, "row_idx"), (support, "support_idx")):
        direct = direct and rows.where(~_plain(vector, m) | F.col(name).isNull()).isEmpty()
        direct = direct and rows.groupBy(name).agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    if not direct:
        s = similarity(knn(df, support, k, strategy, vector, exclude), df, support)
        return df.join(s, "row_idx", "left").withColumns({"q": F.coalesce("q", F.lit(0)), "d0": F.coalesce("d0", F.lit(0.0))})
    right = (F.col("label") == F.col("predicted_label")).cast("int").alias("right")
    rows = support.select("support_idx", F.col(vector).alias("_s"), right, F.col("predicted_label").cast("double").alias("p"))
    rows = rows.toPandas().sort_values("support_idx")  # bounded: its bytes were counted
    attributes = rows["support_idx"].to_numpy(np.int64), rows["right"].fillna(-1).to_numpy(np.int8), rows["p"].to_numpy(np.float64)
    sent = df.sparkSession.sparkContext.broadcast((_in_boxes(rows, k), attributes))

    def several(held: list[pd.DataFrame]) -> pd.DataFrame:
        (ids, v, cut), attributes = sent.value
        b = pd.concat(held, ignore_index=True)
        return _leading(_summed(b[["_q", "_own"]].assign(row_idx=np.arange(len(b))), ids, v, k, cut), len(b), b["p"].to_numpy(np.float64), *attributes)

    @F.pandas_udf("q int, d0 double, nearest long, _found boolean")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for x, own, p in batches:
            held.append(pd.DataFrame({"_q": x, "_own": own, "p": p}))
            if sum(map(len, held)) >= HELD:
                yield several(held)
                held = []
        if sum(map(len, held)):
            yield several(held)

    out = df.withColumn("_s", run(F.col(vector), own, F.col("prediction").cast("double")))
    nearest = F.when(F.col("_s._found"), F.col("_s.nearest"))
    return out.withColumns({"q": F.col("_s.q"), "d0": F.col("_s.d0"), "nearest": nearest}).drop("_s")
