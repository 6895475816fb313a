"""Substring deduplication: words inside a window of ``WINDOW`` words that occurs more than once are removed.

1. Documents with the same sequence of words are one class.  A class of several long enough documents is removed as a whole,
   and one document stands for it from here on.
2. Each window is represented by its anchor, the leftmost least hash among its ``GRAM``-word grams; equal windows have equal
   anchors at equal offsets, so a window occurs at most as often as its anchor.  A text has about one anchor for 14 words.
3. Every partition counts its anchors in a count-min sketch (``DEPTH`` rows, kept sparse: sorted cells with saturated
   counts).  The sketches are cut into shards and merged shard by shard.  The width follows the number of anchors.  The
   minimum over the rows never underestimates, so anchors estimated to occur once are settled: nothing is lost.
4. A second pass over the texts makes 96-bit hashes of exactly those windows whose anchor is estimated repeated; they are
   counted (before they are shuffled, so a passage in a third of all documents is one row a task) and matched again.
5. Texts with repeated windows are read once more and their covered words removed.

Both hashes of a window are built from 64-bit hashes of its words, so words that share one (probability 2^-64 a pair) are taken
for equal; windows of different word hashes share their 96 bits with a probability of 2^-96.

No step gathers a passage's occurrences in one task: counts are partial sums, matches are semi-joins that may be split.

Nulls and empties: a null text has no words.  Rows with the same id and text are separate documents (and so repeat each
other); null and repeated ids are told apart by the text.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 35
GRAM = 8
DEPTH = 2
#: Cells in each row of the sketch for each anchor of the corpus.
CELLS = 8
#: Bases of the hashes of windows; grams use the first.
_BASES = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


def anchors(h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all grams, for each window the place of its anchor)."""
    g = common.rolling(h, gram, _BASES[0])
    wide = window - gram + 1
    at = np.lib.stride_tricks.sliding_window_view(g, wide).argmin(1)
    return g, at + np.arange(len(at))


def windows(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of every window of a text, from the hashes of its words."""
    return common.rolling(h, window, _BASES[0]), common.rolling(h, window, _BASES[1])


def _key() -> list:
    return ["doc_id", F.xxhash64("doc_id", "text").alias("_k"), common.text_of().alias("text")]


def _scan(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """A row for each document: its words' number, sequence hash and joined digest, its anchors and their places."""
    import xxhash

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n, seq, sha, hashes, places = [], [], [], [], []
            for t in b["text"]:
                h = common.hash_words(t.encode())
                joined = b" ".join(t.encode().split())
                n.append(len(h))
                seq.append(xxhash.xxh3_128_digest(joined))
                sha.append(hashlib.sha256(joined).hexdigest())
                if len(h) >= window:
                    g, at = anchors(h, window, gram)
                    at = np.unique(at)
                    hashes.append(g[at].tobytes())
                    places.append(at.astype(np.int32).tobytes())
                else:
                    hashes.append(None)
                    places.append(None)
            yield pd.DataFrame({"doc_id": b["doc_id"], "_k": b["_k"], "n_words": n, "seq": seq, "sha": sha, "hashes": hashes, "places": places})

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select(*_key()).mapInPandas(run, f"doc_id {kind}, _k long, n_words long, seq binary, sha string, hashes binary, places binary")


def _cells(hashes: np.ndarray, width: int) -> list[np.ndarray]:
    """The cell of each hash in each row; the width is a power of two."""
    return [common.mix64(hashes + np.uint64(r * 0x632BE59BD9B4E019 + 1)) & np.uint64(width - 1) for r in range(DEPTH)]


def repeated_cells(reps: DataFrame, width: int) -> DataFrame:
    """(cell) of all cells of the merged sketch with a count of two or more; a row's cells follow the row before's."""
    shards = 1 << max(4, (4 * int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    shards = min(shards, width)
    each = width // shards

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = [np.frombuffer(x, np.uint64) for b in batches for x in b["hashes"]]
        if not found:
            return
        for r, c in enumerate(_cells(np.concatenate(found), width)):
            cells, counts = np.unique(c, return_counts=True)
            counts = np.minimum(counts, 255).astype(np.uint8)
            cuts = np.searchsorted(cells, np.arange(0, shards + 1, dtype=np.uint64) * np.uint64(each))
            rows = [(r, s, i, j) for s, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])) if i < j]
            yield pd.DataFrame(
                {
                    "row": [r] * len(rows),
                    "shard": [s for _, s, _, _ in rows],
                    "cells": [(cells[i:j] - np.uint64(s * each)).astype(np.uint32).tobytes() for _, s, i, j in rows],
                    "counts": [counts[i:j].tobytes() for _, _, i, j in rows],
                }
            )

    def merge(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        cells = np.frombuffer(b"".join(parts["cells"]), np.uint32)
        counts = np.frombuffer(b"".join(parts["counts"]), np.uint8)
        one, at = np.unique(cells, return_inverse=True)
        total = np.bincount(at, counts)
        return pd.DataFrame({"cell": one[total >= 2].astype(np.int64) + key[1] * each + key[0] * width})

    sketches = reps.select("hashes").mapInPandas(sketch, "row int, shard int, cells binary, counts binary")
    return sketches.groupBy("row", "shard").applyInPandas(merge, "cell long")


def _exploded(reps: DataFrame, width: int) -> DataFrame:
    """Each anchor with its cells: c0, c1, .., rid, place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 500):
                some = b.iloc[i : i + 500]
                h = [np.frombuffer(x, np.uint64) for x in some["hashes"]]
                cells = _cells(np.concatenate(h), width)
                out = {f"c{r}": c.astype(np.int64) + r * width for r, c in enumerate(cells)}
                out["rid"] = np.repeat(some["rid"].to_numpy(), [len(x) for x in h])
                out["place"] = np.concatenate([np.frombuffer(x, np.int32) for x in some["places"]])
                yield pd.DataFrame(out)

    fields = ", ".join(f"c{r} long" for r in range(DEPTH))
    return reps.select("hashes", "places", "rid").mapInPandas(run, f"{fields}, rid long, place int")


def _windows_of(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """The windows whose anchor is in ``flagged``: a, b (hashes), rid, start, weight."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rid, text, weight, flagged in zip(batch["rid"], batch["text"], batch["weight"], batch["flagged"]):
                h = common.hash_words(text.encode())
                _, at = anchors(h, window, gram)
                hit = np.zeros(len(h), bool)
                hit[flagged] = True
                start = np.flatnonzero(hit[at])
                a, b = windows(h, window)
                yield pd.DataFrame({"a": a[start].view(np.int64), "b": (b[start] >> np.uint64(32)).astype(np.uint32).view(np.int32), "rid": rid, "start": start.astype(np.int32), "weight": weight})

    return rows.mapInPandas(buffered(run), "a long, b int, rid long, start int, weight int")


def buffered(run):
    """Join small frames into ones of at least 20,000 rows."""

    def out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for x in run(batches):
            held.append(x)
            n += len(x)
            if n >= 20_000:
                yield pd.concat(held, ignore_index=True)
                held, n = [], 0
        if held:
            yield pd.concat(held, ignore_index=True)

    return out


def covered(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which of n words lie in a window that begins at one of the starts."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + window, -1)
    return np.cumsum(change[:-1]) > 0


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(documents, repeats): documents has doc_id, _k, n_words, sha, copies (rows with the same words); repeats has
    doc_id, _k, starts: the places of the repeated windows of documents without copies."""
    scanned = common.written(_scan(docs, window, gram), "scanned")
    long_ones = scanned.where("hashes is not null")
    first = F.min(F.struct("doc_id", "_k", "hashes", "places")).alias("r")
    classes = long_ones.groupBy("seq").agg(F.count("*").alias("copies"), first)
    reps = classes.select("seq", "copies", F.col("r.doc_id").alias("doc_id"), F.col("r._k").alias("_k"), F.col("r.hashes").alias("hashes"), F.col("r.places").alias("places"))
    reps = common.written(reps.withColumn("rid", F.monotonically_increasing_id()), "classes")  # ids are fixed once written
    copies = common.written(reps.where("copies > 1").select("seq", "copies"), "copies")
    info = common.written(scanned.select("doc_id", "_k", "n_words", "sha", "seq"), "info")
    common.discard(scanned)
    n = reps.agg(F.coalesce(F.sum(F.length("hashes")), F.lit(0))).first()[0] // 8
    width = 1 << max(10, int(CELLS * n - 1).bit_length())
    cells = common.written(repeated_cells(reps, width), "cells")
    marked = _exploded(reps, width)
    for r in range(DEPTH):
        marked = marked.join(cells.where(f"cell >= {r * width} and cell < {(r + 1) * width}").withColumnRenamed("cell", f"c{r}"), f"c{r}", "left_semi")
    flagged = marked.groupBy("rid").agg(F.collect_list("place").alias("flagged"))  # at most a document's anchors
    flagged = flagged.join(reps.select("rid", "doc_id", "_k", F.least("copies", F.lit(2)).cast("int").alias("weight")), "rid")
    flagged = common.written(flagged, "flagged")
    common.discard(reps, cells)
    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}._k") == F.col(f"{b}._k"))
    one = docs.select(*_key()).alias("d").join(flagged.alias("f"), same("d", "f")).select("f.rid", "d.text", "f.weight", "f.flagged")
    # a row that repeats another wholly brings its windows again; they have copies, so their weight is 2 anyway
    found = common.written(_windows_of(one, window, gram), "windows")
    # as a table of its own: the join below may then split a window that very many documents share
    repeated = common.written(found.groupBy("a", "b").agg(F.sum("weight").alias("n")).where("n > 1").select("a", "b"), "repeated")
    hits = found.where("weight = 1").join(repeated, ["a", "b"], "left_semi")
    starts = hits.groupBy("rid").agg(F.collect_list("start").alias("starts"))
    repeats = flagged.select("rid", "doc_id", "_k").join(starts, "rid").drop("rid")
    repeats = common.written(repeats, "repeats")
    common.discard(found, repeated)
    return info.join(copies, "seq", "left").drop("seq"), repeats


def deduplicate(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space)."""
    documents, repeats = repeated_windows(docs, window, gram)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n, sha = [], []
            for t, starts in zip(b["text"], b["starts"]):
                words = t.encode().split()
                gone = covered(len(words), np.asarray(starts, np.int64), window)
                n.append(int(gone.sum()))
                sha.append(hashlib.sha256(b" ".join(w for w, g in zip(words, gone) if not g)).hexdigest())
            yield pd.DataFrame({"doc_id": b["doc_id"], "_k": b["_k"], "n_removed": n, "kept": sha})

    kind = dict(docs.dtypes)["doc_id"]
    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}._k") == F.col(f"{b}._k"))
    hit = docs.select(*_key()).alias("d").join(repeats.alias("r"), same("d", "r")).select("d.doc_id", "d._k", "d.text", "r.starts")
    cut = hit.mapInPandas(run, f"doc_id {kind}, _k long, n_removed long, kept string")
    out = documents.alias("s").join(cut.alias("c"), same("s", "c"), "left")
    whole = F.col("copies").isNotNull()
    return out.select(
        F.col("s.doc_id").alias("doc_id"),
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )
