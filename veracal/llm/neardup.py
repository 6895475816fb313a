"""Near-duplicate documents: MinHash bands propose pairs, odd sketches sift them, full shingle sets confirm them.

A document's set holds its distinct word shingles (ASCII lower case).  Documents with the same set are one node, so copies
cost one row each and no pairs.  Each node has ``BANDS * ROWS`` MinHash samples.  Nodes that agree on all rows of a band share
a bucket; a pair at the least similarity misses every band with a probability of (1 - 0.8^6)^48 < 1e-6.  The samples are also
folded into a parity bitmap (odd sketch): each sample toggles one bit, and the population count of two bitmaps' XOR estimates
how many samples differ, precisely where the similarity is high.  Pairs whose estimate is below ``SIFT``, more than five
standard errors under the limit, are dropped; the others are confirmed on the full sets of their texts.

No bucket is expanded into all of its pairs: first each member meets the bucket's least node and its hub, the confirmed
pairs are contracted to components, and only pairs that join two components within a bucket are looked at then.  That finds
every component, since a pair inside a component adds nothing.  Buckets are aggregated before they are shuffled and joined by
joins that may be split; nothing is capped.

Nulls and empties: documents without words, and null ids, are linked with nothing (component: their own id).  Rows with the
same id follow each its own text: nodes are texts, a component's id is the least id of all rows with its texts.  An empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import link_buckets

SHINGLE = 5
PERCENT = 80
BANDS, ROWS = 48, 6
SKETCH_BITS = 1024
SIFT = 0.65
#: The second sketch, for nodes that might still join two components.
FINE_SAMPLES, FINE_BITS, FINE_SIFT = 4096, 8192, 0.765
SMALL, BLOCK_NODES = 24, 1024
#: Shingles that are hashed at once; bounds the memory of very long texts.
BLOCK = 8192

_BASE = 0xA0761D6478BD642F
_G = np.random.default_rng(20_241)
_XOR = _G.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
_MUL = _G.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_ROW = _G.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
_PLACE = _G.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


_FINE_XOR = _G.integers(0, 2**32, FINE_SAMPLES, dtype=np.uint32)
_FINE_MUL = _G.integers(0, 2**32, FINE_SAMPLES, dtype=np.uint32) | np.uint32(1)
_FINE_PLACE = _G.integers(0, 2**63, FINE_SAMPLES, dtype=np.uint64)


def shingles(text: str, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; with fewer words, of the whole sequence."""
    h = common.hash_words(text.encode().lower())
    return np.unique(common.rolling(h, min(size, len(h)), _BASE)) if len(h) else h


def minhash(s: np.ndarray) -> np.ndarray:
    """The samples: for each of the hash functions the least value over the set."""
    x = (s ^ (s >> np.uint64(32))).astype(np.uint32)
    out = np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
    for i in range(0, len(x), BLOCK):
        v = x[i : i + BLOCK, None] ^ _XOR
        v *= _MUL
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        np.minimum(out, v.min(0), out=out)
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band, different for different bands."""
    rows = m.reshape(BANDS, ROWS).astype(np.uint64)
    return common.mix64((rows * _ROW).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def odd_sketch(m: np.ndarray) -> np.ndarray:
    """The parity bitmap of the samples, as 64-bit words."""
    place = common.mix64(m.astype(np.uint64) + _PLACE) >> np.uint64(64 - int(math.log2(SKETCH_BITS)))
    return np.packbits((np.bincount(place.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)).view(np.int64)


def most_differing_bits(similarity: float, samples: int = BANDS * ROWS, size: int = SKETCH_BITS) -> int:
    """The population count of the XOR that is expected at a similarity: above it the estimate is lower."""
    return int(size / 2 * (1 - (1 - 2 / size) ** (2 * samples * (1 - similarity))))


FINE_BITS_APART = most_differing_bits(FINE_SIFT, FINE_SAMPLES, FINE_BITS)


def fine_sketch(s: np.ndarray) -> bytes:
    """An odd sketch of ``FINE_SAMPLES`` samples in ``FINE_BITS`` bits."""
    bits = np.zeros(FINE_BITS, np.int64)
    x = (s ^ (s >> np.uint64(32))).astype(np.uint32)
    for first in range(0, FINE_SAMPLES, 256):
        at = slice(first, first + 256)
        m = np.full(256, 2**32 - 1, np.uint32)
        for i in range(0, len(x), BLOCK):
            v = x[i : i + BLOCK, None] ^ _FINE_XOR[at]
            v *= _FINE_MUL[at]
            v ^= v >> np.uint32(15)
            v *= np.uint32(0x2C1B3C6D)
            np.minimum(m, v.min(0), out=m)
        place = common.mix64(m.astype(np.uint64) + _FINE_PLACE[at]) >> np.uint64(64 - int(math.log2(FINE_BITS)))
        bits += np.bincount(place.astype(np.int64), minlength=FINE_BITS)
    return np.packbits((bits & 1).astype(np.uint8)).tobytes()


def differing_bits(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def sign(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, _k (hash of the text), n_shingles, ``same`` (16 bytes, equal for equal sets; null for empty ones), bands, sketch."""
    import xxhash

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n, same, bands, sketch = [], [], [], []
            for t in batch["text"]:
                s = shingles(t, size)
                n.append(len(s))
                if len(s):
                    m = minhash(s)
                    same.append(xxhash.xxh3_128_digest(s.tobytes()))
                    bands.append(band_keys(m))
                    sketch.append(odd_sketch(m))
                else:
                    same.append(None)
                    bands.append(None)
                    sketch.append(None)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "_k": batch["_k"], "n_shingles": n, "same": same, "bands": bands, "sketch": sketch})

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", _hash(), common.text_of().alias("text"))
    return rows.mapInPandas(run, f"doc_id {kind}, _k long, n_shingles long, same binary, bands array<long>, sketch array<long>")


def _hash() -> Column:
    return F.xxhash64(common.text_of()).alias("_k")


def texts_of(ids: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) of the nodes of ``ids``, each once."""
    asked = common.maybe_broadcast(common.written(nodes.select("node", "doc_id", "_k").join(common.maybe_broadcast(ids), "node"), "asked"))
    rows = docs.select("doc_id", _hash(), common.text_of().alias("text"))
    return rows.join(asked, ["doc_id", "_k"]).select("node", "text").dropDuplicates(["node"])


def confirm(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets reach the similarity.  Texts go only where a pair needs them."""
    ids = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    texts = common.written(texts_of(ids, nodes, docs), "pair-texts")
    a, b = texts.select(F.col("node").alias("u"), F.col("text").alias("a")), texts.select(F.col("node").alias("v"), F.col("text").alias("b"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            ok = []
            for x, y in zip(p["a"], p["b"]):
                s, t = shingles(x, size), shingles(y, size)
                both = len(np.intersect1d(s, t, assume_unique=True))
                union = len(s) + len(t) - both
                ok.append(union > 0 and 100 * both >= percent * union)
            yield p.loc[ok, ["u", "v"]]

    out = common.written(pairs.join(a, "u").join(b, "v").mapInPandas(run, "u long, v long"), "pair-links")
    common.discard(texts)
    return out


def sift(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs that sizes and odd sketches leave possible."""
    one = lambda n: nodes.select(F.col("node").alias(n), F.col("n_shingles").alias(f"n_{n}"), F.col("sketch").alias(f"s_{n}"))
    p = pairs.join(one("u"), "u").join(one("v"), "v")
    p = p.where(100 * F.least("n_u", "n_v") >= percent * F.greatest("n_u", "n_v"))
    return p.where(differing_bits(F.col("s_u"), F.col("s_v")) <= most_differing_bits(SIFT)).select("u", "v").distinct()


def propose(inner: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (u, v) of one bucket and two components (key, node, component) that may reach the similarity.

    Such nodes get a second, longer odd sketch from their texts, whose estimate is five standard errors safe down to
    ``FINE_SIFT``.  Buckets of at most ``SMALL`` nodes are joined with themselves, with the first sketch in the condition.
    Larger ones are cut into blocks of about ``BLOCK_NODES``; each two blocks meet in one task, where all sketches are compared
    as arrays and only the pairs that pass become rows, once each: in the first band that they share."""
    asked = inner.select("node").distinct()

    def refine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"node": b["node"], "fine": [fine_sketch(shingles(t, size)) for t in b["text"]]})

    fine = texts_of(asked, nodes, docs).mapInPandas(refine, "node long, fine binary")
    facts = common.written(fine.join(nodes.drop("doc_id", "_k", "same"), "node"), "facts")
    counts = common.written(inner.groupBy("key").agg(F.count("*").alias("many")), "bucket-sizes")
    sized = inner.join(counts, "key")
    small = sized.where(F.col("many") <= SMALL).join(facts.select("node", "n_shingles", "sketch"), "node")
    side = lambda s: small.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "component", "n_shingles", "sketch")])
    near = (100 * F.least("n_shingles_u", "n_shingles_v") >= percent * F.greatest("n_shingles_u", "n_shingles_v")) & (
        differing_bits(F.col("sketch_u"), F.col("sketch_v")) <= most_differing_bits(SIFT)
    )
    pairs = side("u").join(side("v"), "key").where((F.col("component_u") < F.col("component_v")) & near)
    pairs = pairs.select(F.least("node_u", "node_v").alias("u"), F.greatest("node_u", "node_v").alias("v"))

    blocks = F.ceil(F.col("many") / BLOCK_NODES).cast("int")
    mine = F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int")
    large = sized.where(F.col("many") > SMALL).withColumn("_blocks", blocks).withColumn("_own", mine)
    meets = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda j: F.struct(F.least("_own", j).alias("i"), F.greatest("_own", j).alias("j")))
    large = large.select("key", "node", "component", "_own", F.explode(meets).alias("_m"))
    large = large.select("key", "node", "component", "_own", "_m.i", "_m.j").join(facts.select("node", "n_shingles", "bands", "fine"), "node")

    def compare(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        a = g[g["_own"] == key[1]]
        return _block_pairs(key[0], a, a if key[1] == key[2] else g[g["_own"] == key[2]], percent)

    found = large.groupBy("key", "i", "j").applyInPandas(compare, "u long, v long")
    # the small buckets' pairs meet the longer sketches too
    pairs = pairs.distinct()
    for n in ("u", "v"):
        pairs = pairs.join(facts.select(F.col("node").alias(n), F.col("fine").alias(f"f_{n}")), n)

    def sift_fine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            if len(p):
                x, y = (np.frombuffer(b"".join(p[c]), np.uint64).reshape(len(p), -1) for c in ("f_u", "f_v"))
                yield p.loc[np.bitwise_count(x ^ y).sum(1) <= FINE_BITS_APART, ["u", "v"]]

    return pairs.mapInPandas(sift_fine, "u long, v long").union(found).distinct()


def _block_pairs(band: int, a: pd.DataFrame, b: pd.DataFrame, percent: int) -> pd.DataFrame:
    """The pairs of two blocks of a bucket that pass, in the first band that they share."""
    u, v = a["node"].to_numpy(), b["node"].to_numpy()
    out_u, out_v = [], []
    if len(a) and len(b):
        ca, cb = a["component"].to_numpy(), b["component"].to_numpy()
        na, nb = a["n_shingles"].to_numpy(), b["n_shingles"].to_numpy()
        fa, fb = (np.frombuffer(b"".join(x["fine"]), np.uint64).reshape(len(x), -1) for x in (a, b))
        ka, kb = (np.array(x["bands"].tolist(), np.int64) for x in (a, b))
        for r in range(len(a)):
            ok = (cb != ca[r]) & (100 * np.minimum(nb, na[r]) >= percent * np.maximum(nb, na[r]))
            if a is b:
                ok[: r + 1] = False
            at = np.flatnonzero(ok)
            at = at[np.bitwise_count(fb[at] ^ fa[r]).sum(1) <= FINE_BITS_APART]
            if len(at):
                shared = kb[at] == ka[r]
                at = at[ka[r][shared.argmax(1)] == band]
                out_u.append(np.full(len(at), u[r]))
                out_v.append(v[at])
    x, y = (np.concatenate(o) if o else np.empty(0, np.int64) for o in (out_u, out_v))
    return pd.DataFrame({"u": np.minimum(x, y), "v": np.maximum(x, y)})


def link(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, key: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id (least id reachable over links), kept (the id is the component's); with ``key`` also _k,
    which tells apart rows of one id with different texts."""
    signed = common.written(sign(docs, size), "signed")
    usable = signed.where("same is not null and doc_id is not null")
    facts = [F.first(c).alias(c) for c in ("n_shingles", "bands", "sketch")]
    nodes = usable.groupBy("same").agg(F.min(F.struct("doc_id", "_k")).alias("_r"), *facts)
    nodes = nodes.select("same", "_r.doc_id", "_r._k", "n_shingles", "bands", "sketch", F.monotonically_increasing_id().alias("node"))
    nodes = common.written(nodes, "nodes")  # ids are fixed once written
    members = nodes.select("node", F.explode("bands").alias("key"))
    signed_ids = common.written(signed.select("doc_id", "_k", "n_shingles", "same"), "signed-ids")
    common.discard(signed)

    def holds(pairs: DataFrame) -> DataFrame:
        return proposed_holds(sift(pairs, nodes, percent))

    def proposed_holds(pairs: DataFrame) -> DataFrame:
        pairs = common.written(pairs, "pairs")
        out = confirm(pairs, nodes, docs, size, percent)
        common.discard(pairs)
        return out

    found = link_buckets(members, holds, lambda inner: propose(inner, nodes, docs, size, percent), proposed_holds)
    of = nodes.select("same", "node", F.col("doc_id").alias("_first")).join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = of.groupBy("component").agg(F.min("_first").alias("component_id"))
    named = of.join(least, "component").select("same", "component_id")
    out = signed_ids.join(named, "same", "left")
    component = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component_id")), F.col("doc_id"))
    out = out.select("doc_id", *(["_k"] if key else []), "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
