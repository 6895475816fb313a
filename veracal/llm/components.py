"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step replaces edges so that components stay the same and drift to stars around their least node; it ends when a round
changes nothing.  All minima are aggregated before they are shuffled and the joins may be split, so a node with a third of
all edges is no bottleneck.  Every round is written to the shared folder, which also cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    joined = both.join(least, "u").select("u", "v", F.least("u", "m").alias("m"))
    return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    to_least = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return to_least.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); component is the least node reachable.  A written table."""
    e = common.written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _state(e)
    while before[0]:
        last, e = e, common.written(_small_star(_large_star(e)), "edges")
        common.discard(last)
        after = _state(e)
        if after == before:
            break
        before = after
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = common.written(stars.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
    common.discard(e)
    return out


def link_buckets(members: DataFrame, confirm, propose=None, confirm_proposed=None) -> DataFrame:
    """(node, component) of the nodes that confirmed pairs link, where pairs are sought within buckets.

    ``members`` has (key, node); ``confirm(pairs)`` returns those of the pairs (u, v), u < v, that hold.  No bucket is expanded
    into all of its pairs: each member first meets the bucket's least node and its hub, the node whose buckets are the largest
    together (of copies of one text with edits here and there that is the text itself, or the least edited copy); then only
    pairs that would join two components within a bucket are tried.  A pair inside a component adds nothing, so no component is
    lost.  ``propose`` may replace the plain join that makes those pairs from rows (key, node, component), and
    ``confirm_proposed`` then ``confirm``."""
    # tables of their own: a bucket that very many nodes share may then be split by the join
    buckets = common.written(members.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("lo")).where("n > 1"), "buckets")
    shared = common.written(members.join(buckets, "key"), "bucket-members")
    common.discard(buckets)
    weight = common.written(shared.groupBy("node").agg(F.sum("n").alias("weight")), "weights")
    hubs = shared.select("key", "node").join(weight, "node").groupBy("key").agg(F.max(F.struct("weight", "node"))["node"].alias("hub"))
    hubs = common.written(hubs, "hubs")
    common.discard(weight)
    members = common.written(shared.join(hubs, "key"), "bucket-members")
    common.discard(shared, hubs)
    ends = F.transform(F.array("lo", "hub"), lambda x: F.struct(F.least(x, "node").alias("u"), F.greatest(x, "node").alias("v")))
    first = members.select(F.explode(ends).alias("p")).select("p.u", "p.v").where("u < v").distinct()
    edges = common.written(confirm(first), "links")
    found = components(edges)
    of = members.join(found, "node", "left").select("key", "node", "lo", "hub", F.coalesce("component", "node").alias("component"))
    of = common.written(of, "bucket-components")
    common.discard(members)
    mixed = common.written(of.groupBy("key").agg(F.min("component").alias("c"), F.max("component").alias("d")).where("c < d").select("key"), "mixed")
    # the least node and the hub have met every member already
    inner = common.written(of.where("node <> lo and node <> hub").join(mixed, "key").select("key", "node", "component"), "inner")
    common.discard(of, mixed)
    new = common.written((confirm_proposed or confirm)((propose or all_pairs)(inner)), "links")
    common.discard(inner)
    if not new.isEmpty():
        linked = components(edges.union(new))
        common.discard(found)
        found = linked
    common.discard(edges, new)
    return found


def all_pairs(inner: DataFrame) -> DataFrame:
    """Pairs of nodes of one bucket and two components."""
    other = inner.select("key", F.col("node").alias("v"), F.col("component").alias("w"))
    cross = inner.join(other, "key").where("component < w")
    return cross.select(F.least("node", "v").alias("u"), F.greatest("node", "v").alias("v")).distinct()
