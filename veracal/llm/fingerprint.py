"""Document fingerprints: a Merkle tree over sections, paragraphs and clauses.

Sections are cut at blank lines, paragraphs at line ends, and paragraphs into leaves: clauses, of at most ``LEAF`` code
points.  A leaf is hashed; a paragraph's hash is over its leaves' hashes, a section's over its paragraphs', the root's over
the sections' and the text's own digest, so that equal roots mean equal texts.  Where two trees differ, equal branches are
skipped, and the differing ones say where the edit is.  The likeness of two fingerprints is the Dice coefficient of their
sets of leaves (1 for two empty texts).

A fingerprint is written ``root;section:paragraph.paragraph;section:...`` with paragraphs as runs of leaf hashes.

Everything is DataFrame expressions.  A document is compared with the next one in the order of doc_id: documents are dealt
to ranges of ids whose bounds are ids that occur (approximate quantiles); a document on a bound also goes to the range before
as a guest, and the first one goes to the last range, so each text is shuffled once and ``lead`` needs no global sort.

Nulls: a null text is empty; null ids come first.  Rows with the same id stand in the order of their texts.  An empty table
gives an empty result; a single document is followed by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

LEAF = 80
LEAVES = r"[^.!?,;|]{1,%d}[.!?,;|]*\s*|[.!?,;|]{1,%d}\s*" % (LEAF, LEAF)
#: Hexadecimal digits kept of the hash of a leaf, and of a paragraph or section.
LEAF_HEX, NODE_HEX = 8, 16
#: Most ranges of ids; the number itself follows the shuffle partitions.
MOST_RANGES = 65_536


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, as a lambda variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def leaves(text: Column) -> Column:
    """Sections of paragraphs of leaf hashes: array<array<array<string>>>."""
    cut = lambda p: F.transform(F.regexp_extract_all(p, F.lit(LEAVES), F.lit(0)), lambda x: F.substring(F.sha2(x, 256), 1, LEAF_HEX))
    return F.transform(F.split(text, r"\n[\x20\x09-\x0D]*\n"), lambda s: F.transform(F.split(s, "\n"), cut))


def tree(text: Column) -> Column:
    """struct(root, sections: array<struct<hash, paragraphs: array<struct<hash, leaves>>>>)."""
    short = lambda c: F.substring(F.sha2(c, 256), 1, NODE_HEX)
    paragraph = lambda p: F.struct(short(F.concat_ws("", p)).alias("hash"), p.alias("leaves"))

    def section(s: Column) -> Column:
        return F.struct(short(F.concat_ws(".", F.transform(s, lambda p: p["hash"]))).alias("hash"), s.alias("paragraphs"))

    sections = F.transform(F.transform(leaves(text), lambda s: F.transform(s, paragraph)), section)
    digest = F.sha2(text, 256)
    return F.element_at(
        F.transform(
            F.array(sections),
            lambda s: F.struct(F.sha2(F.concat_ws(";", digest, F.transform(s, lambda x: x["hash"])), 256).alias("root"), s.alias("sections")),
        ),
        1,
    )


def written_form(t: Column) -> Column:
    """The fingerprint as a string."""
    paragraphs = lambda s: F.concat_ws(".", F.transform(s["paragraphs"], lambda p: F.concat_ws("", p["leaves"])))
    return F.concat_ws(";", t["root"], F.transform(t["sections"], lambda s: F.concat_ws(":", s["hash"], paragraphs(s))))


def leaf_set(t: Column) -> Column:
    return F.array_distinct(F.flatten(F.flatten(F.transform(t["sections"], lambda s: F.transform(s["paragraphs"], lambda p: p["leaves"])))))


def dice(a: Column, b: Column) -> Column:
    """Likeness of two sets of leaves; two empty ones are alike."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def differing(a: Column, b: Column) -> Column:
    """Places of the branches that differ: array<struct<section, paragraph>>, zero-based; empty if the roots agree.

    Sections with equal hashes are skipped as a whole; within the others, paragraphs are compared at the same place."""

    def within(x: Column, y: Column, i: Column) -> Column:
        pairs = F.arrays_zip(F.coalesce(x["paragraphs"]["hash"], F.array().cast("array<string>")).alias("x"), F.coalesce(y["paragraphs"]["hash"], F.array().cast("array<string>")).alias("y"))
        places = F.transform(pairs, lambda p, j: F.when(~p["x"].eqNullSafe(p["y"]), F.struct(i.alias("section"), j.alias("paragraph"))))
        return F.filter(places, lambda p: p.isNotNull())

    pairs = F.arrays_zip(a["sections"].alias("x"), b["sections"].alias("y"))
    found = F.transform(
        pairs, lambda s, i: F.when(~s["x"]["hash"].eqNullSafe(s["y"]["hash"]), within(s["x"], s["y"], i))
    )
    return F.flatten(F.filter(found, lambda x: x.isNotNull()))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint of every document."""
    t = docs.select("doc_id", common.text_of().alias("_text")).withColumn("_t", tree(F.col("_text")))
    return t.select("doc_id", F.length("_text").cast("long").alias("n_chars"), written_form(F.col("_t")).alias("fingerprint"))


def _ranges(docs: DataFrame) -> tuple[Column, int]:
    """(struct(bucket, opens) of a key: its range and whether it opens the range, number of ranges); the key is ``_key``.

    Bounds are looked up in two steps of about the square root of their number."""
    spark = docs.sparkSession
    n = min(MOST_RANGES, max(16, 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    found = docs.agg(F.percentile_approx("_key", [i / n for i in range(n)], 10 * n).alias("b"), F.min("_key").alias("least")).first()
    bounds = sorted({*(found["b"] or []), *([found["least"]] if found["least"] is not None else [])}) or [0]
    wide = max(1, int(len(bounds) ** 0.5))
    rows = [bounds[i : i + wide] for i in range(0, len(bounds), wide)]
    key = F.col("_key")
    firsts, table = F.from_json(F.lit(str([r[0] for r in rows])), "array<long>"), F.from_json(F.lit(str(rows)), "array<array<long>>")
    last = lambda a: F.greatest(F.size(F.filter(a, lambda b: b <= key)) - 1, F.lit(0))  # noqa: E731  the last bound up to the key

    def inside(row: Column, bound: Column) -> Column:
        return let(last(bound), lambda i: F.struct((row * wide + i).alias("bucket"), (F.get(bound, i) == key).alias("opens")))

    return let(last(firsts), lambda row: let(F.get(table, row), lambda bound: inside(row, bound))), len(bounds)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, _text and the text of the next document, ``_next``."""
    least = -(2**63)
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(least)).alias("_key"), common.text_of().alias("_text"))
    place, n = _ranges(rows)
    rows = rows.withColumn("_at", place).select("*", F.col("_at.bucket").alias("_bucket"), F.col("_at.opens").alias("_opens")).drop("_at")
    # a row that opens a range also visits the range before (the first range: the last one), behind all residents
    visits = F.when(F.col("_opens"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.withColumn("_guest", F.explode(visits))
    rows = rows.withColumn("_bucket", F.when(F.col("_guest") == 1, F.pmod(F.col("_bucket") - 1, F.lit(n))).otherwise(F.col("_bucket")))
    w = Window.partitionBy("_bucket").orderBy("_guest", "_key", "_text")
    return rows.withColumn("_next", F.lead("_text").over(w)).where("_guest = 0").select("doc_id", "_text", "_next")


def compare(docs: DataFrame) -> DataFrame:
    """Each document with its edited text and the next document.

    The edited text is the text with its last half replaced by the beginning of the next document.  Columns: doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_differing (paragraphs in which the tree and the
    edited text's tree differ), first_differing (place of the first of them, ``section.paragraph``)."""
    half = F.floor(F.length("_text") / 2).cast("int")
    edited = F.concat(F.expr("substring(_text, 1, length(_text) - int(floor(length(_text) / 2)))"), F.substring("_next", F.lit(1), half))
    rows = with_next(docs).select("doc_id", F.length("_text").cast("long").alias("n_chars"), "_text", edited.alias("_edited"), "_next")
    rows = rows.withColumn("_t", tree(F.col("_text"))).withColumn("_e", tree(F.col("_edited"))).withColumn("_n", leaf_set(tree(F.col("_next"))))
    rows = rows.withColumn("_l", leaf_set(F.col("_t"))).withColumn("_d", differing(F.col("_t"), F.col("_e")))
    first = F.get("_d", 0)
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("_edited", 256).alias("edited_sha256"),
        written_form(F.col("_t")).alias("fingerprint"),
        written_form(F.col("_e")).alias("edited_fingerprint"),
        dice(F.col("_l"), leaf_set(F.col("_e"))).alias("near_edited"),
        dice(F.col("_l"), F.col("_n")).alias("near_next"),
        F.size("_d").cast("long").alias("n_differing"),
        F.concat_ws(".", first["section"].cast("string"), first["paragraph"].cast("string")).alias("first_differing"),
    )
