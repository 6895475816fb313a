"""The queries of this subpackage, bound to the tables of the test data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import assess

    out = assess(common.documents(spark, sf_dir), labels(spark, sf_dir))
    stats = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return out.select("doc_id", *stats, "base_failed", "kept", F.array_join("rejected_by", ",").alias("rejected_by"))


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import compare

    return compare(common.documents(spark, sf_dir))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    docs = common.documents(spark, sf_dir)
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2
    found = identify(docs, docs.select("doc_id", "text", "lang").where(~held))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import deduplicate

    return deduplicate(common.documents(spark, sf_dir))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import extract

    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode

    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id"], digests=True)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import digest, scan_documents

    return digest(scan_documents(common.documents(spark, sf_dir)))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    out = mix(common.documents(spark, sf_dir)).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken", F.round("position", 6).alias("position"))
    return out.orderBy("position", "doc_id")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import link

    return link(common.documents(spark, sf_dir), size=2)


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import deduplicate

    out = deduplicate(common.documents(spark, sf_dir))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.length("text").cast("long").alias("n_kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return dict(ORACLES)
