"""What the operators share: words, shared-folder tables and size-checked joins."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than ASCII white space; ``bytes.split()`` cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: A side with at most so many rows may be broadcast; larger ones take part in an ordinary (skew-splitting) join.
BROADCAST_ROWS = 50_000

_MADE: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.  Where it is unset, a local master gets a temporary
    one (tests); on a cluster that is an error, since executors would write to their own disks."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="veracal-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: With it Spark deletes a query's shuffle files when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: it is computed once and its lineage is cut,
    so a lost executor costs no recomputation.  Its shuffle files go at once; the table goes by ``discard`` or when the driver
    ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    _MADE.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._veracal_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made and that nothing reads any more."""
    for t in tables:
        _MADE.remove((t.sparkSession, t._veracal_path))
        _delete(t.sparkSession, t._veracal_path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_written() -> None:
    """Delete all tables that ``written`` made; results that still read them must have been stored before."""
    while _MADE:
        spark, path = _MADE.pop()
        try:
            _delete(spark, path)
        except Exception:  # the session has ended: nothing can be deleted any more
            return


atexit.register(drop_written)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True if ``df`` has at most ``rows`` rows; counts no further than that."""
    return df.limit(rows + 1).count() <= rows


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is proven small; otherwise as it is, so that a shuffled join is used."""
    return F.broadcast(df) if is_small(df, rows) else df


def text_of(col: str | Column = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def n_words(text: Column) -> Column:
    """The number of words of a text, in the JVM and without building them: word starts are what is left of the text
    once each word is one mark and the gaps are gone."""
    return F.length(F.regexp_replace(F.regexp_replace(text, WORD, "x"), GAP, "")).cast("long")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser for 64-bit values (xor-shift and multiply, invertible)."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_TABLE = np.random.default_rng(77).integers(1, 2**64 - 1, 256, dtype=np.uint64)
_SPACE = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
_BASE = 0x9E3779B97F4A7C15
#: Bytes that are hashed at once; a longer text is cut at white space.
HASH_BYTES = 1 << 18
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n (at least); the base is odd."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        up = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, base, np.uint64)], dtype=np.uint64)
        down = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, pow(base, -1, 2**64), np.uint64)], dtype=np.uint64)
        _POWERS[base] = up, down
    return _POWERS[base]


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, down: np.ndarray) -> np.ndarray:
    """Polynomial hashes of spans from prefix sums (sums[i]: of what is before i)."""
    return mix64((sums[ends] - sums[starts]) * down[starts])


def word_spans(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text's bytes start and end."""
    edge = np.flatnonzero(np.diff(np.r_[True, _SPACE[b], True].view(np.int8)))
    return edge[::2], edge[1::2]


def hash_words(text: bytes) -> np.ndarray:
    """64-bit hashes of all words of a text, without building the words: polynomials over randomised bytes, modulo 2^64."""
    if len(text) > HASH_BYTES:
        parts, at = [], 0
        while at < len(text):
            cut = at + HASH_BYTES
            while cut < len(text) and not _SPACE[text[cut]]:
                cut += 1
            parts.append(_hash_words(text[at:cut]))
            at = cut
        return np.concatenate(parts)
    return _hash_words(text)


def _hash_words(text: bytes) -> np.ndarray:
    b = np.frombuffer(text, np.uint8)
    starts, ends = word_spans(b)
    up, down = powers(_BASE, len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_TABLE[b] * up[: len(b)], out=sums[1:])
    return span_hashes(sums, starts, ends, down)


def rolling(h: np.ndarray, size: int, base: int) -> np.ndarray:
    """Polynomial hashes of all runs of ``size`` words, modulo 2^64."""
    up, down = powers(base, len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    n = len(h) - size + 1
    return mix64((sums[size:] - sums[:n]) * down[:n])
