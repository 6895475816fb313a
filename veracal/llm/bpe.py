"""Byte-level BPE encoding and decoding.

A text is cut into pieces by the vocabulary's pattern; each piece is encoded by itself.  Encoding a piece keeps a segment
tree over its byte positions: the leaf of a live position holds the rank of the pair (this part, next live part), inner
nodes hold the least rank, the left child winning ties, so the root is the leftmost minimum.  A merge retires one position
and changes the ranks at two live neighbours: three point updates, each logarithmic.  Many pieces of like length are
encoded at once: the trees of a group are rows of one numpy array and each round merges at every tree's root.

Pieces already seen by a worker are looked up, so the trees run once for each distinct piece and worker; the memory is
bounded (``MOST_PIECES``) and starts again when full.  Texts are never cut; null counts as the empty text; lone surrogates
cannot occur in Spark strings.  One output row for each input row, no shuffle.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_PIECES = 600_000
#: Texts are encoded so many characters at a time (whole texts).
CHUNK_CHARS = 2_000_000
#: Pieces of more bytes get a tree of their own instead of a row in a group's array.
GROUP_BYTES = 64
NONE = np.int32(2**30)


class Ranks:
    """A vocabulary of byte strings with ranks, and the rank of every mergeable pair of them."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        ids = self.ranks
        pairs = [
            (ids[t[:i]] << 32 | ids[t[i:]], r) for t, r in ids.items() for i in range(1, len(t)) if t[:i] in ids and t[i:] in ids
        ]
        # open addressing: a pair's key and rank at the first free slot from its hash on
        keys = np.array([k for k, _ in pairs], np.uint64)
        order = np.argsort(keys)
        self.keys, self.of_pair = keys[order], np.array([r for _, r in pairs], np.int32)[order]
        self.pairs = dict(pairs)
        self.byte = np.array([ids[bytes([b])] for b in range(256)], np.int64)
        self.decimal = {str(r): t for t, r in ids.items()}

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.of_pair[at], NONE)


def encode_group(pieces: list[bytes], r: Ranks) -> list[list[int]]:
    """Encode pieces of at most a common power of two of bytes, all trees at once."""
    n, sizes = len(pieces), np.array([len(p) for p in pieces])
    width = 1 << max(1, int(sizes.max() - 1).bit_length())
    flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
    ids = r.byte[flat]
    place = np.arange(width)
    live = place < sizes[:, None]
    # sentinels: the part after the last live one is ``width``, the one before the first is -1
    after = np.where(place + 1 < sizes[:, None], place + 1, width)
    before = np.tile(place - 1, (n, 1))
    tree = np.full((n, 2 * width), NONE, np.int32)
    tree[:, width : 2 * width - 1] = np.where(live[:, 1:], r.of(ids[:, :-1], ids[:, 1:]), NONE)
    for level in range(width.bit_length() - 2, -1, -1):
        lo = 1 << level
        tree[:, lo : 2 * lo] = np.minimum(tree[:, 2 * lo : 4 * lo : 2], tree[:, 2 * lo + 1 : 4 * lo : 2])

    def put(rows: np.ndarray, at: np.ndarray, rank: np.ndarray) -> None:
        node = at + width
        tree[rows, node] = rank
        node >>= 1
        while node[0]:
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            node >>= 1

    while (rows := np.flatnonzero(tree[:, 1] != NONE)).size:
        node = np.ones(rows.size, np.int64)
        for _ in range(width.bit_length() - 1):
            node = 2 * node + (tree[rows, 2 * node] > tree[rows, 2 * node + 1])
        i = node - width
        j = after[rows, i]
        k = after[rows, j]
        ids[rows, i] = tree[rows, node]
        live[rows, j] = False
        after[rows, i] = k
        has = k < width
        before[rows[has], k[has]] = i[has]
        put(rows, j, np.full(rows.size, NONE, np.int32))
        rank = np.full(rows.size, NONE, np.int32)
        rank[has] = r.of(ids[rows[has], i[has]], ids[rows[has], k[has]])
        put(rows, i, rank)
        h = before[rows, i]
        has = h >= 0
        if has.any():
            put(rows[has], h[has], r.of(ids[rows[has], h[has]], ids[rows[has], i[has]]))
    return [row[keep].tolist() for row, keep in zip(ids, live)]


def encode_long(piece: bytes, r: Ranks) -> list[int]:
    """Encode one long piece with a tree of its own."""
    n = len(piece)
    width = 1 << max(1, (n - 1).bit_length())
    ids = [int(r.byte[b]) for b in piece]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    none, rank_of = int(NONE), r.pairs
    tree = [none] * (2 * width)
    for i in range(n - 1):
        tree[width + i] = rank_of.get(ids[i] << 32 | ids[i + 1], none)
    for x in range(width - 1, 0, -1):
        tree[x] = min(tree[2 * x], tree[2 * x + 1])

    def put(at: int, rank: int) -> None:
        x = at + width
        tree[x] = rank
        x >>= 1
        while x:
            least = min(tree[2 * x], tree[2 * x + 1])
            if tree[x] == least:  # nothing changes further up
                break
            tree[x] = least
            x >>= 1

    while tree[1] != none:
        x = 1
        while x < width:
            x = 2 * x + (tree[2 * x] > tree[2 * x + 1])
        i = x - width
        j = after[i]
        k = after[j]
        ids[i], after[i] = tree[x], k
        ids[j] = -1
        put(j, none)
        if k < n:
            before[k] = i
        put(i, rank_of.get(ids[i] << 32 | ids[k], none) if k < n else none)
        if (h := before[i]) >= 0:
            put(h, rank_of.get(ids[h] << 32 | ids[i], none))
    return [x for x in ids if x >= 0]


class Encoder:
    """Texts to ids and back; one per worker and vocabulary."""

    _made: dict[tuple, "Encoder"] = {}

    def __init__(self, path: str, pattern: str):
        import regex

        self.r, self.find, self.known = Ranks(path), regex.compile(pattern).findall, {}

    @classmethod
    def get(cls, path: str, pattern: str) -> "Encoder":
        if (path, pattern) not in cls._made:
            cls._made[path, pattern] = cls(path, pattern)
        return cls._made[path, pattern]

    def learn(self, pieces: set[str]) -> None:
        """Remember the ids of pieces, as decimals joined by commas."""
        groups: dict[int, list[bytes]] = {}
        names: dict[int, list[str]] = {}
        for p in pieces:
            b = p.encode()
            if (one := self.r.ranks.get(b)) is not None:
                self.known[p] = str(one)
            elif len(b) > GROUP_BYTES:
                self.known[p] = ",".join(map(str, encode_long(b, self.r)))
            else:
                g = (len(b) - 1).bit_length()
                groups.setdefault(g, []).append(b)
                names.setdefault(g, []).append(p)
        for g, all_of in groups.items():
            for at in range(0, len(all_of), 20_000):
                for p, ids in zip(names[g][at:], encode_group(all_of[at : at + 20_000], self.r)):
                    self.known[p] = ",".join(map(str, ids))

    def encode(self, texts: list[str]) -> list[str]:
        """The ids of each text, as decimals joined by commas; what is new in all of them is learned at once."""
        cut = [self.find(t) for t in texts]
        new: set[str] = set()
        for pieces in cut:
            new.update(pieces)
        missing = new.difference(self.known)
        if len(self.known) + len(missing) > MOST_PIECES:
            self.known.clear()
            missing = new
        self.learn(missing)
        return [",".join(map(self.known.__getitem__, pieces)) for pieces in cut]

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.r.decimal.__getitem__, ids.split(","))) if ids else b""


def chunks(texts) -> Iterator[list[str]]:
    """The texts of an Arrow column in lists of about ``CHUNK_CHARS`` characters; null is the empty text."""
    some, n = [], 0
    for t in texts:
        some.append(t.as_py() or "")
        n += len(some[-1])
        if n >= CHUNK_CHARS:
            yield some
            some, n = [], 0
    if some:
        yield some


OUT = "n_tokens long, ids string, decoded binary"
DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode(docs: DataFrame, path: str, pattern: str, keep: list[str] | None = None, digests: bool = False) -> DataFrame:
    """The columns ``keep`` (all) of ``docs`` but without the text unless named, and the number of tokens, their ids
    (decimals joined by commas) and the bytes decoded from the ids; with ``digests`` SHA-256 in their place.

    ``path`` is the vocabulary file, at the same place on all executors.
    """
    from pyspark.sql import types as T

    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")]
    added = [x.split(" ") for x in (DIGESTS if digests else OUT).split(", ")]
    kinds = {"long": T.LongType(), "string": T.StringType(), "binary": T.BinaryType()}
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(n, kinds[k]) for n, k in added])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        e = Encoder.get(path, pattern)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            n_tokens, ids, decoded = [], [], []
            for some in chunks(texts):
                for got in e.encode(some):
                    back = e.decode(got)
                    n_tokens.append(got.count(",") + 1 if got else 0)
                    if digests:
                        ids.append(hashlib.sha256(got.encode()).hexdigest())
                        decoded.append(hashlib.sha256(back).hexdigest())
                    else:
                        ids.append(got)
                        decoded.append(back)
            cols = [batch.column(i) for i in range(len(keep))]
            cols += [pa.array(n_tokens, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string() if digests else pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=keep + [n for n, _ in added])

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema)
