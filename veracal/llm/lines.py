"""Line deduplication for lines that are equal or nearly so.

A line is normalised: lower case, ASCII punctuation deleted, ASCII digits as 0, white space as one space.  Lines without a word
take no part and stay.  Lines with the same normal form are one group from the start.  Forms are near if their edit similarity,
1 - edits / longer length in bytes, reaches ``SIMILARITY``; the edits leave runs of bytes as they are, and forms that share a
run are compared.  Keys are hashes of runs:

- below ``SHORT_FORM`` bytes, all runs of the length that so few edits must leave whole (pigeonhole): no near pair is missed;
- beyond, runs of at least ``MIDDLE_RUN`` or ``LONG_RUN`` bytes whose hash is below a bound that falls with the length, about
  ``KEYS`` a form: a shared run that is taken in the longer form is taken in the other too (of a form
  with few different runs more are taken, at most ``KEYS`` different ones).  A near pair is missed if no run is both whole and taken, which takes very many scattered edits.

(Blocks of a SimHash cannot find these pairs: one word of ten changed flips some 16 of 128 bits, so blocks long enough to be
rare never agree.  The README has the figures.)

Pairs that share a key, and whose lengths and places of the run allow few enough edits, are verified on the normal forms (the
condition on places excludes no near pair with that run whole).  Of each connected group one occurrence stays:
the first line, in the document with the least id, with one of the group's forms; all others are removed, in whatever document.

Keys go to shards as planes of bytes, some 17 bytes each; a shard sorts its keys and returns pairs of buckets of at most
``LARGE`` forms and the members of larger ones.  A key that would hold a large part of a shard is known beforehand from the
keys of every ``SAMPLE``-th form; its members are dealt over all shards.  In a large bucket (lines around a common passage)
each member first meets the least one; then all pairs of members that are not yet in one group are looked at, in blocks of at
most ``BLOCK`` members, by lengths, places and counts of bytes (which no near pair fails), and those left are verified
task by task, unless others have joined their groups by then.  No pair is left out for the size of a bucket.
Texts are read once for the forms, once for the keys, once or twice for the lines to verify and once to be rebuilt.

Nulls and empties: a null text stays null and has no lines.  Rows with the same id count as one document (repeated rows are
treated alike), so do all rows with a null id, the last one.  An empty table gives an empty result.  Columns named _n_lines or
_n_removed are replaced, all others stay.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

SIMILARITY = 0.9
SHORT_FORM = 40
LONG_FORM = 100
MIDDLE_RUN = 10
LONG_RUN = 14
KEYS = 24
#: Bytes of forms whose runs are hashed at once (a longer form is hashed alone).
RUN_BYTES = 1 << 16
#: One form in so many (by its hash) tells which keys are hot; that decides where rows go, never which pairs are made.
SAMPLE = 64
#: A key is hot if it has more than one in so many of a shard's rows, and of the sampled forms at least ``HOT_LEAST``.
HOT_SHARE, HOT_LEAST = 4, 32
#: Keys that a shard shall hold, and keys that a task gathers before it sends them off.
SHARD_KEYS, FLUSH_KEYS = 250_000, 300_000
#: Members of a bucket up to which its pairs are returned at once; of larger ones those within a group are left out.
LARGE = 32
#: Members of a large bucket that are compared in one task with as many others, and members of whole buckets that share a task.
BLOCK, TASK_MEMBERS = 4_096, 10_000
#: Pairs that a task gathers before it looks for equal ones, and verifies before it looks which groups are joined now.
HELD_PAIRS, VERIFIED = 1_000_000, 4_096
#: The bits that tell which forms are asked are at most two to this; forms that a task remembers to have sent.
MOST_BITS, SENT_FORMS = 27, 100_000
#: Words of 64 diagonals up to which the distances of many pairs are computed together.
MOST_WORDS = 16
_KEY_BYTES = 5
#: Hashes end here, so that a bound of all of them is a float.
_MOST = np.uint64(2**64 - 4096)
_FIELD = (1 << 21) - 1
_MULTIPLIERS = tuple(np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F], np.uint64))
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_TABLE = bytes(48 if 48 <= i <= 57 else i for i in range(256))


def normal_text(text: str) -> bytes:
    """The text in normal form, but for white space."""
    return text.lower().encode().translate(_TABLE, PUNCTUATION)


def normal_line(text: str) -> bytes:
    """The normal form of one line."""
    return b" ".join(normal_text(text).split())


def forms_of(text: str) -> tuple[list[int], list[bytes]]:
    """(number of each line that has a word, its normal form)."""
    split = [x.split() for x in normal_text(text).split(b"\n")]
    number = [i for i, w in enumerate(split) if w]
    return number, [b" ".join(split[i]) for i in number]


def form_hashes(forms: list[bytes]) -> np.ndarray:
    """(forms, 2): two 64-bit hashes of each form."""
    import xxhash

    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, forms)), np.int64).reshape(-1, 2)


def most_edits(longer: int, similarity: float) -> int:
    """The edits that two forms may be apart."""
    return int(longer * (1 - similarity) + 1e-9)


@functools.cache
def run_length(longer: int, similarity: float) -> int:
    """The length of the runs that near forms are sought by, if the longer has so many bytes; 0 if only equal ones are near."""
    most = most_edits(longer, similarity)
    if not most:
        return 0
    if longer > LONG_FORM:
        return max(LONG_RUN, run_length(LONG_FORM, similarity))
    least = longer
    while most_edits(least - 1, similarity) == most:
        least -= 1
    whole = -(-(least - most) // (most + 1))  # of the longer form all bytes but ``most`` stay, in most + 1 runs
    return max(1, whole if longer < SHORT_FORM else max(whole, MIDDLE_RUN if longer < LONG_FORM else LONG_RUN))


@functools.cache
def run_lengths(size: int, similarity: float) -> tuple[int, ...]:
    """The run lengths of all pairs of a form of so many bytes with one as long or longer."""
    if size > LONG_FORM:
        return (run_length(size, similarity),)
    top = min(LONG_FORM + 1, int(size / similarity + 1e-9))
    return tuple(sorted({run_length(n, similarity) for n in range(size, top + 1)} - {0}))


def run_hashes(b: np.ndarray, run: int) -> np.ndarray:
    """64-bit hashes of all runs of so many bytes, from unaligned loads of eight bytes."""
    n = len(b) - run + 1
    out = np.full(n, run, np.uint64)
    padded = np.concatenate([b, np.zeros(8, np.uint8)])
    for at in (*range(0, run - 7, 8), *([run - 8] if run % 8 and run > 8 else [0] if run < 8 else [])):
        x = np.ndarray((n,), "<u8", padded, at, (1,))
        out += x << np.uint64(64 - 8 * run) if run < 8 else x
        out *= _MULTIPLIERS[0]
        out ^= out >> np.uint64(32)
    out *= _MULTIPLIERS[1]
    out ^= out >> np.uint64(29)
    out *= _MULTIPLIERS[2]
    out ^= out >> np.uint64(32)
    return out


def form_runs(forms: list[bytes], similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, number of the form, place) of the runs that are keys."""
    by_run: dict[int, list[int]] = {}
    for i, f in enumerate(forms):
        for run in run_lengths(min(len(f), LONG_FORM + 1), similarity):
            by_run.setdefault(run, []).append(i)
    out = [(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))]
    for run, some in by_run.items():
        ids, size = np.array(some), np.array([len(forms[i]) for i in some])
        ends = np.cumsum(size)
        i = 0
        while i < len(ids):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] - size[i] + RUN_BYTES)))
            n, b = size[i:j], np.frombuffer(b"".join([forms[k] for k in some[i:j]]), np.uint8)
            if len(b) >= run:
                h = run_hashes(b, run)
                bound = np.where(n < SHORT_FORM, 2.0**64, np.ceil(2.0**64 * np.minimum(1.0, KEYS / n))).clip(max=2.0**64 - 2048).astype(np.uint64)
                at, first = np.repeat(np.arange(len(n)), n)[: len(h)], np.cumsum(n) - n
                h[h > _MOST] = _MOST
                taken = np.flatnonzero(h <= bound[at])
                place = taken - first[at[taken]]
                taken = taken[place + run <= n[at[taken]]]
                # forms with few: the bound rises until ``KEYS`` different runs or all are taken
                few = np.flatnonzero((np.bincount(at[taken], minlength=len(n)) < KEYS // 2) & (n > KEYS // 2) & (n >= run))
                if len(few):
                    for f in few:
                        bound[f] = max(bound[f], np.unique(h[first[f] : first[f] + n[f] - run + 1])[:KEYS][-1])
                    taken = np.flatnonzero(h <= bound[at])
                    place = taken - first[at[taken]]
                    taken = taken[place + run <= n[at[taken]]]
                out.append((h[taken] + np.uint64(run), ids[i:j][at[taken]], taken - first[at[taken]]))
            i = j
    return tuple(map(np.concatenate, zip(*out)))


def edits(a: bytes, b: bytes) -> int:
    """Levenshtein distance, bit-parallel over integers of any length, after equal ends are cut off."""
    i = common_start(a, b)
    a, b = a[i:], b[i:]
    i = common_start(a[::-1], b[::-1])
    a, b = a[: len(a) - i], b[: len(b) - i]
    if not a or not b:
        return max(len(a), len(b))
    at: dict[int, int] = {}
    for k, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << k
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for c in b:
        eq = at.get(c, 0)
        x = eq | down
        d = (((eq & up) + up) ^ up) | eq
        right_up, right_down = down | (full & ~(d | up)), up & d
        score += bool(right_up & last) - bool(right_down & last)
        right_up = (right_up << 1 | 1) & full
        right_down = right_down << 1 & full
        up, down = right_down | (full & ~(x | right_up)), right_up & x
    return score


def common_start(a: bytes, b: bytes) -> int:
    """The length of the common prefix, by bisection."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def alike(a: bytes, b: bytes, least: float) -> bool:
    """Whether the edit similarity of two normal forms reaches ``least``."""
    most = most_edits(max(len(a), len(b)), least)
    return abs(len(a) - len(b)) <= most and (a == b or most > 0 and edits(a, b) <= most)


def alike_pairs(a: list[bytes], b: list[bytes], least: float) -> np.ndarray:
    """``alike`` of many pairs: those with about as many 64-bit words in the band of diagonals that so many edits can reach go
    through the columns together; bands beyond ``MOST_WORDS`` words one by one."""
    out = np.zeros(len(a), bool)
    by_words: dict[int, list[int]] = {}
    for i, (x, y) in enumerate(zip(a, b)):
        most = most_edits(max(len(x), len(y)), least)
        if abs(len(x) - len(y)) > most:
            continue
        if x == y or not most:
            out[i] = x == y
        elif (words := 1 << (most // 32).bit_length()) > MOST_WORDS or 2 * most > min(len(x), len(y)):
            out[i] = edits(x, y) <= most
        else:
            by_words.setdefault(words, []).append(i)
    for words, some in by_words.items():
        some.sort(key=lambda i: min(len(a[i]), len(b[i])), reverse=True)
        step = max(64, 4096 // words)
        for k in range(0, len(some), step):
            at = some[k : k + step]
            pairs = [(a[i], b[i]) if len(a[i]) >= len(b[i]) else (b[i], a[i]) for i in at]
            most = np.array([most_edits(len(x), least) for x, _ in pairs])
            out[at] = band_distances(pairs, most, words) <= most
    return out


def band_distances(pairs: list[tuple[bytes, bytes]], most: np.ndarray, words: int) -> np.ndarray:
    """Levenshtein distances of pairs (longer, shorter), the longest of the shorter first, right up to ``most`` and too great
    beyond: differences along a band of diagonals as bits (after Hyyroe), a column of all pairs at once.  A pair whose score can
    not come down to ``most`` any more is left out from then on."""
    width = 64 * words
    m, n = np.array([len(x) for x, _ in pairs]), np.array([len(y) for _, y in pairs])
    rows, columns = np.full((len(pairs), n[0] + width), 33, np.uint8), np.zeros((n[0], len(pairs)), np.uint8)  # no form has a "!"
    for i, ((x, y), shift) in enumerate(zip(pairs, width - most - 1)):
        end = min(len(x), rows.shape[1] - shift)
        rows[i, shift : shift + end] = np.frombuffer(x, np.uint8)[:end]
        columns[: len(y), i] = np.frombuffer(y, np.uint8)
    one, top = np.uint64(1), np.uint64(63)
    start = np.arange(width) >= (width - most - 1)[:, None]
    up = np.ascontiguousarray(np.packbits(start, axis=1, bitorder="little").view("<u8").T)
    down = np.zeros_like(up)
    out, score, turn, limit = np.full(len(pairs), 1 << 40), most.copy(), m - most, 2 * most + n - m
    who = np.arange(len(pairs))
    for i in range(n[0]):
        if i % 16 == 0 or n[who[-1]] <= i:
            ended = n[who] <= i
            out[who[ended]] = score[ended]
            stay = ~ended & (score <= limit[who])
            if not stay.any():
                break
            if ended.any() or 4 * stay.sum() < 3 * len(stay):
                who, score, rows = who[stay], score[stay], rows[stay]
                up, down = np.ascontiguousarray(up[:, stay]), np.ascontiguousarray(down[:, stay])
                columns = columns[:, stay]
        equal = np.packbits(rows[:, i : i + width] == columns[i, :, None], axis=1, bitorder="little").view("<u8").T
        total = equal & up
        carry = None
        for w in range(words):
            t = total[w] + up[w]
            over = t < up[w]
            if carry is not None:
                t += carry
                over |= (t == 0) & carry.astype(bool)
            total[w] = t
            carry = over.astype(np.uint64)
        diagonal = (total ^ up) | equal | down
        right_up, right_down = down | ~(diagonal | up), diagonal & up
        after = np.flatnonzero(i >= turn[who])
        change = (one - (diagonal[-1] >> top)).astype(np.int64)
        if len(after):
            at = width - 2 - (i - turn[who[after]])
            w, shift = at >> 6, (at & 63).astype(np.uint64)
            change[after] = (right_up[w, after] >> shift & one).astype(np.int64) - (right_down[w, after] >> shift & one).astype(np.int64)
        score += change
        down_one = diagonal >> one
        down_one[:-1] |= diagonal[1:] << top
        up, down = right_down | ~(down_one | right_up), down_one & right_up
    else:
        out[who] = score
    return out


def planes(x: np.ndarray, size: int) -> bytes:
    """The low ``size`` bytes of unsigned integers, all lowest bytes first: bytes that are mostly zero lie together."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1)[:, :size].T).tobytes()


def from_planes(parts: list[bytes], size: int, kind: type) -> np.ndarray:
    """The integers of several ``planes``, one after the other."""
    out = [np.zeros((len(b) // size, np.dtype(kind).itemsize), np.uint8) for b in parts]
    for x, b in zip(out, parts):
        x[:, :size] = np.frombuffer(b, np.uint8).reshape(size, -1).T
    return np.concatenate(out).view(kind).ravel()


def pack(size: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A form's length and a run's first and last place as one integer (a form too long for that may have it anywhere)."""
    size, lo, hi = (x.astype(np.int64) for x in (size, lo, hi))
    return np.where(size <= _FIELD, size << 42 | np.minimum(lo, _FIELD) << 21 | np.minimum(hi, _FIELD), -size)


def sizes(p: np.ndarray) -> np.ndarray:
    """The lengths in packed integers."""
    return np.where(p < 0, -p, p >> 42)


def near_places(p: np.ndarray, q: np.ndarray, similarity: float) -> np.ndarray:
    """``may_be_near`` for arrays."""
    s, t = (np.where(x < 0, -x, x >> 42) for x in (p, q))
    (a, b), (c, d) = ((np.where(x < 0, 0, x >> 21 & _FIELD), np.where(x < 0, -x, x & _FIELD)) for x in (p, q))
    most = np.floor(np.maximum(s, t) * (1 - similarity) + 1e-9)
    before = np.maximum(0, np.maximum(a - d, c - b))
    after = np.maximum(0, np.maximum((s - b) - (t - c), (t - d) - (s - a)))
    return (abs(s - t) <= most) & (before + after <= most)


def _size(p: Column) -> Column:
    return F.when(p < 0, -p).otherwise(F.shiftright(p, 42))


def _first(p: Column) -> Column:
    return F.when(p < 0, 0).otherwise(F.shiftright(p, 21).bitwiseAND(F.lit(_FIELD)))


def _last(p: Column) -> Column:
    return F.when(p < 0, -p).otherwise(p.bitwiseAND(F.lit(_FIELD)))


def may_be_near(p: Column, q: Column, similarity: float) -> Column:
    """Whether the lengths of two forms, and where each has a run, allow few enough edits."""
    most = F.floor(F.greatest(_size(p), _size(q)) * F.lit(1 - similarity) + F.lit(1e-9))
    before = F.greatest(F.lit(0), _first(p) - _last(q), _first(q) - _last(p))
    rest = lambda x, end: _size(x) - end(x)
    after = F.greatest(F.lit(0), rest(p, _last) - rest(q, _first), rest(q, _last) - rest(p, _first))
    return (F.abs(_size(p) - _size(q)) <= most) & (before + after <= most)


def _key() -> list:
    return ["doc_id", F.xxhash64("doc_id", "text").alias("_k")]


def scan(docs: DataFrame, similarity: float) -> DataFrame:
    """A row for each line with a word: doc_id, _k, line (from 0), again (the document has the form before), a and b (hash of
    the form), keys (only of every ``SAMPLE``-th form)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 500):
                some = batch.iloc[i : i + 500]
                found = [forms_of(t) for t in some["text"]]
                forms = [f for _, fs in found for f in fs]
                if not forms:
                    continue
                owner = np.repeat(np.arange(len(found)), [len(fs) for _, fs in found])
                h = form_hashes(forms)
                out = pd.DataFrame({"_o": owner, "line": np.array([k for n, _ in found for k in n], np.int32), "a": h[:, 0], "b": h[:, 1]})
                out["again"] = out.duplicated(["_o", "a", "b"])
                out["doc_id"], out["_k"] = some["doc_id"].to_numpy()[owner], some["_k"].to_numpy()[owner]
                at = np.flatnonzero((h[:, 0] % SAMPLE == 0) & ~out["again"].to_numpy())
                key, of, _ = form_runs([forms[k] for k in at], similarity)
                keys = np.full(len(out), None, object)
                for n, k in enumerate(at):
                    keys[k] = np.unique(key[of == n]).view(np.int64)
                out["keys"] = keys
                yield out.drop(columns="_o")

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.where("text is not null").select(*_key(), "text")
    return rows.mapInPandas(run, f"doc_id {kind}, _k long, line int, again boolean, a long, b long, keys array<long>")


def keys(docs: DataFrame, similarity: float, shards: int, hot: np.ndarray) -> DataFrame:
    """(shard, key, a, size, lo): the keys of each form, many to a row as planes of bytes; with the first hash of the form, its
    length and the place.  A key's top bits name its shard, those of ``hot`` keys are dealt over as many further ones."""
    bits = shards.bit_length() - 1

    def rows(held: list[tuple]) -> pd.DataFrame:
        key, a, size, lo = map(np.concatenate, zip(*held))
        shard = (key >> np.uint64(64 - bits)).astype(np.int32)
        dealt = np.isin(key, hot) if len(hot) else np.zeros(len(key), bool)
        shard[dealt] = shards + a[dealt] % shards
        order = np.argsort(shard, kind="stable")
        one, first = np.unique(shard[order], return_index=True)
        key = key << np.uint64(bits) >> np.uint64(64 - 8 * _KEY_BYTES)
        parts = [order[i:j] for i, j in zip(first, np.r_[first[1:], len(order)])]
        lists = {"key": (key, _KEY_BYTES), "a": (a, 8), "size": (size, 4), "lo": (lo, 4)}
        return pd.DataFrame({"shard": one} | {c: [planes(x[i], n) for i in parts] for c, (x, n) in lists.items()})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for batch in batches:
            for i in range(0, len(batch), 500):
                forms = list({f for t in batch["text"].iloc[i : i + 500] for f in forms_of(t)[1]})
                if not forms:
                    continue
                key, of, place = form_runs(forms, similarity)
                size = np.array([len(f) for f in forms], np.uint32)
                held.append((key, form_hashes(forms)[of, 0], size[of], place.astype(np.uint32)))
                n += len(key)
                if n >= FLUSH_KEYS:
                    yield rows(held)
                    held, n = [], 0
        if n:
            yield rows(held)

    return docs.where("text is not null").select("text").mapInPandas(run, "shard int, key binary, a binary, size binary, lo binary")


def hot_keys(lines: DataFrame) -> tuple[int, np.ndarray]:
    """(shards, keys that would hold too many of a shard's rows, fewer than ``HOT_SHARE`` for each shard)."""
    own = common.written(lines.where("keys is not null").dropDuplicates(["a", "b"]).select(F.explode("keys").alias("key")), "sample")
    rows = own.count()
    shards = 1 << max(4, (SAMPLE * rows // SHARD_KEYS).bit_length())
    found = own.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > max(HOT_LEAST, rows // (HOT_SHARE * shards)))
    hot = np.array([r["key"] for r in found.select("key").collect()], np.int64).view(np.uint64)
    common.discard(own)
    return shards, hot


#: What ``bucket_pairs`` returns: pairs with the least of a bucket, other pairs, members of large buckets.
STAR, INNER, MEMBER = 0, 1, 2


FOUND = {"kind": np.int32, "u": np.int64, "v": np.int64, "key": np.int64, "p": np.int64}


def bucket_pairs(key: np.ndarray, a: np.ndarray, p: np.ndarray, similarity: float) -> Iterator[pd.DataFrame]:
    """(kind, u, v, key, p) of the buckets of sorted keys: of small ones the pairs that may be near, of large ones the members
    (u); p is of those only."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    n = np.diff(np.r_[first, len(key)])
    for k in np.unique(n[(n > 1) & (n <= LARGE)]):
        at = first[n == k]
        i, j = np.triu_indices(k, 1)
        step = max(1, 100_000 // len(i))
        for x in range(0, len(at), step):
            u, v = ((at[x : x + step, None] + c).ravel() for c in (i, j))
            ok = near_places(p[u], p[v], similarity)
            kind = np.tile(np.where(i == 0, STAR, INNER), len(at[x : x + step]))[ok]
            u, v = a[u[ok]], a[v[ok]]
            yield pd.DataFrame({"kind": kind, "u": np.minimum(u, v), "v": np.maximum(u, v), "key": 0, "p": 0})
    many = np.repeat(n > LARGE, n)
    if many.any():
        yield members_of(a[many], key[many].view(np.int64), p[many])


def members_of(a: np.ndarray, key: np.ndarray, p: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"kind": MEMBER, "u": a, "v": 0, "key": key, "p": p})


def merge(shard: int, parts: pd.DataFrame, shards: int, similarity: float) -> pd.DataFrame:
    """``bucket_pairs`` of all rows of a shard."""
    key, a = from_planes(list(parts["key"]), _KEY_BYTES, np.uint64), from_planes(list(parts["a"]), 8, np.int64)
    size, lo = from_planes(list(parts["size"]), 4, np.uint32), from_planes(list(parts["lo"]), 4, np.uint32)
    order = np.lexsort((a, key))
    key, a, size, lo = key[order], a[order], size[order], lo[order]
    new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (a[1:] != a[:-1])])
    p = pack(size[new], np.minimum.reduceat(lo, new), np.maximum.reduceat(lo, new))
    key, a = key[new] | np.uint64(shard) << np.uint64(8 * _KEY_BYTES), a[new]
    if shard >= shards:  # a part of hot keys
        return members_of(a, -1 - (key & np.uint64((1 << 8 * _KEY_BYTES) - 1)).view(np.int64), p)
    found = list(bucket_pairs(key, a, p, similarity))
    return pd.concat(found, ignore_index=True) if found else pd.DataFrame({c: np.empty(0, t) for c, t in FOUND.items()})


def gram_counts(forms: list[bytes]) -> np.ndarray:
    """(forms, 96): how many bytes, and pairs of bytes, of each form fall into 32 and 64 classes (255 at most)."""
    ends = np.cumsum([len(f) for f in forms])
    out, i = [np.empty((0, 96), np.int16)], 0
    while i < len(forms):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + RUN_BYTES)))
        out.append(_gram_counts(forms[i:j]))
        i = j
    return np.concatenate(out)


def _gram_counts(forms: list[bytes]) -> np.ndarray:
    b = np.frombuffer(b"".join(forms), np.uint8).astype(np.int64)
    n = np.array([len(f) for f in forms], np.int64)
    owner = np.repeat(np.arange(len(n)), n)
    one = np.bincount(owner * 32 + b % 32, minlength=32 * len(n)).reshape(-1, 32)
    within = np.flatnonzero(owner[1:] == owner[:-1])
    pair = (b[within] * 256 + b[within + 1]) * 0x9E37 >> 4 & 63
    two = np.bincount(owner[within] * 64 + pair, minlength=64 * len(n)).reshape(-1, 64)
    return np.hstack([one, two]).clip(max=255).astype(np.int16)


def counts_allow(x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether forms with these ``gram_counts`` can be so few edits apart: an edit takes away and adds at most one byte and two
    pairs of bytes, and classes only hide differences."""
    d = x - y
    more, all_ = np.maximum(d, 0), d
    ok = np.ones(len(d), bool)
    for part, grams in ((slice(0, 32), 1), (slice(32, 96), 2)):
        over = more[:, part].sum(1, dtype=np.int64)
        ok &= np.maximum(over, over - all_[:, part].sum(1, dtype=np.int64)) <= grams * most
    return ok


def open_pairs(rows: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """(u, v, cu, cv): of each bucket (key, node, p, c, counts; b, i and j: the member's block and the blocks to compare) the pairs
    of members in different groups c that may be near, each once."""
    rows = rows.sort_values(["key", "b"], kind="stable")
    node, first, at = np.unique(rows["node"].to_numpy(), return_index=True, return_inverse=True)
    counts = np.frombuffer(b"".join(rows["counts"].iloc[first]), np.uint8).reshape(len(node), -1).astype(np.int16)
    c = rows["c"].to_numpy()[first]
    key, p, b, i, j = (rows[x].to_numpy() for x in ("key", "p", "b", "i", "j"))
    size, held, n = sizes(p), [np.empty(0, np.int64)], 0
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    for x, y in zip(starts, np.r_[starts[1:], len(key)]):
        half = x + int(np.searchsorted(b[x:y], b[y - 1])) if b[x] != b[y - 1] else y
        if half == y and i[x] != j[x]:
            continue  # the other block has no member
        start = half if half < y else x
        other, of = size[start:y], c[at[start:y]]
        for k in range(x, half, 256):
            to = min(half, k + 256)
            longer = np.maximum(size[k:to, None], other[None])
            ok = (abs(size[k:to, None] - other[None]) <= np.floor(longer * (1 - similarity) + 1e-9)) & (c[at[k:to], None] != of[None])
            if start == x:
                ok &= np.arange(k, to)[:, None] < np.arange(x, y)[None]
            u, v = np.nonzero(ok)
            u, v = u + k, v + start
            for z in range(0, len(u), 8192):
                s, t = u[z : z + 8192], v[z : z + 8192]
                ok = near_places(p[s], p[t], similarity)
                s, t = s[ok], t[ok]
                ok = counts_allow(counts[at[s]], counts[at[t]], np.floor(np.maximum(size[s], size[t]) * (1 - similarity) + 1e-9))
                s, t = at[s[ok]], at[t[ok]]
                held.append(np.minimum(s, t) * len(node) + np.maximum(s, t))
                n += len(held[-1])
        if n > HELD_PAIRS:
            held, n = [np.unique(np.concatenate(held))], 0
    code = np.unique(np.concatenate(held))
    u, v = code // max(1, len(node)), code % max(1, len(node))
    return pd.DataFrame({"u": node[u], "v": node[v], "cu": c[u], "cv": c[v]})


def pair_links(pairs: pd.DataFrame, forms: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """(u, v): near ones of the pairs (u, v) of nodes in the groups cu and cv, that join the groups as all near ones do: every pair
    is verified unless its groups are joined by then."""
    text = dict(zip(forms["node"], forms["form"]))
    u, v = pairs["u"].to_numpy(), pairs["v"].to_numpy()
    group = np.unique(np.r_[pairs["cu"].to_numpy(), pairs["cv"].to_numpy()], return_inverse=True)[1]
    gu, gv, now = group[: len(u)], group[len(u) :], np.arange(group.max(initial=-1) + 1)
    out = [np.empty((0, 2), np.int64)]
    while len(u):
        x, y = u[:VERIFIED], v[:VERIFIED]
        near = alike_pairs([text[k] for k in x], [text[k] for k in y], similarity)
        out.append(np.column_stack([x[near], y[near]]))
        join_groups(now, gu[:VERIFIED][near], gv[:VERIFIED][near])
        u, v, gu, gv = (z[VERIFIED:] for z in (u, v, gu, gv))
        apart = now[gu] != now[gv]
        u, v, gu, gv = u[apart], v[apart], gu[apart], gv[apart]
    found = np.concatenate(out)
    return pd.DataFrame({"u": found[:, 0], "v": found[:, 1]})


def join_groups(group: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Give the members of groups that the pairs (x, y) of members join one number, in place."""
    parent = np.arange(group.max() + 1)
    for a, b in zip(group[x].tolist(), group[y].tolist()):
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        parent[max(a, b)] = min(a, b)
    while not np.array_equal(parent, up := parent[parent]):
        parent = up
    group[:] = parent[group]


def bucket_rest(members: DataFrame, forms: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """(u, v), near pairs that join the groups of all buckets of ``members`` (key, node, p, c) with more than one: ``open_pairs`` of
    small buckets many to a task, of larger ones as pairs of blocks, then their ``pair_links``.  Buckets with the same least member
    share tasks, so a pair that meets in several of them is mostly found once; it is verified once.  ``forms`` has the
    hashes of each node (a, b)."""
    mixed = members.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi")
    mixed = common.written(mixed.select("key", "least", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), "n"), "line-buckets")
    n, blocks = mixed.agg(F.sum(F.when(F.col("blocks") == 1, F.col("n"))), F.max("blocks")).first()
    zero = F.lit(0)
    few = members.join(common.maybe_broadcast(mixed.where("blocks = 1").select("key", "least")), "key")
    task = F.pmod(F.xxhash64("least"), F.lit(1 + (n or 0) // TASK_MEMBERS))
    rows = few.select(task.alias("_task"), zero.alias("i"), zero.alias("j"), "key", "node", "p", "c", zero.alias("b"))
    if (blocks or 0) > 1:
        many = members.join(common.maybe_broadcast(mixed.where("blocks > 1").drop("n")), "key")
        many = many.withColumn("b", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        many = many.withColumn("x", F.explode(F.sequence(zero, F.col("blocks") - 1))).withColumns({"i": F.least("b", "x"), "j": F.greatest("b", "x")})
        rows = rows.union(many.select(F.xxhash64("least", "blocks", "i", "j"), "i", "j", "key", "node", "p", "c", "b"))
    rows = common.written(rows, "line-tasks")
    where = forms.select("node", "a", "b")
    counts = common.written(_forms_of(rows.select("node").distinct().join(where, "node"), docs, counted=True), "line-counts")
    counts = counts.select("node", F.col("form").alias("counts")).dropDuplicates(["node"])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        return open_pairs(part, similarity).assign(_task=part["_task"].iloc[0])

    pairs = rows.join(counts, "node").groupBy("_task").applyInPandas(run, "u long, v long, cu long, cv long, _task long")
    pairs = common.written(pairs.dropDuplicates(["u", "v"]), "line-open")
    common.discard(mixed, rows)
    asked = pairs.select("_task", F.col("u").alias("node")).union(pairs.select("_task", "v")).distinct().join(where, "node")

    def verify(part: pd.DataFrame, form: pd.DataFrame) -> pd.DataFrame:
        return pair_links(part, form, similarity)

    text = _forms_of(asked, docs, "_task").groupBy("_task")
    out = common.written(pairs.groupBy("_task").cogroup(text).applyInPandas(verify, "u long, v long"), "line-rest")
    common.discard(pairs)
    return out


def candidates(docs: DataFrame, shards: int, hot: np.ndarray, similarity: float) -> DataFrame:
    """(kind, u, v, key, p) of all buckets, as ``bucket_pairs`` has them; u and v are first hashes of forms."""

    def run(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        return merge(key[0], parts, shards, similarity)

    return keys(docs, similarity, shards, hot).groupBy("shard").applyInPandas(run, "kind int, u long, v long, key long, p long")


def _same(a: str, b: str):
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}._k") == F.col(f"{b}._k"))


def bitmap(asked: DataFrame) -> np.ndarray:
    """A bit for each remainder of the hashes a, about one in eight set, or more beyond ``MOST_BITS``."""
    bits = 1 << min(MOST_BITS, max(16, (8 * asked.count()).bit_length()))
    at = F.col("a").bitwiseAND(F.lit(bits - 1))
    words = asked.select(F.shiftright(at, 6).alias("word"), F.expr("shiftleft(1L, cast(a & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    rows = words.toPandas()  # bounded: at most a row for 64 bits
    out = np.zeros(bits // 64, np.int64)
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return out


def may_be_asked(bits: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash is set: of those asked it is."""
    return bits[(a & (64 * len(bits) - 1)) >> 6] >> (a & 63) & 1 == 1


def _forms_of(asked: DataFrame, docs: DataFrame, task: str = "node", counted: bool = False) -> DataFrame:
    """(node, _task, form): the normal form of the lines with the hashes a and b, for each row of ``asked``; or the ``gram_counts``
    of it as bytes.  The tasks know by a ``bitmap`` which forms are hardly asked, so whole texts stay where they are read; the
    join settles the rest."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(asked))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sure: set[bytes] = set()
        for batch in batches:
            for i in range(0, len(batch), 500):
                forms = list({f for t in batch["text"].iloc[i : i + 500] for f in forms_of(t)[1]})
                if not forms:
                    continue
                h = form_hashes(forms)
                at = [k for k in np.flatnonzero(may_be_asked(sent.value, h[:, 0])) if h[k].tobytes() not in sure]
                sure = sure if len(sure) < SENT_FORMS else set()  # forms of this task that went already
                sure.update(h[k].tobytes() for k in at)
                form = [forms[k] for k in at]
                form = [c.tobytes() for c in gram_counts(form).astype(np.uint8)] if counted else form
                yield pd.DataFrame({"a": h[at, 0], "b": h[at, 1], "form": form})

    found = docs.where("text is not null").select("text").mapInPandas(run, "a long, b long, form binary").dropDuplicates(["a", "b"])
    return asked.select("a", "b", "node", F.col(task).alias("_task")).join(found, ["a", "b"]).select("node", "_task", "form")


def _with_counts(forms: DataFrame) -> DataFrame:
    """``forms`` (node, form) with counts, ``gram_counts`` as bytes, and n, the length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            counts = gram_counts(list(f["form"])).astype(np.uint8)
            yield f.assign(counts=[c.tobytes() for c in counts], n=f["form"].str.len())

    return forms.mapInPandas(run, "node long, form binary, counts binary, n long")


def removed_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, _k, gone: the numbers of the lines to remove, for documents that have any."""
    lines = common.written(scan(docs, similarity), "lines")
    forms = lines.where("not again").groupBy("a", "b").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    forms = common.written(forms.withColumn("node", F.monotonically_increasing_id()), "forms")  # ids are fixed once written
    named = forms.select("a", "node")
    found = common.written(candidates(docs, *hot_keys(lines), similarity), "line-candidates")
    members = found.where(f"kind = {MEMBER}").select("key", F.col("u").alias("a"), "p")

    def holds(near: DataFrame) -> DataFrame:
        near = common.written(near, "line-pairs")
        asked = near.select(F.col("u").alias("node")).union(near.select("v")).distinct().join(forms.select("node", "a", "b"), "node")
        text = common.written(_with_counts(_forms_of(asked, docs).select("node", "form").dropDuplicates(["node"])), "line-forms")

        def allowed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in batches:
                if len(p):
                    x, y = (np.frombuffer(b"".join(p[c]), np.uint8).reshape(len(p), -1).astype(np.int16) for c in ("xc", "yc"))
                    yield p.loc[counts_allow(x, y, np.floor(np.maximum(p["xn"], p["yn"]).to_numpy() * (1 - similarity) + 1e-9)), ["u", "v"]]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in batches:
                yield p.loc[alike_pairs(list(p["x"]), list(p["y"]), similarity), ["u", "v"]]

        x, y = (text.select(F.col("node").alias(n), F.col("counts").alias(f"{c}c"), F.col("n").alias(f"{c}n")) for n, c in (("u", "x"), ("v", "y")))
        every, near = near, common.written(near.join(x, "u").join(y, "v").mapInPandas(allowed, "u long, v long"), "line-pairs")
        x, y = text.select(F.col("node").alias("u"), F.col("form").alias("x")), text.select(F.col("node").alias("v"), F.col("form").alias("y"))
        out = common.written(near.join(x, "u").join(y, "v").mapInPandas(run, "u long, v long"), "line-links")
        common.discard(every, near, text)
        return out

    def nodes(pairs: DataFrame) -> DataFrame:
        one = lambda n: named.select(F.col("a").alias(f"a_{n}"), F.col("node").alias(n))
        return pairs.distinct().join(one("u"), "a_u").join(one("v"), "a_v").select("u", "v")

    # large buckets: their least is found by partial minima, in a join that may be split each member meets it
    least = members.groupBy("key").agg(F.min(F.struct("a", "p")).alias("least"))
    star = members.join(common.maybe_broadcast(least), "key").where("a <> least.a")
    star = star.where(may_be_near(F.col("least.p"), F.col("p"), similarity)).select(F.col("least.a").alias("a_u"), F.col("a").alias("a_v"))
    links = holds(nodes(found.where(f"kind = {STAR}").select(F.col("u").alias("a_u"), F.col("v").alias("a_v")).union(star)))
    linked = components(links)
    of = common.written(linked.join(named, "node").select("a", "component"), "form-components")
    here = lambda df, n: df.join(common.maybe_broadcast(of.select(F.col("a").alias(f"a_{n}"), F.col("component").alias(f"c_{n}"))), f"a_{n}", "left")
    placed = named.join(linked, "node", "left").select("a", "node", F.coalesce("component", "node").alias("c"))
    grouped = common.written(members.join(placed, "a").select("key", "node", "p", "c"), "line-members")
    rest = bucket_rest(grouped, forms, docs, similarity)
    common.discard(grouped)
    pairs = found.where(f"kind = {INNER}").select(F.col("u").alias("a_u"), F.col("v").alias("a_v")).distinct()
    apart = F.coalesce("c_u", "a_u") != F.coalesce("c_v", "a_v")
    more = holds(nodes(here(here(pairs, "u"), "v").where(apart).select("a_u", "a_v")))
    common.discard(of, found)
    found = linked
    if not (more.isEmpty() and rest.isEmpty()):
        found = components(links.union(more).union(rest))
        common.discard(linked)
    # of a group the form that the least id has stays, where that document has it first; the group's other forms go
    linked = forms.join(found, "node").select("a", "b", "doc_id", "component")
    keep = linked.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("_n"), "doc_id", "a", "b")).alias("k"))
    mine = (F.col("a") == F.col("k.a")) & (F.col("b") == F.col("k.b"))
    groups = linked.join(keep, "component").select("a", "b", mine.alias("stays"), F.col("k.doc_id").alias("first"))
    alone = forms.where("n > 1").join(found, "node", "left_anti").select("a", "b", F.lit(True).alias("stays"), F.col("doc_id").alias("first"))
    gone = lines.where("not again").join(groups.union(alone), ["a", "b"]).where(~(F.col("stays") & F.col("doc_id").eqNullSafe(F.col("first"))))
    gone = gone.select("doc_id", "_k", "line").union(lines.where("again").select("doc_id", "_k", "line"))
    out = common.written(gone.groupBy("doc_id", "_k").agg(F.collect_set("line").alias("gone")), "gone")
    common.discard(lines, forms, found, links, more, rest)
    return out


def deduplicate(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with the text rebuilt from the lines that stay, and two columns, _n_lines and _n_removed."""
    gone = removed_lines(docs, similarity)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    out = docs.select(row, *_key(), "text").alias("d").join(gone.hint("shuffle_hash").alias("g"), _same("d", "g"), "left")
    lines = F.split(F.col("d.text"), "\n")
    stay = F.filter(lines, lambda x, i: ~F.array_contains(F.col("g.gone"), i))
    text = F.when(F.col("g.gone").isNull(), F.col("d.text")).otherwise(F.array_join(stay, "\n"))
    columns = [text.alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in ("_n_lines", "_n_removed")]
    return out.select(
        *columns,
        F.when(F.col("d.text").isNotNull(), F.size(lines)).otherwise(0).cast("long").alias("_n_lines"),
        F.when(F.col("g.gone").isNotNull(), F.size("g.gone")).otherwise(0).cast("long").alias("_n_removed"),
    )
