"""Secret scans.

Base kinds are patterns: ``assign`` (a key name, a sign and a value of 8 or more characters), ``access`` (an access key id)
and ``hex`` (32 or more hexadecimal digits), leftmost and non-overlapping for each kind; a match too short is dropped after
matching, so it still hides what it covers.

The method adds the kind ``entropy``: candidate strings are runs of ``[A-Za-z0-9+/_-]`` of ``MIN_RUN`` or more characters
with at least two of the classes lower case, upper case and digit.  A window of ``WINDOW`` characters slides over each
candidate; character counts change by one in and one out, and the entropy with them.  A window counts if its entropy reaches
the threshold of the candidate's class (hexadecimal, alphanumeric, base64); the span runs from the first such window's start
to the last one's end.  Allow-listed strings add nothing: UUIDs, paths and words joined by signs, runs of one repeated
unit, and anything a base span already covers.

Null is the empty text.  Texts are never cut, one output row for each input row, no shuffle.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
#: Of these one stands in every match of ASSIGN; looking for them is faster than the pattern.
NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

WINDOW = 20
MIN_RUN = 20
RUN = re.compile(r"[A-Za-z0-9+/_-]{%d,}" % MIN_RUN)
#: Bits a character that a window must reach, by class; a window of 20 has 4.32 at most, of hexadecimal digits 3.92.
THRESHOLDS = {"hex": 3.0, "alnum": 3.6, "base64": 3.7}
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
#: Between signs, parts that read as words or plain numbers: paths, slugs, rules of dashes.
PLAIN = re.compile(r"[A-Za-z]?[a-z]*|[A-Z]+|[0-9]+")
SIGNS = re.compile(r"[+/_-]+")
_TERM = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]


def entropies(s: str, window: int = WINDOW) -> list[float]:
    """The Shannon entropy of every window of ``s``, by counts that change by one in and one out."""
    term = _TERM if window == WINDOW else [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    counts: dict[str, int] = {}
    total, out, bits = 0.0, [], math.log2(window)
    for i, c in enumerate(s):
        if i >= window:
            gone = s[i - window]
            n = counts[gone]
            total += term[n - 1] - term[n]
            counts[gone] = n - 1
        n = counts.get(c, 0)
        total += term[n + 1] - term[n]
        counts[c] = n + 1
        if i >= window - 1:
            out.append(bits - total / window)
    return out


def allowed(s: str) -> bool:
    """Strings that look random to a window but are not secrets."""
    return bool(UUID.fullmatch(s)) or all(map(PLAIN.fullmatch, SIGNS.split(s))) or repeats(s)


def repeats(s: str) -> bool:
    """Whether the string is one unit several times; by the lengths of its borders, in linear time."""
    border = [0] * len(s)
    k = 0
    for i in range(1, len(s)):
        while k and s[i] != s[k]:
            k = border[k - 1]
        k += s[i] == s[k]
        border[i] = k
    unit = len(s) - k
    return unit < len(s) and len(s) % unit == 0


def classify(s: str) -> str:
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s):
        return "hex"
    return "alnum" if s.isalnum() else "base64"


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of all spans, in order."""
    low = text.encode().lower()  # of bytes: only ASCII letters change
    spans = []
    if any(n in low for n in NAMES):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= 8]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    runs = [m.span() for m in RUN.finditer(text)]
    if runs:  # 32 hexadecimal digits are a run too
        spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base = sorted(spans)
    for a, b in runs:
        s = text[a:b]
        if sum(map(bool, (re.search("[a-z]", s), re.search("[A-Z]", s), re.search("[0-9]", s)))) < 2 or allowed(s):
            continue
        if any(x <= a and b <= y for x, _, y in base):
            continue
        least = THRESHOLDS[classify(s)]
        hits = [i for i, e in enumerate(entropies(s)) if e >= least]
        if hits:
            spans.append((a + hits[0], 3, a + hits[-1] + WINDOW))
    return sorted(spans)


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id and ``found``: array of (kind, start, end) in order of start, then kind; code points, end exclusive."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in scan(t)] for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "found": found})

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", common.text_of().alias("text"))
    return rows.mapInPandas(run, f"doc_id {kind}, found array<struct<kind:string,start:long,end:long>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as text."""
    line = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    joined = lambda c: F.array_join(F.transform(c, line), ",")
    base = F.filter("found", lambda x: x["kind"] != "entropy")

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts[:3], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), counts[3])
