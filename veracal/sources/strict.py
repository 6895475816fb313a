"""Strict JSON and path rules that dataset and model files share."""

from __future__ import annotations

import hashlib
import json
import math
import unicodedata
from pathlib import Path

LEAST_INT, MOST_INT = -(2**63), 2**64 - 1
MOST_DEPTH = 64


class FormatError(ValueError):
    """A file that breaks the format's rules."""


def loads(text: str | bytes, canonical: bool = False):
    """JSON without duplicate keys (``canonical``: nor keys equal under NFC), NaN, infinities or integers beyond 64 bits."""

    def pairs(items):
        seen = set()
        for k, _ in items:
            k = unicodedata.normalize("NFC", k) if canonical else k
            if k in seen:
                raise FormatError(f"the key {k!r} stands twice")
            seen.add(k)
        return dict(items)

    def constant(name):
        raise FormatError(f"{name} is no JSON number")

    def integer(digits):
        n = int(digits)
        if canonical and not LEAST_INT <= n <= MOST_INT:
            raise FormatError(f"{digits} does not fit in 64 bits")
        return n

    def number(digits):
        x = float(digits)
        if not math.isfinite(x):
            raise FormatError(f"{digits} is not finite")
        return x

    try:
        out = json.loads(text, object_pairs_hook=pairs, parse_constant=constant, parse_int=integer, parse_float=number)
    except (json.JSONDecodeError, UnicodeDecodeError, RecursionError) as e:
        raise FormatError(f"no valid JSON: {e}") from None
    if depth(out) > MOST_DEPTH:
        raise FormatError(f"nested deeper than {MOST_DEPTH} levels")
    return out


def depth(value) -> int:
    level, todo = 0, [value]
    while todo:
        todo = [y for x in todo if isinstance(x, (dict, list)) for y in (x.values() if isinstance(x, dict) else x)]
        level += 1
        if level > MOST_DEPTH:
            break
    return level


def dumps(value) -> str:
    return json.dumps(value, ensure_ascii=False, allow_nan=False)


def digest(path: str | Path) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


def member(folder: Path, name: str) -> Path:
    """A regular file directly in the folder; no links, no other paths."""
    p = folder / name
    if Path(name).name != name or p.is_symlink() or not p.is_file():
        raise FormatError(f"{name} is not a regular file of {folder}")
    return p
