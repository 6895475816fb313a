"""Dataset bundles: a folder with a manifest, JSON Lines rows and float matrices, read in row ranges, written row by row on the driver.

``read_bundle`` gives rows in order (row_idx) with typed columns and all other keys as JSON text in ``extra``.  The bundle's
folder must be visible to the driver and all executors, as the format is a plain folder of files."""

from __future__ import annotations

import ast
import os
import shutil
import struct
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import strict
from .strict import FormatError

# Fixed values of the format.
MATRICES = {"embedding": "embeddings.npy", "attributes": "attributes.npy"}
ROWS = "rows.jsonl"
MANIFEST = "manifest.json"
REFERENCES = {"embedding": "embeddingRow", "attributes": "attributesRow"}
MOST_HEADER = 65_536
MOST_MANIFEST = 8 << 20

SCHEMA = T.StructType(
    [
        T.StructField("row_idx", T.LongType(), False),
        T.StructField("id", T.StringType()),
        T.StructField("label", T.LongType()),
        T.StructField("document", T.StringType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("attributes", T.ArrayType(T.FloatType())),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("metadata", T.StringType()),
        T.StructField("extra", T.StringType()),
    ]
)
_OWN = {"id", "label", "document", "prompt", "embedding", "attributes", "metadata", "representationFingerprint"}


def matrix_header(path: str | Path) -> tuple[int, int, int]:
    """(rows, columns, offset of the numbers) of a matrix file in the restricted NPY profile."""
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        if f.read(6) != b"\x93NUMPY":
            raise FormatError(f"{path} is no NPY file")
        major = f.read(2)[0]
        if major not in (1, 2, 3):
            raise FormatError(f"{path}: unknown NPY version {major}")
        (n,) = struct.unpack("<H", f.read(2)) if major == 1 else struct.unpack("<I", f.read(4))
        if n > MOST_HEADER:
            raise FormatError(f"{path}: the header is too long")
        text, offset = f.read(n), f.tell()
    try:
        header = ast.literal_eval(text.decode("utf-8" if major == 3 else "latin-1").strip())
    except (ValueError, SyntaxError):
        raise FormatError(f"{path}: unreadable header") from None
    if not isinstance(header, dict) or set(header) != {"descr", "fortran_order", "shape"} or header["descr"] != "<f4" or header["fortran_order"] is not False:
        raise FormatError(f"{path}: only row-major little-endian single precision is allowed")
    shape = header["shape"]
    if not isinstance(shape, tuple) or len(shape) != 2 or any(not isinstance(x, int) or isinstance(x, bool) or x < 1 for x in shape):
        raise FormatError(f"{path}: the shape must be two positive integers")
    if size != offset + 4 * shape[0] * shape[1]:
        raise FormatError(f"{path}: the file's length does not fit its shape")
    return shape[0], shape[1], offset


def check_finite(path: str | Path, rows: int, columns: int, offset: int) -> None:
    m = np.memmap(path, "<f4", "r", offset, (rows * columns,))
    for i in range(0, len(m), 2 << 20):
        if not np.isfinite(m[i : i + (2 << 20)]).all():
            raise FormatError(f"{path} holds values that are not finite")


def open_manifest(path: str, verify: bool = True) -> dict:
    """The checked manifest of a bundle."""
    folder = Path(path)
    file = strict.member(folder, MANIFEST)
    if file.stat().st_size > MOST_MANIFEST:
        raise FormatError("the manifest is too long")
    m = strict.loads(file.read_bytes())
    if not isinstance(m, dict) or m.get("schemaVersion") != 1 or not str(m.get("format", "")).endswith("-dataset"):
        raise FormatError("no dataset manifest of version 1")
    count = m.get("rowCount")
    if not isinstance(count, int) or isinstance(count, bool) or count < 1:
        raise FormatError("rowCount must be a positive integer")
    entries = [("rows", m.get("rows"), ROWS), *[(k, v, MATRICES.get(k)) for k, v in (m.get("matrices") or {}).items()]]
    for name, entry, expected in entries:
        if expected is None or not isinstance(entry, dict) or entry.get("path") != expected:
            raise FormatError(f"the entry {name} is not allowed")
        p = strict.member(folder, expected)
        if verify and strict.digest(p) != entry.get("sha256"):
            raise FormatError(f"{expected} does not have the recorded digest")
        if name != "rows":
            rows, columns, offset = matrix_header(p)
            if entry.get("dtype") != "<f4" or list(entry.get("shape") or ()) != [rows, columns]:
                raise FormatError(f"{expected} is not what the manifest says")
            if verify:
                check_finite(p, rows, columns, offset)
    names = m.get("classNames")
    if names is not None and (not isinstance(names, list) or len(names) < 2 or len(set(names)) != len(names) or any(not isinstance(x, str) or not x or x != x.strip() for x in names)):
        raise FormatError("class names must be at least two, distinct and not empty")
    return m


def fingerprint_of(row: dict) -> str | None:
    """The row's representation: its own key, or else the metadata's."""
    if "representationFingerprint" in row:
        value = row["representationFingerprint"]
    elif isinstance(row.get("metadata"), dict) and "representationFingerprint" in row["metadata"]:
        value = row["metadata"]["representationFingerprint"]
    else:
        return None
    if not isinstance(value, str) or not value:
        raise FormatError("a representation fingerprint must be a string that is not empty")
    return value


def vector(value, name: str) -> list[float] | None:
    """A float vector of JSON numbers that stay finite in single precision."""
    if value is None:
        return None
    if not isinstance(value, list) or not value or any(isinstance(x, bool) or not isinstance(x, (int, float)) for x in value):
        raise FormatError(f"{name} must be numbers")
    with np.errstate(over="ignore"):
        v = np.asarray(value, np.float64).astype(np.float32)
    if not np.isfinite(v).all():
        raise FormatError(f"{name} is not finite in single precision")
    return v.tolist()


def check_logits(row: dict) -> None:
    if "logits" in row and "sourceLogits" in row:
        raise FormatError("logits and sourceLogits cannot both be there")
    for k in ("logits", "sourceLogits"):
        if k in row and (not isinstance(row[k], list) or len(row[k]) < 2 or vector(row[k], k) is None):
            raise FormatError(f"{k} must be two numbers or more")


def typed(row: dict, index: int, embedding=None, attributes=None, require_label: bool = False) -> tuple:
    """One row in the order of SCHEMA."""
    id_, label = row.get("id"), row.get("label", None if require_label else -1)
    if not isinstance(id_, str) or not id_:
        raise FormatError(f"row {index}: the id must be a string that is not empty")
    if isinstance(label, bool) or not isinstance(label, int) or label < -1 and label != -99:
        raise FormatError(f"row {index}: the label must be a class index, -1 or -99")
    for k in ("document", "prompt"):
        if row.get(k) is not None and not isinstance(row[k], str):
            raise FormatError(f"row {index}: {k} must be text or null")
    if row.get("metadata") is not None and not isinstance(row["metadata"], dict):
        raise FormatError(f"row {index}: metadata must be an object")
    check_logits(row)
    rest = {k: v for k, v in row.items() if k not in _OWN and k not in REFERENCES.values()}
    return (
        index, id_, label, row.get("document"), row.get("prompt"),
        embedding if embedding is not None else vector(row.get("embedding"), "embedding"),
        attributes if attributes is not None else vector(row.get("attributes"), "attributes"),
        fingerprint_of(row), strict.dumps(row["metadata"]) if row.get("metadata") is not None else None, strict.dumps(rest) if rest else None,
    )


def frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=SCHEMA.names)
    return out.astype({"row_idx": "int64"})


def line_ranges(path: str | Path, bytes_each: int = 32 << 20) -> list[tuple[int, int, int, int, int]]:
    """(first row, byte start, byte end, embedding rows before, attribute rows before) for pieces of a JSON Lines file; one
    sequential pass that counts rows and references by their keys."""
    out, start, first, rows = [], 0, 0, 0
    seen = {"embeddingRow": 0, "attributesRow": 0}
    before = dict(seen)
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                rows += 1
                for k in seen:
                    seen[k] += f'"{k}"'.encode() in line
            if f.tell() - start >= bytes_each:
                out.append((first, start, f.tell(), before["embeddingRow"], before["attributesRow"]))
                start, first, before = f.tell(), rows, dict(seen)
        if f.tell() > start:
            out.append((first, start, f.tell(), before["embeddingRow"], before["attributesRow"]))
    return out


def read_bundle(spark: SparkSession, path: str, verify: bool = True) -> DataFrame:
    """The rows of a bundle, in parallel; references to matrix rows must run 0, 1, .. in row order."""
    m = open_manifest(path, verify)
    heads = {k: matrix_header(Path(path) / MATRICES[k]) for k in m.get("matrices") or {}}
    default = (m.get("representation") or {}).get("fingerprint")
    pieces = line_ranges(Path(path) / ROWS)
    todo = spark.createDataFrame([(i, *p) for i, p in enumerate(pieces)], "n int, first long, start long, end long, e long, a long")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        maps = {k: np.memmap(Path(path) / MATRICES[k], "<f4", "r", o, (r, c)) for k, (r, c, o) in heads.items()}
        for b in batches:
            for t in b.itertuples(index=False):
                at = {"embedding": t.e, "attributes": t.a}
                with open(Path(path) / ROWS, "rb") as f:
                    f.seek(t.start)
                    lines = [x for x in f.read(t.end - t.start).split(b"\n") if x.strip()]
                rows = []
                for i, line in enumerate(lines, t.first):
                    row, got = strict.loads(line), {}
                    for k, ref in REFERENCES.items():
                        if k in row:
                            raise FormatError(f"row {i}: {k} must be in its matrix")
                        if ref in row:
                            if k not in maps or row[ref] != at[k]:
                                raise FormatError(f"row {i}: {ref} must be {at[k]}")
                            got[k] = maps[k][at[k]].tolist()
                            at[k] += 1
                    rows.append(typed(row, i, **got))
                yield frame(rows)

    out = todo.repartition(max(1, len(pieces)), "n").mapInPandas(run, SCHEMA)
    if default:
        same = F.assert_true(F.coalesce(F.col("fingerprint"), F.lit(default)) == default, F.lit("a row is represented otherwise than its bundle"))
        out = out.withColumn("fingerprint", F.when(same.isNull(), F.lit(default)))
    return out


def read_jsonl(spark: SparkSession, path: str, composition: str = "auto", require_labels: bool = False, dimension: int | None = None, classes: int | None = None, fingerprint: str | None = None) -> DataFrame:
    """Feature-ready rows of a JSON Lines file (any path that Spark reads); blank lines are skipped, row_idx is their order.

    Columns as ``read_bundle`` and ``x``.  A repeated key keeps its last value here."""
    import json

    from ..operators.features import compose

    lines = spark.read.text(path).where(F.trim("value") != "")
    lines = lines.select(F.monotonically_increasing_id().alias("row_idx"), "value")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, v in zip(b["row_idx"], b["value"]):
                try:
                    row = json.loads(v)
                except json.JSONDecodeError as e:
                    raise FormatError(f"no valid JSON: {e}") from None
                if not isinstance(row, dict):
                    raise FormatError("each line must be an object")
                rows.append(typed(row, i, require_label=require_labels))
            yield frame(rows)

    out = compose(lines.mapInPandas(run, SCHEMA), composition)
    ok = F.col("x").isNotNull()
    if dimension:
        ok = ok & (F.size("x") == dimension)
    if classes:
        ok = ok & ((F.col("label") < classes))
    if fingerprint:
        ok = ok & (F.coalesce("fingerprint", F.lit(fingerprint)) == fingerprint)
    checked = F.assert_true(F.coalesce(ok, F.lit(False)), F.concat(F.lit("features, label or representation do not fit: "), "id"))
    return out.withColumn("x", F.when(checked.isNull(), F.col("x")))


def read_dataset(spark: SparkSession, path: str, composition: str = "auto", **options) -> DataFrame:
    """A bundle (a folder) or a JSON Lines file, with ``x``."""
    from ..operators.features import compose

    local = path.removeprefix("file://")
    if os.path.isdir(local) and os.path.exists(os.path.join(local, MANIFEST)):
        return compose(read_bundle(spark, local), composition)
    return read_jsonl(spark, path, composition, **options)


def to_json_row(r: dict, features: bool = True) -> dict:
    """A row of SCHEMA as the JSON object it stands for."""
    import json

    out = {"id": r["id"], "label": int(r["label"])}
    for k in ("document", "prompt"):
        if r.get(k) is not None:
            out[k] = r[k]
    if features:
        out |= {k: [float(x) for x in r[k]] for k in MATRICES if r.get(k) is not None}
    if r.get("metadata") is not None:
        out["metadata"] = json.loads(r["metadata"])
    if r.get("fingerprint") is not None:
        out["representationFingerprint"] = r["fingerprint"]
    return out | (json.loads(r["extra"]) if r.get("extra") is not None else {})


def write_bundle(df: DataFrame, path: str, class_names: list[str] | None = None, representation: dict | None = None, metadata: dict | None = None, overwrite: bool = False, format_name: str = "vector-dataset") -> None:
    """Write rows (columns of SCHEMA, any of them absent) in order of row_idx as a bundle.

    Rows stream to the driver partition by partition, the folder is built beside its place and renamed at the end, so readers
    never see half of it; an existing bundle stays until then."""
    target = Path(path)
    if target.is_symlink() or target.exists() and not overwrite:
        raise FileExistsError(path)
    stage = target.parent / f".{target.name}-{uuid.uuid4().hex}"
    stage.mkdir(parents=True)
    try:
        counts, widths, files = {}, {}, {}
        ids: set[str] = set()
        n = 0
        with open(stage / ROWS, "w", encoding="utf-8") as out:
            for r in df.orderBy("row_idx").toLocalIterator(prefetchPartitions=True):
                row = r.asDict(recursive=True)
                if row["id"] in ids:
                    raise FormatError(f"the id {row['id']!r} stands twice")
                ids.add(row["id"])
                o = to_json_row(row, features=False)
                for k in MATRICES:
                    if row.get(k) is not None:
                        v = np.asarray(row[k], "<f4")
                        if k not in files:
                            files[k], widths[k], counts[k] = open(stage / f"{k}.raw", "wb"), len(v), 0  # noqa: SIM115
                        if len(v) != widths[k] or not np.isfinite(v).all():
                            raise FormatError(f"{k} of {row['id']!r} has another dimension or is not finite")
                        files[k].write(v.tobytes())
                        o[REFERENCES[k]] = counts[k]
                        counts[k] += 1
                out.write(strict.dumps(o) + "\n")
                n += 1
        if not n:
            raise FormatError("a bundle needs rows")
        matrices = {}
        for k, f in files.items():
            f.close()
            name = MATRICES[k]
            with open(stage / name, "wb") as out, open(stage / f"{k}.raw", "rb") as raw:
                np.lib.format.write_array_header_1_0(out, {"descr": "<f4", "fortran_order": False, "shape": (counts[k], widths[k])})
                shutil.copyfileobj(raw, out, 8 << 20)
            os.remove(stage / f"{k}.raw")
            matrices[k] = {"path": name, "dtype": "<f4", "shape": [counts[k], widths[k]], "sha256": strict.digest(stage / name)}
        manifest = {"format": format_name, "schemaVersion": 1, "rowCount": n, "rows": {"path": ROWS, "sha256": strict.digest(stage / ROWS)}, "matrices": matrices}
        manifest |= {k: v for k, v in (("classNames", class_names), ("representation", representation), ("metadata", metadata)) if v}
        (stage / MANIFEST).write_text(strict.dumps(manifest), encoding="utf-8")
        publish(stage, target)
    finally:
        shutil.rmtree(stage, ignore_errors=True)


def publish(stage: Path, target: Path) -> None:
    """Put a finished folder in its place; what was there comes back if that fails."""
    old = target.parent / f".{target.name}-old-{uuid.uuid4().hex}"
    if target.exists():
        target.rename(old)
    try:
        stage.rename(target)
    except OSError:
        if old.exists():
            old.rename(target)
        raise
    shutil.rmtree(old, ignore_errors=True)


def write_jsonl(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Rows in order of row_idx as JSON Lines, in place only when complete."""
    target = Path(path)
    if target.exists() and not overwrite:
        raise FileExistsError(path)
    stage = target.parent / f".{target.name}-{uuid.uuid4().hex}"
    try:
        with open(stage, "w", encoding="utf-8") as out:
            for r in df.orderBy("row_idx").toLocalIterator(prefetchPartitions=True):
                out.write(strict.dumps(to_json_row(r.asDict(recursive=True))) + "\n")
        stage.replace(target)
    finally:
        stage.unlink(missing_ok=True)
