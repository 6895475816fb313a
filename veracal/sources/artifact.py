"""Model artifacts: a folder with a manifest, the adaptor's weights, the support and, if kept, calibration rows."""

from __future__ import annotations

import datetime
import json
import math
import shutil
import unicodedata
import uuid
from pathlib import Path

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import __version__
from ..functions.scores import ladder
from ..plans.model import Model
from . import strict
from .bundle import publish
from .strict import FormatError

# Fixed values of the format.
FILES = {"manifest": "manifest.json", "weights": "weights.f32", "support": "support.f32", "records": "support.jsonl", "calibration": "calibration.jsonl"}
METRIC, TIES = "squaredL2", "supportIndexAscending"
MOST_MANIFEST = 4 << 30
MOST_ELEMENTS = 2_000_000_000

SUPPORT = T.StructType(
    [
        T.StructField("support_idx", T.LongType()), T.StructField("id", T.StringType()), T.StructField("label", T.LongType()),
        T.StructField("predicted_label", T.LongType()), T.StructField("document", T.StringType()), T.StructField("metadata", T.StringType()),
        T.StructField("exemplar", T.ArrayType(T.DoubleType())),
    ]
)
CALIBRATION = T.StructType(
    [
        T.StructField("cal_idx", T.LongType()), T.StructField("id", T.StringType()), T.StructField("label", T.LongType()),
        T.StructField("prediction", T.LongType()), T.StructField("sdm", T.ArrayType(T.DoubleType())), T.StructField("q_prime", T.DoubleType()),
        T.StructField("q", T.LongType()), T.StructField("d0", T.DoubleType()), T.StructField("d", T.DoubleType()), T.StructField("z", T.ArrayType(T.DoubleType())),
    ]
)


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise FormatError(what)


def _int(x, least: int = 0) -> bool:
    return isinstance(x, int) and not isinstance(x, bool) and x >= least


def _real(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x)


def validate_manifest(m: dict) -> None:
    """Raise unless the manifest is complete and consistent in itself."""
    _need(isinstance(m, dict) and m.get("schemaVersion") == 1, "no model manifest of version 1")
    _need(isinstance(m.get("modelID"), str) and bool(m["modelID"]), "the model needs an id")
    try:
        _need(datetime.datetime.fromisoformat(m["createdAt"].replace("Z", "+00:00")).tzinfo is not None, "createdAt needs an offset")
    except (KeyError, AttributeError, ValueError) as e:
        raise FormatError("createdAt must be a time") from e
    c = m.get("configuration")
    _need(isinstance(c, dict), "there is no configuration")
    classes, k = c.get("numberOfClasses"), c.get("maxNeighbors")
    _need(_int(classes, 2), "there must be two classes or more")
    names = c.get("classNames")
    _need(isinstance(names, list) and len(names) == classes and all(isinstance(x, str) and x for x in names), "each class needs a name")
    _need(len({unicodedata.normalize("NFC", x) for x in names}) == classes, "class names must be distinct")
    _need(_int(c.get("embeddingDimension"), 1) and _int(c.get("exemplarDimension"), 1) and _int(k, 1), "dimensions and neighbours must be positive")
    _need(_real(c.get("qOffset")) and c["qOffset"] > 1 and _int(c.get("oodLimit")), "qOffset or oodLimit is out of range")
    _need(_real(c.get("alphaResolution")), "alphaResolution must be a number")
    ladder(c["alphaResolution"])
    _need(c.get("distanceMetric") == METRIC and c.get("neighborTieBreak") == TIES, "unknown metric or tie rule")
    n = m.get("normalization") or {}
    _need(_real(n.get("mean")) and _real(n.get("standardDeviation")) and n["standardDeviation"] > 0, "the normalisation is not valid")
    r = m.get("representation")
    _need(isinstance(r, dict) and isinstance(r.get("fingerprint"), str) and bool(r["fingerprint"]), "the representation needs a fingerprint")
    d, e = c["embeddingDimension"], c["exemplarDimension"]
    elements = e * d + e + classes * e + classes
    _need(m.get("weights", {}).get("file") == FILES["weights"] and m["weights"].get("elementCount") == elements <= MOST_ELEMENTS, "the weights entry is wrong")
    s = m.get("support") or {}
    _need(s.get("vectorsFile") == FILES["support"] and s.get("recordsFile") == FILES["records"] and _int(s.get("count"), 1), "the support entry is wrong")
    _need(s["count"] * e <= MOST_ELEMENTS, "the support is too large")
    most = float(np.float32(min(k, s["count"])))
    for key, limit in (("distanceCDFs", math.inf), ("rescaledSimilarityCDFs", most)):
        lists = m.get(key)
        _need(isinstance(lists, list) and len(lists) == classes, f"{key} needs a list for each class")
        for v in lists:
            _need(isinstance(v, list) and all(_real(x) and 0 <= x <= limit for x in v) and all(a <= b for a, b in zip(v, v[1:])), f"{key} must ascend within its range")
    above = 1.0
    for g in m.get("regions", []):
        a, t, q = g.get("alpha"), g.get("outputThresholds"), g.get("minimumRescaledSimilarity")
        _need(_real(a) and 0.5 < a < above, "regions must descend in alpha")
        _need(isinstance(t, list) and len(t) == classes and all(_real(x) and np.float32(x) >= np.float32(a) and x <= 1 for x in t), "a region's thresholds must reach its alpha")
        _need(_real(q) and 0 <= q <= most, "a region's similarity is out of range")
        above = a


def load_artifact(spark: SparkSession, path: str, verify: bool = True) -> Model:
    """The model in a folder.  Weights come to the driver; the support becomes a table."""
    folder = Path(path)
    file = strict.member(folder, FILES["manifest"])
    _need(file.stat().st_size <= MOST_MANIFEST, "the manifest is too long")
    m = strict.loads(file.read_bytes(), canonical=True)
    validate_manifest(m)
    there = {f for f in FILES.values() if f != FILES["manifest"] and (folder / f).exists()}
    sums = m.get("checksums")
    if sums:
        _need(set(sums) == there, "the checksums do not cover the files")
        for f in there if verify else ():
            _need(strict.digest(strict.member(folder, f)) == sums[f], f"{f} does not have the recorded digest")
    c, count = m["configuration"], m["support"]["count"]
    d, e, k = c["embeddingDimension"], c["exemplarDimension"], c["numberOfClasses"]
    w = _floats(strict.member(folder, FILES["weights"]), m["weights"]["elementCount"])
    cuts = np.cumsum([e * d, e, k * e])
    w1, b1, w2, b2 = np.split(w, cuts)
    vectors = _floats(strict.member(folder, FILES["support"]), count * e).reshape(count, e)
    records = [strict.loads(x, canonical=True) for x in strict.member(folder, FILES["records"]).read_bytes().split(b"\n") if x.strip()]
    _need(len(records) == count, "the support records do not match the vectors")
    seen: set[str] = set()
    for r in records:
        _need(isinstance(r.get("id"), str) and bool(r["id"]) and unicodedata.normalize("NFC", r["id"]) not in seen, "support ids must be distinct")
        seen.add(unicodedata.normalize("NFC", r["id"]))
        _need(_int(r.get("label"), -99) and (r["label"] == -99 or 0 <= r["label"] < k) and _int(r.get("predictedLabel")) and r["predictedLabel"] < k, "a support label is out of range")
    rows = [(i, r["id"], r["label"], r["predictedLabel"], r.get("document"), json.dumps(r["metadata"]) if "metadata" in r else None, v.astype(float).tolist()) for i, (r, v) in enumerate(zip(records, vectors))]
    support = spark.createDataFrame(rows, SUPPORT)
    cal = None
    if FILES["calibration"] in there:
        parsed = [_calibration_row(i, strict.loads(x, canonical=True), k, min(c["maxNeighbors"], count)) for i, x in enumerate(x for x in (folder / FILES["calibration"]).read_bytes().split(b"\n") if x.strip())]
        cal = spark.createDataFrame(parsed, CALIBRATION)
    return Model(
        class_names=c["classNames"], support=support, distance_cdfs=m["distanceCDFs"], similarity_cdfs=m["rescaledSimilarityCDFs"],
        regions=[(g["alpha"], g["minimumRescaledSimilarity"], g["outputThresholds"]) for g in m.get("regions", [])],
        weights={"w1": w1.reshape(e, d), "b1": b1, "w2": w2.reshape(k, e), "b2": b2}, mean=m["normalization"]["mean"], std=m["normalization"]["standardDeviation"],
        k=c["maxNeighbors"], q_offset=c["qOffset"], ood_limit=c["oodLimit"], resolution=c["alphaResolution"], fingerprint=m["representation"]["fingerprint"],
        model_id=m["modelID"], calibration=cal, metadata=m.get("metadata", {}), representation=m["representation"], created_at=m["createdAt"],
    )


def _floats(path: Path, n: int) -> np.ndarray:
    _need(path.stat().st_size == 4 * n, f"{path.name} does not have {n} numbers")
    v = np.fromfile(path, "<f4")
    _need(bool(np.isfinite(v).all()), f"{path.name} holds values that are not finite")
    return v


def _calibration_row(i: int, r: dict, classes: int, most: int) -> tuple:
    p, q, z = r.get("sdm"), r.get("q"), r.get("zPrime")
    _need(_int(r.get("label")) and r["label"] < classes and _int(r.get("prediction")) and r["prediction"] < classes, "a calibration label is out of range")
    _need(isinstance(p, list) and len(p) == classes and all(_real(x) and 0 <= x <= 1 for x in p) and abs(sum(p) - 1) <= 1e-5, "calibration probabilities must sum to one")
    _need(_real(r.get("qPrime")) and 0 <= r["qPrime"] <= np.float32(most), "a calibration similarity is out of range")
    _need(q is None or _real(q) and q == int(q) and 0 <= q <= most and r["qPrime"] <= q + 1e-5, "a calibration count is out of range")
    _need(z is None or len(z) == classes and int(np.argmax(np.asarray(z, np.float32))) == r["prediction"], "a calibration prediction does not fit its logits")
    floats = lambda x: None if x is None else [float(v) for v in x]
    one = lambda x: None if x is None else float(x)
    return i, r.get("id"), r["label"], r["prediction"], floats(p), float(r["qPrime"]), None if q is None else int(q), one(r.get("d0")), one(r.get("d")), floats(z)


def write_artifact(model: Model, path: str, overwrite: bool = False, checksums: bool = True) -> None:
    """Write the model as a folder: staged, read back as a check, then put in its place."""
    target = Path(path)
    if target.is_symlink() or target.exists() and not overwrite:
        raise FileExistsError(path)
    if target.exists() and not (target / FILES["manifest"]).is_file():
        raise FormatError(f"{path} is no model; it is not overwritten")
    stage = target.parent / f".{target.name}-{uuid.uuid4().hex}"
    stage.mkdir(parents=True)
    try:
        w = model.weights
        flat = np.concatenate([np.asarray(w[k], "<f4").ravel() for k in ("w1", "b1", "w2", "b2")])
        flat.tofile(stage / FILES["weights"])
        n = 0
        with open(stage / FILES["support"], "wb") as vectors, open(stage / FILES["records"], "w", encoding="utf-8") as records:
            for r in model.support.orderBy("support_idx").toLocalIterator():
                r = r.asDict()
                np.asarray(r["exemplar"], "<f4").tofile(vectors)
                o = {"id": r["id"], "label": int(r["label"]), "predictedLabel": int(r["predicted_label"])}
                o |= {k: v for k, v in (("document", r.get("document")), ("metadata", json.loads(r["metadata"]) if r.get("metadata") else None)) if v is not None}
                records.write(strict.dumps(o) + "\n")
                n += 1
        if model.calibration is not None:
            with open(stage / FILES["calibration"], "w", encoding="utf-8") as out:
                for r in model.calibration.orderBy("cal_idx").toLocalIterator():
                    r = r.asDict()
                    o = {"id": r["id"], "label": int(r["label"]), "prediction": int(r["prediction"]), "sdm": r["sdm"], "qPrime": r["q_prime"]}
                    o |= {k: v for k, v in (("q", r.get("q")), ("d0", r.get("d0")), ("d", r.get("d")), ("zPrime", r.get("z"))) if v is not None}
                    out.write(strict.dumps(o) + "\n")
        e, d = np.asarray(w["w1"]).shape
        manifest = {
            "schemaVersion": 1, "modelID": model.model_id, "createdAt": model.created_at or datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds").replace("+00:00", "Z"),
            "producer": {"name": "veracal", "version": __version__},
            "configuration": {
                "numberOfClasses": model.classes, "classNames": list(model.class_names), "embeddingDimension": d, "exemplarDimension": e, "maxNeighbors": model.k,
                "qOffset": float(model.q_offset), "oodLimit": model.ood_limit, "alphaResolution": model.resolution, "distanceMetric": METRIC, "neighborTieBreak": TIES,
            },
            "normalization": {"mean": float(model.mean), "standardDeviation": float(model.std)},
            "representation": {"provider": "precomputed", "model": None, "revision": None, "inputTemplate": None} | model.representation | {"fingerprint": model.fingerprint or "unspecified"},
            "weights": {"file": FILES["weights"], "elementCount": int(flat.size)},
            "support": {"vectorsFile": FILES["support"], "recordsFile": FILES["records"], "count": n},
            "distanceCDFs": [[float(x) for x in v] for v in model.distance_cdfs], "rescaledSimilarityCDFs": [[float(x) for x in v] for v in model.similarity_cdfs],
            "regions": [{"alpha": a, "minimumRescaledSimilarity": q, "outputThresholds": list(t)} for a, q, t in model.regions],
        }
        if model.metadata:
            manifest["metadata"] = model.metadata
        if checksums:
            manifest["checksums"] = {f: strict.digest(stage / f) for f in FILES.values() if (stage / f).exists()}
        validate_manifest(manifest)
        (stage / FILES["manifest"]).write_text(strict.dumps(manifest), encoding="utf-8")
        load_artifact(model.support.sparkSession, str(stage))
        publish(stage, target)
    finally:
        shutil.rmtree(stage, ignore_errors=True)


def file_digests(path: str) -> dict[str, str]:
    """SHA-256 of every file of a model, for binding other data to exactly this model."""
    return {f: strict.digest(Path(path) / f) for f in FILES.values() if (Path(path) / f).exists()}


def regions_table(model: Model):
    from ..operators.calibration import regions_frame

    return regions_frame(model.support.sparkSession, model.regions)


def inspect(model: Model) -> dict:
    """The model's parameters and sizes."""
    counts = model.support.groupBy("label").agg(F.count("*").alias("n")).collect()
    return {
        "modelID": model.model_id, "classNames": model.class_names, "numberOfClasses": model.classes, "maxNeighbors": model.k, "alphaResolution": model.resolution,
        "regions": [r[0] for r in model.regions], "support": {str(r["label"]): r["n"] for r in counts}, "representationFingerprint": model.fingerprint,
        "calibrationRows": 0 if model.calibration is None else model.calibration.count(),
    }
