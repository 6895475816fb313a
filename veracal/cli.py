"""``python -m veracal``: artifact, dataset, score, evaluate, recalibrate, train."""

from __future__ import annotations

import argparse
import json
import sys


def _session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("veracal").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _emit(value, path: str) -> None:
    text = json.dumps(value, ensure_ascii=False, indent=2, default=str)
    if path == "-":
        print(text)
    else:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text + "\n")


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("veracal")
    top = p.add_subparsers(dest="verb", required=True)

    def dataset_options(q):
        q.add_argument("--input", required=True)
        q.add_argument("--composition", default="auto")
        q.add_argument("--representation_fingerprint")

    def model_options(q):
        q.add_argument("--model", required=True)
        q.add_argument("--estimator", default="centroid", choices=("centroid", "lower"))
        q.add_argument("--strategy", default="arrow", choices=("arrow", "sql"))
        q.add_argument("--no_verify_checksums", action="store_true")

    a = top.add_parser("artifact").add_subparsers(dest="what", required=True)
    for n in ("validate", "inspect"):
        q = a.add_parser(n)
        q.add_argument("--model", required=True)
        q.add_argument("--output", default="-")
        q.add_argument("--no_verify_checksums", action="store_true")
    d = top.add_parser("dataset").add_subparsers(dest="what", required=True)
    for n in ("inspect", "validate"):
        q = d.add_parser(n)
        q.add_argument("--input", required=True)
        q.add_argument("--output", default="-")
    q = d.add_parser("convert")
    q.add_argument("--input", required=True)
    q.add_argument("--output", required=True)
    q.add_argument("--class_names")
    q.add_argument("--representation_fingerprint")
    q.add_argument("--overwrite", action="store_true")
    q = d.add_parser("export-sources")
    q.add_argument("--model", required=True)
    q.add_argument("--training")
    q.add_argument("--calibration")
    q.add_argument("--role", required=True)
    q.add_argument("--output", required=True)
    q.add_argument("--composition", default="auto")
    q.add_argument("--text_only", action="store_true")
    q.add_argument("--overwrite", action="store_true")
    q = top.add_parser("score")
    model_options(q)
    dataset_options(q)
    q.add_argument("--output", default="-")
    q.add_argument("--detail", default="full", choices=("full", "compact"))
    q.add_argument("--nearest_exemplars", type=int, default=25)
    q = top.add_parser("evaluate")
    model_options(q)
    dataset_options(q)
    q.add_argument("--output", default="-")
    q.add_argument("--histogram_bins", type=int, default=10)
    q = top.add_parser("recalibrate")
    q.add_argument("--model", required=True)
    q.add_argument("--output", required=True)
    q.add_argument("--alpha_resolution", type=float, default=0.05)
    q.add_argument("--report_output", default="-")
    q.add_argument("--overwrite", action="store_true")
    q = top.add_parser("train")
    q.add_argument("--training", required=True)
    q.add_argument("--calibration", required=True)
    q.add_argument("--output", required=True)
    q.add_argument("--number_of_classes", type=int, required=True)
    q.add_argument("--class_names")
    q.add_argument("--composition", default="auto")
    q.add_argument("--representation_fingerprint", default="")
    q.add_argument("--exemplar_dimension", type=int, default=1000)
    q.add_argument("--epochs", type=int, default=20)
    q.add_argument("--cross_entropy_epochs", type=int, default=1)
    q.add_argument("--initial_model")
    q.add_argument("--batch_size", type=int, default=64)
    q.add_argument("--learning_rate", type=float, default=1e-5)
    q.add_argument("--seed", type=int, default=0)
    q.add_argument("--number_of_random_shuffles", type=int, default=1)
    q.add_argument("--max_neighbors", type=int, default=2048)
    q.add_argument("--alpha_resolution", type=float, default=0.05)
    q.add_argument("--do_not_shuffle_data", action="store_true")
    q.add_argument("--overwrite", action="store_true")
    return p


def _names(text: str | None) -> list[str] | None:
    return [x.strip() for x in text.split(",")] if text else None


def _run(o: argparse.Namespace) -> None:
    from pyspark.sql import functions as F

    from .controller import Controller, SelectionPolicy
    from .operators import datasets, training
    from .plans import documents
    from .sources import artifact, bundle

    spark = _session()
    if o.verb == "artifact":
        m = artifact.load_artifact(spark, o.model, not o.no_verify_checksums)
        _emit({"valid": True, "modelID": m.model_id} if o.what == "validate" else artifact.inspect(m), o.output)
    elif o.verb == "dataset" and o.what in ("inspect", "validate"):
        rows = bundle.read_dataset(spark, o.input).drop("embedding").withColumnRenamed("x", "embedding")
        datasets.require_valid(rows)
        facts = datasets.validation(rows).first().asDict()
        labels = {str(r["label"]): r["n"] for r in datasets.label_histogram(rows).collect()}
        _emit({"valid": True} | (facts | {"labels": labels} if o.what == "inspect" else {}), o.output)
    elif o.verb == "dataset" and o.what == "convert":
        rows = bundle.read_dataset(spark, o.input)
        rows = rows.withColumn("label", F.coalesce("label", F.lit(-1)))
        if o.representation_fingerprint:
            rows = rows.withColumn("fingerprint", F.lit(o.representation_fingerprint))
        if o.output.endswith(".jsonl"):
            bundle.write_jsonl(rows, o.output, o.overwrite)
        else:
            r = {"fingerprint": o.representation_fingerprint} if o.representation_fingerprint else None
            bundle.write_bundle(rows, o.output, _names(o.class_names), r, overwrite=o.overwrite)
    elif o.verb == "dataset":
        m = artifact.load_artifact(spark, o.model)
        parts = [bundle.read_dataset(spark, p, o.composition) for p in (o.training, o.calibration) if p]
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        out = documents.export_sources(m, rows, o.role)
        out = out.drop("embedding", "attributes") if o.text_only else out
        meta = {"modelSource": {"schemaVersion": 1, "modelID": m.model_id, "modelFiles": artifact.file_digests(o.model), "role": o.role}}
        bundle.write_bundle(out, o.output, m.class_names, {"fingerprint": m.fingerprint} if m.fingerprint else None, meta, o.overwrite)
    elif o.verb in ("score", "evaluate"):
        c = Controller.load(spark, o.model, SelectionPolicy(estimator=o.estimator), not o.no_verify_checksums)
        c.model.check(o.representation_fingerprint)
        rows = bundle.read_dataset(spark, o.input, o.composition)
        if o.verb == "score":
            documents.write_scored(documents.score_documents(c.model, rows, o.detail, o.nearest_exemplars, strategy=o.strategy), o.output)
        else:
            scored = c.score(rows, strategy=o.strategy).persist()
            _emit({"evaluation": c.evaluate(scored), "distribution": c.summarize(scored, o.histogram_bins)}, o.output)
    elif o.verb == "recalibrate":
        m = artifact.load_artifact(spark, o.model).recalibrated(o.alpha_resolution)
        artifact.write_artifact(m, o.output, o.overwrite)
        _emit(artifact.inspect(m), o.report_output)
    else:
        config = training.Config(o.number_of_classes, o.exemplar_dimension, o.epochs, o.batch_size, o.learning_rate, o.seed, o.max_neighbors, resolution=o.alpha_resolution, cross_entropy_epochs=o.cross_entropy_epochs)
        start = artifact.load_artifact(spark, o.initial_model) if o.initial_model else None
        t, c = (bundle.read_dataset(spark, p, o.composition) for p in (o.training, o.calibration))
        m = training.train(t, c, config, _names(o.class_names), o.number_of_random_shuffles, not o.do_not_shuffle_data, start, o.representation_fingerprint)
        artifact.write_artifact(m, o.output, o.overwrite)
        _emit(artifact.inspect(m), "-")


def main(argv: list[str] | None = None) -> int:
    """0, or 2 after an expected error, which is told in one line."""
    o = _parser().parse_args(argv)
    try:
        _run(o)
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    except Exception as e:
        if type(e).__module__.startswith("pyspark"):
            print(f"error: {str(e).splitlines()[0]}", file=sys.stderr)
            return 2
        raise
    return 0
