"""A whole model: scoring, documents, artifacts, bundles, evaluation, training, streams and the command line."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from veracal import cli
from veracal.controller import Controller, SelectionPolicy
from veracal.operators import datasets, evaluation, features, training
from veracal.plans import documents
from veracal.plans.model import Model
from veracal.sources import artifact, bundle, strict
from veracal.streaming import scoring

# An identity adaptor with five support rows, two classes and two regions.
VECTORS = [[1, 0], [2, 0], [0, 1], [0, 2], [4, 4]]
SUPPORT = [(0, 0), (0, 0), (1, 1), (1, 1), (1, 0)]


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, f"s{i}", y, p, None, None, [float(v) for v in x]) for i, (x, (y, p)) in enumerate(zip(VECTORS, SUPPORT))]
    eye = np.eye(2)
    return Model(
        ["A", "B"], spark.createDataFrame(rows, artifact.SUPPORT), [[0.0, 1.0, 4.0]] * 2, [[0.0] * 200 + [1.0] * 200 + [2.0] * 200] * 2,
        [(0.9, 1.0, [0.9, 0.9]), (0.8, 1.0, [0.8, 0.8])], {"w1": eye, "b1": np.zeros(2), "w2": eye, "b2": np.zeros(2)}, k=5, resolution=0.1,
        fingerprint="test-v1", model_id="m1",
    )


def rows(spark, xs, labels=None):
    data = [(i, f"r{i}", (labels or [0] * len(xs))[i], [float(v) for v in x]) for i, x in enumerate(xs)]
    return spark.createDataFrame(data, "row_idx long, id string, label long, x array<double>")


QUERIES = [[2, 0], [0, 1], [0, 0], [4, 4]]


@pytest.mark.parametrize("strategy", ["sql", "arrow"])
def test_scores(spark, model, strategy):
    got = model.score(rows(spark, QUERIES), strategy, nearest=2).orderBy("row_idx").collect()
    a, b, c, d = got
    assert (a["prediction"], a["q"], a["d0"], a["d"], a["q_prime"], a["nearest"]) == (0, 2, 0.0, 1.0, 2.0, 1)
    assert a["sdm"] == pytest.approx([0.9411764740943909, 0.05882352963089943], rel=1e-5)
    assert list(a["n"]) == [600, 600] and a["errors"] == pytest.approx([0.04996442422270775] * 2, rel=1e-5)
    assert a["d_lower"] == pytest.approx(0.950035572052002, rel=1e-5) and a["sdm_lower"] == pytest.approx([0.933021605014801, 0.06697840988636017], rel=1e-5)
    assert (a["centroid_alpha"], a["lower_alpha"], a["in_top_region"], a["in_top_region_lower"]) == (0.9, 0.9, True, True)
    assert (b["prediction"], b["q"], b["centroid_alpha"], b["lower_alpha"], b["d_lower"], b["d_upper"]) == (1, 2, 0.8, 0.0, 0.0, 1.0)
    assert b["sdm_lower"] == [0.5, 0.5] and b["errors"] == [1.0, 1.0]
    assert c["centroid_alpha"] == 0.0 and d["q"] == 0
    assert [m["support_idx"] for m in a["matches"]] == [1, 0]


def test_explicit_exclusion(spark, model):
    q = rows(spark, [[1, 0]]).withColumn("own", F.lit(0).cast("long"))
    r = model.score(q, "sql", exclude="own").first()
    assert r["nearest"] == 1 and r["d0"] == 1.0
    docs = documents.score_documents(model, q.withColumn("document", F.lit("x")), exclude="own")
    o = json.loads(docs.first()["value"])
    assert o["excludedSupportIndex"] == 0 and o["excludedSupportID"] == "s0" and o["scoreSchemaVersion"] == 1


def test_documents(spark, model):
    q = rows(spark, QUERIES).withColumns({"metadata": F.lit('{"source": "x"}'), "extra": F.lit('{"q": 99, "note": 1}')})
    got = [json.loads(r["value"]) for r in documents.score_documents(model, q, nearest=1).orderBy("row_idx").collect()]
    assert got[0]["q"] == 2 and got[0]["note"] == 1 and got[0]["metadata"] == {"source": "x"} and got[0]["modelID"] == "m1"
    assert got[0]["nearestSupportMatches"][0]["supportIndex"] == 1
    compact = json.loads(documents.score_documents(model, q, "compact", 0).first()["value"])
    assert "sdm" not in compact and "qPrime" in compact


def test_evaluation(spark, model):
    scored = model.score(rows(spark, QUERIES, [0, 1, -1, -99]))
    c = Controller(model, SelectionPolicy(0.85))
    e = c.evaluate(scored)
    assert e["totals"] == {"total": 4, "known": 2, "unlabelled": 1, "outside": 1}
    by = {(r["estimator"], r["alpha"]): r for r in e["cumulative"]}
    assert by["centroid", 0.9]["admitted"] == 1 and by["centroid", 0.8]["admitted"] == 2 and by["lower", 0.8]["admitted"] == 1
    actions = [r["decision"]["action"] for r in c.decide(scored).orderBy("row_idx").collect()]
    assert actions == ["allow", "review", "review", "review"]
    s = c.summarize(scored)
    assert sum(r["n"] for r in s["predictions"]) == 4 and len(s["quantiles"]) == 9
    with pytest.raises(ValueError):
        SelectionPolicy(0.4)


def test_undefined_cells(spark):
    df = spark.createDataFrame([(0, 0, 0.0, 0.0)], "label int, prediction int, centroid_alpha double, lower_alpha double")
    cells = evaluation.cells(df, 2)
    minima = {r["kind"]: (r["minimum"], r["complete_minimum"]) for r in evaluation.conditional_minima(cells).collect()}
    assert minima == {"label": (1.0, None), "prediction": (1.0, None)}


def test_histogram_of_a_constant(spark):
    long = spark.createDataFrame([("a", 2.0), ("a", 2.0), ("b", 0.0), ("b", 1.0)], "signal string, v double")
    got = [(r["signal"], r["bin"], r["lo"], r["hi"], r["n"]) for r in evaluation.histogram(long, 2).orderBy("signal", "bin").collect()]
    assert got == [("a", 0, 1.5, 2.5, 2), ("b", 0, 0.0, 0.5, 1), ("b", 1, 0.5, 1.0, 1)]


def test_artifact_round_trip(spark, model, tmp_path):
    path = str(tmp_path / "model")
    artifact.write_artifact(model, path)
    back = artifact.load_artifact(spark, path)
    assert back.model_id == "m1" and back.regions == [(0.9, 1.0, [0.9, 0.9]), (0.8, 1.0, [0.8, 0.8])] and back.k == 5
    a, b = (m.score(rows(spark, QUERIES)).orderBy("row_idx").select("q", "d", "sdm", "centroid_alpha").collect() for m in (model, back))
    assert a == b
    with pytest.raises(FileExistsError):
        artifact.write_artifact(model, path)
    (tmp_path / "model" / "weights.f32").write_bytes(b"\0" * 48)
    with pytest.raises(strict.FormatError):
        artifact.load_artifact(spark, path)


@pytest.mark.parametrize("change", [{"schemaVersion": 2}, {"modelID": ""}, {"createdAt": "now"}, {"regions": [{"alpha": 0.9, "minimumRescaledSimilarity": 1, "outputThresholds": [0.5, 0.9]}]}, {"distanceCDFs": [[2, 1], []]}])
def test_manifest_is_checked(spark, model, tmp_path, change):
    artifact.write_artifact(model, str(tmp_path / "m"))
    m = json.loads((tmp_path / "m" / "manifest.json").read_text())
    artifact.validate_manifest(m)
    with pytest.raises(strict.FormatError):
        artifact.validate_manifest(m | change)


def source(tmp_path, n=6):
    g = np.random.default_rng(1)
    out = [{"id": f"d{i}", "label": i % 2, "document": f"text {i} é", "embedding": [float(x) for x in g.normal(i % 2 * 3, 1, 3).round(3)], "note": {"k": i}} for i in range(n)]
    p = tmp_path / "in.jsonl"
    p.write_text("".join(json.dumps(o) + "\n\n" for o in out))
    return str(p), out


def test_bundle_round_trip(spark, tmp_path):
    path, want = source(tmp_path)
    df = bundle.read_jsonl(spark, path)
    bundle.write_bundle(df, str(tmp_path / "b"), ["no", "yes"], {"fingerprint": "f"})
    back = [r.asDict() for r in bundle.read_dataset(spark, str(tmp_path / "b")).orderBy("row_idx").collect()]
    assert [r["id"] for r in back] == [o["id"] for o in want] and all(r["fingerprint"] == "f" for r in back)
    assert np.allclose([r["x"] for r in back], [o["embedding"] for o in want], atol=1e-6) and json.loads(back[2]["extra"]) == {"note": {"k": 2}}
    bundle.write_jsonl(bundle.read_bundle(spark, str(tmp_path / "b")), str(tmp_path / "out.jsonl"))
    again = [json.loads(x) for x in (tmp_path / "out.jsonl").read_text().splitlines()]
    assert [o["document"] for o in again] == [o["document"] for o in want]
    m = tmp_path / "b" / "embeddings.npy"
    m.write_bytes(m.read_bytes()[:-4])
    with pytest.raises(strict.FormatError):
        bundle.read_bundle(spark, str(tmp_path / "b"))


@pytest.mark.parametrize("text", ['{"a": 1, "a": 2}', '{"a": NaN}', "{", '{"a": 1e999}', "[" * 80 + "]" * 80])
def test_strict_json(text):
    with pytest.raises(strict.FormatError):
        strict.loads(text)
    assert strict.loads('{"a": 18446744073709551615}', True) == {"a": 2**64 - 1}
    with pytest.raises(strict.FormatError):
        strict.loads('{"é": 1, "é": 2}', True)


@pytest.mark.parametrize("row", [{"id": "", "label": 0}, {"id": "a", "label": -2}, {"id": "a", "label": True}, {"id": "a", "document": 3}, {"id": "a", "embedding": [1, True]}, {"id": "a", "embedding": [1e39]}, {"id": "a", "logits": [1.0]}, {"id": "a", "logits": [1, 2], "sourceLogits": [1, 2]}])
def test_bad_rows(row):
    with pytest.raises(strict.FormatError):
        bundle.typed(row, 0)


def test_validation(spark):
    good = spark.createDataFrame([("a", 0, [1.0, 2.0]), ("b", -99, [0.0, 1.0])], "id string, label int, embedding array<double>")
    datasets.require_valid(good)
    for bad in ([("a", 0, [1.0]), ("a", 0, [1.0])], [("a", -3, [1.0])], [("a", 0, [1.0]), ("b", 0, [1.0, 2.0])], [("a", 0, [float("nan")])]):
        with pytest.raises(datasets.DatasetError):
            datasets.require_valid(spark.createDataFrame(bad, "id string, label int, embedding array<double>"))


def test_split_and_export(spark):
    rows_ = spark.createDataFrame([(f"i{k}", k % 2, f"t{k}") for k in range(11)], "id string, label int, document string")
    m = datasets.split(rows_, 3)
    got = m.collect()
    assert sorted(r["pool_index"] for r in got) == list(range(11)) and sum(r["selected_split"] == "training" for r in got) == 5
    out = datasets.export(rows_, m, "calibration").collect()
    assert [r["selected_index"] for r in out] == list(range(6))
    with pytest.raises(Exception, match="source missing"):
        datasets.export(rows_.where("id <> 'i3'"), m.withColumn("selected_split", F.lit("calibration")), "calibration").collect()


def test_digest():
    assert features.digest([1.0, -0.0, -2.5]) == features.digest([1.0, 0.0, -2.5])
    with pytest.raises(ValueError):
        features.digest([float("inf")])


def test_affine(spark):
    df = rows(spark, [[2, 3, 1]])
    w = {"w1": np.array([[1.0, 0.0, -1.0], [0.5, 0.5, 0.5]]), "b1": np.array([0.25, -0.5]), "w2": np.array([[1.0, 2.0], [-1.0, 1.0]]), "b2": np.array([0.1, -0.2])}
    r = features.project(df, w, 2.0, 1.0).first()
    assert r["exemplar"] == pytest.approx([1.25, -0.5]) and r["z"] == pytest.approx([0.35, -1.95])
    sql = df.select(features.affine(F.transform("x", lambda v: v - 2.0), w["w1"].tolist(), w["b1"].tolist()).alias("e")).first()
    assert sql["e"] == pytest.approx([1.25, -0.5])


def blobs(spark, n, seed, first=0):
    g = np.random.default_rng(seed)
    data = [(i, f"p{first + i}", i % 2, [float(v) for v in g.normal([3 * (i % 2), 0, 1], 1)]) for i in range(n)]
    return spark.createDataFrame(data, "row_idx long, id string, label long, x array<double>")


def test_gradients():
    g = np.random.default_rng(0)
    c = training.Config(3, 4)
    w, x, y = training.initial(c, 5, g), g.normal(size=(7, 5)), g.integers(0, 3, 7)
    q, d = g.integers(0, 5, 7).astype(float), g.random(7)
    _, grad = training.gradients(w, x, y, q, d, 2.0)
    for k in w:
        at = tuple(0 for _ in w[k].shape)
        for s in (1e-6, -1e-6):
            w[k][at] += s
            (up, _), w[k][at] = training.gradients(w, x, y, q, d, 2.0), w[k][at] - s
            base, _ = training.gradients(w, x, y, q, d, 2.0)
            assert (up - base) / s == pytest.approx(grad[k][at], abs=1e-4)


def test_training(spark, tmp_path):
    c = training.Config(2, 4, epochs=6, batch_size=16, learning_rate=0.03, seed=5, k=10)
    t, k = blobs(spark, 30, 1), blobs(spark, 26, 2, 100)
    m = training.train(t, k, c, ["no", "yes"], iterations=2, fingerprint="f")
    run = m.metadata["trainingRun"]
    training.check_history(run)
    assert training.history(m).count() == 12 and len(m.metadata["sourceData"]["training"]) == 28
    again = training.train(t, k, c, ["no", "yes"], iterations=2, fingerprint="f")
    assert again.metadata["trainingRun"]["bestBalancedCalibrationLoss"] == run["bestBalancedCalibrationLoss"]
    scored = m.score(blobs(spark, 20, 9))
    assert scored.where(F.col("label") == F.col("prediction")).count() >= 16
    artifact.write_artifact(m, str(tmp_path / "m"))
    back = artifact.load_artifact(spark, str(tmp_path / "m"))
    new = back.recalibrated(0.1)
    assert new.metadata["recalibration"]["sourceModelID"] == back.model_id and new.model_id != back.model_id
    pool = t.unionByName(k).withColumn("document", F.col("id"))
    out = documents.export_sources(back, pool, "original-training").collect()
    assert [r["id"] for r in out] == [f"p{i}" for i in range(30)]
    on = training.train(t, k, c, start=back)
    assert on.metadata["trainingRun"]["sourceModelID"] == back.model_id and on.mean == back.mean
    stop = training.Control()
    stop.request_stop()
    assert training.train(t, k, training.Config(2, 4, epochs=5, cross_entropy_epochs=3, k=10), control=stop).metadata["trainingRun"]["stoppedEarly"]
    gone = training.Control()
    gone.cancel()
    with pytest.raises(training.Cancelled):
        training.train(t, k, c, control=gone)
    with pytest.raises(ValueError):
        training.train(t, t, c)


def test_stream(spark, model, tmp_path):
    data = rows(spark, QUERIES)
    data.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
    q = scoring.score_stream(stream, model).writeStream.format("memory").queryName("scored").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    cols = ["row_idx", "q", "d", "centroid_alpha", "lower_alpha"]
    assert spark.table("scored").select(cols).orderBy("row_idx").collect() == model.score(data).select(cols).orderBy("row_idx").collect()
    w = scoring.windowed_summary(spark.createDataFrame([("2024-01-01 00:01:00", "a", 1.0), ("2024-01-01 00:07:00", "a", 3.0)], "t string, k string, v double").select(F.to_timestamp("t").alias("ts"), "k", "v"), "v", "k")
    assert w.count() == 2


def test_command_line(spark, model, tmp_path, capsys):
    artifact.write_artifact(model, str(tmp_path / "m"))
    (tmp_path / "q.jsonl").write_text("".join(json.dumps({"id": f"q{i}", "label": 0, "embedding": [float(v) for v in x]}) + "\n" for i, x in enumerate(QUERIES)))
    assert cli.main(["artifact", "validate", "--model", str(tmp_path / "m")]) == 0
    assert cli.main(["score", "--model", str(tmp_path / "m"), "--input", str(tmp_path / "q.jsonl"), "--output", str(tmp_path / "s.jsonl")]) == 0
    got = [json.loads(x) for x in (tmp_path / "s.jsonl").read_text().splitlines()]
    assert [o["centroidRegionAlpha"] for o in got][:2] == [0.9, 0.8]
    assert cli.main(["evaluate", "--model", str(tmp_path / "m"), "--input", str(tmp_path / "q.jsonl"), "--output", str(tmp_path / "e.json")]) == 0
    assert cli.main(["dataset", "convert", "--input", str(tmp_path / "q.jsonl"), "--output", str(tmp_path / "bundle")]) == 0
    assert cli.main(["dataset", "inspect", "--input", str(tmp_path / "bundle"), "--output", str(tmp_path / "i.json")]) == 0
    assert json.loads((tmp_path / "i.json").read_text())["n"] == 4
    assert cli.main(["artifact", "inspect", "--model", str(tmp_path / "none")]) == 2
