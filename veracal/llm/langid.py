"""Language identification by a convolutional network over bytes.

A text's UTF-8 bytes are cut into windows of ``WINDOW`` bytes, the last one filled up with spaces.  Filters of several widths
run over the window; as the input is one of 256 bytes at each place, a filter of width w is a sum of w table rows.  Max
pooling over the places, then a linear layer and softmax give a window's probabilities; a document's are the mean over all of
its windows, weighted by their bytes.

The network is trained in numpy on the driver, on a bounded sample: ``SAMPLE_DOCS`` labelled documents, about equally many for
each language, with ``PER_DOC`` pieces of each.  Every document is predicted from its whole text.  Language, source and id
are no inputs.  No shuffle but the sample's; the network (about 150 kB) is broadcast.

Nulls and empties: a text that is null or has no letter is ``und`` with score 0, as is every text if nothing is labelled.
Null or repeated ids do no harm.  All languages are learned (each but for a chance of about 2e-9); the sample grows where there
are more than ``SAMPLE_DOCS / LEAST_DOCS`` of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
SAMPLE_DOCS = 3000
PER_DOC = 4
EPOCHS = 5
BATCH = 64
LEAST_DOCS = 20
#: Windows that are in flight at once when predicting.
CHUNK = 128
_LETTER = re.compile(r"[^\W\d_]")


class ByteNet:
    """Multi-width filters over bytes, max pooling and softmax."""

    def __init__(self, classes: list[str], seed: int = 0):
        g = np.random.default_rng(seed)
        self.classes = classes
        self.p: dict[str, np.ndarray] = {}
        for w in WIDTHS:
            self.p[f"t{w}"] = g.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32)
        self.p["v"] = g.normal(0, 0.2, (len(WIDTHS) * FILTERS, len(classes))).astype(np.float32)
        self.p["c"] = np.zeros(len(classes), np.float32)

    def pooled(self, x: np.ndarray, places: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
        """(n, filters) of windows (n, bytes), and for each width the places of the maxima."""
        n, length = x.shape
        out, at = np.empty((n, len(WIDTHS) * FILTERS), np.float32), []
        for k, w in enumerate(WIDTHS):
            t, m = self.p[f"t{w}"], length - w + 1
            s = t[0].take(x[:, :m], 0)
            for i in range(1, w):
                s += t[i].take(x[:, i : m + i], 0)
            if places:
                at.append(s.argmax(1))
            out[:, k * FILTERS : (k + 1) * FILTERS] = s.max(1)
        return out, at

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        h, _ = self.pooled(x)
        return softmax(np.tanh(h) @ self.p["v"] + self.p["c"])

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        n = len(x)
        h, at = self.pooled(x, True)
        a = np.tanh(h)
        d = softmax(a @ self.p["v"] + self.p["c"])
        d[np.arange(n), y] -= 1
        d /= n
        g = {"v": a.T @ d, "c": d.sum(0)}
        dh = (d @ self.p["v"].T) * (1 - a * a)
        rows, cols = np.arange(n)[:, None], np.arange(FILTERS)[None, :]
        for k, w in enumerate(WIDTHS):
            gt = np.zeros_like(self.p[f"t{w}"])
            for i in range(w):
                np.add.at(gt[i], (x[rows, at[k] + i], cols), dh[:, k * FILTERS : (k + 1) * FILTERS])
            g[f"t{w}"] = gt
        return g


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(pieces: list[bytes], names: list[str], seed: int = 0, epochs: int = EPOCHS) -> ByteNet:
    """Train on labelled pieces of at most ``WINDOW`` bytes, with Adam; a third of them is shortened, as texts may be short."""
    classes = sorted(set(names))
    net, g = ByteNet(classes, seed), np.random.default_rng(seed)
    x = np.frombuffer(b"".join(p[:WINDOW].ljust(WINDOW, b" ") for p in pieces), np.uint8).reshape(-1, WINDOW).copy()
    for i in np.flatnonzero(g.random(len(x)) < 1 / 3):
        x[i, int(g.integers(12, WINDOW)) :] = 32
    y = np.searchsorted(classes, names)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    s = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    for epoch in range(epochs):
        order = g.permutation(len(x))
        rate = 0.01 * (1 - epoch / epochs) + 0.001
        for i in range(0, len(x), BATCH):
            step += 1
            for k, d in net.gradients(x[order[i : i + BATCH]], y[order[i : i + BATCH]]).items():
                m[k] += 0.1 * (d - m[k])
                s[k] += 0.001 * (d * d - s[k])
                net.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    return net


def windows_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text and the bytes of the text in each."""
    b = text.encode()
    n = -(-len(b) // WINDOW)
    size = np.full(n, WINDOW)
    size[-1] = len(b) - (n - 1) * WINDOW
    return np.frombuffer(b.ljust(n * WINDOW, b" "), np.uint8).reshape(n, WINDOW), size


def predict(net: ByteNet, texts: list[str]) -> tuple[list[str], list[float]]:
    """Language and score of each text; windows of many texts share a chunk, a long text's are spread over several."""
    lang, score = ["und"] * len(texts), [0.0] * len(texts)
    sums = np.zeros((len(texts), len(net.classes)))
    x, own, size, held = [], [], [], 0

    def flush() -> None:
        nonlocal x, own, size, held
        if held:
            all_x, all_own, all_size = np.concatenate(x), np.concatenate(own), np.concatenate(size)
            for i in range(0, len(all_x), CHUNK):
                s = slice(i, i + CHUNK)
                np.add.at(sums, all_own[s], net.probabilities(all_x[s]) * all_size[s, None])
        x, own, size, held = [], [], [], 0

    found = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
    for i in found:
        a, n = windows_of(texts[i])
        x.append(a)
        size.append(n)
        own.append(np.full(len(a), i))
        held += len(a)
        if held >= 4 * CHUNK:
            flush()
    flush()
    for i in found:
        p = sums[i] / sums[i].sum()
        best = int(p.argmax())
        lang[i], score[i] = net.classes[best], float(min(1.0, max(0.0, p[best])))
    return lang, score


def sample(labelled: DataFrame, docs: int = SAMPLE_DOCS, per_doc: int = PER_DOC) -> tuple[list[bytes], list[str]]:
    """Pieces of at most ``WINDOW`` code points from a bounded, repeatable, balanced sample of (doc_id, text, lang)."""
    labelled = labelled.where("text is not null and lang is not null and doc_id is not null")
    counts = labelled.groupBy("lang").agg(F.count("*").cast("double").alias("_n"))
    found = counts.count()
    if not found:
        return [], []
    docs = max(docs, LEAST_DOCS * found)
    draw = F.pmod(F.xxhash64(F.lit("draw"), "doc_id"), F.lit(2**40)) / float(2**40)
    rows = labelled.join(common.maybe_broadcast(counts), "lang").select("doc_id", "text", "lang", (draw * F.col("_n")).alias("_u"))
    start = lambda j: F.when(F.length("text") > WINDOW, F.pmod(F.xxhash64(F.lit(j), "doc_id"), F.length("text") - WINDOW).cast("int") + 1).otherwise(1)
    pieces = F.array_distinct(F.array(*[F.substring("text", start(j), F.lit(WINDOW)) for j in range(per_doc)]))
    # _u is uniform up to the language's count: this keeps about so many of each, wherever they lie, before any sorting
    rows = rows.where(F.col("_u") <= 1.25 * docs / found).select("_u", "doc_id", "lang", pieces.alias("_p")).orderBy("_u", "doc_id").limit(docs)
    got = [(p.encode(), r["lang"]) for r in rows.collect() for p in r["_p"] if _LETTER.search(p)]
    return [p for p, _ in got], [n for _, n in got]


def identify(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """doc_id, lang_pred, score for every document; the network learns from ``labelled`` (doc_id, text, lang)."""
    spark = docs.sparkSession
    pieces, names = sample(labelled)
    net = spark.sparkContext.broadcast(fit(pieces, names) if pieces else None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = list(b["text"])
            lang, score = predict(net.value, texts) if net.value else (["und"] * len(texts), [0.0] * len(texts))
            yield pd.DataFrame({"doc_id": b["doc_id"], "lang_pred": lang, "score": score})

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", common.text_of().alias("text")).mapInPandas(run, f"doc_id {kind}, lang_pred string, score double")
