"""The pipeline stage by stage against brute force on the smallest tables, and the queries' shape."""

import hashlib
import os
from collections import Counter

import pytest

import corpus_pipeline
from veracal.llm import lines as L
from veracal.llm import queries

from .test_operators import P, PATH, base, groups, tiktoken

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, rows(docs)
    made = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.common.written(stage(spark, docs, SF), f"test-{name}")
        made.append(rows(docs))
        if k < 4:
            assert docs.columns == columns
    quality, lines, near, mixed, tokens = made

    # 200 documents hold too few labels for cutoffs: the base rules alone decide
    want = {r["doc_id"] for r in before if (b := base(r["text"])) and b[0] >= 50 and 100 * b[4] <= 50 * b[0]}
    assert {r["doc_id"] for r in quality} == want

    # all pairs of normal forms whose SimHashes differ in at most three bits must be one group; groups hold only alike forms
    texts = {r["doc_id"]: r["text"] for r in quality}
    first, seen = {}, set()
    for i in sorted(texts):
        for n, x in enumerate(texts[i].split("\n")):
            if (form := L.normal_line(x)) and form not in seen:
                seen.add(form)
                first[form] = (i, n)
    after = {r["doc_id"]: r["text"] for r in lines}
    for i, t in texts.items():
        kept = Counter((after.get(i) or "").split("\n"))
        for n, x in enumerate(t.split("\n")):
            form = L.normal_line(x)
            if form and first[form] != (i, n):
                continue
            if form and not kept[x]:  # removed though it is the first of its form: another form is alike
                assert any(L.alike(form, o, L.SIMILARITY) for o in first if o != form)
        assert len((after.get(i) or "").split("\n")) <= len(set(filter(None, map(L.normal_line, t.split("\n"))))) + sum(not L.normal_line(x) for x in t.split("\n"))
    assert all(r["n_chars"] == len(r["text"]) for r in lines)

    # near duplicates: five-word shingles
    sets = {}
    for i, t in after.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    ids = sorted(sets)
    pairs = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert {r["doc_id"] for r in near} == {i for i, top in groups(pairs, ids).items() if i == top}

    # the mix: each source takes the first target words of its repeated stream
    sizes, sources = {}, {}
    for r in near:
        sizes[r["doc_id"]] = len(r["text"].encode().split())
        sources.setdefault(r["source"], []).append(r["doc_id"])
    total, names = sum(sizes.values()), sorted(sources)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    own = {s: sum(sizes[i] for i in sources[s]) for s in names}
    target, left, free = {}, float(total), set(names)
    while free:
        share = {s: left * weight[s] / sum(weight[o] for o in free) for s in free}
        full = {s for s in free if share[s] > 3 * own[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 3.0 * own[s]
            left -= target[s]
        free -= full
    want = Counter()
    for s in names:
        at = 0
        order = sorted(sources[s], key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
        for _ in range(3):
            for i in order:
                want[i] += at < round(target[s]) and sizes[i] > 0
                at += sizes[i]
    assert Counter(r["doc_id"] for r in mixed) == +want

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=queries_ranks(), special_tokens={})
    text = {r["doc_id"]: r["text"] for r in mixed}
    assert len(tokens) == len(mixed)
    for r in tokens:
        assert r["ids"] == ",".join(map(str, enc.encode_ordinary(text[r["doc_id"]])))
        assert r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()


def queries_ranks():
    from veracal.llm.bpe import Encoder

    return Encoder.get(PATH, P.PATTERN).r.ranks


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"] and out.count() > 0
    assert [int(n[2:].split("_")[0]) for n in queries.queries()] == list(range(1, 11))
