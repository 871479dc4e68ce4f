"""The pipeline: each stage against a plain version of itself."""

from __future__ import annotations

import collections

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from treeq.llm import decontam, overlap, quality, simhash
from treeq.llm.common import Scratch


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "test")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(scratch.save(stage(spark, kept[-1], sf_dir), "stage"))
        assert kept[-1].columns == docs.columns
    raw, good, single, clean, mixed = ([r.asDict() for r in d.collect()] for d in kept)

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels)
    assert {r["doc_id"] for r in good} == {r["doc_id"] for r in raw if model.scores([quality.terms_of(r["text"])])[0] >= 0.5}

    fps = {r["doc_id"]: simhash.fingerprint(r["text"]) for r in good}
    up = {d: d for d in fps}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 4 and top(a) != top(b):
                up[max(top(a), top(b))] = min(top(a), top(b))
    assert {r["doc_id"] for r in single} == {top(d) for d in fps}

    bad = {r["doc_id"] for r in decontam.findings(kept[2], spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert {r["doc_id"] for r in clean} == {r["doc_id"] for r in single} - bad

    copies = collections.Counter(r["doc_id"] for r in mixed)
    assert set(copies) <= {r["doc_id"] for r in clean} and max(copies.values()) <= 2

    last = corpus_pipeline.STAGES[-1][1](spark, kept[-1], sf_dir).collect()
    assert collections.Counter(r["doc_id"] for r in last) == copies
    whole = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, last))


def test_near_copies_far_apart(spark):
    """With ``alike``, texts alike to 0.8 by five-word shingles are one, though their fingerprints are over 4 bits apart."""
    rng = np.random.default_rng(2)
    docs, want = [], set()
    for i in range(30):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 60)]
        changed = words[:1] + ["other"] + words[2:] if i % 2 else words[:30] + ["other"] + words[31:]
        docs += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(changed))]
        alike = [overlap.shingles(t) for _, t in docs[-2:]]
        share = len(np.intersect1d(*alike)) / len(np.union1d(*alike))
        far = (simhash.fingerprint(docs[-2][1]) ^ simhash.fingerprint(docs[-1][1])).bit_count() > 4
        want |= {2 * i} if share >= 0.8 or not far else {2 * i, 2 * i + 1}
    assert any((simhash.fingerprint(docs[i][1]) ^ simhash.fingerprint(docs[i + 1][1])).bit_count() > 4 for i in range(0, 60, 2))
    docs.append((99, docs[0][1]))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.one_of_each(table, alike=True).collect()} == want


def test_odd_rows(spark, sf_dir):
    """Nulls, repeated rows and ids, a very long text and clashing names pass all stages."""
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, None, "a"), (2, "", None), (3, "some words of a text", "a"), (3, "some words of a text", "a"), (3, "another text with this id", "b"), (None, "no id at all here", "b"), (4, long, None)]
    names = ["__key", "__score", "__copies", "__doc", "__row", "score", "key"]
    docs = spark.createDataFrame([(d, t, "en", s, len(t or ""), *["x"] * len(names)) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    single = simhash.one_of_each(docs)
    assert sorted(str((r["doc_id"], (r["text"] or "")[:9])) for r in single.collect()) == sorted(str(x) for x in [(1, ""), (3, "some word"), (3, "another t"), (None, "no id at "), (4, "w0 w1 w2 ")])
    kept = single
    for _, stage in corpus_pipeline.STAGES[2:4]:
        kept = stage(spark, kept, sf_dir)
        assert kept.columns == docs.columns
    rows = kept.collect()
    assert {(r["doc_id"], (r["text"] or "")[:4]) for r in rows} == {(3, "some"), (3, "anot"), (None, "no i"), (4, "w0 w")} and all(r[n] == "x" for r in rows for n in names)
    assert corpus_pipeline.STAGES[-1][1](spark, kept, sf_dir).count() == len(rows)
    assert corpus_pipeline.STAGES[0][1](spark, docs, sf_dir).columns == docs.columns


def test_empty(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).withColumn("words", F.lit("x"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
