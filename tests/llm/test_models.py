"""Toxicity and quality models: held-out accuracy, the formulas, and unusual rows."""

import random
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from gaugeflow.llm import quality, toxicity
from gaugeflow.llm.labelled import held_out, training_rows

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rates(rows, labels):
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    right = {y: [p == y for p, own in held if own == y] for y in (0, 1)}
    return {y: sum(r) / len(r) for y, r in right.items()}


@pytest.mark.parametrize("operator,label,least", [(toxicity.op4_toxicity, "toxic", {1: 0.7, 0: 0.99}), (quality.op5_quality, "quality", {0: 0.9, 1: 0.97})])
def test_held_out_accuracy(spark, operator, label, least):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = operator(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    found = rates(rows, {r["doc_id"]: r[label] for r in labels.collect()})
    assert found[0] >= least[0] and found[1] >= least[1], found


def test_training_rows_leave_the_fold_out(spark):
    docs = spark.createDataFrame([(n, f"t{n}", None, None, None) for n in [*range(50), 7, 7]] + [(None, "x", None, None, None)], DOCS)
    labels = spark.createDataFrame([(n, n % 2, None) for n in range(50)] + [(7, 0, 1), (8, None, 1), (None, 1, 1)], "doc_id long, toxic int, text int")
    rows = training_rows(docs, labels, "toxic").collect()
    wanted = [n for n in range(50) if zlib.crc32(str(n).encode()) % 5]
    assert sorted((r["doc_id"], r["y"]) for r in rows) == [(n, n % 2) for n in wanted]
    assert training_rows(docs, labels, "toxic", 5).count() == 5
    assert [r[0] for r in spark.range(40).select(held_out(F.col("id"))).collect()] == [zlib.crc32(str(n).encode()) % 5 == 0 for n in range(40)]


def test_sentences_and_their_places():
    rng = random.Random(6)
    pieces = ["one", "Two", "ÄÖ", "İx", "!", ". ", "?", "\n", " ", "_", "word " * 30, "é", "３", "the the"]
    for _ in range(2000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(25)))
        words, sizes = toxicity.sentence_words(text)
        spans = toxicity.sentence_spans(text)
        assert len(spans) == len(sizes) and sum(sizes) == len(words) and all(0 < n <= toxicity.SENTENCE_WORDS for n in sizes)
        assert all(0 <= lo < hi <= len(text) for lo, hi in spans)


def test_noisy_or_finds_the_sentence(spark):
    rng = random.Random(2)
    plain = [f"w{n}" for n in range(60)]
    rows = []
    for n in range(600):
        talk = [" ".join(rng.choice(plain) for _ in range(8)) for _ in range(rng.randrange(1, 6))]
        if n % 3 == 0:
            talk[rng.randrange(len(talk))] += " " + rng.choice(["vile", "awful"])
        rows.append((n, ". ".join(talk), int(n % 3 == 0)))
    docs = spark.createDataFrame([(n, t, None, None, None) for n, t, _ in rows] + [(900, None, None, None, None), (901, "", None, None, None), (None, "you vile thing", None, None, None), (902, "w1 w2 " * 40_000 + "vile", None, None, None)], DOCS).withColumnRenamed("lang", "score")
    labels = spark.createDataFrame([(n, y) for n, _, y in rows], "doc_id long, toxic int")
    model = toxicity.train_toxicity(docs, labels)
    out = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert sum((out[n]["score"] >= 0.5) == bool(y) for n, _, y in rows) >= 0.99 * len(rows)
    for n, text, y in rows:
        for span in out[n]["offending"]:
            assert y and any(w in text[span["start"] : span["end"]] for w in ("vile", "awful"))
    assert out[900]["score"] == out[901]["score"] == 0 and out[None]["score"] >= 0.5
    assert [docs.sparkSession.createDataFrame([(902, 1)], "d long, x int").count(), out[902]["offending"][-1]["end"]] == [1, len("w1 w2 " * 40_000 + "vile")]
    assert toxicity.op4_toxicity(docs.limit(0), labels).count() == 0
    none = toxicity.op4_toxicity(docs, labels.limit(0)).collect()
    assert len(none) == docs.count() and all(0 <= r["score"] <= 1 for r in none)


def test_every_toxic_document_has_sentences():
    rng = np.random.default_rng(4)
    for _ in range(500):
        z = rng.normal(-3, 2, rng.integers(0, 30))
        named = toxicity.offending(z)
        if toxicity.noisy_or(z) < toxicity.THRESHOLD:
            assert not len(named)
        else:
            assert toxicity.noisy_or(z[named]) >= toxicity.THRESHOLD and set(np.flatnonzero(z >= 0)) <= set(named)


def test_offending_sentences_of_the_given_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.op4_toxicity(docs, labels).collect()
    assert all((r["n_offending"] > 0) == bool(r["predicted"]) for r in rows) and any(r["predicted"] for r in rows)


def test_pairs_in_linear_time():
    rng = np.random.default_rng(3)
    model = quality.QualityModel(0.3, rng.standard_normal(quality.BUCKETS).astype(np.float32), rng.standard_normal((quality.BUCKETS, quality.FACTORS)).astype(np.float32))
    buckets, values = rng.choice(quality.BUCKETS, 40, False), rng.random(40).astype(np.float32)
    slow = 0.3 + sum(model.linear[b] * x for b, x in zip(buckets, values))
    for i in range(40):
        for j in range(i):
            slow += float(model.factors[buckets[i]] @ model.factors[buckets[j]]) * values[i] * values[j]
    assert abs(quality.log_odds(model, buckets, values) - slow) < 1e-3


def test_quality_edge_cases(spark):
    rows = [(n, ("LOUD! " if n % 2 else "calm words here. ") * (n % 7 + 2), None, None, n) for n in range(200)]
    rows += [(900, None, None, None, None), (901, "", None, None, -5), (None, "calm words here.", None, None, 10), (902, "LOUD! " * 50_000, None, None, 7), (902, "LOUD! " * 50_000, None, None, 7)]
    docs = spark.createDataFrame(rows, DOCS).withColumnRenamed("lang", "score")
    labels = spark.createDataFrame([(n, 1 - n % 2) for n in range(200)], "doc_id long, quality int")
    out = quality.op5_quality(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    assert all(r["predicted"] == 1 - r["doc_id"] % 2 for r in out if r["doc_id"] is not None and r["doc_id"] < 200)
    assert quality.op5_quality(docs.drop("n_chars"), labels).count() == len(rows)
    assert quality.op5_quality(docs.limit(0), labels).count() == 0
    assert len(quality.op5_quality(docs, labels.limit(0)).collect()) == len(rows)
