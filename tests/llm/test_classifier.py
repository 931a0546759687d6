import math
import re
import zlib

import numpy as np
import pytest

from logclew.llm import classifier


def held(doc):
    return zlib.crc32(str(doc).encode()) % 5 == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    weights = classifier.train(docs, labels)
    rows = classifier.score_documents(docs, weights).join(labels, "doc_id").collect()
    assert all(r.held_out == held(r.doc_id) and r.predicted == (r.score >= 0.3) for r in rows)
    test = [r for r in rows if r.held_out]
    good, bad = ([r.score for r in test if r.quality == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.97


def test_training_equals_a_plain_loop(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    got = classifier.train(docs, labels)
    rows = classifier.training_rows(docs, labels).collect()
    assert rows
    models = []
    for shard in range(classifier.SHARDS):
        model = classifier.Ftrl()
        mine = [r for r in rows if r.shard == shard]
        for r in sorted(mine, key=lambda r: (r.epoch, r.turn, r.text)):
            model.update(*classifier.features(r.text), r.label)
        models.append(model.all_weights() if mine else np.zeros(classifier.BIAS + 1))
    assert np.allclose(got, sum(models) / classifier.SHARDS)


def test_a_partition_holds_one_shard(spark):
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('word', id) AS text")
    labels = spark.range(400).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality")
    rows = classifier.training_rows(docs, labels).selectExpr("shard", "spark_partition_id() AS part").distinct().collect()
    assert sorted(r.shard for r in rows) == list(range(classifier.SHARDS))
    assert len({r.part for r in rows}) == classifier.SHARDS


def plain_features(text):
    """Feature slots and weights with dictionaries and whole numbers."""
    tokens = re.findall(r"[^\W\d_]+|[0-9]+|[^\w\s]+|[\d_]", text or "")
    codes = [zlib.crc32(t.encode()) for t in tokens]
    marked = [0x9E3779B97F4A7C15 if i and codes[i] == codes[i - 1] else c for i, c in enumerate(codes)]
    whole, mix = 1 << 64, 0xBF58476D1CE4E5B9
    pairs = [(a * mix + b) * 0x9E3779B97F4A7C15 % whole for a, b in zip(marked, marked[1:], strict=False)]
    counts = {}
    for code in marked + pairs:
        slot = ((code ^ (code >> 29)) * mix % whole) >> (64 - 18)
        counts[slot] = counts.get(slot, 0) + 1
    return {**{s: (n / max(1, len(tokens))) ** 0.5 for s, n in counts.items()}, 1 << 18: 1.0}


def test_features_and_updates_equal_a_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()
    model, z, n = classifier.Ftrl(), {}, {}
    for label, text in [(i % 2, r.text) for i, r in enumerate(docs)] + [(1, ""), (0, None), (1, "a a a 12 _")]:
        at, x = classifier.features(text)
        plain = plain_features(text)
        assert dict(zip(at.tolist(), x.tolist(), strict=True)) == pytest.approx(plain)
        model.update(at, x, label)
        weights = {}
        for s in plain:
            value = z.get(s, 0.0)
            shrunk = 0.0 if abs(value) <= 0.001 else math.copysign(0.001, value) - value
            weights[s] = shrunk / ((1.0 + math.sqrt(n.get(s, 0.0))) / 2.0)
        error = 1 / (1 + math.exp(-sum(weights[s] * v for s, v in plain.items()))) - label
        for s, v in plain.items():
            g = error * v
            old = n.get(s, 0.0)
            n[s] = old + g * g
            z[s] = z.get(s, 0.0) + g - (math.sqrt(n[s]) - math.sqrt(old)) / 2.0 * weights[s]
    assert {s: model.z[s] for s in z} == pytest.approx(z, rel=1e-6, abs=1e-9)


def test_labels_of_held_out_ids_are_not_read(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    flipped = labels.selectExpr(
        "doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality"
    )
    assert np.array_equal(classifier.train(docs, labels), classifier.train(docs, flipped))


def test_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(3, 1), (3, 0), (None, 1), (5, None)], "doc_id long, quality int")
    weights = classifier.train(edge_docs, labels)
    rows = classifier.score_documents(edge_docs, weights).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r.score <= 1 for r in rows)
    nothing = classifier.train(no_docs, labels)
    assert not nothing.any()
    assert {r.score for r in classifier.score_documents(edge_docs, nothing).collect()} == {0.5}
    assert classifier.score_documents(no_docs, weights).count() == 0
