import hashlib
import re

import numpy as np
import pytest
import xxhash

from logclew.llm import sketch


def plain_sketch(text):
    """Hashes of 5-word shingles below a third of the range, else the least, with sets."""
    words = re.sub(r"[A-Z]", lambda m: m.group().lower(), text or "").encode().split()
    joined = [b" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, min(len(words), 1)))]
    hashes = {xxhash.xxh64_intdigest(s, 42) for s in joined}
    return sorted(h for h in hashes if h < 2**64 // 3) or sorted(hashes)[:1]


def plain_likeness(one, other):
    small, large = sorted((one, other), key=len)
    return len(set(small) & set(large)) / len(small) if small else float(not large)


def test_equals_plain_version(documents, edge_docs):
    texts = [r.text for r in documents.collect()] + [r.text for r in edge_docs.collect()]
    made = [plain_sketch(t) for t in texts]
    assert [sketch.sketch(t).tolist() for t in texts] == made
    for one, other in zip(texts, [*texts[1:], texts[0]], strict=True):
        assert sketch.likeness(sketch.sketch(one), sketch.sketch(other)) == plain_likeness(
            plain_sketch(one), plain_sketch(other))


def check(rows, got):
    """``rows`` in descending order of ids."""
    assert len(rows) == len(got)
    for i, (doc, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1] or ""
        text = text or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        r = got[doc]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.fingerprint == sketch.written(sketch.sketch(text))
        assert r.edited_fingerprint == sketch.written(sketch.sketch(changed))
        one, two = sketch.sketch(text), sketch.sketch(following)
        assert r.near_next == sketch.likeness(one, two)
        assert r.near_edited == sketch.likeness(one, sketch.sketch(changed))


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_pairs_across_partitions(spark, documents, coalesce):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    rows = [(r.doc_id, r.text) for r in documents.orderBy("doc_id", ascending=False).collect()]
    got = {r.doc_id: r for r in sketch.edited_pairs(documents).collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    check(rows, got)
    near = [got[d].near_edited for d, t in rows if len(t) > 800]
    assert 0.35 < float(np.mean(near)) < 0.8


def test_containment_estimates_true_share():
    words = [f"w{i}" for i in range(6000)]
    whole, part = sketch.sketch(" ".join(words)), sketch.sketch(" ".join(words[1000:1600]))
    other = sketch.sketch(" ".join(words[1300:1600] + [f"x{i}" for i in range(300)]))
    assert sketch.containment(part, whole) == 1.0
    assert sketch.containment(other, whole) == pytest.approx(0.5, abs=0.15)
    assert sketch.containment(whole, part) == pytest.approx(0.1, abs=0.05)


def test_merge_is_the_sketch_of_both():
    a, b = " ".join(f"a{i}" for i in range(300)), " ".join(f"b{i}" for i in range(200))
    merged = sketch.merge(sketch.sketch(a), sketch.sketch(b))
    both = np.concatenate([sketch.shingle_hashes(x.encode().split(), 5) for x in (a, b)])
    assert merged.tolist() == sketch.scaled(both).tolist()
    assert sketch.read(sketch.written(merged)).tolist() == merged.tolist()


def test_edges(spark, edge_docs, no_docs):
    rows = sketch.edited_pairs(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    assert {r.fingerprint for r in rows if r.doc_id in (1, 2)} == {""}
    assert len({r.fingerprint for r in rows if r.doc_id == 3}) == 1
    assert sketch.edited_pairs(no_docs).count() == 0
    alone = spark.createDataFrame([(7, "a b c d e f g h")], "doc_id long, text string")
    check([(7, "a b c d e f g h")], {r.doc_id: r for r in sketch.edited_pairs(alone).collect()})
    assert sketch.sketches(edge_docs).count() == edge_docs.count()


def test_staged_sketches_are_packed(spark):
    docs = spark.createDataFrame([(i, f"some words of document {i} and no others") for i in range(5)], "doc_id long, text string")
    read = sketch.edited_pairs(docs).inputFiles()
    assert read and all(".zstd." in name for name in read)


def test_only_the_starts_of_ranges_are_staged(spark):
    rows = [(i // 2 if i % 9 else None, f"document {i % 40} has some words") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = sketch.edited_pairs(docs)
    staged = [spark.read.parquet(name) for name in made.inputFiles()]
    assert [t.columns for t in staged] == [["firsts"]]
    assert 1 < sum(map(len, staged[0].first().firsts)) <= 4
    assert made.count() == len(rows)
    # Rows in order are a ring: each text follows one and is followed by one.
    following = sorted((r.n_chars, r.edited_sha256) for r in made.collect())
    hashes = dict(map(tuple, docs.selectExpr("text", "xxhash64(text)").collect()))
    ring = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]]))
    wanted = [sketch.edited(t, ring[(i + 1) % len(ring)][1]) for i, (_, t) in enumerate(ring)]
    assert following == sorted((len(t), hashlib.sha256(t.encode()).hexdigest()) for t in wanted)
