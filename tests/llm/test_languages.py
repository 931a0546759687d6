import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from logclew.llm import languages, queries


def plain_trees(rows):
    """{language: {context: {byte: count}}} over contexts of 0 to 4 bytes."""
    trees = {}
    for lang, text in rows:
        tree = trees.setdefault(lang, defaultdict(lambda: defaultdict(int)))
        data = b"\n" * 4 + text.encode()
        for i in range(4, len(data)):
            for k in range(5):
                tree[data[i - k : i]][data[i]] += 1
    return trees


def plain_bits(tree, text):
    """Code length of a text: matches down from the longest context, escapes on the way."""
    data, total = b"\n" * 4 + text.encode(), 0.0
    for i in range(4, len(data)):
        for k in (4, 3, 2, 1, 0):
            seen = tree.get(data[i - k : i])
            if not seen:
                continue
            n, kinds = sum(seen.values()), len(seen)
            if data[i] in seen:
                total -= math.log2(seen[data[i]] / (n + kinds))
                break
            total -= math.log2(kinds / (n + kinds))
        else:
            total += 8
    return total


def remainder(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4


TEXTS = {
    "north": "der und die ßen äch ver",
    "south": "la que ción ños para está",
    "east": "the and ing tion of",
}


def corpus(n=120, seed=2):
    rand = random.Random(seed)
    out = []
    for i in range(n):
        lang = rand.choice(list(TEXTS))
        words = TEXTS[lang].split()
        out.append((i, " ".join("".join(rand.choices(words, k=2)) for _ in range(rand.randint(1, 12))), lang))
    return out


@pytest.fixture(scope="module")
def learnt(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string").repartition(3)
    return docs, languages.train(docs)


def test_code_lengths_equal_plain_trees(learnt):
    _, model = learnt
    trees = plain_trees((lang, t) for i, t, lang in corpus() if remainder(i) != 2)
    probes = [t for _, t, _ in corpus(40, 9)] + ["", "x", "que\x00 日本 zzz", "äää" * 50]
    got = model.texts_bits([t.encode() for t in probes])
    assert model.languages == tuple(sorted(trees))
    for k, lang in enumerate(model.languages):
        want = [plain_bits(trees[lang], t) for t in probes]
        assert np.allclose(got[:, k], want, rtol=1e-4, atol=1e-2)


def test_prediction_is_the_shortest_code(learnt):
    docs, model = learnt
    trees = plain_trees((lang, t) for i, t, lang in corpus() if remainder(i) != 2)
    got = {r["doc_id"]: r for r in languages.predict(docs, model).collect()}
    for i, text, _ in corpus():
        bits = {lang: plain_bits(tree, text) for lang, tree in trees.items()}
        low = min(bits.values())
        share = 1 / sum(2.0 ** (low - b) for b in bits.values())
        assert got[i]["held_out"] == (remainder(i) == 2)
        assert got[i]["score"] == pytest.approx(share, abs=1e-3)
        assert bits[got[i]["lang_pred"]] == pytest.approx(low, abs=0.05)


def test_pruned_trees_stay_trees_and_bounded(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    model = languages.train(docs, cells=900)
    assert 0 < sum(len(b) for b in model.bits) * len(model.languages) <= 900
    for k in range(1, len(model.nodes)):
        tails = languages._tail(model.nodes[k].keys, k - 1)
        assert np.isin(tails, model.nodes[k - 1].keys).all()


def test_slices_cover_every_byte(monkeypatch):
    texts = [t.encode() for _, t, _ in corpus(30)] + [b"", b"ab" * 500]
    whole = [(o.tolist(), w.tolist()) for o, w in languages.slices(texts)]
    monkeypatch.setattr(languages, "_SLICE", 64)
    cut = [(o.tolist(), w.tolist()) for o, w in languages.slices(texts)]
    flat = lambda parts, i: [x for p in parts for x in p[i]]
    assert flat(whole, 0) == flat(cut, 0) and flat(whole, 1) == flat(cut, 1)
    assert len(flat(cut, 0)) == sum(map(len, texts))


def test_counts_handed_on_early_are_the_same(spark, monkeypatch):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string").coalesce(1)
    read = lambda: {tuple(r) for r in languages._window_counts(docs).collect()}
    whole = read()
    monkeypatch.setattr(languages, "_HELD", 50)
    assert read() == whole


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op13_ppm_trees(spark, "/root/testdata/sf0.01")
    rows = got.join(docs.select("doc_id", "lang", "text"), "doc_id").where("held_out").collect()
    worded = [r for r in rows if any(c.isalpha() for c in r["text"] or "")]
    right = sum(r["lang_pred"] == r["lang"] for r in worded)
    assert right / len(worded) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_edges(spark, edge_docs, no_docs):
    model = languages.train(edge_docs.withColumn("letters", edge_docs.text))
    found = languages.predict(edge_docs, model)
    rows = found.collect()
    assert len(rows) == edge_docs.count()
    for r in rows:
        if r["doc_id"] in (2, 4):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        if r["doc_id"] is None:
            assert r["held_out"] is False
    digits = spark.createDataFrame([(7, "123 456 ---"), (8, "日本語")], "doc_id long, text string")
    assert [r["lang_pred"] for r in languages.predict(digits, model).orderBy("doc_id").collect()][0] == "und"
    nothing = languages.train(no_docs)
    assert nothing.languages == ()
    assert {r["lang_pred"] for r in languages.predict(edge_docs, nothing).collect()} == {"und"}
    assert languages.predict(no_docs, model).collect() == []
