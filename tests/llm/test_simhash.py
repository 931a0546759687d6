import random

import numpy as np
import pytest
import xxhash

from logclew.llm import simhash


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def clusters(seed=5):
    rand, prints = random.Random(seed), set()
    for _ in range(12):
        base = rand.getrandbits(64)
        for _ in range(25):
            x = base
            for _ in range(rand.randint(0, 5)):
                x ^= 1 << rand.randrange(64)
            prints.add(signed(x))
    return sorted(prints | {signed(rand.getrandbits(64)) for _ in range(100)} | {0})


def plain_components(prints):
    codes = np.array(prints, np.int64).view(np.uint64)
    label = list(range(len(codes)))
    changed = True
    while changed:
        changed = False
        for i in range(len(codes)):
            near = np.flatnonzero(np.bitwise_count(codes ^ codes[i]) <= 3)
            low = min(label[j] for j in near)
            for j in near:
                if label[j] != low:
                    label[j], changed = low, True
    return label


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("max_posting", [4096, 3, 0])
def test_components_equal_brute_force(spark, max_posting):
    prints = clusters()
    rows = spark.createDataFrame(list(enumerate(prints)), "doc_id long, fingerprint long")
    got = {r.doc_id: r.component_id for r in simhash.with_components(rows, max_posting).collect()}
    assert [got[i] for i in range(len(prints))] == plain_components(prints)


def test_blocks_cover_every_three_positions():
    import itertools

    assert len(simhash.BLOCKS) == 14
    for three in itertools.combinations(range(8), 3):
        assert any(not set(three) & set(block) for block in simhash.BLOCKS)


def test_documents(documents):
    rows = documents.collect()
    got = {r.doc_id: r for r in simhash.near_duplicates(documents).collect()}
    prints = [plain_fingerprint(r.text) for r in rows]
    assert [got[r.doc_id].fingerprint for r in rows] == [f"{p:016x}" for p in prints]
    distinct = sorted({signed(p) for p in prints})
    label = dict(zip(distinct, plain_components(distinct), strict=True))
    least = {}
    for r, p in zip(rows, prints, strict=True):
        least[label[signed(p)]] = min(r.doc_id, least.get(label[signed(p)], r.doc_id))
    for r, p in zip(rows, prints, strict=True):
        assert got[r.doc_id].component_id == least[label[signed(p)]]


def test_edges(edge_docs, no_docs):
    found = simhash.near_duplicates(edge_docs).collect()
    assert len(found) == edge_docs.count()
    zero = [r for r in found if r.fingerprint == "0" * 16]
    assert len(zero) == 4 and {r.component_id for r in zero} == {1}
    assert {r.component_id for r in found if r.doc_id == 3} == {3}
    kept = simhash.keep_first(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 5]
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash.keep_first(no_docs).count() == 0


def test_keep_first_keeps_one_of_repeated_rows(documents):
    once = {r.doc_id for r in simhash.keep_first(documents).collect()}
    twice = [r.doc_id for r in simhash.keep_first(documents.unionByName(documents)).collect()]
    assert sorted(twice) == sorted(once)
