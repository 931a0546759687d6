import math
import struct
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from logclew.llm import shards


def plain_place(key, tree):
    """Descend by hand: least -ln(u) / weight among the children of each node."""

    def hashed(*numbers):
        seed = xxhash.xxh64_intdigest(struct.pack("<q", key), seed=42)
        for n in numbers:
            seed = xxhash.xxh64_intdigest(struct.pack("<i", n), seed=seed)
        return seed

    path, left = (), list(tree)
    for level in range(3):
        names = list(dict.fromkeys((s.region, s.rack, s.number)[level] for s in left))
        if len(names) > 1:
            weight = {n: sum(s.weight for s in left if (s.region, s.rack, s.number)[level] == n) for n in names}
            draw = {n: -math.log(((hashed(*path, n) >> 12) + 0.5) / 2**52) / weight[n] for n in names}
            name = min(names, key=draw.__getitem__)
        else:
            name = names[0]
        path, left = (*path, name), [s for s in left if (s.region, s.rack, s.number)[level] == name]
    return left[0].number


UNEVEN = [
    shards.Shard(0, 0, 0, 1.0), shards.Shard(0, 0, 1, 3.0), shards.Shard(0, 1, 2, 2.0),
    shards.Shard(1, 2, 3, 5.0), shards.Shard(2, 3, 4, 0.5), shards.Shard(2, 4, 5, 0.5),
]


def placed(spark, *trees, n=20_000):
    columns = [shards.place(F.col("id"), t).alias(f"t{i}") for i, t in enumerate(trees)]
    return spark.range(n).select("id", *columns).collect()


def test_equals_plain_descent(spark):
    trees = (UNEVEN, shards.regular_tree(16), shards.regular_tree(17), shards.regular_tree(3))
    for r in placed(spark, *trees, n=1500):
        assert [r[f"t{i}"] for i in range(len(trees))] == [plain_place(r["id"], t) for t in trees]


def test_a_shard_in_a_region_of_its_own_takes_rows_only_into_itself(spark):
    rows = placed(spark, shards.regular_tree(16), shards.regular_tree(17))
    moved = [r["t1"] for r in rows if r["t0"] != r["t1"]]
    assert set(moved) == {16} and len(moved) / len(rows) == pytest.approx(1 / 17, abs=0.01)


def test_the_tree_decides(spark):
    """The same shards under other racks and regions place rows otherwise."""
    other = [shards.Shard(s.number % 3, s.number % 5, s.number) for s in shards.regular_tree(16)]
    rows = placed(spark, shards.regular_tree(16), other)
    assert sum(r["t0"] != r["t1"] for r in rows) / len(rows) > 0.5
    for number in range(16):
        assert sum(r["t1"] == number for r in rows) / len(rows) == pytest.approx(1 / 16, abs=0.01)


def test_weights_share_rows_and_confine_moves(spark):
    total = sum(s.weight for s in UNEVEN)
    heavier = [shards.Shard(0, 1, 2, 6.0) if s.number == 2 else s for s in UNEVEN]
    rows = placed(spark, UNEVEN, heavier)
    for s in UNEVEN:
        assert sum(r["t0"] == s.number for r in rows) / len(rows) == pytest.approx(s.weight / total, abs=0.015)
    region, rack = {s.number: s.region for s in UNEVEN}, {s.number: s.rack for s in UNEVEN}
    moved = [(r["t0"], r["t1"]) for r in rows if r["t0"] != r["t1"]]
    # Between regions only into the one that grew; within it only into the rack that grew; the
    # others' rows do not change places among themselves.
    assert moved and {region[b] for _, b in moved} == {0}
    assert {rack[b] for a, b in moved if region[a] == 0} == {1}


def test_rows_sizes_and_slots(documents):
    tree, grown = shards.regular_tree(16), shards.regular_tree(17)
    rows = shards.assign_shards(documents, tree, grown).collect()
    texts = {r.doc_id: r.text.encode() for r in documents.collect()}
    assert len(rows) == len(texts)
    slots = {}
    for r in rows:
        assert r.size == len(texts[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id])
        assert r.law == "key" and r.grown_shard in (r.shard, 16)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_edges(edge_docs, no_docs):
    tree = shards.regular_tree(16)
    rows = shards.assign_shards(edge_docs, tree, tree).collect()
    assert len(rows) == edge_docs.count()
    assert {r.size for r in rows if r.doc_id in (1, 2)} == {1}
    assert len({r.shard for r in rows if r.doc_id == 3}) == 1
    assert shards.assign_shards(no_docs, tree, tree).count() == 0
    with pytest.raises(ValueError):
        shards.assign_shards(no_docs, [shards.Shard(0, 0, 0, 0.0)], tree)
    with pytest.raises(ValueError):
        shards.place(F.col("id"), [shards.Shard(0, 0, 1), shards.Shard(1, 1, 1)])
