import zlib

import numpy as np
from pyspark.sql import functions as F

from logclew.llm import packing
from logclew.llm.queries import vocabulary

WORDS = vocabulary("word_bpe_49k.json")
HARD = [
    "Don't stop 'll I'd we've", "ΣΑΣ ΟΔΟΣ", "İstanbul ﬁ é 日本語 テスト 12345",
    "a\x1cb c d <|endoftext|> x", "a<|endoftext|>b <|startoftext|><|endoftext|> <|endof text|>", "...,,!! a!b --' 'tis ''", " \n\t", "ªº µm Ⅷ ß ẞ x²y _a_ ÷×",
]


def plain_ids(text, specials_as_text=False):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    if specials_as_text:
        tokenizer.encode_special_tokens = True
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def check(texts, rows):
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert set(by_doc) == set(texts)
    for doc, text in texts.items():
        ids, at = np.array(plain_ids(text), "<u4"), 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.offset == 0
            assert r.length & (r.length - 1) == 0 and r.length <= 4096
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert len({r.sequence_id for r in rows}) == len(rows)


def test_pieces_hold_every_token_once(spark, documents):
    docs = documents.unionByName(
        spark.createDataFrame([(10**6 + i, t, "en", "s", 0) for i, t in enumerate(HARD)], documents.schema)
    )
    check({r.doc_id: r.text for r in docs.collect()}, packing.pack_documents(docs, WORDS).collect())


def test_sequences_of_a_length_are_gapless_and_batched(documents):
    packed = packing.pack_documents(documents, WORDS)
    numbers = packed.groupBy("length").agg(
        F.count("*").alias("n"), F.max(F.floor(F.col("sequence_id") / 64)).alias("last")
    )
    assert all(r.last == r.n - 1 for r in numbers.collect())
    batches = packing.batches_of(packed, 8192).groupBy("length", "batch").agg(F.sum("length").alias("t"))
    assert all(r.t <= 8192 for r in batches.collect())


def test_binary_pieces():
    assert list(packing.binary_pieces(11, 4)) == [(0, 4), (4, 4), (8, 2), (10, 1)]


def test_ids_come_with_the_pieces(documents):
    rows = packing.cut_documents(documents.limit(5), WORDS, with_ids=True).collect()
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows)


def test_edges(edge_docs, no_docs):
    rows = packing.pack_documents(edge_docs, WORDS).collect()
    assert [r.length for r in rows if r.doc_id in (1, 2, 4)] == [1, 1, 1]
    assert sum(r.length for r in rows if r.doc_id == 5) == 30_001
    assert sum(r.doc_id == 3 for r in rows) == 2 * len(list(packing.binary_pieces(8, 4096)))
    assert packing.pack_documents(no_docs, WORDS).count() == 0


def test_specials_as_text_on_request(spark):
    docs = spark.createDataFrame([(1, "a<|endoftext|>b")], "doc_id long, text string")
    for as_text in (False, True):
        (row,) = [r for r in packing.cut_documents(docs, WORDS, specials_as_text=as_text).collect() if r.start == 0]
        assert row.doc_tokens == len(plain_ids("a<|endoftext|>b", as_text))
    assert len(plain_ids("a<|endoftext|>b")) == 4 < len(plain_ids("a<|endoftext|>b", True))
