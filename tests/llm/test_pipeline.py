import zlib

import numpy as np

import corpus_pipeline
from logclew.llm import private, quality, simhash, substrings
from logclew.llm.queries import vocabulary
from test_packing import plain_ids
from test_simhash import plain_components, plain_fingerprint, signed
from test_substrings import plain as plain_repeats

SF = "/root/testdata/sf0.001"


def test_stages_and_columns():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality rules", "SimHash near-dedup", "substring dedup", "personal data", "packing",
    ]


def test_run_equals_a_plain_pipeline(spark, documents):
    rows = sorted((r.doc_id, r.text, r.lang) for r in documents.collect())
    judged = quality.judge_all([t for _, t, _ in rows], [x for _, _, x in rows], quality.BANDS,
                               vocabulary("piece_bpe_32k.model"))
    rows = [r[:2] for r, j in zip(rows, judged, strict=True) if j[6]]
    prints = [signed(plain_fingerprint(t)) for _, t in rows]
    distinct = sorted(set(prints))
    label = dict(zip(distinct, plain_components(distinct), strict=True))
    first = {}
    for (doc, _), p in zip(rows, prints, strict=True):
        first.setdefault(label[p], doc)
    rows = [r for r in rows if r[0] in set(first.values())]
    rows = [
        (doc, kept)
        for (doc, _), (_, kept) in zip(rows, plain_repeats(rows, substrings.MIN_WORDS), strict=True)
    ]
    rows = [(doc, private.masked(t, private.base_spans(t))) for doc, t in rows]

    got = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == {doc for doc, _ in rows}
    for doc, text in rows:
        ids, at = np.array(plain_ids(text), "<u4"), 0
        for r in sorted(got[doc], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_every_stage_takes_edges(spark, edge_docs, no_docs):
    plain = edge_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for docs in (plain, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            out.count()
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).count()


def test_removed_and_changed(spark):
    prose = "The quick brown fox, which was red, jumps over the lazy dog and then goes home for tea number {0} in town {0}. "
    text = "".join(prose.format(i) for i in range(12))
    docs = spark.createDataFrame(
        [(1, text + "mail me at jo@example.com", "en", "s", 0), (2, text + "mail me at jo@example.com", "en", "s", 0), (3, "short", "en", "s", 0)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    kept = simhash.keep_first(docs)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]
    masked = corpus_pipeline.mask_private(spark, kept, SF).where("doc_id = 1").first()
    assert masked.text.endswith("mail me at [EMAIL]") and masked.n_chars == len(masked.text)
