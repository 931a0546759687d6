import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from logclew.llm import periodic, queries


def plain_runs(words, min_words=6, min_exponent=4):
    """Every period, word by word; of equal stretches the least period."""
    n, found = len(words), {}
    for q in range(1, n // min_exponent + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            start = i - q
            while i < n and words[i] == words[i - q]:
                i += 1
            if i - start >= max(min_words, min_exponent * q):
                found.setdefault((start, i - start), q)
    return sorted(((s, m, q) for (s, m), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    """The whole contract of the query, in plain Python."""
    words = [w.decode() for w in (text or "").encode().split()]
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    milli = 1000 * best[1] // best[2] if runs else None
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (doc_id, len(runs), *best, milli, sha(listed), sha(kept))


def caught(ids, cuts, min_words=6, min_exponent=4):
    catcher = periodic.SquareCatcher(len(ids) // min_exponent)
    for a, b in zip([0, *cuts], [*cuts, len(ids)]):
        catcher.append(np.array(ids[a:b], np.int64))
    return list(zip(*(c.tolist() for c in catcher.runs(min_words, min_exponent))))


pieces = st.lists(
    st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 9)), max_size=6
)


@given(pieces, st.lists(st.integers(0, 200), max_size=4), st.sampled_from([(6, 4), (1, 2), (9, 3)]))
@settings(max_examples=400, deadline=None)
def test_equals_plain_runs_however_it_is_fed(parts, cuts, least):
    ids = [x for unit, times in parts for x in unit * times]
    cuts = sorted(min(c, len(ids)) for c in cuts)
    assert caught(ids, cuts, *least) == plain_runs(ids, *least)


def test_word_by_word_and_thue_morse():
    rand = random.Random(3)
    ids = [rand.randrange(2) for _ in range(300)]
    assert caught(ids, range(1, 300), 1, 2) == plain_runs(ids, 1, 2)
    # The words on which hashes of this kind may collide.
    morse = [bin(i).count("1") % 2 for i in range(4096)]
    assert caught(morse * 5, [], 6, 4) == plain_runs(morse * 5)


def test_long_periods_and_many_words():
    rand = random.Random(5)
    unit = [rand.randrange(50) for _ in range(3000)]
    ids = [7] * 11 + unit * 4 + unit[:17] + [9]
    assert (11, 12_017, 3000) in caught(ids, [5000])
    assert caught([1] * 40_000, []) == [(0, 40_000, 1)]


def test_query_equals_plain_version(spark, tmp_path):
    rand = random.Random(11)
    rows = []
    for i in range(400):
        words = [rand.choice("ab cd ef gh ij klä".split()) for _ in range(rand.randrange(70))]
        if i % 3 == 0:
            words += words[-rand.randint(1, 5) :] * rand.randint(1, 9) if words else []
        rows.append((i, rand.choice([" ", "\n", " \t", "\x0b"]).join(words)))
    rows += [(None, "a a a a a a a"), (1, None), (2, ""), (2, ""), (3, "\x1f            ")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.op11_square_catchers(spark, str(tmp_path)).collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted((plain_row(*r) for r in rows), key=key)


def test_edges(spark, edge_docs, no_docs):
    found = periodic.find_runs(edge_docs)
    assert found.columns == ["doc_id", "runs", "collapsed"]
    rows = {r["doc_id"]: r for r in found.collect()}
    assert found.count() == edge_docs.count()
    long = rows[5]["runs"]
    assert [tuple(r) for r in long] == [(0, 30_000, 1)] and rows[5]["collapsed"] == "word"
    assert rows[1]["runs"] == [] and rows[1]["collapsed"] == ""
    assert periodic.find_runs(no_docs).collect() == []


def test_whole_table_equals_plain_version(spark, documents):
    short = [(r["doc_id"], r["text"]) for r in documents.collect() if len((r["text"] or "").split()) < 400]
    docs = spark.createDataFrame(short, "doc_id long, text string")
    changed = {r["doc_id"]: r["text"] for r in queries.made_periodic(docs).collect()}
    got = {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in periodic.find_runs(queries.made_periodic(docs)).collect()}
    assert got == {k: plain_runs((t or "").encode().split()) for k, t in changed.items()}
