import random

from logclew.llm import substrings


def plain(rows, min_words):
    """rows in rank order: (id, text) -> removed spans and kept text, with sets of what was seen."""
    seen, lines, out = set(), set(), []
    for _, text in rows:
        gone, run, at = set(), [], 0
        for start, end, unit in [*substrings.units_of(text), (0, 0, None)]:
            if unit is not None and unit in seen:
                run.append((start, end, unit))
                continue
            lengths = [len(u.split()) for _, _, u in run]
            if run and sum(n for n in lengths if n > 2) >= min_words:
                gone |= set(range(run[0][0], run[-1][1]))
            run = []
            seen.add(unit)
        for line in (text or "").split("\n"):
            same = " ".join(line.strip(".,;:!?。，、；：！？ \t").lower().split())
            if len(same.split()) >= 5:
                if same in lines:
                    gone |= set(range(at, min(at + len(line) + 1, len(text))))
                lines.add(same)
            at += len(line) + 1
        spans = []
        for i in sorted(gone):
            if spans and spans[-1][1] == i:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((i, i + 1))
        out.append((spans, "".join(c for i, c in enumerate(text or "") if i not in gone)))
    return out


def corpus(seed=1):
    rand = random.Random(seed)
    sentence = lambda: " ".join(rand.choice("abcdefghijklmnop") * rand.randint(1, 6) for _ in range(rand.randint(2, 9)))
    passages = [". ".join(sentence() for _ in range(12)) + ". " for _ in range(4)]
    rows = []
    for i in range(60):
        text = "".join(sentence() + rand.choice([", ", ". ", "\n", "!! "]) for _ in range(10))
        if rand.random() < 0.6:
            at = rand.randrange(len(text))
            text = text[:at] + " " + rand.choice(passages) + text[at:]
        rows.append((i, text))
    return rows


def test_equals_plain_version(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in substrings.remove_repeats(docs).collect()}
    want = plain(rows, substrings.MIN_WORDS)
    assert any(spans for spans, _ in want)
    for (i, _), (spans, kept) in zip(rows, want, strict=True):
        assert [tuple(s) for s in got[i].removed_spans] == spans and got[i].text == kept


def test_offsets_are_of_the_original(spark):
    rows = corpus(2)
    originals = dict(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in substrings.remove_repeats(docs).collect():
        assert r.text == substrings.cut(originals[r.doc_id], [tuple(s) for s in r.removed_spans])


def test_short_repeats_stay(spark):
    short = "Yes. And so on.\nOf course it is, sir."
    docs = spark.createDataFrame([(1, short), (2, short + "\nNo.")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in substrings.remove_repeats(docs).collect()} == {
        1: short, 2: "Yes. And so on.\nNo."}


def test_lines_need_no_run(spark):
    line = "All rights to this text are reserved."
    rows = [(i, f"{'abcde'[i] * 3} {'vwxyz'[i]} one.\n{line}\nend {'abcde'[i]}") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in substrings.remove_repeats(docs).collect()}
    assert got[0].text == rows[0][1] and not got[0].removed_spans
    for i, text in rows[1:]:
        at = text.index(line)
        assert [tuple(s) for s in got[i].removed_spans] == [(at, at + len(line) + 1)]
        assert got[i].text == text.replace(line + "\n", "")


def test_scripts_without_blanks(spark):
    shared = "".join(f"{'天地玄黄宇宙洪荒日月'[i]}在这里的句子是相同的。" for i in range(10))
    rows = [(i, f"{'甲乙丙'[i]}开头不同，{shared}{'甲乙丙'[i]}结尾不同") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in substrings.remove_repeats(docs).collect()}
    assert got == {0: rows[0][1], 1: "乙开头不同，乙结尾不同", 2: "丙开头不同，丙结尾不同"}


def test_edges(edge_docs, no_docs):
    out = substrings.remove_repeats(edge_docs, min_words=5)
    assert out.columns == [*edge_docs.columns, "removed_spans"]
    rows = out.collect()
    assert len(rows) == edge_docs.count()
    assert sorted(r.text for r in rows if r.doc_id == 3) == ["", "one two three four five six seven"]
    assert [r.text for r in rows if r.doc_id == 1] == [None]
    assert sorted(r.text or "" for r in rows if r.doc_id is None) == ["", ""]
    assert substrings.remove_repeats(no_docs).count() == 0
