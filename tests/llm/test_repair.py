import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from logclew.llm import queries, repair

SHAPE = re.compile(r"(s?(ua)+)?")
BLANK = " \t\n\x0b\x0c\r"


def plain_faults(rows):
    """rows: (role, text) in order -> fault names."""
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(BLANK)
        if not body:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def plain_repair(rows):
    """(cost, audit, repaired rows): the best suffix from every place, compared as whole strings."""
    faults = plain_faults(rows)
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    best = {s: None for s in after}
    done = {"": (0, "", ()), "a": (0, "", ()), "u": (5, "I", (("assistant", ""),)),
            "s": (10, "II", (("user", ""), ("assistant", "")))}
    best = done
    name = {"u": "user", "a": "assistant"}
    for (role, text), fault in zip(reversed(rows), reversed(faults)):
        now = {}
        for state in after:
            options = []

            def add(letter, cost, to, lines, rest):
                c, audit, out = rest[to]
                options.append((cost + c, letter + audit, lines + out))

            lead, at, spent, lines = "", state, 0, ()
            for _ in range(4):
                more = 5 if fault == "truncated" else 0
                add(lead + "D", spent + 2, at, lines, best)
                if fault not in ("blank", "duplicate"):
                    first = role[:1]
                    if first == after[at] or (first == "s" and at == ""):
                        add(lead + "K", spent + more, first, lines + ((role, text),), best)
                    add(lead + "R", spent + 1 + more, after[at], lines + ((name[after[at]], text),), best)
                lines += ((name[after[at]], ""),)
                lead, at, spent = lead + "I", after[at], spent + 5
            now[state] = min(options, key=lambda o: o[:2])
        best = now
    return best[""]


def enumerated(rows, most=14):
    """The same by trying every edit sequence of a cost up to ``most``."""
    faults = plain_faults(rows)
    found = []

    def go(i, audit, initials, cost):
        if cost > most:
            return
        if i == len(rows) and SHAPE.fullmatch(initials):
            found.append((cost, audit))
        for r in "ua":
            go(i, audit + "I", initials + r, cost + 5)
        if i == len(rows):
            return
        more = 5 if faults[i] == "truncated" else 0
        go(i + 1, audit + "D", initials, cost + 2)
        if faults[i] not in ("blank", "duplicate"):
            go(i + 1, audit + "K", initials + (rows[i][0][:1] or "?"), cost + more)
            for r in "ua":
                go(i + 1, audit + "R", initials + r, cost + 1 + more)

    go(0, "", "", 0)
    return min(found)


TEXTS = ["Yes.", "no", "What? ", "", " \n", "Good!\t", "half a", "Fine."]
ROLES = ["system", "user", "assistant", "user", "assistant", "tool", "", "sys", "a"]


def random_rows(rand, n):
    return [(rand.choice(ROLES), rand.choice(TEXTS)) for _ in range(n)]


def symbols_of(rows):
    number = lambda role: "sua".find(role[:1]) if role[:1] and role[:1] in "sua" else 3
    out = []
    for (role, _), fault in zip(rows, plain_faults(rows)):
        out.append(repair.GONE if fault in ("blank", "duplicate") else 2 * number(role) + (fault == "truncated"))
    return [(s, len(list(g))) for s, g in itertools.groupby(out)]


def test_plain_version_equals_enumeration():
    rand = random.Random(1)
    for _ in range(150):
        rows = random_rows(rand, rand.randrange(5))
        assert plain_repair(rows)[:2] == enumerated(rows)


def test_program_equals_plain_version():
    rand = random.Random(2)
    for n in [*range(12)] * 25 + [60, 200]:
        rows = random_rows(rand, n)
        if n > 6:
            rows = [r for r in rows for _ in range(rand.randint(1, 4))]
        runs = symbols_of(rows)
        cost = repair.apply(repair.matrix_of(runs), repair.FINAL)[repair.START]
        edits, state = repair.unroll(runs, repair.FINAL, repair.START)
        assert (cost, "".join(edits) + "I" * len(repair.closing(state))) == plain_repair(rows)[:2]


def test_long_runs_are_advanced_by_powers():
    users = 2 * repair.INITIALS.index("u")
    runs = [(users, 100_001)]
    rows = [("user", f"{i}.") for i in range(301)]
    edits, state = repair.unroll([(users, 301)], repair.FINAL, repair.START)
    assert "".join(edits) + "I" * len(repair.closing(state)) == plain_repair(rows)[1]
    assert repair.apply(repair.matrix_of(runs), repair.FINAL)[0] == 50_002
    assert len(repair.unroll(runs, repair.FINAL, repair.START)[0]) == 100_001


def plain_query(rows):
    """The whole contract in plain Python: rows of (conv_id, turn, role, text)."""
    conversations = {c: [] for c, *_ in rows}
    text_of = lambda v: " " if v is None else str(v)
    for c, t, role, text in rows:
        case = zlib.crc32(f"{text_of(c)}:{text_of(t)}".encode()) % 20
        role, text = text_of(role), text_of(text)
        if case == 0:
            continue
        if case == 1:
            text = ""
        if case == 2:
            text = re.sub("[.!?]", "", text)
        if case == 4:
            role = "user"
        conversations[c] += [(t, role, text)] * (2 if case == 3 else 1)
    out = {}
    for c, turns in conversations.items():
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], sha(r[2])))
        plain = [r[1:] for r in turns]
        faults = plain_faults(plain)
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        initials = [r[:1] for r, _ in plain]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, lines = plain_repair(plain)
        out[c] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
                  sha("\n".join(f"{r}:{t}" for r, t in lines)))
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
SCHEMA = "conv_id long, turn long, role string, text string"


def of_query(spark, rows, path, schema=SCHEMA):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{path}/conversations.parquet")
    got = queries.op12_min_plus_runs(spark, str(path))
    assert got.columns == ["conv_id", *COLUMNS]
    found = got.collect()
    assert len(found) == len({r["conv_id"] for r in found})
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in found}


def some_conversations():
    rand = random.Random(4)
    rows = []
    for c in [*range(120), None]:
        for t in range(rand.randrange(1, 14)):
            role = rand.choice(["user", "assistant"]) if rand.random() < 0.3 else ("user", "assistant")[t % 2]
            rows.append((c, t * rand.choice([1, 1, 1, 2]), role, f"{rand.choice('abcdef')} {rand.choice(TEXTS)}"))
    rows += [(500, None, None, None), (500, None, "user", "x."), (500, 3, "user", "x."), (501, 1, "user", None)]
    rows += [(502, 1, "user", "Same.")] * 3 + [(503, 0, "", ""), (504, 2, "assistant", "word " * 50_000)]
    # Ids of which every turn is dropped.
    gone = [c for c in range(1000, 1100) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:2]
    return rows + [(c, 0, "user", "Hello.") for c in gone]


def test_query_equals_plain_version(spark, tmp_path):
    rows = some_conversations()
    got = of_query(spark, rows, tmp_path)
    assert got == plain_query(rows)
    assert (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in got.values()


@pytest.mark.parametrize("size", [1, 3])
def test_pieces_of_any_size_give_the_same(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(repair, "PIECE_TURNS", size)
    rows = some_conversations()
    assert of_query(spark, rows, tmp_path) == plain_query(rows)


def test_one_conversation_with_most_rows(spark, tmp_path):
    rand = random.Random(8)
    rows = [(1, t, rand.choice(["user", "assistant"]), f"{rand.randrange(900)}{rand.choice('.! ?')}") for t in range(3000)]
    rows += [(c, 0, "user", "Hi.") for c in range(2, 40)]
    assert of_query(spark, rows, tmp_path) == plain_query(rows)


def test_tables_of_the_operator(spark):
    rows = [(1, 0, "user", "One."), (1, 1, "user", "Two."), (1, 2, "user", "Three."), (2, 0, "assistant", "cut")]
    turns = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("seq", "piece", "fault", "digest")})
    found = repair.repair_conversations(turns)
    mended = {}
    for r in found.repaired.orderBy("conv_id", "seq", "pos").collect():
        mended.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    plain = {c: plain_repair([r[2:] for r in rows if r[0] == c]) for c in (1, 2)}
    assert {c: plain[c][:2] for c in plain} == {r["conv_id"]: (r["cost"], r["audit"]) for r in found.conversations.collect()}
    assert mended == {c: list(v[2]) for c, v in plain.items() if v[2]}


def test_empty_table(spark, tmp_path):
    assert of_query(spark, [], tmp_path) == {}
