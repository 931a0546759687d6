import random
import re

import pytest
from pyspark.sql import functions as F

from logclew.functions.regex import check_pattern, to_java, to_java_replacement


def matches(spark, pattern, text, flags=""):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(F.regexp_extract_all("t", F.lit(to_java(pattern, flags)), F.lit(0))).first()[0]


@pytest.mark.parametrize(
    "pattern, flags, text, expected",
    [
        (r"\bcat\b", "", "écat cat_ catalog cat", ["cat", "cat"]),
        (r"\b[a-c]+\b", "", "éabc abcd bca", ["abc", "bca"]),
        (r"\b(?:ab|cd)\b", "", "éab cd_ cd", ["ab", "cd"]),
        (r"\b[a-z]?1\b", "", "é1 x1 _1", ["1", "x1"]),
        (r"x\b", "", "xé x1 x", ["x", "x"]),
        (r"a\Bb", "", "ab", ["ab"]),
        (r"a\sb", "", "a b a b", ["a b", "a b"]),
        (r"\S+", "", "a b　c", ["a", "b", "c"]),
        (r"[^\s]+", "", "a b", ["a", "b"]),
        (r"(?i)warn", "", "WARN warn", ["WARN", "warn"]),
        (r"warn", "gi", "WARN", ["WARN"]),
        (r"end$", "", "the end\n", []),
        (r"end$", "m", "the end\nx", ["end"]),
        (r"a.c", "", "a\u0085c a\nc", ["a\u0085c"]),
        (r"a.c", "s", "a\nc", ["a\nc"]),
        (r"[[a]+", "", "[a[", ["[a["]),
        (r"[a&&b]+", "", "a&b", ["a&b"]),
        (r"[\d.-]+", "", "1.2-3x", ["1.2-3"]),
        (r"[^]", "", "\n", ["\n"]),
    ],
)
def test_javascript_meaning(spark, pattern, flags, text, expected):
    assert matches(spark, pattern, text, flags) == expected


@pytest.mark.parametrize(
    "replacement, expected",
    [("$1=x", "<a>=x".replace("<a>", "a")), ("$$1", "$1"), ("[$&]", "[a]"), ("\\$", "\\$"), ("$", "$")],
)
def test_replacement(spark, replacement, expected):
    df = spark.createDataFrame([("a",)], "t string")
    out = df.select(F.regexp_replace("t", F.lit("(a)"), F.lit(to_java_replacement(replacement))))
    assert out.first()[0] == expected


def test_unsupported_replacement():
    with pytest.raises(ValueError):
        to_java_replacement("$`")


def test_bad_pattern_is_found_before_the_query(spark):
    with pytest.raises(ValueError, match="ticket_regex"):
        check_pattern(spark, to_java("(unclosed"), "ticket_regex")


def test_word_boundaries_match_ascii_semantics(spark):
    """Random texts, against Python's ASCII mode, whose ``\\b`` and ``\\w`` mean the same."""
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ab1_ é-.@ßç") for _ in range(rnd.randrange(25))) for _ in range(400)]
    patterns = [
        r"\bab?\b", r"\b[a-b]+\b", r"\b[ab.-]+\b", r"a\b", r"\b1*a", r"\b(?:a|1)+\b", r"\Ba", r"\b\w{2,}\b",
        r"[a-b-]\b", r"\b[a-b]{0,2}1", r"\d+\b", r"-\b\w", r"é\b", r"\bé", r"\b",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    counts = [F.size(F.regexp_extract_all("t", F.lit(to_java(p)), F.lit(0))).alias(f"p{n}") for n, p in enumerate(patterns)]
    for row in df.select("t", *counts).collect():
        for n, pattern in enumerate(patterns):
            expected = len(re.findall(pattern, row["t"], re.ASCII))
            assert row[f"p{n}"] == expected, (pattern, row["t"])
