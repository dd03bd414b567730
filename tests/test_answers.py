import random
import re

import pytest
from pyspark.sql import functions as F

from evalspark.functions.answers import response_field, strip_preamble
from evalspark.functions.text import content_words, strip, words
from evalspark.operators.annotate import parse_answers

CASES = [
    (None, "Error", "no response", 0),
    ("", "Unclear", "", 0),
    ("DECISION: Yes\nEXPLANATION: because", "Yes", "because", 1),
    ("DECISION: No.\n\nEXPLANATION:\t because \n", "No", "because", 0),
    ("DECISION: Yes", "Yes", "DECISION: Yes", 1),
    ("EXPLANATION: no such thing", "No", "EXPLANATION: no such thing", 0),
    ("EXPLANATION: first DECISION: Yes", "Yes", "first DECISION: Yes", 1),
    ("DECISION: no DECISION: yes EXPLANATION: x", "No", "x", 0),
    ("<think>DECISION: yes?</think> DECISION: No EXPLANATION: y", "Yes", "y", 1),
    ("DECISION: yes and no EXPLANATION: z", "Yes", "z", 1),
    ("DECISION: Cannot say EXPLANATION: z", "No", "z", 0),
    ("DECISION: I do know EXPLANATION: z", "No", "z", 0),
    ("DECISION: Maybe EXPLANATION: yes", "Unclear", "yes", 0),
    ("DECISION: Yes EXPLANATION: one EXPLANATION: two", "Yes", "one", 1),
    ("." * 47 + "yes", "Yes", "." * 47 + "yes", 1),
    ("." * 48 + "yes", "Unclear", "." * 48 + "yes", 0),
    ("ERROR: Status code 500", "Unclear", "ERROR: Status code 500", 0),
    ("DECISION: YES EXPLANATION:   kept inside　", "Yes", "kept inside", 1),
]


def _answers(spark, responses):
    return spark.createDataFrame(list(enumerate(responses)), "i int, raw_response string")


def test_cases(spark):
    rows = parse_answers(_answers(spark, [c[0] for c in CASES])).orderBy("i").collect()
    for case, row in zip(CASES, rows, strict=True):
        assert (row.raw_response, row.decision, row.explanation, row.pred) == case


def _restated(response):
    """The rules again, by regular expressions."""
    marks = "DECISION:|EXPLANATION:"
    if "DECISION:" in response and "EXPLANATION:" in response:
        judged = re.search(f"DECISION:(.*?)(?={marks}|\\Z)", response, re.S)[1].lower()
        explained = re.search("EXPLANATION:(.*?)(?=EXPLANATION:|\\Z)", response, re.S)[1].strip()
    else:
        judged, explained = response.lower()[:50], response
    found = re.search("yes", judged) or re.search("no", judged)
    return {"yes": "Yes", "no": "No", None: "Unclear"}[found and found[0]], explained


def test_random_responses(spark):
    pick = random.Random(5)
    pieces = ["DECISION:", "EXPLANATION:", "Yes", "no", "NO", "maybe", " ", "\n", "\t", "\x1f", "é", "😀"]
    pieces += [" ", " ", "DECISION", ":", "x" * 30]
    responses = ["".join(pick.choices(pieces, k=pick.randint(0, 14))) for _ in range(3000)]
    rows = parse_answers(_answers(spark, responses)).orderBy("i").collect()
    for response, row in zip(responses, rows, strict=True):
        assert (row.decision, row.explanation) == _restated(response), response


def test_word_mode(spark):
    responses = ["Cannot say", "No, never", "yesterday", "Yes!"]
    rows = parse_answers(_answers(spark, responses), mode="word").orderBy("i").collect()
    assert [r.decision for r in rows] == ["Unclear", "No", "Unclear", "Yes"]
    with pytest.raises(ValueError):
        parse_answers(_answers(spark, responses), mode="other")


def test_unclear_as_null(spark):
    rows = parse_answers(_answers(spark, ["yes", "no", "?", None]), unclear="null").orderBy("i")
    assert [r.pred for r in rows.collect()] == [1, 0, None, None]


def test_preamble_and_body(spark):
    df = spark.createDataFrame(
        [("<think>a</think>b", '{"response": "x\\ny", "done": true}'), ("c", '{"done": true}')],
        "r string, body string",
    )
    rows = df.select(strip_preamble(F.col("r")).alias("r"), response_field(F.col("body")).alias("b"))
    assert [tuple(r) for r in rows.collect()] == [("b", "x\ny"), ("c", "")]


def test_words(spark):
    texts = ["Éaux d'été a b2 _x the THE co-op", "", "naïve 日本語 x", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    found = df.select(
        words(F.col("text")).alias("w"),
        content_words(F.col("text"), ["the"]).alias("c"),
        strip(F.concat(F.lit("\x85\x1c "), "text", F.lit(" "))).alias("s"),
    ).collect()
    for text, row in zip(texts, found, strict=True):
        if text is None:
            assert row.w is None and row.c is None
            continue
        expected = re.findall(r"\b\w\w+\b", text.lower())
        assert row.w == expected
        assert row.c == [w for w in expected if w != "the"]
        assert row.s == text.strip()
