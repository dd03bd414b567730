"""Concurrent calls of one task."""

import threading
import time

import pytest
from test_annotate import RUBRICS, _items, echo

from evalspark.operators.annotate import annotate
from evalspark.operators.inflight import InFlight


def calls(factory, limit, **options):
    return InFlight(factory, limit, **{"max_attempts": 3, "backoff": lambda n: 0.0, **options})


def test_order_and_speed():
    """Eight calls at a time are over five times as fast, and answers keep the order of the prompts."""
    opened = []

    def factory():
        opened.append(threading.get_ident())

        def score(prompt):
            time.sleep(0.03 + 0.01 * (hash(prompt) % 3 == 0))
            return prompt.upper()

        return score

    prompts = [f"p{i}" for i in range(96)]
    seconds = {}
    for limit in (1, 8):
        start = time.perf_counter()
        assert list(calls(factory, limit).answers(prompts)) == [p.upper() for p in prompts]
        seconds[limit] = time.perf_counter() - start
    assert seconds[1] > 5 * seconds[8]
    assert len(opened) == 1 + 8, "one scorer per thread"


def test_back_off_holds_up_nobody():
    """One prompt fails twice and waits; all others are answered meanwhile, by a single other thread too."""
    answered = []

    def factory():
        def score(prompt):
            if prompt == "bad" and answered.count("bad") < 2:
                answered.append("bad")
                raise RuntimeError("busy")
            answered.append(prompt)
            return prompt

        return score

    prompts = ["bad", *map(str, range(20))]
    got = list(calls(factory, 1, backoff=lambda n: 0.2).answers(prompts))
    assert got == prompts
    assert answered.index("19") < len(answered) - 1 - answered[::-1].index("bad")


def test_window_and_attempts():
    """The oldest prompt waits for its back-off: only ``ahead`` prompts are read meanwhile. Then failures are answers."""
    read, waits = [], []

    def prompts():
        for i in range(100):
            read.append(i)
            yield None if i == 5 else f"p{i}"

    def factory():
        def score(prompt):
            if prompt in ("p0", "p7"):
                raise RuntimeError(f"no {prompt}")
            return prompt

        return score

    stream = calls(
        factory, 4, ahead=10, backoff=lambda n: 60.0, sleep=lambda s: waits.append((s, len(read)))
    ).answers(prompts())
    assert next(stream) == "ERROR: no p0"
    assert waits[0][1] == 10 and all(s > 50 for s, _ in waits)
    rest = list(stream)
    assert rest[4] is None and rest[6] == "ERROR: no p7" and rest[-1] == "p99" and len(rest) == 99


def test_closing_cancels():
    begun = []

    def factory():
        def score(prompt):
            begun.append(prompt)
            time.sleep(0.05)
            return prompt

        return score

    stream = calls(factory, 2).answers(f"p{i}" for i in range(1000))
    assert next(stream) == "p0"
    stream.close()
    count = len(begun)
    time.sleep(0.2)
    assert len(begun) <= count + 2 < 20


def test_broken_factory():
    def factory():
        raise RuntimeError("no server")

    assert list(calls(factory, 3).answers(["a", None, "b"])) == ["ERROR: no server", None, "ERROR: no server"]
    for wrong in ({"limit": 0}, {"max_attempts": 0}):
        with pytest.raises(ValueError):
            InFlight(factory, **{"limit": 1, "max_attempts": 1, "backoff": lambda n: 0.0, **wrong})


@pytest.mark.parametrize("size", ["3", "2000"])
def test_same_rows_as_one_by_one(spark, size):
    """Several batches and partitions; failures, other types and null texts included."""

    def scorer():
        answer = echo()

        def score(prompt):
            if "boom" in prompt:
                raise RuntimeError("Status code 500")
            return 7 if "number" in prompt else answer(prompt)

        return score

    texts = ["bad", "good", "boom", "number", None, "bad boom"] * 15
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        got = [
            annotate(
                _items(spark, texts).coalesce(2), RUBRICS, "M", scorer, backoff=lambda n: 0.0, max_in_flight=n
            ).collect()
            for n in (1, 8)
        ]
        assert got[0] == got[1] and len(got[0]) == 180
        empty = annotate(_items(spark, texts).limit(0), RUBRICS, "M", scorer, max_in_flight=8)
        assert empty.collect() == []
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
