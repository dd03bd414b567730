"""Failed answers asked again later, while others go on.

A stream of answers is grouped by item and definition. A failed answer is kept as state with a timer; when it is due, in some
later micro-batch, the prompt is asked again. Every answer is passed on as it comes and every new one follows with a
higher ``ingest_seq``, so the last answer wins as it does everywhere else. State is one small row per failed answer, in RocksDB
under the checkpoint, so a stopped stream asks what is due when it starts again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from evalspark.session import ship_package

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ANSWERS = "item_id bigint, definition string, prompt string, raw_response string, ingest_seq bigint, attempt int"
PENDING = "prompt string, ingest_seq bigint, attempt int"
FAILED = "ERROR:"


def failed(response: str | None) -> bool:
    return response is None or response.startswith(FAILED)


class _AskAgain(StatefulProcessor):
    def __init__(self, factory: Callable[[], Callable[[str], str]], attempts: int, backoff: Callable[[int], float]):
        self.factory, self.attempts, self.backoff = factory, attempts, backoff

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.score = handle, None
        self.pending = handle.getValueState("pending", PENDING)

    def _wait(self, now: int, prompt: str, seq: int, attempt: int) -> None:
        self.pending.update((prompt, seq, attempt))
        self.handle.registerTimer(now + int(1000 * self.backoff(attempt)))

    def _forget(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.pending.clear()

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        seen = sorted(rows, key=lambda r: r.ingest_seq)
        yield from seen
        last = seen[-1]
        older = self.pending.get()
        if older is not None and older[1] > last.ingest_seq:
            return
        self._forget()
        if failed(last.raw_response) and last.prompt is not None and last.attempt < self.attempts:
            now = timerValues.getCurrentProcessingTimeInMs()
            self._wait(now, last.prompt, last.ingest_seq, last.attempt)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        prompt, seq, attempt = self.pending.get()
        try:
            # One scorer per task.
            self.score = self.score or self.factory()
            response = self.score(prompt)
        except Exception as failure:
            response = f"{FAILED} {failure}"
        attempt += 1
        yield Row(
            item_id=key[0], definition=key[1], prompt=prompt, raw_response=response, ingest_seq=seq + 1, attempt=attempt
        )
        if failed(response) and attempt < self.attempts:
            self._wait(timerValues.getCurrentProcessingTimeInMs(), prompt, seq + 1, attempt)
        else:
            self.pending.clear()

    def close(self) -> None:
        pass


def ask_again(
    answers: DataFrame,
    scorer_factory: Callable[[], Callable[[str], str]],
    *,
    attempts: int = 3,
    backoff: Callable[[int], float] = lambda attempt: 60.0 * attempt,
) -> DataFrame:
    """The stream ``answers`` (columns of ``ANSWERS``; ``attempt`` from 1) and, later, new answers to those that failed.

    A prompt is asked up to ``attempts`` times in all, ``backoff(attempt)`` seconds after its failure or in the first
    micro-batch after that. ``ingest_seq`` of the answers to one prompt must leave room for ``attempts`` numbers. The
    session must keep state in RocksDB (``spark.sql.streaming.stateStore.providerClass`` = ``PROVIDER``).
    """
    spark = answers.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != PROVIDER:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {PROVIDER}")
    ship_package(spark)
    names = [part.split()[0] for part in ANSWERS.split(", ")]
    grouped = answers.select(*[F.col(n) for n in names]).groupBy("item_id", "definition")
    return grouped.transformWithState(
        statefulProcessor=_AskAgain(scorer_factory, attempts, backoff),
        outputStructType=ANSWERS,
        outputMode="Append",
        timeMode="ProcessingTime",
    )
