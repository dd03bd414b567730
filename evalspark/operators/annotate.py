"""Annotation: items and rubrics in, raw answers and decisions out."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.functions.answers import decision, explanation, prediction
from evalspark.operators.inflight import InFlight
from evalspark.schemas import DECISIONS, ITEMS, Rubric
from evalspark.session import ship_package

Scorer = Callable[[str], str]
ScorerFactory = Callable[[], Scorer]
NARROW = ("item_id", "truth", "keyword", "text_length")


def linear_backoff(attempt: int) -> float:
    """Seconds to wait after the given failed attempt, counted from 0."""
    return 2.0 * (attempt + 1)


def fan_out(items: DataFrame, rubrics: Sequence[Rubric]) -> DataFrame:
    """One row per item and rubric.

    The rubrics are a handful of configured texts, so they ride in the plan as literals: the fan-out is
    a local generate step, with no join and no shuffle.
    """
    entries = [
        F.struct(
            F.lit(r.definition).alias("definition"),
            F.lit(r.prefix).alias("prefix"),
            F.lit(r.suffix).alias("suffix"),
        )
        for r in rubrics
    ]
    return items.select("*", F.inline(F.array(*entries)))


def build_prompts(fanned: DataFrame) -> DataFrame:
    """Put the text between the two halves of its rubric; braces in the text stay as they are."""
    return fanned.withColumn("prompt", F.concat("prefix", "text", "suffix")).drop("prefix", "suffix")


def ask(
    score: Scorer,
    prompt: str,
    max_attempts: int,
    backoff: Callable[[int], float],
    sleep: Callable[[float], None],
) -> str:
    """Call the scorer, waiting and retrying on failure; the last failure becomes the answer."""
    for attempt in range(max_attempts):
        try:
            return score(prompt)
        except Exception as failure:
            if attempt + 1 == max_attempts:
                return f"ERROR: {failure}"
            sleep(backoff(attempt))
    raise ValueError("max_attempts must be at least 1")


def score_items(
    items: DataFrame,
    rubrics: Sequence[Rubric],
    scorer_factory: ScorerFactory,
    *,
    keep: Iterable[str] = NARROW,
    max_attempts: int = 3,
    backoff: Callable[[int], float] = linear_backoff,
    sleep: Callable[[float], None] = time.sleep,
    parallelism: int | None = None,
    max_in_flight: int = 1,
) -> DataFrame:
    """Ask for every item under every rubric: ``responses`` and ``errors`` in the rubrics' order.

    ``scorer_factory`` runs once per partition and returns the function from prompt to answer. Spark
    may run a task again, so the scorer must tolerate a repeated prompt. ``parallelism`` sets the number
    of partitions, hence of scorers, at the price of a shuffle of the items; without it, one scorer runs
    per input partition. ``max_in_flight`` is the number of prompts a partition asks at a time, each by a
    scorer of its own thread; a prompt that waits to be asked again does not hold up the others, and rows
    come out in their order. Only the ``keep`` columns and the prompts travel to Python, in Arrow batches
    whose kept columns are passed on untouched. An item's answers stay together in its row, so neither
    the long nor the wide table needs a shuffle.
    """
    if not rubrics:
        raise ValueError("no rubric to ask about")
    ship_package(items.sparkSession)
    kept = list(keep)
    source = items if parallelism is None else items.repartition(parallelism)
    prompts = F.array(*[F.concat(F.lit(r.prefix), "text", F.lit(r.suffix)) for r in rubrics])
    asked = source.select(*kept, prompts.alias("prompts"))
    texts = T.ArrayType(T.StringType())
    answered = T.StructType(
        [
            *[asked.schema[c] for c in kept],
            T.StructField("responses", texts),
            T.StructField("errors", texts),
        ]
    )

    def checked(prompt: str | None, response: object) -> tuple[str | None, str | None]:
        if prompt is None:
            return None, "no text"
        if isinstance(response, str):
            return response, None
        return None, f"scorer returned {type(response).__name__}, not text"

    def one_by_one(prompts: Iterable[str | None]) -> Iterator[str | None]:
        score = scorer_factory()
        for p in prompts:
            yield None if p is None else ask(score, p, max_attempts, backoff, sleep)

    def several(prompts: Iterable[str | None]) -> Iterator[str | None]:
        calls = InFlight(
            scorer_factory, max_in_flight, max_attempts=max_attempts, backoff=backoff, sleep=sleep
        )
        return calls.answers(prompts)

    def score_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Batches whose prompts have been handed out; reading ahead keeps calls in flight across batches.
        waiting: deque[tuple[pa.RecordBatch, list]] = deque()

        def handed_out() -> Iterator[str | None]:
            for batch in batches:
                rows = batch.column("prompts").to_pylist()
                if not rows:
                    continue
                waiting.append((batch, rows))
                for row in rows:
                    yield from row

        answers = (one_by_one if max_in_flight == 1 else several)(handed_out())
        for first in answers:
            batch, rows = waiting.popleft()
            given = chain([first], answers)
            pairs = [[checked(p, next(given)) for p in row] for row in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in kept],
                    *[
                        pa.array([[pair[i] for pair in row] for row in pairs], pa.list_(pa.string()))
                        for i in (0, 1)
                    ],
                ],
                names=answered.names,
            )

    return asked.mapInArrow(score_partition, answered)


def annotate(
    items: DataFrame,
    rubrics: Sequence[Rubric],
    model: str,
    scorer_factory: ScorerFactory,
    *,
    keep: Iterable[str] = NARROW,
    ingest_seq: int = 1,
    mode: str = "compat",
    **options,
) -> DataFrame:
    """The long table of predictions: one row per item and rubric. For options see ``score_items``."""
    kept = list(keep)
    scored = score_items(items, rubrics, scorer_factory, keep=kept, **options)
    definitions = F.array(*[F.lit(r.definition) for r in rubrics])
    rows = scored.select(*kept, F.inline(F.arrays_zip(definitions, "responses", "errors"))).toDF(
        *kept, "definition", "raw_response", "error"
    )
    return parse_answers(rows, mode=mode).select(
        *kept,
        "definition",
        F.lit(model).alias("model"),
        F.lit(ingest_seq).cast("long").alias("ingest_seq"),
        "raw_response",
        "decision",
        "explanation",
        "pred",
    )


def row_position(batch: int) -> Column:
    """A number for every row that orders rows by batch, then by task and row: the last of equal ids wins by it.

    The batch has the upper 19 bits, the task 20 and the row 24; more rows in a task stop the job.
    """
    own = F.monotonically_increasing_id()
    task, row = F.shiftright(own, 33), own.bitwiseAND(F.lit((1 << 33) - 1))
    number = F.lit(batch << 44) + F.shiftleft(task, 24) + row
    fits = (task < 1 << 20) & (row < 1 << 24)
    return F.when(fits, number).otherwise(F.raise_error(F.lit("too many rows in a task")).cast("long"))


def annotation_table(
    items: DataFrame,
    rubrics: Sequence[Rubric],
    scorer_factory: ScorerFactory,
    *,
    keep: Iterable[str] = tuple(ITEMS.names),
    ingest_seq: int = 1,
    mode: str = "compat",
    **options,
) -> DataFrame:
    """One model's annotation table: a row per item, a decision and an explanation per rubric."""
    kept = list(keep)
    scored = score_items(items, rubrics, scorer_factory, keep=kept, **options)
    parsed = []
    for i, r in enumerate(rubrics):
        response, error = F.col("responses")[i], F.col("errors")[i]
        parsed.append(decision(response, mode).alias(f"{r.definition}_Decision"))
        parsed.append(explanation(response, error).alias(f"{r.definition}_Explanation"))
    return scored.select(*kept, *parsed, row_position(ingest_seq).alias("ingest_seq"))


def parse_answers(answers: DataFrame, mode: str = "compat", unclear: str = "zero") -> DataFrame:
    """Add ``decision``, ``explanation`` and ``pred`` to rows with a ``raw_response``."""
    error = F.col("error") if "error" in answers.columns else None
    response = F.col("raw_response")
    return (
        answers.withColumn("decision", decision(response, mode))
        .withColumn("explanation", explanation(response, error))
        .withColumn("pred", prediction(F.col("decision"), unclear))
    )


def decision_counts(predictions: DataFrame) -> DataFrame:
    """How often each decision was given, per definition and model."""
    return predictions.groupBy("definition", "model").agg(
        F.count("*").alias("n_answers"),
        F.count_if(F.col("decision") == "Yes").alias("n_yes"),
        F.count_if(F.col("decision") == "No").alias("n_no"),
        F.count_if(F.col("decision") == "Unclear").alias("n_unclear"),
        F.count_if(F.col("decision") == "Error").alias("n_error"),
    )


def observe_decisions(table: DataFrame, definitions: Sequence[str]) -> tuple[DataFrame, Observation]:
    """An annotation table that counts its rows and decisions while it is written, and the observation of them.

    The counts are there once the returned table has been written; nothing is read for them.
    """
    seen = Observation()
    counts = [
        F.count_if(F.col(f"{d}_Decision") == decision).alias(f"{d}|{decision}")
        for d in definitions
        for decision in DECISIONS
    ]
    return table.observe(seen, F.count(F.lit(1)).alias("n_rows"), *counts), seen


def observed_counts(
    spark: SparkSession, seen: Observation, definitions: Sequence[str], model: str
) -> DataFrame:
    """``decision_counts`` of an observed table."""
    counts = seen.get
    rows = [
        (d, model, counts["n_rows"], *[counts[f"{d}|{x}"] for x in ("Yes", "No", "Unclear", "Error")])
        for d in definitions
    ]
    kinds = "definition string, model string, n_answers long, n_yes long, n_no long, n_unclear long, n_error long"
    return spark.createDataFrame(rows, kinds)
