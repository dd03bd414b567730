"""Items, answers and annotations derived from the ``documents`` and ``labels`` tables.

The tables hold no model answers, so these are computed from each item's id, length and label by
integer rules that any SQL engine can repeat. Every document is an item; ``truth`` is NULL for those
without a label, and asking for labelled items turns the join into an inner one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.functions.answers import decision_code
from evalspark.operators.annotate import parse_answers
from evalspark.schemas import Variant

# The answer rule of each variant, as in FIXTURES.md.
ANSWER_RULES = {
    Variant("A", "S"): (37, 11, 35, 15),
    Variant("A", "L"): (53, 7, 55, 35),
    Variant("B", "S"): (29, 13, 30, 15),
    Variant("B", "L"): (61, 17, 53, 35),
}
VARIANTS = list(ANSWER_RULES)
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LABELS = "doc_id bigint, quality int, toxic int"
DEFINITIONS = ["A", "B"]
MODELS = ["S", "L"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(DOCUMENTS).parquet(f"{sf_dir}/documents.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All items without their labels, for what does not need them."""
    return _item_columns(documents(spark, sf_dir)).drop("author", "created", "truth")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items_of(documents(spark, sf_dir), labels(spark, sf_dir))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(LABELS).parquet(f"{sf_dir}/labels.parquet")


def items_of(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return _item_columns(documents.join(labels.select("doc_id", "toxic"), "doc_id", "left"))


def _item_columns(documents: DataFrame) -> DataFrame:
    return documents.selectExpr(
        "doc_id AS item_id",
        "CAST(NULL AS STRING) AS author",
        "CAST(NULL AS STRING) AS created",
        f"{'toxic' if 'toxic' in documents.columns else 'CAST(NULL AS INT)'} AS truth",
        "if(doc_id % 53 <> 7, concat_ws('-', source, lang), NULL) AS keyword",
        "text",
        "CAST(n_chars AS INT) AS text_length",
    )


def labelled_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).where(F.col("truth").isNotNull())


def _response(yes: str, reason: str) -> str:
    """SQL of a free-form answer, in one of the shapes that models give."""
    return f"""CASE
      WHEN item_id % 30 = 4 THEN 'ERROR: Status code 500'
      WHEN item_id % 30 = 9 THEN 'Perhaps; the item is ambiguous.'
      WHEN item_id % 30 = 14 THEN 'DECISION: Cannot say\\nEXPLANATION: unsure'
      WHEN item_id % 6 = 1 THEN concat('<think>weighing it</think>\\nDECISION: ',
        if({yes}, 'yes', 'no'), '.\\n\\nEXPLANATION:\\t', {reason}, '  ')
      WHEN item_id % 6 = 2 THEN concat(if({yes}, 'YES', 'NO'), ', as the rubric states.')
      WHEN item_id % 6 = 3 THEN concat('DECISION: ', if({yes}, 'Yes', 'No'),
        '\\nEXPLANATION: first EXPLANATION: second DECISION: No')
      ELSE concat('DECISION: ', if({yes}, 'Yes', 'No'), '\\nEXPLANATION: ', {reason})
    END"""


def _says_yes(k1: int | str, k2: int | str, t0: int | str, t1: int | str) -> str:
    """SQL of a variant's answer; a second attempt turns the first around."""
    first = f"(item_id * {k1} + text_length * {k2}) % 100 < {t0} + {t1} * coalesce(truth, 0)"
    return f"(({first}) = (ingest_seq = 1))"


ATTEMPTS = "explode(if(model = 'L' AND item_id % 41 = 3, array(1L, 2L), array(1L))) AS ingest_seq"
ANSWERED = "model <> 'L' OR item_id % 37 <> 5"
BY_ID = "concat('reason ', item_id)"


def responses(source: DataFrame, quote_text: bool = False) -> DataFrame:
    """One row per item, variant and attempt, with the raw answer.

    Model L skips some items and answers others twice, the second time the other way round. With
    ``quote_text`` the answers quote the whole text as their reason, otherwise only the id.
    """
    rules = ", ".join(
        f"struct('{v.definition}' AS definition, '{v.model}' AS model, "
        f"{k1} AS k1, {k2} AS k2, {t0} AS t0, {t1} AS t1)"
        for v, (k1, k2, t0, t1) in ANSWER_RULES.items()
    )
    reason = "concat('reason ', text)" if quote_text else BY_ID
    kept = ["item_id", "truth", "keyword", "text_length"]
    answer = _response(_says_yes("k1", "k2", "t0", "t1"), reason)
    return (
        source.selectExpr(*kept, *(["text"] if quote_text else []), f"inline(array({rules}))")
        .where(ANSWERED)
        .selectExpr("*", ATTEMPTS)
        .selectExpr(*kept, "definition", "model", "ingest_seq", f"{answer} AS raw_response")
    )


def predictions(source: DataFrame, quote_text: bool = False) -> DataFrame:
    """Parsed answers, repeated attempts included."""
    parsed = parse_answers(responses(source, quote_text))
    return parsed.withColumn("decision_code", decision_code(F.col("decision")))


def annotations(source: DataFrame, model: str) -> DataFrame:
    """One model's annotation table: a row per item and attempt, columns per definition."""
    table = source.withColumn("model", F.lit(model)).where(ANSWERED).selectExpr("*", ATTEMPTS)
    for definition in DEFINITIONS:
        answer = _response(_says_yes(*ANSWER_RULES[Variant(definition, model)]), BY_ID)
        parsed = parse_answers(table.withColumn("raw_response", F.expr(answer)))
        table = parsed.withColumnsRenamed(
            {"decision": f"{definition}_Decision", "explanation": f"{definition}_Explanation"}
        ).drop("raw_response", "pred")
    return table.drop("model")


def length_scorer() -> Callable[[str], str]:
    """A scorer that judges a prompt by its length, and cannot answer some prompts."""

    def score(prompt: str) -> str:
        n = len(prompt)
        if n % 10 == 0:
            raise RuntimeError("Status code 500")
        if n % 10 == 1:
            return "Perhaps."
        return f"DECISION: {'Yes' if n % 3 == 0 else 'No'}\nEXPLANATION: {n} characters "

    return score


def no_wait(seconds: float) -> None:
    """Stand-in for sleep where failures are final, so that waiting would not help."""


def at_once(attempt: int) -> float:
    """No back-off, for the same reason."""
    return 0.0
