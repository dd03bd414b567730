"""Merging the answers of several models into long and wide tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.answers import decision_name, prediction
from evalspark.schemas import Variant


def binarize(annotations: DataFrame, definitions: Sequence[str], unclear: str = "zero") -> DataFrame:
    """Add a 0/1 column next to each definition's decision."""
    return annotations.withColumns(
        {f"{d}_Binary": prediction(F.col(f"{d}_Decision"), unclear) for d in definitions}
    )


def combine_models(annotations: Mapping[str, DataFrame], definitions: Sequence[str]) -> DataFrame:
    """Stack the models' annotation tables, each tagged with its model and binarised."""
    tagged = [
        binarize(df, definitions).withColumn("model", F.lit(model)) for model, df in annotations.items()
    ]
    return reduce(DataFrame.unionByName, tagged)


def long_answers(combined: DataFrame, definitions: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """From one decision column per definition to one row per definition."""
    entries = [
        F.struct(
            F.lit(d).alias("definition"),
            F.col(f"{d}_Decision").alias("decision"),
            F.col(f"{d}_Binary").alias("pred"),
        )
        for d in definitions
    ]
    return combined.select(*keep, "model", F.inline(F.array(*entries)))


def last_answer(
    answers: DataFrame, keys: Sequence[str], values: Sequence[str], order: str = "ingest_seq"
) -> DataFrame:
    """Per key, the values of the row with the highest ``order``, which must be unique within a key.

    A grouped ``max_by`` combines before the shuffle, so a key repeated very often costs no more than
    any other, which a window over the key could not promise. Fixed-width values keep the aggregation
    hash-based.
    """
    return answers.groupBy(*keys).agg(*[F.max_by(v, order).alias(v) for v in values])


def answers_by_item(
    predictions: DataFrame,
    variants: Sequence[Variant],
    item_columns: Sequence[str] = ("item_id", "truth", "keyword", "text_length"),
    value: str = "pred",
    order: str = "ingest_seq",
) -> DataFrame:
    """One row per item with the last answer of every variant, NULL where a variant has none.

    De-duplication and pivot in one aggregation, hence one shuffle. ``item_columns`` are properties of
    the item, equal on all its rows, so they ride along as grouping keys and the aggregation buffer
    holds numbers only.
    """

    def last(variant: Variant) -> Column:
        mine = (F.col("definition") == variant.definition) & (F.col("model") == variant.model)
        return F.max_by(value, F.when(mine, F.col(order))).alias(variant.name)

    return predictions.groupBy(*item_columns).agg(*[last(v) for v in variants])


def unpivot_predictions(
    wide: DataFrame, variants: Sequence[Variant], keep: Sequence[str], value: str = "pred"
) -> DataFrame:
    """Wide to long: one row per item and variant, missing answers kept as NULL."""
    entries = [
        F.struct(
            F.lit(v.definition).alias("definition"),
            F.lit(v.model).alias("model"),
            F.col(v.name).alias(value),
        )
        for v in variants
    ]
    return wide.select(*keep, F.inline(F.array(*entries)))


def evaluation_rows(
    predictions: DataFrame,
    variants: Sequence[Variant],
    item_columns: Sequence[str] = ("item_id", "truth", "keyword", "text_length"),
) -> DataFrame:
    """One row per item and variant with the last ``decision`` and ``pred``, NULL where none was given.

    Needs ``decision_code`` in ``predictions``. This is the input of the metrics and slices.
    """
    wide = answers_by_item(predictions, variants, item_columns, value="decision_code")
    rows = unpivot_predictions(wide, variants, item_columns, value="decision_code")
    return rows.select(
        *item_columns,
        "definition",
        "model",
        decision_name(F.col("decision_code")).alias("decision"),
        (F.col("decision_code") == 1).cast("int").alias("pred"),
    )


def comparative(
    base: DataFrame,
    base_model: str,
    others: Mapping[str, DataFrame],
    definitions: Sequence[str],
    item_columns: Sequence[str] = ("item_id", "author", "created", "truth", "keyword", "text"),
    order: str = "ingest_seq",
) -> DataFrame:
    """The wide table of the base model's rows with the other models' last answers beside them.

    All rows of the base stay, repeated ids included; an id another model has not answered gets NULL.
    ``base`` and ``others`` are binarised annotation tables. A base id may repeat without bound: the
    lookup is grouped by id and model, so both join inputs come straight from a shuffle of their own
    and adaptive execution can split the partitions of such an id.
    """
    wide = base.select(
        *item_columns,
        *[F.col(f"{d}_Binary").alias(Variant(d, base_model).name) for d in definitions],
    )
    for model, annotations in others.items():
        names = {f"{d}_Binary": Variant(d, model).name for d in definitions}
        lookup = (
            last_answer(annotations, ["item_id", "model"], list(names), order)
            .withColumnsRenamed(names)
            .drop("model")
        )
        wide = wide.join(lookup, "item_id", "left")
    return wide.withColumn("text_length", F.length("text"))


def select_models(predictions: DataFrame, models: Sequence[str]) -> DataFrame:
    return predictions.where(F.col("model").isin(list(models)))


def unscored_items(items: DataFrame, predictions: DataFrame, variants: Sequence[Variant]) -> DataFrame:
    """Items a variant has not answered: one row per id and variant, also where an id is listed twice.

    The answered variants are gathered per item as bits before the join, 62 to a number, so an item crosses
    the network once and not once per variant.
    """
    words = range(-(-len(variants) // 62))
    bits = [F.lit(None).cast("long") for _ in words]
    for i, v in reversed(list(enumerate(variants))):
        mine = (F.col("definition") == v.definition) & (F.col("model") == v.model)
        bits[i // 62] = F.when(mine, F.lit(1 << i % 62).cast("long")).otherwise(bits[i // 62])
    answered = predictions.groupBy("item_id").agg(*[F.bit_or(b).alias(f"answered_{w}") for w, b in enumerate(bits)])
    entries = [
        F.struct(
            F.lit(v.definition).alias("definition"),
            F.lit(v.model).alias("model"),
            F.coalesce(f"answered_{i // 62}", F.lit(0)).bitwiseAND(F.lit(1 << i % 62).cast("long")).alias("seen"),
        )
        for i, v in enumerate(variants)
    ]
    return (
        items.select("item_id")
        .distinct()
        .join(answered, "item_id", "left")
        .select("item_id", F.inline(F.array(*entries)))
        .where("seen = 0")
        .select("item_id", "definition", "model")
    )
