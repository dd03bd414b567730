"""Table schemas and the small configuration records the operators take."""

from __future__ import annotations

from string import Formatter
from typing import NamedTuple

from pyspark.sql import types as T


class Variant(NamedTuple):
    """One classifier under test: a model answering under one definition."""

    definition: str
    model: str

    @property
    def name(self) -> str:
        return f"{self.definition}_{self.model}"


class Rubric(NamedTuple):
    """A labelling instruction, split where the item's text goes."""

    definition: str
    prefix: str
    suffix: str

    @classmethod
    def from_template(cls, definition: str, template: str) -> Rubric:
        """Split a ``str.format`` template that has exactly one ``{text}`` field."""
        parts = [(literal or "", field) for literal, field, _, _ in Formatter().parse(template)]
        fields = [field for _, field in parts if field is not None]
        if fields != ["text"]:
            raise ValueError(f"rubric {definition!r} needs exactly one {{text}} field, found {fields}")
        at = next(i for i, (_, field) in enumerate(parts) if field is not None)
        return cls(
            definition,
            "".join(literal for literal, _ in parts[: at + 1]),
            "".join(literal for literal, _ in parts[at + 1 :]),
        )


# Column headings of the CSV files, in file order, and our names for them.
CSV_ITEM_COLUMNS = {
    "TweetID": "item_id",
    "Username": "author",
    "CreateDate": "created",
    "Biased": "truth",
    "Keyword": "keyword",
    "Text": "text",
}

DECISIONS = ("No", "Yes", "Unclear", "Error")

ITEMS = T.StructType(
    [
        T.StructField("item_id", T.LongType()),
        T.StructField("author", T.StringType()),
        T.StructField("created", T.StringType()),
        T.StructField("truth", T.IntegerType()),
        T.StructField("keyword", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)

PREDICTIONS = T.StructType(
    [
        T.StructField("item_id", T.LongType()),
        T.StructField("definition", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("ingest_seq", T.LongType()),
        T.StructField("raw_response", T.StringType()),
        T.StructField("decision", T.StringType()),
        T.StructField("explanation", T.StringType()),
        T.StructField("pred", T.IntegerType()),
    ]
)


def annotations_schema(definitions: list[str]) -> T.StructType:
    """One row per item and attempt, with a decision and an explanation per definition."""
    schema = T.StructType(list(ITEMS.fields))
    for definition in definitions:
        schema = schema.add(f"{definition}_Decision", T.StringType())
        schema = schema.add(f"{definition}_Explanation", T.StringType())
    return schema


def comparative_schema(variants: list[Variant]) -> T.StructType:
    """One row per item, with a nullable 0/1 answer per variant."""
    schema = T.StructType(list(ITEMS.fields))
    for variant in variants:
        schema = schema.add(variant.name, T.IntegerType())
    return schema.add("text_length", T.IntegerType())
