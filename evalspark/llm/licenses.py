"""License scan by a positional index of rare words.

Each template is a key phrase with a label. Document frequencies of all template words are counted over
the whole table, and the ``ANCHORS`` rarest words of a phrase (the first of equals) become its postings: word, phrase,
place in the phrase. All words of a text are looked up in the postings. A hit gives the place where the phrase would have to
start; the postings that agree on that start are intersected there, so a start is proposed once. Where all of
them agree, the whole phrase is compared; where some do, the phrase stands altered and has a share. Texts are never exploded or shuffled: the only shuffle holds one count per template word.

Defined cases: a null or empty text has no words, no labels and score 0; repeated rows each give their own
row; an empty table gives an empty result; other columns are carried along only if asked for by ``keep``.
Of the vocabulary of the templates (a fixed list) one row per word reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Phrase(NamedTuple):
    label: str
    words: tuple[str, ...]
    base: bool = False


def _phrases(lines: str, base: bool) -> list[Phrase]:
    pairs = [line.split(": ") for line in lines.strip().splitlines()]
    return [Phrase(label, tuple(words.split()), base) for words, label in pairs]


# Phrases in lower case, and their labels.
BASE_PHRASES = _phrases(
    """
under the mit license: mit
apache license version 2: apache-2
cc by nc: cc-by-nc
""",
    True,
)
MORE_PHRASES = _phrases(
    """
permission is hereby granted free of charge to any person obtaining a copy: mit
apache org licenses license 2 0: apache-2
creative commons attribution noncommercial: cc-by-nc
cc by sa: cc-by-sa
cc0 1 0 universal: cc0
gnu general public license version 2: gpl-2
gnu general public license version 3: gpl-3
gnu lesser general public license: lgpl
gnu affero general public license: agpl
mozilla public license version 2: mpl-2
eclipse public license: epl
redistribution and use in source and binary forms: bsd
permission to use copy modify and or distribute this software for any purpose: isc
this is free and unencumbered software released into the public domain: unlicense
all rights reserved: all-rights-reserved
""",
    False,
)
PHRASES = BASE_PHRASES + MORE_PHRASES
# Rare words by which a template is looked up.
ANCHORS = 3
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text with A-Z in lower case.

    ``lower`` also folds other letters, which changes neither the cuts between words nor what equals an
    ASCII word, but for the Kelvin sign, whose lower case is an ASCII letter; it is masked.
    """
    plain = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\ufffd")))
    return F.array_remove(F.split(plain, NOT_WORD), "")


def word_weights(words: DataFrame, phrases: Sequence[Phrase]) -> dict[str, float]:
    """Inverse document frequency of every phrase word over all rows of ``words``."""
    vocabulary = sorted({w for p in phrases for w in p.words})
    found = F.array_intersect("words", F.array(*map(F.lit, vocabulary)))
    # The empty word counts the documents.
    counted = words.select(F.explode(F.array_append(found, F.lit(""))).alias("word")).groupBy("word").count()
    n = {r["word"]: r["count"] for r in counted.collect()}
    return {w: math.log((n.get("", 0) + 1) / (n.get(w, 0) + 1)) + 1e-9 for w in vocabulary}


def _rarest(phrase: Phrase, weights: dict[str, float], n: int = ANCHORS) -> list[int]:
    """Places of the phrase's rarest words, the rarest first; all of them in a short phrase."""
    return sorted(range(len(phrase.words)), key=lambda i: (-weights[phrase.words[i]], i))[:n]


def scan_licenses(
    documents: DataFrame, phrases: Sequence[Phrase] = PHRASES, keep: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """One row per document: the places of base phrases, labels, and a score.

    ``score`` is the best share, over all places where one of a phrase's rare words stands as it should, of the phrase's
    word weights that do: 1 where a whole phrase stands, less for altered ones, 0 without a rare word.
    """
    words = documents.select(*keep, words_of(F.col("text")).alias("words"))
    weights = word_weights(words, phrases)
    anchors = {p: _rarest(phrase, weights) for p, phrase in enumerate(phrases)}
    posted = [(phrases[p].words[at], p, at) for p, places in anchors.items() for at in places]
    lookup = sorted({word for word, *_ in posted})
    postings = F.array(*
        [
            F.struct(
                F.lit(word).alias("word"), F.lit(p).alias("phrase"), F.lit(at).alias("at")
            )
            for word, p, at in posted
        ]
    )
    templates = F.array(*
        [
            F.struct(
                F.array(*map(F.lit, phrase.words)).alias("words"),
                F.array(*[F.lit(weights[w]) for w in phrase.words]).alias("weights"),
                F.lit(sum(weights[w] for w in phrase.words)).alias("whole"),
                F.array(*map(F.lit, anchors[p])).alias("anchors"),
                F.lit(phrase.label).alias("label"),
                F.lit(phrase.base).alias("base"),
            )
            for p, phrase in enumerate(phrases)
        ]
    )

    def word_at(i: Column) -> Column:
        return F.when((i >= 0) & (i < F.size("words")), F.get("words", i))

    def agrees(t: Column, start: Column) -> Column:
        return F.filter(t["anchors"], lambda at: word_at(start + at) == F.get(t["words"], at))

    def proposals(i: Column) -> Column:
        """Starts at which a template's rare words would stand here; each by the rarest word that does."""
        own = F.filter(postings, lambda p: p["word"] == F.get("words", i))
        starts = F.transform(
            own,
            lambda p: F.struct(
                F.get(templates, p["phrase"]).alias("t"), (i - p["at"]).alias("start"), p["at"].alias("at")
            ),
        )
        starts = F.transform(starts, lambda c: c.withField("agree", agrees(c["t"], c["start"])))
        return F.filter(starts, lambda c: F.get(c["agree"], F.lit(0)) == c["at"])

    def share(c: Column) -> Column:
        hit = F.transform(
            c["t"]["words"],
            lambda w, k: F.when(word_at(c["start"] + k) == w, F.get(c["t"]["weights"], k)).otherwise(0.0),
        )
        return F.aggregate(hit, F.lit(0.0), lambda a, x: a + x) / c["t"]["whole"]

    def stands(c: Column) -> Column:
        t, start = c["t"], c["start"]
        agree = F.size(c["agree"]) == F.size(t["anchors"])
        inside = (start >= 0) & (start + F.size(t["words"]) <= F.size("words"))
        # A slice has to begin inside the array even where the rest of the condition is false.
        there = F.slice("words", F.greatest(start, F.lit(0)) + 1, F.size(t["words"])) == t["words"]
        return F.coalesce(agree & inside & there, F.lit(False))

    places = F.array_compact(F.transform("words", lambda w, i: F.when(w.isin(lookup), i)))
    proposed = F.flatten(F.transform(places, proposals))
    some = F.arrays_overlap("words", F.array(*map(F.lit, lookup)))
    found = F.transform(
        proposed,
        lambda c: F.struct(
            c["t"]["label"].alias("label"),
            c["t"]["base"].alias("base"),
            c["start"].cast("long").alias("start"),
            share(c).alias("share"),
            stands(c).alias("stands"),
        ),
    )
    scanned = words.select(
        *keep, F.size("words").cast("long").alias("n_words"), F.when(some, found).alias("found")
    )
    empty = "cast(array() AS array<struct<label:string,base:boolean,start:bigint,share:double,stands:boolean>>)"
    standing = scanned.withColumn("found", F.coalesce("found", F.expr(empty))).withColumn(
        "standing", F.filter("found", lambda c: c["stands"])
    )
    standing = standing.withColumn("bases", F.filter("standing", lambda c: c["base"]))

    def labels(column: str) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.col(column)["label"])), ",")

    return standing.select(
        *keep,
        "n_words",
        F.size("bases").cast("long").alias("n_base"),
        F.array_min(F.col("bases")["start"]).alias("first_word"),
        F.array_max(F.col("bases")["start"]).alias("last_word"),
        labels("bases").alias("base_labels"),
        labels("standing").alias("labels"),
        F.round(F.coalesce(F.array_max(F.col("found")["share"]), F.lit(0.0)), 9).alias("score"),
        F.transform(
            "standing",
            lambda c: F.struct(c["label"].alias("label"), c["start"].alias("start"), c["base"].alias("base")),
        ).alias("matches"),
    )
