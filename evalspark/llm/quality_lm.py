"""Quality classifier: perplexity under a Kneser-Ney model of trusted text, with a threshold per language.

The model is an interpolated modified Kneser-Ney model of order 4 over the bytes of the texts, as they are. Counts of n-grams are
tables sharded by n-gram, which grow with the different n-grams of the trusted texts; continuation counts, totals and discounts
are aggregations of them, and the probabilities come from joins of an order's counts with its contexts and with the order below.

The logarithm of a probability is a sum of weights: of the n-gram, its context, and the same of its shorter ends, each 0 if it
was not seen. So a text's score is the sum of the weights of all its n-grams and contexts, in any order. The weights are
dealt to parts of at most about ``PART`` by their key; a part is broadcast, and documents are scored by it where they are, symbol by symbol
over their whole texts, without a shuffle of texts. Of several parts each has its pass, and its sums meet by the number of the row.

Trusted are labelled documents of quality 1 that are not toxic. Training counts all of them; each task sends one row
per n-gram it saw. A language's threshold is a quantile of the perplexities of
all its trusted documents, each under a model that has not counted it (of the documents of the other fold), as a model is less
perplexed by what it was fitted on than by other good texts; languages with fewer than ``MIN_TRUSTED`` use that of all languages.

Defined cases: null and empty texts have no perplexity and are rejected; a null language counts as a
language of its own; without trusted documents there is no model and every text that is not empty is kept;
repeated rows are judged each; of repeated labels all must be good; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.blocks import text_blocks
from evalspark.llm.filters import bits, marked, numbered, packed, unpacked, without_rows
from evalspark.session import materialize, ship_package

ORDER, SYMBOLS = 4, 256
QUANTILE, MIN_TRUSTED = 0.998, 50
# Perplexities are compared on a grid of this step in their logarithm.
GRID = 0.001
# Weights that are in memory at once; different n-grams that a task counts before it sends them on.
PART = 1 << 22
COUNTED = 1 << 20
# Trusted documents are judged for the thresholds by models of the other folds.
FOLDS = 2

# Every byte is a symbol of its own.
_CLASS = np.arange(256, dtype=np.uint8)
_BREAK = 10


def ngrams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The n-gram that ends at every byte; in front of a text stand line breaks."""
    symbol = _CLASS[data].astype(np.uint32)
    starts = offsets[:-1][offsets[1:] > offsets[:-1]]
    code = symbol.copy()
    for back in range(1, ORDER):
        before = np.full(len(symbol), _BREAK, np.uint32)
        before[back:] = symbol[:-back]
        for k in range(back):
            at = starts + k
            before[at[at < len(symbol)]] = _BREAK
        # A text shorter than the reach marked places of the next one, which is marked itself.
        code += before * np.uint32(SYMBOLS**back)
    return code


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, of = np.unique(np.concatenate([np.empty(0, np.uint32), *[p[0] for p in parts]]), return_inverse=True)
    n = np.zeros(len(codes), np.int64)
    np.add.at(n, of, np.concatenate([np.empty(0, np.int64), *[p[1] for p in parts]]))
    return codes, n


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: list[tuple[np.ndarray, np.ndarray]] = []

    def counted() -> pa.RecordBatch:
        codes, n = _added(parts)
        return pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(n)], ["g", "c"])

    for batch in batches:
        for _, data, offsets in text_blocks(batch.column("text")):
            if len(data):
                parts.append(np.unique(ngrams(data, offsets), return_counts=True))
                if sum(len(p[0]) for p in parts) > COUNTED:
                    parts = [_added(parts)]
                    if len(parts[0][0]) > COUNTED // 2:
                        yield counted()
                        parts = []
    yield counted()


class _Lookup:
    """Values by 32-bit keys, 0 for others: buckets of a hash, about one key for two of them."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint32(31 - len(keys).bit_length())
        bucket = self._bucket(keys)
        order = np.argsort(bucket, kind="stable")
        self.keys, self.values = keys[order], values[order]
        self.start = np.searchsorted(bucket[order], np.arange((1 << 32 - int(self.shift)) + 1)).astype(np.int32)

    def _bucket(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(2654435769)) >> self.shift

    def get(self, keys: np.ndarray) -> np.ndarray:
        found = np.zeros(len(keys))
        bucket = self._bucket(keys)
        at, end = self.start[bucket], self.start[bucket + 1]
        live = np.flatnonzero(at < end)
        while len(live):
            i = at[live]
            hit = self.keys[i] == keys[live]
            found[live[hit]] = self.values[i[hit]]
            live = live[~hit]
            at[live] += 1
            live = live[at[live] < end[live]]
        return found


def _key(kind: int, code: Column) -> Column:
    return (F.lit(kind << 32) + code).alias("key")


class Weights:
    """A part of the weights: of n-grams of order k by the kind 2 k and the n-gram, of their contexts by 2 k + 1 and the context."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order].astype(np.float32)
        kinds = self.keys >> 32

        def of(kind: int) -> tuple[np.ndarray, np.ndarray]:
            return (self.keys[kinds == kind] & 0xFFFFFFFF).astype(np.uint32), self.values[kinds == kind]

        # Those of up to two symbols as one table by the last two.
        self.pairs = np.zeros(SYMBOLS**2)
        for kind, last, back in ((2, 1, 0), (3, 1, 1), (4, 2, 0), (5, 2, 1)):
            codes, own = of(kind)
            table = np.zeros(SYMBOLS ** (last - back))
            table[codes] = own
            self.pairs += table[np.arange(SYMBOLS**2) % SYMBOLS**last // SYMBOLS**back]
        codes, own = of(7)
        self.before = np.zeros(SYMBOLS**2)
        self.before[codes] = own
        self.longer = [(_Lookup(*of(kind)), last, back) for kind, last, back in ((6, 3, 0), (8, 4, 0), (9, 4, 1)) if len(of(kind)[0])]

    def of(self, codes: np.ndarray) -> np.ndarray:
        """The sum of the weights of each n-gram of the highest order and all that it ends with."""
        total = self.pairs[codes & np.uint32(0xFFFF)] + self.before[codes >> np.uint32(8) & np.uint32(0xFFFF)]
        for lookup, last, back in self.longer:
            total += lookup.get((codes & np.uint32(SYMBOLS**last - 1)) >> np.uint32(8 * back))
        return total

    def sums(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Summed weights and number of symbols of every text."""
        total, n = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for at, data, offsets in text_blocks(texts):
            if not len(data):
                continue
            filled = np.flatnonzero(offsets[1:] > offsets[:-1])
            total[at + filled] = np.add.reduceat(self.of(ngrams(data, offsets)), offsets[:-1][filled])
            n[at + filled] = np.diff(offsets)[filled]
        return total, n


class _Logs:
    """Natural logarithms of the probabilities of n-grams of the highest order, by their codes."""

    def __init__(self, parts: list[Weights]):
        self.parts = parts

    def __getitem__(self, codes: int | np.ndarray) -> float | np.ndarray:
        found = sum(p.of(np.atleast_1d(np.asarray(codes, np.uint32))) for p in self.parts)
        return found if np.ndim(codes) else found[0]

    def __eq__(self, other: object) -> np.bool_:
        if not isinstance(other, _Logs) or len(self.parts) != len(other.parts):
            return np.bool_(False)
        pairs = zip(self.parts, other.parts)
        return np.bool_(all(np.array_equal(a.keys, b.keys) and np.array_equal(a.values, b.values) for a, b in pairs))


class Model:
    """The stored weights, ``key`` and ``w``, in ``n_parts`` parts that are read one at a time."""

    def __init__(self, weights: DataFrame):
        self.weights = weights
        self.whole: Broadcast | None = None
        self.n_parts = max(1, -(-weights.count() // PART))

    def part(self, number: int) -> Weights:
        own = self.weights.where(F.pmod(F.xxhash64("key"), F.lit(self.n_parts)) == number).toArrow()
        return Weights(own.column("key").to_numpy(), own.column("w").to_numpy())

    @property
    def log_p(self) -> _Logs:
        """For small models: all parts at once."""
        return _Logs([self.part(i) for i in range(self.n_parts)])

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Summed logarithm and number of symbols of every text."""
        found = [self.part(i).sums(texts) for i in range(self.n_parts)]
        return sum(total for total, _ in found), found[0][1]

    def levels(self, documents: DataFrame) -> DataFrame:
        """``documents`` with ``level``: minus the mean weight of a text's symbols, null for an empty text."""
        context, n = documents.sparkSession.sparkContext, F.octet_length("text")
        if self.n_parts == 1:
            self.whole = self.whole or context.broadcast(self.part(0))
            return documents.withColumn("level", F.when(n > 0, -summed_weights(self.whole, F.col("text")) / n))
        rows = documents if "row" in documents.columns else numbered(documents)
        found: list[DataFrame] = []
        for i in range(self.n_parts):
            part = context.broadcast(self.part(i))
            own = F.struct(F.lit(i).alias("i"), summed_weights(part, F.col("text")).alias("w")).alias("own")
            found.append(materialize(rows.where(n > 0).select("row", n.alias("n"), own), "part-scores"))
            part.destroy()
        # In the order of the parts, so that sums do not depend on the run.
        parts = F.array_sort(F.collect_list("own"))
        total = F.aggregate(parts, F.lit(0.0), lambda x, own: x + own["w"])
        levels = reduce(DataFrame.unionAll, found).groupBy("row").agg((-total / F.first("n")).alias("level"))
        scored = rows.join(levels, "row", "left")
        return scored if "row" in documents.columns else scored.drop("row")


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of an order, from the numbers of n-grams that occur one to four times."""
    n = counts.agg(*[F.coalesce(F.count_if(F.col("c") == i), F.lit(0)).alias(f"n{i}") for i in range(1, 5)]).first()
    n1, n2, n3, n4 = (n[f"n{i}"] for i in range(1, 5))
    if not (n1 and n2 and n3):
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), i - 0.05) for i, d in enumerate(raw, 1))


def train(texts: DataFrame, left_out: DataFrame | None = None) -> Model | None:
    """Fit the model on the column ``text``, but for the rows ``left_out``, which are among them; None if there is no text."""
    counts = texts.select("text").mapInArrow(_count, "g bigint, c bigint")
    if left_out is not None:
        less = left_out.select("text").mapInArrow(_count, "g bigint, c bigint")
        counts = counts.unionByName(less.select("g", (-F.col("c")).alias("c")))
    counts = counts.groupBy("g").agg(F.sum("c").alias("c")).where("c <> 0")
    orders = {ORDER: materialize(counts, "ngrams")}
    if orders[ORDER].isEmpty():
        return None
    for k in range(ORDER - 1, 0, -1):
        # How many symbols an n-gram continues.
        shorter = orders[k + 1].groupBy((F.col("g") % SYMBOLS**k).alias("g")).agg(F.count("*").alias("c"))
        orders[k] = materialize(shorter, "continuations")
    weights: list[DataFrame] = []
    below: DataFrame | None = None
    for k in range(1, ORDER + 1):
        d1, d2, d3 = _discounts(orders[k])
        own = orders[k].withColumn("h", F.expr(f"g div {SYMBOLS}"))
        contexts = own.groupBy("h").agg(
            F.sum("c").alias("total"),
            F.expr(f"{d1!r}D * count_if(c = 1) + {d2!r}D * count_if(c = 2) + {d3!r}D * count_if(c > 2)").alias("mass"),
        )
        contexts = contexts.select("h", "total", (F.col("mass") / F.col("total")).alias("gamma"))
        discount = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        joined = own.join(contexts, "h").withColumn("s", F.col("g") % SYMBOLS ** (k - 1))
        if below is None:
            joined = joined.withColumn("p_below", F.lit(1.0 / SYMBOLS))
        else:
            joined = joined.join(below, "s")
        share = F.col("gamma") * F.col("p_below")
        p = (F.col("c") - discount) / F.col("total") + share
        seen = materialize(joined.select("g", p.alias("p"), F.ln(p / share).alias("w")), "probabilities")
        below = seen.select(F.col("g").alias("s"), F.col("p").alias("p_below"))
        # What was not seen has its context's share of the order below; the lowest order has all symbols alike.
        gamma = F.ln("gamma") + F.lit(math.log(1 / SYMBOLS) if k == 1 else 0.0)
        weights.append(seen.select(_key(2 * k, F.col("g")), "w"))
        weights.append(contexts.select(_key(2 * k + 1, F.col("h")), gamma.alias("w")))
    return Model(materialize(reduce(DataFrame.unionAll, weights), "weights"))


def _summer(part: Broadcast) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(part.value.sums(texts)[0], pa.float64())

    return run


def summed_weights(part: Broadcast, text: Column) -> Column:
    """The sum of the weights of a text's symbols that are in a part of the model."""
    return F.arrow_udf(_summer(part), "double")(text)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """``doc_id`` of documents all of whose labels are good."""
    good = (F.coalesce("quality", F.lit(0)) == 1) & (F.coalesce("toxic", F.lit(1)) == 0)
    named = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.every(good).alias("good"))
    return named.where("good").drop("good")


def maybe_trusted(documents: DataFrame, trusted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows of ``documents`` whose id is trusted, with some whose id shares a bit with one; and these others alone.

    Counts of the ones less counts of the others are exact, and only the others' texts, and those that share a bit with them, are shuffled.
    """
    named, key = documents.where("doc_id IS NOT NULL"), F.xxhash64("doc_id")
    maybe = marked(named, key, bits(trusted, key)).where("maybe").drop("maybe")
    others = materialize(maybe.select("doc_id").join(trusted, "doc_id", "left_anti").distinct(), "not-trusted")
    # Another hash, so that ids which shared a bit do not share one again.
    again = F.xxhash64("doc_id", F.lit(1))
    found = marked(named, again, bits(others, again)).where("maybe").drop("maybe")
    return maybe, found.join(others, "doc_id", "left_semi")


class Judge:
    """The model and the thresholds, fitted on ``documents`` and ``labels``."""

    def __init__(
        self,
        documents: DataFrame,
        labels: DataFrame,
        quantile: float = QUANTILE,
    ):
        spark = documents.sparkSession
        ship_package(spark)
        trusted = materialize(trusted_ids(labels), "trusted")
        texts = documents.select("doc_id", "lang", "text")
        maybe, others = maybe_trusted(texts, trusted)
        self.model = train(maybe, others)
        self.scored = materialize(self.score(texts).drop("text"), "scores")
        bins = materialize(self._held_out(maybe, others), "held-out-scores")
        bins = bins.join(trusted, "doc_id", "left_semi").where("level IS NOT NULL")
        bins = bins.groupBy(F.coalesce("lang", F.lit("")).alias("judge_lang"), F.round(F.col("level") / GRID).alias("bin"))
        bins = materialize(bins.agg(F.count("*").alias("n")), "levels")
        everything = bins.groupBy("bin").agg(F.sum("n").alias("n")).withColumn("judge_lang", F.lit(None).cast("string"))
        # A window holds one row per step of the grid, not per document.
        w = Window.partitionBy("judge_lang")
        cut = (
            bins.unionByName(everything)
            .withColumn("below", F.sum("n").over(w.orderBy("bin")))
            .withColumn("all", F.sum("n").over(w))
            .where(F.col("below") >= quantile * F.col("all"))
            .groupBy("judge_lang")
            .agg((F.min("bin") * GRID).alias("threshold"), F.max("all").alias("n_trusted"))
        )
        self.thresholds = materialize(cut.where(f"judge_lang IS NULL OR n_trusted >= {MIN_TRUSTED}"), "thresholds")

    def _held_out(self, maybe: DataFrame, others: DataFrame) -> DataFrame:
        """Levels of the trusted documents, and some others, by models that have not counted them: those of the other folds."""
        if self.model is None:
            return self.score(maybe).drop("text")
        fold = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(FOLDS))
        found: list[DataFrame] = []
        for i in range(FOLDS):
            # With trusted documents in one fold only there is no other model than the whole one.
            model = train(maybe.where(fold != i), others.where(fold != i)) or self.model
            found.append(model.levels(maybe.where(fold == i)).drop("text"))
        return reduce(DataFrame.unionAll, found)

    def score(self, documents: DataFrame) -> DataFrame:
        """``documents`` with ``level``, the logarithm of the perplexity."""
        if self.model is None:
            return documents.withColumn("level", F.when(F.octet_length("text") > 0, F.lit(0.0)))
        return self.model.levels(documents)

    def judge(self, scored: DataFrame) -> DataFrame:
        """``scored`` with the ``threshold`` of its language and the verdict ``kept``."""
        rest = self.thresholds.where("judge_lang IS NULL").agg(F.max("threshold")).first()[0]
        own = self.thresholds.where("judge_lang IS NOT NULL").select("judge_lang", "threshold")
        joined = scored.join(own, F.coalesce("lang", F.lit("")) == F.col("judge_lang"), "left").drop("judge_lang")
        threshold = F.coalesce("threshold", F.lit(rest).cast("double"), F.lit(float("inf")))
        kept = F.coalesce(F.round(F.col("level") / GRID) * GRID <= threshold, F.lit(False))
        return joined.withColumn("threshold", threshold).withColumn("kept", kept)


def quality_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: id, language, ``perplexity``, ``threshold`` (of the perplexity) and ``kept``."""
    judge = Judge(documents, labels)
    return judge.judge(judge.scored).select(
        "doc_id", "lang", F.exp("level").alias("perplexity"), F.exp("threshold").alias("threshold"), "kept"
    )


def keep_good(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``documents`` that the classifier keeps, with their columns.

    Texts are scored twice, once for the thresholds, which is cheaper than to shuffle them. A model of several parts
    shuffles those texts only that may go.
    """
    names = {c.lower() for c in documents.columns}
    assert "doc_id" in names and "text" in names
    judge = Judge(documents, labels)
    if judge.model is not None and judge.model.n_parts > 1:
        rows = packed(documents)
        scored = judge.score(rows.select("row", F.col("own.lang").alias("lang"), F.col("own.text").alias("text")))
        gone = materialize(judge.judge(scored).where("NOT kept").select("row"), "rejected")
        return without_rows(rows, gone).select(*unpacked(documents.columns))
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("own"), "lang", "text")
    judged = judge.judge(judge.score(rows)).where("kept")
    return judged.select("own.*")
