"""Topics of the false positives."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.functions.text import content_words
from evalspark.operators.transitions import fp_flags
from evalspark.schemas import Variant
from evalspark.session import materialize, ship_package

MIN_TEXTS = 10

# How the English stop list of the published analysis differs from Spark's own.
NOT_STOP_WORDS = """
did didn does doesn doing don having just ll shan shouldn theirs ve wasn weren won wouldn
""".split()
MORE_STOP_WORDS = """
across afterwards almost alone along already also although always among amongst amoungst amount
another anyhow anyone anything anyway anywhere around
back became become becomes becoming beforehand behind beside besides beyond bill bottom
call cannot cant co con couldnt cry de describe detail done due eg eight either eleven else elsewhere
empty enough etc even ever every everyone everything everywhere except fifteen fifty fill find fire
first five former formerly forty found four front full get give go hasnt hence hereafter hereby herein
hereupon however hundred ie inc indeed interest keep last latter latterly least less ltd
made many may meanwhile mill mine moreover mostly move much must
name namely neither never nevertheless next nine nobody none noone nothing nowhere often one onto
others otherwise part per perhaps please put rather seem seemed seeming seems serious several show
side since sincere six sixty somehow someone something sometime sometimes somewhere still system
take ten thence thereafter thereby therefore therein thereupon thick thin third though three
throughout thru thus together top toward towards twelve twenty two un upon us via well whatever
whence whenever whereafter whereas whereby wherein whereupon wherever whether whither whoever whole
whose within without yet
""".split()

TOPICS = (
    "definition string, model string, topic int, label string, words array<string>, "
    "weights array<double>"
)
ASSIGNMENTS = "definition string, model string, item_id bigint, text_no bigint, text_key bigint, topic int"


class TopicTables(NamedTuple):
    """``topics``: one row per variant and topic. ``assignments``: one row per variant and text."""

    topics: DataFrame
    assignments: DataFrame


def english_stop_words() -> list[str]:
    spark_list = StopWordsRemover.loadDefaultStopWords("english")
    return sorted((set(spark_list) - set(NOT_STOP_WORDS)) | set(MORE_STOP_WORDS))


def fp_tokens(
    wide: DataFrame,
    variants: Sequence[Variant],
    stop_words: Sequence[str] | None = None,
    texts: DataFrame | None = None,
) -> DataFrame:
    """Words of every text that some variant flags wrongly, with one 0/1 flag per variant and ``text_key``, its hash.

    A text is split once, however many variants flag it. It is a column of ``wide`` or comes from
    ``texts``, a table with one row per item.
    """
    stops = english_stop_words() if stop_words is None else list(stop_words)
    flags = [f"{v.name}_fp" for v in variants]
    flagged = fp_flags(wide, variants).where(F.greatest(*flags, F.lit(0)) == 1)
    if texts is not None:
        flagged = flagged.select("item_id", *flags).join(texts.select("item_id", "text"), "item_id")
    key = F.xxhash64("text").alias("text_key")
    return flagged.select("item_id", *flags, key, content_words(F.col("text"), stops).alias("words"))


def by_variant(tokens: DataFrame, variants: Sequence[Variant]) -> DataFrame:
    """One row per variant and text that variant flags wrongly."""
    entries = [
        F.struct(
            F.lit(v.definition).alias("definition"),
            F.lit(v.model).alias("model"),
            F.col(f"{v.name}_fp").alias("flag"),
        )
        for v in variants
    ]
    return tokens.select("item_id", "words", F.inline(F.array(*entries))).where("flag = 1").drop("flag")


def vocabulary(
    texts: DataFrame,
    by: Sequence[str] = (),
    min_df: int | float = 2,
    max_df: int | float = 0.95,
) -> DataFrame:
    """Words and the number of texts that hold them, within bounds on that number.

    A bound is a number of texts if an int, and a share of the texts if a float.
    """
    sizes = texts.groupBy(*by).agg(F.count("*").alias("n_all"))
    counted = (
        texts.select(*by, F.explode(F.array_distinct("words")).alias("word"))
        .groupBy(*by, "word")
        .agg(F.count("*").alias("n_texts"))
    )
    if by:
        counted = counted.join(sizes, list(by))
    else:
        counted = counted.withColumn("n_all", sizes.scalar())

    def bound(limit: int | float):
        return F.lit(limit) if isinstance(limit, int) else F.lit(limit) * F.col("n_all")

    return counted.where(
        (F.col("n_texts") >= bound(min_df)) & (F.col("n_texts") <= bound(max_df))
    ).drop("n_all")


def _digamma(x: np.ndarray) -> np.ndarray:
    """Eight steps of the recurrence, then the asymptotic series."""
    shift = sum(1 / (x + j) for j in range(8))
    x = x + 8
    y = 1 / (x * x)
    return np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132)))) - shift


# Counts of words in texts that are inferred together, about: their arrays stay in a processor's cache. After so many
# rounds the texts that have not settled are brought together anew.
TOGETHER, ROUNDS = 1 << 15, (8, 12, 20, 60)


def _infer(n: np.ndarray, beta: np.ndarray, starts: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """A row of topic weights per text, and a row per topic of the shares of each word, for texts whose words begin at ``starts``.

    Each text goes on until its own weights settle, so the texts beside it do not matter; settled ones are left out.
    Texts of similar size are taken together, filled up with words of weight 0.
    """
    sizes = np.diff(np.append(starts, len(n)))
    gamma = np.ones((len(starts), len(beta)))
    filled_n, filled_beta = np.append(n, 0.0), np.hstack([beta, np.zeros((len(beta), 1))])
    left = np.argsort(sizes, kind="stable")
    for rounds in ROUNDS:
        going = [left[:0]]
        for own in _together(left, sizes):
            place = np.arange(sizes[own[-1]])
            at = np.where(place < sizes[own, None], starts[own, None] + place, len(n))
            own_beta = np.ascontiguousarray(filled_beta[:, at].transpose(1, 0, 2))
            gamma[own], on = _settle(filled_n[at], own_beta, gamma[own], alpha, rounds)
            going.append(own[on])
        left = np.concatenate(going)
        if not len(left):
            break
    shares = np.repeat(_theta(gamma).T, sizes, axis=1)
    shares *= beta
    shares *= n / (shares.sum(axis=0) + 1e-100)
    return gamma, shares


def _together(texts: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Groups of ``texts``, which come by size, of about ``TOGETHER`` words each."""
    first = 0
    while first < len(texts):
        last = first + 1
        while last < len(texts) and (last + 1 - first) * sizes[texts[last]] <= TOGETHER:
            last += 1
        yield texts[first:last]
        first = last


def _theta(gamma: np.ndarray) -> np.ndarray:
    logs = _digamma(np.hstack([gamma, gamma.sum(axis=1)[:, None]]))
    return np.exp(logs[:, :-1] - logs[:, -1:])


def _settle(n: np.ndarray, beta: np.ndarray, gamma: np.ndarray, alpha: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Topic weights of texts after so many rounds more, and which have not settled. ``beta``: by text, topic and word."""
    found, on = gamma.copy(), np.ones(len(n), bool)
    text = np.arange(len(n))
    for _ in range(rounds):
        theta = _theta(gamma)
        norm = np.einsum("tkl,tk->tl", beta, theta)
        norm += 1e-100
        np.divide(n, norm, out=norm)
        new = alpha + theta * np.einsum("tkl,tl->tk", beta, norm)
        going = on[text]
        settled = np.abs(new - gamma).mean(axis=1) < 1e-3
        gamma = new
        found[text[going]] = gamma[going]
        on[text[going & settled]] = False
        going &= ~settled
        if not going.any():
            break
        if 4 * going.sum() < 3 * len(n):
            text, n, beta, gamma = text[going], n[going], beta[going], gamma[going]
    return found, on


# Counts of words in texts that a block holds, about; words of blocks that a shard of the vocabulary answers, about.
BLOCK_COUNTS, SHARD_WORDS = 1 << 18, 1 << 15
# Arrays of numbers travel as their bytes.
COUNTED = "variant int, codes binary, n binary, text_nos binary, starts binary, words array<string>, df binary"
ASKED = "variant int, shard bigint, block bigint, words array<string>, codes binary, df binary"
SHARDS = "variant int, shard bigint, words array<string>, blocks binary, lens binary, idx binary, codes binary"
BLOCKS = "variant int, block bigint, codes binary, n binary, text_nos binary, starts binary"


def _numbers(column: pa.ChunkedArray | pa.Array, row: int, kind: type) -> np.ndarray:
    return np.frombuffer(column[row].as_buffer(), kind)


def _pieces(values: np.ndarray, lens: np.ndarray) -> pa.Array:
    """``values`` cut into one binary value for each of ``lens`` rows of it."""
    values = np.ascontiguousarray(values)
    width = values.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    offsets = np.concatenate([[0], np.cumsum(lens) * width]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lens), [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def _joined(column: pa.ChunkedArray, order: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows in that order, and how many each row has."""
    parts = [_numbers(column, int(i), kind) for i in order]
    return np.concatenate([np.empty(0, kind), *parts]), np.array([len(x) for x in parts], np.int64)


def _one(schema: str, *values: object) -> pa.Table:
    """A table of one row."""
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "array<string>": pa.list_(pa.string())}
    names, types = zip(*(x.split(" ") for x in schema.split(", ")))
    packed = [x.tobytes() if isinstance(x, np.ndarray) and t == "binary" else x for x, t in zip(values, types)]
    return pa.table([pa.array([x], kinds[t]) for x, t in zip(packed, types)], list(names))


def _none(schema: str) -> pa.Table:
    return _one(schema, *[None] * len(schema.split(", "))).slice(0, 0)


def _block(variant: int, parts: list[tuple]) -> pa.RecordBatch:
    """The counts of some texts in one row: the texts in a row, their different words by number."""
    words = pa.concat_arrays([p[3] for p in parts]).dictionary_encode()
    before = np.cumsum([0, *[len(p[3]) for p in parts[:-1]]])
    codes = words.indices.to_numpy()[np.concatenate([p[1] + at for p, at in zip(parts, before)])]
    text = np.concatenate([p[0] for p in parts])
    n = np.concatenate([p[2] for p in parts])
    starts = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
    df = np.bincount(codes, minlength=len(words.dictionary)).astype(np.int32)
    row = [variant, codes.astype(np.int32), n.astype(np.int32), text[starts], starts.astype(np.int32), words.dictionary, df]
    return _one(COUNTED, *row).combine_chunks().to_batches()[0]


def _counter(flags: dict[int, str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of counts for each variant, of the texts of a partition as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {v: [] for v in flags}
        for batch in batches:
            ends = np.cumsum(batch.column("words").value_lengths().fill_null(0).to_numpy())
            at = 0
            while at < batch.num_rows:
                gone = ends[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(ends, gone + BLOCK_COUNTS // 4, "right")))
                part = batch.slice(at, end - at)
                at = end
                lists = part.column("words")
                words = lists.flatten().dictionary_encode()
                text = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())
                # A text and a word in one number; each pair is counted once, for all variants.
                width = max(1, len(words.dictionary))
                pairs, n = np.unique(text * width + words.indices.to_numpy(), return_counts=True)
                text, code = np.divmod(pairs, width)
                numbers = part.column("text_no").to_numpy()
                for v, flag in flags.items():
                    mine = (part.column(flag).to_numpy(zero_copy_only=False) == 1)[text]
                    if not mine.any():
                        continue
                    used, codes = np.unique(code[mine], return_inverse=True)
                    held[v].append((numbers[text[mine]], codes, n[mine], words.dictionary.take(pa.array(used))))
                    if sum(len(p[0]) for p in held[v]) >= BLOCK_COUNTS:
                        yield _block(v, held[v])
                        held[v] = []
        for v, parts in held.items():
            if parts:
                yield _block(v, parts)

    return run


def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for every shard that has words of a block; ``shards`` names each word's."""
    for batch in batches:
        for i in range(batch.num_rows):
            of = batch.column("shards")[i].values.to_numpy()
            order = np.argsort(of, kind="stable")
            shard, lens = np.unique(of, return_counts=True)
            ends = np.cumsum([0, *lens]).astype(np.int32)
            words = pa.ListArray.from_arrays(pa.array(ends), batch.column("words")[i].values.take(pa.array(order)))
            df = _numbers(batch.column("df"), i, np.int32)[order]
            ids = [np.full(len(lens), batch.column(c)[i].as_py(), t) for c, t in (("variant", np.int32), ("block", np.int64))]
            columns = [pa.array(ids[0]), pa.array(shard), pa.array(ids[1]), words]
            columns += [_pieces(x, lens) for x in (order.astype(np.int32), df)]
            yield pa.RecordBatch.from_arrays(columns, ["variant", "shard", "block", "words", "codes", "df"])


def _shard(sizes: dict[int, int], min_df: int | float, max_df: int | float) -> Callable[[tuple, pa.Table], pa.Table]:
    """The words of a shard that are in bounds, and which of them each block asks for."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        variant = key[0].as_py()
        order = np.argsort(rows.column("block").to_numpy())
        words = pa.concat_arrays([rows.column("words")[int(i)].values for i in order]).dictionary_encode()
        codes = words.indices.to_numpy()
        own, lens = _joined(rows.column("codes"), order, np.int32)
        total = np.bincount(codes, _joined(rows.column("df"), order, np.int32)[0])
        low, high = (x if isinstance(x, int) else x * sizes[variant] for x in (min_df, max_df))
        chosen = np.flatnonzero((total >= low) & (total <= high))
        if not len(chosen):
            return _none(SHARDS)
        place = np.full(len(total), -1, np.int32)
        place[chosen] = np.arange(len(chosen))
        keep = place[codes] >= 0
        blocks, lens = np.unique(np.repeat(rows.column("block").to_numpy()[order], lens)[keep], return_counts=True)
        asked = [place[codes[keep]], own[keep]]
        return _one(SHARDS, variant, key[1].as_py(), words.dictionary.take(pa.array(chosen)), blocks, lens, *asked)

    return run


def _spread(batch: pa.RecordBatch, i: int, values: dict[str, np.ndarray]) -> pa.RecordBatch:
    """A row for every block that asks shard ``i`` of the batch, with the block's part of each of the ``values``."""
    blocks, lens = (_numbers(batch.column(c), i, np.int64) for c in ("blocks", "lens"))
    shard = pa.array(np.full(len(blocks), batch.column("shard")[i].as_py(), np.int64))
    return pa.RecordBatch.from_arrays(
        [pa.array(blocks), shard, *[_pieces(x, lens) for x in values.values()]], ["block", "shard", *values]
    )


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield _spread(batch, i, {"codes": _numbers(batch.column("codes"), i, np.int32)})


def _narrow(block: pa.Table, known: pa.Table) -> pa.Table:
    """A block without the words that no shard knows; the others numbered in the order in which shards answer."""
    if not block.num_rows or not known.num_rows:
        return _none(BLOCKS)
    at, _ = _joined(known.column("codes"), np.argsort(known.column("shard").to_numpy()), np.int32)
    codes, n, starts = (_numbers(block.column(c), 0, np.int32) for c in ("codes", "n", "starts"))
    place = np.full(codes.max() + 1, -1, np.int32)
    place[at] = np.arange(len(at))
    codes = place[codes]
    text = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(n))))[codes >= 0]
    first = np.flatnonzero(np.append(True, text[1:] != text[:-1])).astype(np.int32)
    numbers = _numbers(block.column("text_nos"), 0, np.int64)[text[first]]
    ids = [block.column(c)[0].as_py() for c in ("variant", "block")]
    return _one(BLOCKS, *ids, codes[codes >= 0], n[codes >= 0], numbers, first)


def _weights_schema(k: int) -> str:
    sums = "".join(f", t{i} double" for i in range(k))
    return f"variant int, shard bigint, blocks binary, lens binary, idx binary, w binary{sums}"


def _starter(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Shards with their first weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                w = np.stack([batch.column(f"w{j}")[i].values.to_numpy() for j in range(k)], axis=1)
                kept = [batch.column(c)[i].as_py() for c in ("variant", "shard", "blocks", "lens", "idx")]
                yield from _one(_weights_schema(k), *kept, w, *w.sum(axis=0)).to_batches()

    return run


def _giver(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What every block asks of a shard: its words' weights, but for the topics' totals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                idx = _numbers(batch.column("idx"), i, np.int32)
                beta = np.exp(_digamma(_numbers(batch.column("w"), i, np.float64).reshape(-1, k)))
                yield _spread(batch, i, {"idx": idx, "beta": beta[idx]})

    return run


def _by_block(k: int, alpha: float, totals: dict[int, list[float]], assign: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For a block and the weights of its words: the words' shares of the topics, or each text's topic."""

    def run(block: pa.Table, given: pa.Table) -> pa.Table:
        variant = block.column("variant")[0].as_py()
        order = np.argsort(given.column("shard").to_numpy())
        beta, sizes = _joined(given.column("beta"), order, np.float64)
        beta, lens = beta.reshape(-1, k), sizes // k
        codes, n, starts = (_numbers(block.column(c), 0, np.int32) for c in ("codes", "n", "starts"))
        weight = beta.T * np.exp(-_digamma(np.array(totals[variant])))[:, None]
        gamma, shares = _infer(n.astype(float), weight[:, codes], starts, alpha)
        if assign:
            numbers = _numbers(block.column("text_nos"), 0, np.int64)
            values = [np.full(len(numbers), variant, np.int32), numbers, gamma.argmax(axis=1).astype(np.int32)]
            return pa.table([pa.array(x) for x in values], ["variant", "text_no", "topic"])
        sums = np.stack([np.bincount(codes, x, len(beta)) for x in shares], axis=1)
        ids = [pa.array(np.full(len(lens), variant, np.int32)), given.column("shard").take(pa.array(order))]
        ids.append(pa.array(np.full(len(lens), block.column("block")[0].as_py(), np.int64)))
        idx = given.column("idx").take(pa.array(order))
        return pa.table([*ids, idx, _pieces(sums, lens)], ["variant", "shard", "block", "idx", "sums"])

    return run


def _gatherer(k: int, eta: float) -> Callable[[tuple, pa.Table], pa.Table]:
    """The next weights of a shard: its blocks' sums, added in the order of the blocks, and the prior."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        blocks = rows.column("block").to_numpy()
        order = np.argsort(blocks)
        idx, lens = _joined(rows.column("idx"), order, np.int32)
        sums = _joined(rows.column("sums"), order, np.float64)[0].reshape(-1, k)
        w = eta + np.stack([np.bincount(idx, sums[:, i]) for i in range(k)], axis=1)
        kept = [blocks[order], lens, idx, w]
        return _one(_weights_schema(k), key[0].as_py(), key[1].as_py(), *kept, *w.sum(axis=0))

    return run


def _lister(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for every word of a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words = batch.column("words")[i].values
                w = _numbers(batch.column("w"), i, np.float64).reshape(-1, k)
                variant = pa.array(np.full(len(words), batch.column("variant")[i].as_py(), np.int32))
                columns = [variant, words, *[pa.array(np.ascontiguousarray(w[:, j])) for j in range(k)]]
                yield pa.RecordBatch.from_arrays(columns, ["variant", "word", *[f"w{j}" for j in range(k)]])

    return run


def term_counts(
    tokens: DataFrame, variants: Sequence[Variant], min_df: int | float = 2, max_df: int | float = 0.95
) -> DataFrame:
    """How often each word of a variant's vocabulary occurs in each of its texts (``text_no``)."""
    entries = [
        F.struct(F.lit(i).alias("variant"), F.col(f"{v.name}_fp").alias("flag")) for i, v in enumerate(variants)
    ]
    texts = tokens.select("text_no", "words", F.inline(F.array(*entries))).where("flag = 1").drop("flag")
    chosen = vocabulary(texts, ["variant"], min_df, max_df).select("variant", "word")
    counted = texts.select("variant", "text_no", F.explode("words").alias("word"))
    counted = counted.groupBy("variant", "text_no", "word").agg(F.count("*").alias("n"))
    return counted.join(chosen, ["variant", "word"])


def fit_topics(
    tokens: DataFrame,
    variants: Sequence[Variant],
    k: int = 5,
    *,
    top_words: int = 10,
    min_texts: int = MIN_TEXTS,
    min_df: int | float = 2,
    max_df: int | float = 0.95,
    max_iter: int = 10,
) -> TopicTables:
    """Fit one topic model per variant on all the texts it flags wrongly, by full-batch variational Bayes.

    All variants are fitted in the same jobs. Words are counted once, where their texts are, in blocks of whole texts; the
    vocabulary is dealt to shards by a hash of the word. In a pass each shard sends every block the weights of the words that
    the block holds, the block infers its texts' topics from them, adds up the words' shares and sends the sums back, which make the
    next weights: a row per block and shard, no row per word. The start is a hash of word and topic. Nothing of the
    vocabulary comes to the driver. Variants with fewer than ``min_texts`` texts, or without a vocabulary,
    have no topics; a text without a word of the vocabulary goes to topic 0.
    """
    spark = tokens.sparkSession
    ship_package(spark)
    alpha = eta = 1.0 / k
    tokens = materialize(tokens.withColumn("text_no", F.monotonically_increasing_id()), "fp-tokens")
    # One row of numbers; variants are configuration.
    sizes = tokens.agg(*[F.count_if(F.col(f"{v.name}_fp") == 1).alias(v.name) for v in variants]).first()
    flags = {i: f"{v.name}_fp" for i, v in enumerate(variants) if sizes[v.name] >= min_texts}
    counted = tokens.select("text_no", "words", *flags.values()).mapInArrow(_counter(flags), COUNTED)
    counted = materialize(counted.withColumn("block", F.monotonically_increasing_id()), "text-counts")

    n_asked = counted.agg(F.sum(F.size("words"))).first()[0] or 0
    n_shards = max(1, -(-n_asked // SHARD_WORDS))
    shard_of = F.transform("words", lambda word: F.pmod(F.xxhash64(word), F.lit(n_shards)))
    asked = counted.select("variant", "block", "words", "df", shard_of.alias("shards")).mapInArrow(_ask, ASKED)
    texts_of = {i: sizes[v.name] for i, v in enumerate(variants)}
    shards = materialize(asked.groupBy("variant", "shard").applyInArrow(_shard(texts_of, min_df, max_df), SHARDS), "topic-words")
    known = shards.select("shard", "blocks", "lens", "codes").mapInArrow(_codes, "block bigint, shard bigint, codes binary")
    blocks = counted.drop("words", "df").groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_narrow, BLOCKS)
    blocks = materialize(blocks, "text-blocks")

    def start(i: int) -> Column:
        def of(word: Column) -> Column:
            return 1 + 0.35 * (F.pmod(F.xxhash64(word, F.lit(i)), F.lit(1000003)) / 1000003.0 - 0.5)

        return F.transform("words", of).alias(f"w{i}")

    begun = shards.select("variant", "shard", "blocks", "lens", "idx", *[start(i) for i in range(k)])
    weights = materialize(begun.mapInArrow(_starter(k), _weights_schema(k)), "topic-weights")

    def totals() -> dict[int, list[float]]:
        """A row of numbers per variant."""
        summed = weights.groupBy("variant").agg(*[F.sum(f"t{i}") for i in range(k)])
        return {r[0]: list(r[1:]) for r in summed.collect()}

    def passed(assign: bool, schema: str) -> DataFrame:
        given = weights.select("shard", "blocks", "lens", "idx", "w")
        given = given.mapInArrow(_giver(k), "block bigint, shard bigint, idx binary, beta binary")
        return blocks.groupBy("block").cogroup(given.groupBy("block")).applyInArrow(_by_block(k, alpha, totals(), assign), schema)

    for _ in range(max_iter):
        sums = passed(False, "variant int, shard bigint, block bigint, idx binary, sums binary")
        summed = sums.groupBy("variant", "shard").applyInArrow(_gatherer(k, eta), _weights_schema(k))
        weights = materialize(summed, "topic-weights")
    topic_of = passed(True, "variant int, text_no bigint, topic int")
    fitted = totals()
    entries = [
        F.struct(
            F.lit(i).alias("variant"),
            F.lit(v.definition).alias("definition"),
            F.lit(v.model).alias("model"),
            F.col(f"{v.name}_fp").alias("flag"),
        )
        for i, v in enumerate(variants)
        if i in fitted
    ]
    if not entries:
        return TopicTables(spark.createDataFrame([], TOPICS), spark.createDataFrame([], ASSIGNMENTS))
    texts = tokens.select("text_no", "item_id", "text_key", F.inline(F.array(*entries))).where("flag = 1")
    assigned = texts.join(topic_of, ["variant", "text_no"], "left").select(
        "definition", "model", "item_id", "text_no", "text_key", F.coalesce("topic", F.lit(0)).alias("topic")
    )
    listed = weights.select("variant", "shard", "w").join(shards.select("variant", "shard", "words"), ["variant", "shard"])
    listed = listed.mapInArrow(_lister(k), ", ".join(["variant int, word string", *[f"w{i} double" for i in range(k)]]))
    return TopicTables(
        materialize(topic_rows(listed, variants, k, top_words), "topics"), materialize(assigned, "fp-topic-assignments")
    )


def topic_rows(weights: DataFrame, variants: Sequence[Variant], k: int, top_words: int) -> DataFrame:
    """The heaviest words of each topic, with their weights as pseudo-counts; the first of equals by word."""
    entries = [F.struct(F.lit(i).alias("topic"), F.col(f"w{i}").alias("weight")) for i in range(k)]
    ranked = weights.select("variant", "word", F.inline(F.array(*entries))).withColumn(
        "rank", F.row_number().over(Window.partitionBy("variant", "topic").orderBy(F.desc("weight"), "word"))
    )
    best = (
        ranked.where(F.col("rank") <= top_words)
        .groupBy("variant", "topic")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "word", "weight"))).alias("best"))
    )
    of = F.array(*[F.struct(F.lit(v.definition).alias("definition"), F.lit(v.model).alias("model")) for v in variants])
    words = F.col("best")["word"]
    label = F.concat(F.lit("Topic "), F.col("topic") + 1, F.lit(": "), F.array_join(F.slice(words, 1, 3), " "))
    named = best.withColumn("of", F.get(of, "variant"))
    return named.select(
        "of.definition", "of.model", "topic", label.alias("label"), words.alias("words"), F.col("best")["weight"].alias("weights")
    )


def topic_counts(tables: TopicTables) -> DataFrame:
    """Texts per topic and their share of the variant's texts; topics without texts have 0."""
    counted = tables.assignments.groupBy("definition", "model", "topic").agg(
        F.count("*").alias("n_texts")
    )
    whole = Window.partitionBy("definition", "model")
    return (
        tables.topics.join(counted, ["definition", "model", "topic"], "left")
        .withColumn("n_texts", F.coalesce("n_texts", F.lit(0)))
        .withColumn("share", F.try_divide("n_texts", F.sum("n_texts").over(whole)))
        .orderBy("definition", "model", F.desc("n_texts"), "topic")
    )


def topic_examples(tables: TopicTables, items: DataFrame, n: int = 5) -> DataFrame:
    """The texts of the first ``n`` rows, by id, of every topic; rows that share an id or a text count each.

    The rows are chosen first; their ids and texts' hashes, at most ``n`` per topic and variant, are broadcast to fetch the
    texts, so the texts are not shuffled.
    """
    topic = ["definition", "model", "topic"]
    first = Window.partitionBy(*topic).orderBy("item_id", "text_no")
    chosen = (
        tables.assignments.select(*topic, "item_id", "text_no", "text_key")
        .withColumn("example", F.row_number().over(first))
        .where(F.col("example") <= n)
    )
    chosen = chosen.drop("text_no")
    keys = chosen.select("item_id", "text_key").distinct()
    hashed = items.select("item_id", "text", F.xxhash64("text").alias("text_key"))
    found = hashed.join(F.broadcast(keys), ["item_id", "text_key"]).dropDuplicates(["item_id", "text_key"])
    return chosen.join(F.broadcast(found), ["item_id", "text_key"]).select(*topic, "example", "item_id", "text")
