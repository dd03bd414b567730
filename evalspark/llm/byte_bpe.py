"""Encoding and decoding with a byte-level BPE rank table, by Spark's higher-order functions.

Texts are cut into words by the vocabulary's pattern, and the different words of all texts are encoded once, whichever documents
hold them: each block of about ``BLOCK_BYTES`` asks for its words and gets their ids back (``unit_blocks``). Words that are frequent in
a sample can be encoded ahead and broadcast (``known``); which words these are changes no result. A word is an array of single bytes, and ``aggregate`` folds the merges
over it: the pair of lowest rank in the table becomes one piece, until no pair is in the table. The rank map is a
literal: a lookup in a Spark map reads the map from its start, so the pairs lie in arrays, as rows of a sparse table pushed
into each other, and a lookup is three reads by position.

A round of the fold merges one pair wherever it stands, from left to right. One by one gives the same unless a merge
makes a pair of lower rank than its own, or two pairs of one rank share a piece. ``pair_literals`` has patterns of the
neighbours of which that is possible; where such stand together, the round merges its first pair only. So that a round is one pass, pieces
are written as one character each (rank + ``FIRST``), and a merge is a replacement in a string.

Words are shuffled once per block that has them, texts as one compressed frame per block; a task holds one block's texts and
words. Work grows with the text; for one word, with its length times its rounds, which are few for repeated characters and at most
its length.

``decode`` looks each id up in a literal array of pieces and concatenates these.

Defined cases: null and empty texts have no ids; repeated rows give one row each; an empty table gives an empty result;
an id that the table does not have stops ``decode``. Other columns are kept only if ``keep`` names them; ``ids`` is not
a name to keep.
"""

from __future__ import annotations

import base64
import json
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.unit_blocks import MakeCut, encode_blocks
from evalspark.session import ship_package

BLOCK_BYTES = 32 << 20
# The character of rank 0: no character from here on means anything in a pattern.
FIRST = 0x10000


def default_vocabulary() -> tuple[str, str]:
    """Path of the rank file, and the pattern that cuts words."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


class Table(NamedTuple):
    """``ranks`` by piece, ``forms`` (the pairs that make a piece) and ``late`` by rank.

    ``late`` has the neighbours before and behind a piece with which it makes a pair of lower rank than its own.
    """

    ranks: dict[bytes, int]
    forms: dict[int, list[tuple[int, int]]]
    late: dict[int, tuple[set[int], set[int]]]


def merge(ranks: dict[bytes, int], word: bytes) -> list[int]:
    """Plain merging, one pair at a time."""
    pieces = [word[i : i + 1] for i in range(len(word))]
    while len(pieces) > 1:
        found = [ranks.get(a + b, 1 << 60) for a, b in zip(pieces, pieces[1:])]
        lowest = min(found)
        if lowest == 1 << 60:
            break
        i = found.index(lowest)
        pieces[i : i + 2] = [pieces[i] + pieces[i + 1]]
    return [ranks[x] for x in pieces]


@lru_cache(4)
def read_table(path: str) -> Table:
    """The ranks of a file; every piece has to come out of its own merges, and every byte has to have a rank."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing or max(ranks.values()) + FIRST > 0x10FFFF:
        raise ValueError(f"bytes without a rank, or ranks too high: {missing[:5]}")
    apart = [p for p, r in ranks.items() if merge(ranks, p) != [r]]
    if apart:
        raise ValueError(f"pieces that merges do not make: {apart[:5]}")
    forms: dict[int, list[tuple[int, int]]] = {}
    late: dict[int, tuple[set[int], set[int]]] = {}
    for piece, rank in ranks.items():
        for i in range(1, len(piece)):
            a, b = ranks.get(piece[:i]), ranks.get(piece[i:])
            if a is None or b is None:
                continue
            forms.setdefault(rank, []).append((a, b))
            if a > rank:
                late.setdefault(a, (set(), set()))[1].add(b)
            if b > rank:
                late.setdefault(b, (set(), set()))[0].add(a)
    return Table(ranks, forms, late)


def _char(rank: int) -> str:
    return chr(FIRST + rank)


def _json(value: object) -> str:
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def _literal(text: str, kind: str) -> Column:
    """A large constant, which the optimizer evaluates once."""
    return F.from_json(F.lit(text), kind)


def _placed(rows: dict[int, list[int]]) -> tuple[dict[int, int], np.ndarray]:
    """A start for each row of a sparse table so that no two entries, at start + column, share a place; and the owners."""
    taken, starts = 0, {}
    for row, columns in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
        # A bit for each start that would put some column on a taken place; the lowest start without it.
        barred, own = 0, 0
        for c in columns:
            barred |= taken >> c
            own |= 1 << c
        starts[row] = (~barred & (barred + 1)).bit_length() - 1
        taken |= own << starts[row]
    owners = np.full(taken.bit_length(), -1, np.int64)
    for row, columns in rows.items():
        owners[starts[row] + np.array(columns)] = row
    return starts, owners


LITERALS = {
    "starts": "array<int>",
    "owners": "array<int>",
    "numbers": "array<int>",
    "rules": "array<struct<pair:string,to:string,watch:string,any:string>>",
}


@lru_cache(4)
def pair_literals(path: str) -> dict[str, str]:
    """All pairs by rank, numbered, as the JSON of literals of the types in ``LITERALS``.

    They are a map from pair to number, and by number the rule of the pair.

    The map is a sparse table with a row per second piece: ``starts`` by that piece, ``owners`` and ``numbers`` by place.
    A rule has ``pair`` and ``to``, its piece, as characters. Some have ``watch``, a pattern of places where the order of the
    merges of that rank matters: ``late`` neighbours, and pieces that two pairs of one rank could claim. There
    ``any`` is the pattern of all pairs of the rank.
    """
    table = read_table(path)
    rows: dict[int, list[int]] = {}
    rules: list[dict[str, str]] = []
    entries: list[tuple[int, int]] = []
    for rank in sorted(table.forms):
        forms = [(_char(a), _char(b)) for a, b in table.forms[rank]]
        pairs = "|".join(a + b for a, b in forms)
        watch = [a + b + d for a, b in forms for c, d in forms if b == c and (a, b) != (c, d)]
        if rank in table.late:
            before, behind = map(sorted, table.late[rank])
            # A piece that makes such a pair with its like may stand beside another of its pairs, about to be merged.
            like = f"|{pairs}" if rank in (*before, *behind) else ""
            watch += [f"(?:{'|'.join(map(_char, before))}{like})(?:{pairs})"] if before else []
            watch += [f"(?:{pairs})(?:{'|'.join(map(_char, behind))}{like})"] if behind else []
        for (a, b), (first, second) in zip(forms, table.forms[rank]):
            rows.setdefault(second, []).append(first)
            entries.append((first, second))
            rules.append({"pair": a + b, "to": _char(rank), **({"watch": "|".join(watch), "any": pairs} if watch else {})})
    starts, owners = _placed(rows)
    numbers = [-1] * len(owners)
    for number, (first, second) in enumerate(entries):
        numbers[starts[second] + first] = number
    by_piece = [starts.get(r) for r in range(max(table.ranks.values()) + 1)]
    values = {"starts": by_piece, "owners": owners.tolist(), "numbers": numbers, "rules": rules}
    return {name: _json(value) for name, value in values.items()}


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _codes(text: Column) -> Column:
    return F.transform(F.split(text, ""), lambda x: F.ascii(x) - FIRST)


def _lowest(known: Column, text: Column) -> Column:
    """The number of the pair of lowest rank among neighbours, null if no pair is in the table."""

    def number(first: Column, second: Column) -> Column:
        # The last piece has no neighbour: null.
        place = F.get(known["starts"], second) + first
        return F.when(F.get(known["owners"], place) == second, F.get(known["numbers"], place))

    def of(codes: Column) -> Column:
        return F.array_min(F.zip_with(codes, F.slice(codes, F.lit(2), F.size(codes)), number))

    return _let(_codes(text), of)


def _merged(text: Column, rule: Column) -> Column:
    """All merges of the pair, from the left, or the first one of its rank where their order matters."""
    first = F.regexp_replace(
        text, F.concat(F.lit(r"\A(.*?)(?:"), rule["any"], F.lit(")")), F.concat(F.lit("$1"), rule["to"])
    )
    watched = rule["watch"].isNotNull() & F.rlike(text, rule["watch"])
    return F.when(watched, first).otherwise(F.replace(text, rule["pair"], rule["to"]))


def encode_word(known: Column, word: Column, of_bytes: tuple[str, str]) -> Column:
    """The ids of one word, given as bytes, by the literals of ``pair_literals`` in one struct."""

    def state(text: Column) -> Column:
        return F.struct(text.alias("text"), _lowest(known, text).alias("next"))

    def step(s: Column, _: Column) -> Column:
        merged = _merged(s["text"], F.get(known["rules"], s["next"]))
        return F.when(s["next"].isNull(), s).otherwise(_let(merged, state))

    spelled = F.translate(F.decode(word, "ISO-8859-1"), *of_bytes)
    rounds = F.sequence(F.lit(1), F.greatest(F.octet_length(word) - 1, F.lit(1)))
    return F.aggregate(rounds, _let(spelled, state), step, lambda s: _codes(s["text"]))


def encode_words(words: Column, path: str) -> Column:
    """``words`` (array<binary>, none of them empty) as an array of arrays of ids, by the rank file ``path``."""
    ranks = read_table(path).ranks
    of_bytes = ("".join(map(chr, range(256))), "".join(_char(ranks[bytes([b])]) for b in range(256)))
    literals = F.struct(*[_literal(pair_literals(path)[name], kind).alias(name) for name, kind in LITERALS.items()])
    return _let(literals, lambda known: F.transform(words, lambda w: encode_word(known, w, of_bytes)))


def _counted(pattern: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        cut = regex.compile(pattern).findall
        for batch in batches:
            counts: Counter[str] = Counter()
            for text in batch.column("text"):
                counts.update(cut(text.as_py() or ""))
            words = [w.encode() for w in counts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"]
            )

    return run


def known_words(documents: DataFrame, path: str, pattern: str, rows: int, words: int) -> list[tuple[str, bytes]]:
    """Up to ``words`` words that are frequent in about ``rows`` texts, with their ids as little-endian 32-bit bytes."""
    n = documents.count() if rows and words else 0
    if not n:
        return []
    sample = documents.select("text").sample(min(1.0, rows / n), seed=1)
    counted = sample.mapInArrow(_counted(pattern), "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    top = counted.where("n > 1").orderBy(F.desc("n"), "word").limit(words)
    # A number of rows that is bounded, dealt to tasks again.
    spread = top.select(F.array("word").alias("words")).repartition(32, "words")
    coded = spread.select(F.get("words", F.lit(0)).alias("word"), F.get(encode_words(F.col("words"), path), F.lit(0)).alias("ids"))
    return [(bytes(w).decode(), np.array(ids, "<i4").tobytes()) for w, ids in coded.collect()]


def _cutter(pattern: str) -> MakeCut:
    def make() -> Callable[[str], list[str]]:
        import regex

        return regex.compile(pattern).findall

    return make


def encode(
    documents: DataFrame,
    keep: tuple[str, ...] = ("doc_id",),
    vocabulary: tuple[str, str] | None = None,
    block_bytes: int = BLOCK_BYTES,
    known: tuple[int, int] = (0, 0),
) -> DataFrame:
    """The columns ``keep`` and ``ids`` (array<int>), the encoding of ``text``, one row per document.

    ``known`` is the number of texts that are sampled for frequent words and the most words encoded ahead, as (20_000, 1 << 17); it
    bounds what is broadcast and changes no result. It saves work on the executors and costs the driver a second plan with
    the literals, some 100 MB, so by default none are.
    """
    if "ids" in keep:
        raise ValueError("ids is the name of the result")
    ship_package(documents.sparkSession)
    path, pattern = vocabulary or default_vocabulary()

    def encoded(units: DataFrame) -> DataFrame:
        ids = F.get(encode_words(F.array(F.col("unit").cast("binary")), path), F.lit(0))
        return units.select("unit", "blocks", ids.alias("ids"))

    ahead = known_words(documents, path, pattern, *known)
    return encode_blocks(documents, keep, _cutter(pattern), encoded, block_bytes, ahead)


def decode(ids: Column, vocabulary: tuple[str, str] | None = None) -> Column:
    """The bytes that an array of ids stands for."""
    ranks = read_table((vocabulary or default_vocabulary())[0]).ranks
    pieces: list[str | None] = [None] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.hex()
    unknown = F.raise_error(F.lit("an id that the rank table does not have"))

    def spelled(table: Column) -> Column:
        return F.transform(ids, lambda i: F.coalesce(F.get(table, i), unknown))

    # A concatenation of the pieces' digits, as array_join takes one pass where folding bytes copies them each time.
    return F.unhex(F.array_join(_let(_literal(_json(pieces), "array<string>"), spelled), ""))
