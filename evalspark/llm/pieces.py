"""Encoding and decoding with a public piece vocabulary, as a relational lattice.

Texts are cut where no piece can cross: in front of a run of word marks (a mark stands for a blank), around
line breaks, and between letters or digits and other characters, which ``read_pieces`` checks. The different units of all texts are encoded once. A unit's substrings up to the longest piece are
exploded and joined with the piece table; what matches are the edges of its lattice, which are grouped by unit and
folded with ``aggregate``. The units come from a shuffle by unit, so the edges are grouped without another one. Single characters are
no edges for BPE, which starts from them; their ids are looked up by code point.

* For a unigram table the fold is Viterbi's: the best score and the last edge of every prefix.
* The vocabulary at hand is a BPE table, for which the best sum of scores is not the encoding. There the fold takes the
  edges by rank and applies one where it joins two neighbouring symbols. This is exact if no piece is built by a
  merge of later rank than its own, which ``read_pieces`` checks for every piece.

Units meet their texts again by block (``unit_blocks``): each block of about ``BLOCK_BYTES`` asks for its
units once, and one task per block replaces them. The piece table has a fixed size and is broadcast. Characters
that no piece covers become their bytes' pieces. Units longer than ``LONG`` characters are folded in Python,
by the same rule.

Defined cases: null and empty texts have no ids; decoding gives the text back, except that a word mark in the text
comes back as a blank; repeated rows give one row each; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.unit_blocks import encode_blocks
from evalspark.session import ship_package

MARK = "▁"
BLOCK_BYTES = 32 << 20
LONG = 128
PIECES = "piece string, id int, rank int, score double"
# A row that every unit's edges hold, so that a unit without any edge is not lost.
NONE = ("", -1, -2, 0.0)
# Marks in front of letters and digits, or in front of other characters, or alone; line breaks. No piece holds a letter
# or digit beside another character, but for one: a superscript two and a full stop.
_OTHER = r"(?:(?![ \n])[\W_])"
_UNITS = re.compile(rf" *[^\W_]+(?:(?<=²)\.{_OTHER}*)?| *{_OTHER}+| +|\n")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def merge(unit: str, ranks: dict[str, int]) -> tuple[list[str], int]:
    """The symbols of a unit by plain merging, and the last rank that was merged."""
    symbols, last = list(unit), -1
    while len(symbols) > 1:
        found = [ranks.get(a + b, 1 << 60) for a, b in zip(symbols, symbols[1:])]
        rank = min(found)
        if rank == 1 << 60:
            break
        # All places of one rank, from the left.
        merged, i = [], 0
        while i < len(symbols):
            if i < len(found) and found[i] == rank:
                merged.append(symbols[i] + symbols[i + 1])
                i += 2
            else:
                merged.append(symbols[i])
                i += 1
        symbols, last = merged, max(last, rank)
    return symbols, last


def read_pieces(path: str | None = None) -> tuple[list[tuple], list[int]]:
    """Rows (piece, id, rank, score) of the ordinary pieces, and the ids of the 256 bytes."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path or default_model())
    rows, of_byte = [], [0] * 256
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            of_byte[int(piece[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            rows.append((piece, i, int(-model.get_score(i)), float(model.get_score(i))))
    ranks = {p: r for p, _, r, _ in rows}
    late = [p for p, _, r, _ in rows if len(p) > 1 and merge(p, ranks) != ([p], r)]
    if late:
        raise ValueError(f"pieces that are built by later merges: {late[:5]}")
    inner = [p for p, *_ in rows if MARK in p.lstrip(MARK) or len(units_of(p.lstrip(MARK), mark=False)) > 1]
    if inner:
        raise ValueError(f"pieces across words: {inner[:5]}")
    return rows, of_byte


def units_of(text: str | None, mark: bool = True) -> list[str]:
    """Parts of a text that are encoded on their own, blanks as they are; ``mark`` puts one in front."""
    if not text:
        return []
    return _UNITS.findall((" " if mark else "") + text.replace(MARK, " "))


def _lattice(units: DataFrame, pieces: DataFrame, shortest: int, longest: int, long: int | None) -> DataFrame:
    """One row per substring of ``shortest`` characters and more that is a piece; a first one has the unit's ``blocks``.

    Units of more than ``long`` characters have that first row only.
    """
    kind = dict(units.dtypes)["blocks"]
    marked = units.withColumns(
        {"marked": F.replace("unit", F.lit(" "), F.lit(MARK)), "n": F.length("unit")}
    )
    # The first row starts before the unit and has no length.
    last = F.greatest(F.col("n") - shortest, F.lit(-1))
    last = last if long is None else F.when(F.col("n") > long, -1).otherwise(last)
    started = marked.select("*", F.explode(F.sequence(F.lit(-1), last)).alias("at"))
    lengths = F.when(F.col("at") < 0, F.array(F.lit(0))).otherwise(
        F.sequence(F.lit(shortest), F.least(F.lit(longest), F.col("n") - F.col("at")))
    )
    spans = started.select("*", F.explode(lengths).alias("k")).select(
        "unit",
        F.greatest("at", F.lit(0)).alias("s"),
        (F.greatest("at", F.lit(0)) + F.col("k")).alias("e"),
        F.when(F.col("k") == 0, "").otherwise(F.substr("marked", F.col("at") + 1, F.col("k"))).alias("piece"),
        F.when(F.col("k") == 0, F.col("blocks")).otherwise(F.lit(None).cast(kind)).alias("blocks"),
    )
    return spans.join(F.broadcast(pieces), "piece").select("unit", "s", "e", "id", "rank", "score", "blocks")


def _bpe_fold() -> Column:
    """Where the symbol that starts at a place ends, 0 where none starts."""
    start = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: (i + 1).cast("int"))

    def apply(ends: Column, x: Column) -> Column:
        middle = F.get(ends, x["s"])
        joins = (middle > 0) & (F.get(ends, middle) == x["e"])
        joined = F.transform(
            ends, lambda v, i: F.when(i == x["s"], x["e"]).when(i == middle, F.lit(0)).otherwise(v)
        )
        return F.when(F.coalesce(joins, F.lit(False)), joined).otherwise(ends)

    return F.aggregate(F.filter("edges", lambda x: x["e"] - x["s"] > 1), start, apply)


def _viterbi_fold(unknown: float) -> Column:
    """The same table for the path with the best sum of scores; single characters always pass."""
    n = F.col("n")
    by_end = F.array_sort(
        F.transform(
            F.filter("edges", lambda x: x["e"] > x["s"]),
            lambda x: F.struct(x["e"].alias("e"), x["s"].alias("s"), x["score"].alias("score")),
        )
    )
    single = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.struct((i + 1).cast("int").alias("e"), i.cast("int").alias("s"), F.lit(unknown).alias("score")),
    )
    steps = F.array_sort(F.concat(by_end, single))
    start = F.transform(
        F.sequence(F.lit(0), n),
        lambda i: F.struct(F.when(i == 0, 0.0).otherwise(float("-inf")).alias("best"), F.lit(0).alias("back")),
    )

    def step(state: Column, x: Column) -> Column:
        score = F.get(state, x["s"])["best"] + x["score"]
        here = F.struct(score.alias("best"), x["s"].alias("back"))
        better = score > F.get(state, x["e"])["best"]
        return F.when(better, F.transform(state, lambda v, i: F.when(i == x["e"], here).otherwise(v))).otherwise(state)

    state = F.aggregate(steps, start, step)
    walked = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.lit(0))

    def back(done: Column, _: Column) -> Column:
        end = done["end"]
        s = F.get(done["state"], end)["back"]
        ends = F.transform(done["ends"], lambda v, i: F.when((i == s) & (end > 0), end).otherwise(v))
        return F.struct(done["state"].alias("state"), s.alias("end"), ends.alias("ends"))

    first = F.struct(state.alias("state"), n.alias("end"), walked.alias("ends"))
    return F.aggregate(F.sequence(F.lit(1), n), first, back, lambda done: done["ends"])


def _ids(of_byte: list[int], of_char: dict[str, int]) -> tuple[Column, Column, Column]:
    """Ids of the symbols in ``ends``: of their edges, of the characters that stand alone, or of the bytes of these."""
    chosen = F.filter("edges", lambda x: (x["e"] > x["s"]) & (F.get("ends", x["s"]) == x["e"]))
    bytes_ = F.array(*map(F.lit, of_byte))
    by_code = [None] * (max(map(ord, of_char), default=0) + 1)
    for c, i in of_char.items():
        by_code[ord(c)] = i
    chars = F.from_json(F.lit(json.dumps(by_code)), "array<int>")

    def char(s: Column) -> Column:
        return F.get(chars, F.ascii(F.substr("unit", s + 1, F.lit(1))))

    def symbol(s: Column) -> Column:
        own = F.transform(F.filter(F.col("chosen"), lambda x: x["s"] == s), lambda x: x["id"])
        raw = F.encode(F.substr("unit", s + 1, F.lit(1)), "UTF-8")
        spelled = F.transform(
            F.sequence(F.lit(1), F.octet_length(raw)),
            lambda i: F.get(bytes_, F.conv(F.hex(F.substr(raw, i, F.lit(1))), 16, 10).cast("int")),
        )
        return F.when(F.size(own) > 0, own).when(char(s).isNotNull(), F.array(char(s))).otherwise(spelled)

    places = F.sequence(F.lit(0), F.col("n") - 1)
    pieces = F.transform("chosen", lambda x: F.struct(x["s"].alias("s"), x["id"].alias("id")))
    alone = F.filter(places, lambda i: (F.get("ends", i) == i + 1) & ~F.exists("chosen", lambda x: x["s"] == i))
    symbols = F.concat(pieces, F.transform(alone, lambda i: F.struct(i.cast("int").alias("s"), char(i).alias("id"))))
    # Where no symbol has to be spelled in bytes, which is nearly everywhere, the symbols in their order are all.
    whole = F.forall("symbols", lambda x: x["id"].isNotNull())
    starts = F.filter(places, lambda i: F.get("ends", i) > 0)
    ids = F.when(whole, F.transform(F.array_sort("symbols"), lambda x: x["id"]))
    return chosen, symbols, ids.otherwise(F.flatten(F.transform(starts, symbol)))


def _long_encoder(rows: list[tuple], of_byte: list[int]) -> Callable[[str], list[int]]:
    ranks, ids = {p: r for p, _, r, _ in rows}, {p: i for p, i, _, _ in rows}

    def encode(unit: str) -> list[int]:
        out: list[int] = []
        for s in merge(unit.replace(" ", MARK), ranks)[0]:
            out.extend([ids[s]] if s in ids else [of_byte[b] for b in s.replace(MARK, " ").encode()])
        return out

    return encode


def encode_units(
    units: DataFrame, rows: list[tuple], of_byte: list[int], algorithm: str = "bpe", long: int = LONG
) -> DataFrame:
    """``unit``, ``blocks`` and ``ids`` for a table of different units with ``blocks`` (an array, may be null)."""
    ship_package(units.sparkSession)
    pieces = units.sparkSession.createDataFrame([*rows, NONE], PIECES)
    bpe = algorithm == "bpe"
    edges = _lattice(units, pieces, 2 if bpe else 1, max(len(p) for p, *_ in rows), long if bpe else None)
    # The units are different, so where they come from a shuffle by unit this needs no other.
    edge = F.struct("rank", "s", "e", "id", "score")
    grouped = edges.groupBy("unit").agg(
        F.first("blocks", ignorenulls=True).alias("blocks"), F.collect_list(F.when(F.col("e") > 0, edge)).alias("edges")
    )
    grouped = grouped.withColumns({"n": F.length("unit"), "edges": F.array_sort("edges")})
    if bpe:
        encoder = _long_encoder(rows, of_byte)

        def run(units: pa.Array) -> pa.Array:
            return pa.array([None if u is None else encoder(u) for u in units.to_pylist()], pa.list_(pa.int32()))

        run.__annotations__ = {"units": pa.Array, "return": pa.Array}
        long_ids = F.arrow_udf(run, "array<int>")(F.when(F.col("n") > long, F.col("unit")))
        grouped = grouped.withColumn("ids", long_ids)
    else:
        grouped = grouped.withColumn("ids", F.lit(None).cast("array<int>"))
    ends = _bpe_fold() if bpe else _viterbi_fold(min(s for *_, s in rows) - 10.0)
    of_char = {p: i for p, i, *_ in rows if len(p) == 1}
    # Units have blanks where pieces have marks.
    of_char |= {" ": of_char[MARK]} if MARK in of_char else {}
    chosen, symbols, ids = _ids(of_byte, of_char)
    folded = grouped.withColumn("ends", F.when(F.col("ids").isNull(), ends)).withColumn("chosen", chosen)
    folded = folded.withColumn("symbols", symbols)
    return folded.select("unit", "blocks", F.coalesce("ids", ids).alias("ids"))


def encode(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",), model: str | None = None) -> DataFrame:
    """The columns ``keep`` and ``ids``, the encoding of ``text``, one row per document."""
    ship_package(documents.sparkSession)
    rows, of_byte = read_pieces(model)
    return encode_blocks(
        documents, keep, lambda: units_of, lambda units: encode_units(units, rows, of_byte), BLOCK_BYTES
    )


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """``encoded`` with ``decoded``, the text of its ``ids``; no ids give an empty text."""
    rows, of_byte = read_pieces(model)
    spelled = {i: p.replace(MARK, " ").encode() for p, i, *_ in rows} | {i: bytes([b]) for b, i in enumerate(of_byte)}
    by_id = [spelled[i].hex() if i in spelled else None for i in range(max(spelled) + 1)]
    table = F.array(F.from_json(F.lit(json.dumps(by_id, separators=(",", ":"))), "array<string>"))
    unknown = F.raise_error(F.lit("an id that the vocabulary does not have")).cast("string")
    # Digits of all pieces in one pass; the literal is looked at once per row.
    digits = F.transform(table, lambda t: F.array_join(F.transform("ids", lambda i: F.coalesce(F.get(t, i), unknown)), ""))
    text = F.make_valid_utf8(F.unhex(F.get(digits, F.lit(0))).cast("string"))
    return encoded.withColumn("decoded", F.coalesce(F.substr(text, F.lit(2)), F.lit("")))
