"""Token counts, packing and piece encoding against the libraries themselves."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from llm_fixtures import rows, table

from evalspark.llm import packing as pk
from evalspark.llm import pieces as pc
from evalspark.llm import token_counts as tc
from evalspark.llm.tokens import default_vocabulary, encoder


@pytest.fixture(scope="module")
def ids():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(default_vocabulary()[0])
    return [own.encode(r[1] or "", add_special_tokens=False).ids for r in rows()]


def test_encoder(ids):
    own = encoder(*default_vocabulary())
    for r, expected in zip(rows(), ids):
        assert np.frombuffer(own.encode(r[1]), "<u4").tolist() == expected
    r = random.Random(4)
    for _ in range(3000):
        text = "".join(r.choice([" ", " ", "\n", "\t", " ", "a", "b'll", "9", "é", ".", "<|endoftext|>"]) for _ in range(r.randint(0, 9)))
        expected = own.whole.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<u4").tolist() == expected, repr(text)


def test_counts(spark, ids):
    sums = tc.token_counts(table(spark)).cache()
    n = [len(x) for x in ids]
    for r in sums.collect():
        assert r["n_docs"] == n.count(r["length"])
        assert r["docs_at_least"] == sum(x >= r["length"] for x in n)
        assert r["tokens_at_least"] == sum(x for x in n if x >= r["length"])
        assert r["truncated_tokens"] == sum(min(x, r["length"]) for x in n)
        assert r["docs_at_most"] == sum(x <= r["length"] for x in n)
    limits = [0, 1, 57, 2048, 10**7]
    got = {r["limit"]: (r["docs_above"], r["truncated_tokens"]) for r in tc.at_limits(sums, limits).collect()}
    assert got == {x: (sum(k > x for k in n), sum(min(k, x) for k in n)) for x in limits}
    shares = {r["share"]: r["length"] for r in tc.quantiles(sums, [0.0, 0.5, 1.0]).collect()}
    assert shares == {0.0: min(n), 0.5: sorted(n)[-(-len(n) // 2) - 1], 1.0: max(n)}
    sums.unpersist()


def test_counts_empty(spark):
    sums = tc.token_counts(table(spark, data=[]))
    assert sums.count() == 0
    assert [tuple(r) for r in tc.at_limits(sums, [5]).collect()] == [(5, 0, 0)]


def _places(packed, capacity):
    bins = defaultdict(list)
    for r in packed:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for content in bins.values():
        content.sort()
        assert content[0][0] == 0 and sum(content[-1]) <= capacity
        assert all(a + n == b for (a, n), (b, _) in zip(content, content[1:]))
    return bins


def test_packing(spark, ids):
    expected = []
    for r, own in zip(rows(), ids):
        own = np.array([*own, 0], "<u4")
        at, end, k = 0, len(own) % 2048 or 2048, 0
        while at < len(own):
            expected.append((r[0] is not None, r[0], k, at, end - at, zlib.crc32(own[at:end].tobytes())))
            at, end, k = end, end + 2048, k + 1
    got = pk.pack_documents(table(spark)).collect()
    own = sorted((r[0] is not None, r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got)
    assert own == sorted(expected)
    assert len(_places(got, 2048)) == -(-sum(r["length"] for r in got) // 2048)
    assert pk.pack_documents(table(spark, data=[])).count() == 0
    with_ids = pk.pieces(table(spark), with_ids=True).collect()
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in with_ids)


def test_packing_many_blocks(spark, tmp_path):
    r = np.random.default_rng(3)
    data = [(i, 0, 0, int(n), 0) for i, n in enumerate(np.minimum(2048, r.lognormal(6, 1, 3000).astype(int) + 1))]
    schema = pk.PIECE.format(kind="bigint")
    spark.createDataFrame(data, schema).write.parquet(str(tmp_path / "pieces"))
    packed = pk.pack(spark.read.parquet(str(tmp_path / "pieces")), block_rows=400).collect()
    assert sorted(x["doc_id"] for x in packed) == list(range(3000))
    assert len(_places(packed, 2048)) <= 1.01 * sum(x[3] for x in data) / 2048 + 1


def test_crossover_keeps_every_item():
    lengths = np.random.default_rng(1).integers(1, 900, 300)
    packer = pk._Packer(lengths, 1000, 1)
    a, b = packer.fresh(0.0), packer.fresh(0.5)
    child = packer.crossover(a, b)
    assert sorted(x for c in child for x in c) == list(range(300))
    assert all(packer.fill(c) <= 1000 for c in child)
    assert len(packer.evolve([b])) <= len(b)


def test_pieces(spark):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=pc.default_model())
    got = pc.decode(pc.encode(table(spark), ("doc_id", "text"))).collect()
    assert len(got) == len(rows())
    for r in got:
        assert r["ids"] == model.encode(r["text"] or "")
        assert r["decoded"] == (r["text"] or "").replace(pc.MARK, " ")
    assert pc.encode(table(spark, data=[])).count() == 0


def test_long_units_by_both_folds(spark):
    """The fold in Spark and the one in Python agree."""
    pieces, of_byte = pc.read_pieces()
    r = random.Random(9)
    units = sorted({"".join(r.choices([" ", "th", "e", "re", "tion", "é", "漢", "x"], k=r.randint(1, 14))) for _ in range(80)})
    df = spark.createDataFrame([(u, [k]) for k, u in enumerate(units)], "unit string, blocks array<int>")
    short = {x["unit"]: x["ids"] for x in pc.encode_units(df, pieces, of_byte).collect()}
    assert short == {x["unit"]: x["ids"] for x in pc.encode_units(df, pieces, of_byte, long=0).collect()}
    assert set(short) == set(units)


def test_unigram_is_the_best_path(spark):
    scored = [("a", -1.5), ("b", -1.0), ("ab", -2.2), ("aba", -2.5), ("bb", -3.0), (pc.MARK, -1.0), (pc.MARK + "a", -1.2)]
    pieces = [(p, i, 0, s) for i, (p, s) in enumerate(scored)]
    r = random.Random(1)
    units = sorted({"".join(r.choices(" ab", k=1 + k % 9)) for k in range(60)})
    df = spark.createDataFrame([(u, [k]) for k, u in enumerate(units)], "unit string, blocks array<int>")
    score = dict(scored)

    def best(t):
        return max((score[t[:k]] + best(t[k:]) for k in (1, 2, 3) if t[:k] in score), default=0.0)

    for x in pc.encode_units(df, pieces, list(range(1000, 1256)), "unigram").collect():
        marked = x["unit"].replace(" ", pc.MARK)
        assert "".join(scored[i][0] for i in x["ids"]) == marked
        assert abs(sum(scored[i][1] for i in x["ids"]) - best(marked)) < 1e-9


def test_units_meet_their_blocks(spark):
    """Many blocks per task: texts are not shuffled as rows, units are grouped once, every block gets its own ids back."""
    from evalspark.llm.unit_blocks import encode_blocks

    r = random.Random(3)
    data = [(i, None if i % 17 == 0 else " ".join(r.choices("abcdefgh", k=r.randint(0, 30)))) for i in range(600)]
    df = spark.createDataFrame(data, "doc_id int, text string").repartition(3).localCheckpoint()

    def coded(units):
        assert dict(units.dtypes)["unit"] == "string"
        return units.selectExpr("unit", "blocks", "array(ascii(unit), 7) AS ids")

    got = encode_blocks(df, ("doc_id", "text"), lambda: str.split, coded, 500, [("a", b"\x01\0\0\0")])
    found = {x["doc_id"]: x for x in got.collect()}
    assert len(found) == len(data)
    for i, t in data:
        expected = [k for u in (t or "").split() for k in ([1] if u == "a" else [ord(u), 7])]
        assert (found[i]["text"], found[i]["ids"]) == (t, expected)


def test_pieces_decode_in_one_python_step(spark):
    """The ids are spelled by Spark, so a task needs no second Python worker."""
    coded = pc.encode(table(spark), ("doc_id", "text"))
    decoded = pc.decode(spark.createDataFrame([([],), (None,)], "ids array<int>"))
    assert [x["decoded"] for x in decoded.collect()] == ["", ""]
    last_step = pc.decode(coded)._jdf.queryExecution().executedPlan().toString().split("FlatMapCoGroupsInArrow")[0]
    assert "ArrowEvalPython" not in last_step
    with pytest.raises(Exception, match="does not have"):
        pc.decode(spark.createDataFrame([([0, 10**6],)], "ids array<int>")).collect()
