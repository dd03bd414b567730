"""Conversation trie, byte-level BPE and fill-in-middle against plain Python versions and the libraries."""

import hashlib
import random
import zlib

import pytest
from llm_fixtures import SCHEMA, WORDS, prose, rows, table
from pyspark.sql import functions as F

from evalspark.llm import byte_bpe as bb
from evalspark.llm import conversation_trie as ct
from evalspark.llm import fill_in_middle as fm

CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string, depth string, key int, words string"


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def talks():
    """(conv_id, turn, role, text): families, copies, gaps, nulls, ties, repeated rows, one long conversation."""
    r = random.Random(5)
    said = ["hello there", "", None, " \t", "a b  c\nd", "Ünd so 漢字", prose(3, 1, 400)]
    out = []
    for c in [*range(60), *range(200, 260, 3), 1003, 1004, 2025, -3, -20, -41]:
        for turn in range(r.choice([0, 1, 1, 2, 3, 5])):
            out.append((c, turn, r.choice(["user", "assistant", None]), r.choice(said)))
    first = [x for x in out if x[0] == 7]
    out += [(c, t, role, text) for c in range(500, 540) for _, t, role, text in first]
    out += [(61, None, "user", "null turn"), (61, None, "user", "again"), (61, 3, "user", "tie"), (61, 3, "user", "tie2")]
    out += out[:9] + [(None, 0, "user", "no id"), (62, 5, "user", "x"), (62, 5, "user", "x")]
    out += [(81, i, "user", f"turn {i % 50}") for i in range(700)]
    r.shuffle(out)
    return out


def brute_trie(talk):
    own = {}
    digest = lambda role, text: sha(f"{len(role)}:{role}{text}")[:32]
    for c, turn, role, text in talk:
        if c is not None:
            role, text = role or "", text or ""
            order = (turn is not None, turn or 0, digest(role, text))
            own.setdefault(c, []).append((order, (role, text)))
    own = {c: [x for _, x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        rebuilt[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        below = children.get(path, [])
        leaves[path] = sum(leaves[x] for x in below) or 1
        here = (len(members[path]) - 1) * len(WORDS.findall(path[-1][1])) if path else 0
        saved[path] = here + sum(saved[x] for x in below)
    out = []
    for path, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(rebuilt[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        below = len(children.get(path, []))
        out.append((min(convs), len(path), parent, len(convs), below, leaves[path], saved[path], sha(ends)))
    return sorted(out, key=str)


def trie_rows(spark, df):
    trie = ct.prefix_trie(*ct.rebuilt_turns(df))
    ends = ct.end_digests(trie.ends)
    got = trie.nodes.join(ends, ct.KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )
    return sorted((tuple(r[:-1]) + (r[-1] or sha(""),) for r in got.collect()), key=str), trie


@pytest.mark.parametrize("block", [3, 4096])
def test_trie(spark, monkeypatch, block):
    """Blocks of few turns, ids of a node in several rows, conversations across ranges."""
    monkeypatch.setattr(ct, "BLOCK_TURNS", block)
    monkeypatch.setattr(ct, "IDS_A_ROW", 5)
    talk = talks()
    df = spark.createDataFrame([(*t, "x", 1, "y") for t in talk], CONVERSATIONS).repartition(5)
    got, trie = trie_rows(spark, df)
    assert got == brute_trie(talk)
    if block == 3:
        texts = {(r["conv_id"], r["depth"]): r["text"] for r in ct.with_turns(trie.nodes, df).collect()}
        depth = max(d for c, d in texts if c == 81)
        assert depth > 690 and texts[81, depth] == "turn 49" and {t for (_, d), t in texts.items() if d == 0} == {None}


def test_trie_without_rows(spark):
    none = spark.createDataFrame([], CONVERSATIONS)
    assert trie_rows(spark, none)[0] == []
    only_null = spark.createDataFrame([(None, 1, "user", "x", "", 1, "")], CONVERSATIONS)
    assert trie_rows(spark, only_null)[0] == []
    # A conversation without any turn of its own: its first ones are replaced by those of an absent one.
    turnless = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 > 0)
    got = trie_rows(spark, spark.createDataFrame([(turnless, 0, "u", "x", "", 1, "")], CONVERSATIONS))[0]
    assert got == [(turnless, 0, None, 1, 0, 1, 0, sha(str(turnless)))]


def odd_texts():
    r = random.Random(1)
    alphabets = ["ab", "the ", "ACGT", "xé漢\U0001f600 ", "aeiou 12,.\n\t\r ", "= -\n  "]
    made = ["".join(r.choices(a, k=n)) for a in alphabets for n in (1, 2, 3, 7, 40, 300)]
    made += ["x" * 20_000, "th" * 3000, " " * 999, "é" * 3000 + "x" * 5000, "it's we'll I'D 'Tis", "\x1c\x1d a\x85b c"]
    return made + ["<|endoftext|>", "a\x00b", "͸\U000323b0 new letters", prose(5, 1, 5000)]


@pytest.mark.parametrize("name", ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"])
def test_bpe(spark, name):
    import public_tokenizers
    import tiktoken

    vocabulary = (public_tokenizers.path(name), public_tokenizers.PATTERN)
    ranks = bb.read_table(vocabulary[0]).ranks
    library = tiktoken.Encoding("t", pat_str=vocabulary[1], mergeable_ranks=ranks, special_tokens={})
    data = rows() + [(1000 + i, t, "en", "s", 1, "r", 1, "l") for i, t in enumerate(odd_texts())]
    # Several blocks in a task; some words known ahead, most not; kept columns with the names of inner ones.
    df = table(spark, data=data).withColumnsRenamed({"row": "words", "at": "place", "lines": "codes"})
    coded = bb.encode(df, ("doc_id", "text", "words", "place", "codes"), vocabulary, 9000, (30, 50))
    got = coded.withColumn("decoded", bb.decode(F.col("ids"), vocabulary)).collect()
    key = lambda x: (str(x["doc_id"]), x["text"] or "")
    assert sorted(map(key, got)) == sorted((str(x[0]), x[1] or "") for x in data)
    for x in got:
        assert x["ids"] == library.encode_ordinary(x["text"] or ""), x["doc_id"]
        assert bytes(x["decoded"]) == (x["text"] or "").encode()
        assert (x["words"], x["codes"]) == ("r", "l")


def test_bpe_late_merges(spark, tmp_path):
    """Pieces that make a pair of lower rank than their own with a neighbour: one merge at a time there."""
    import base64

    ranks = {bytes([i]): i for i in range(256)}
    # " t" is made early, "th" late; "thth" before "th"; "aab" before "ab" although "ab" can make it.
    for piece in (b" t", b"aa", b"aab", b" th", b"bc", b"th", b"ab", b"abab", b"aabc"):
        ranks[piece] = len(ranks)
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(p) + b" %d\n" % r for p, r in ranks.items()))
    assert bb.read_table(str(path)).late
    r = random.Random(2)
    words = ["".join(r.choices("abc", k=n)).encode() for n in range(1, 40) for _ in range(6)]
    words += ["".join(r.choices(" th", k=n)).encode() for n in range(1, 30) for _ in range(6)]
    df = spark.createDataFrame([(w, [w, w]) for w in words], "word binary, words array<binary>").coalesce(2)
    got = df.select("word", bb.encode_words(F.col("words"), str(path)).alias("ids")).collect()
    for x in got:
        assert x["ids"] == [bb.merge(ranks, bytes(x["word"]))] * 2, x["word"]


def test_bpe_refuses(spark, tmp_path):
    import base64

    with pytest.raises(ValueError, match="ids"):
        bb.encode(spark.createDataFrame([(1, "a")], "ids int, text string"), ("ids",))
    apart = tmp_path / "apart"
    known = [bytes([i]) for i in range(256)] + [b"abc"]
    apart.write_bytes(b"".join(base64.b64encode(p) + b" %d\n" % i for i, p in enumerate(known)))
    with pytest.raises(ValueError, match="merges"):
        bb.read_table(str(apart))
    assert bb.encode(spark.createDataFrame([], SCHEMA)).collect() == []
    with pytest.raises(Exception, match="does not have"):
        spark.createDataFrame([([60_000],)], "ids array<int>").select(bb.decode(F.col("ids"))).collect()


def brute_fim(doc_id, text):
    text = text or ""
    n, h = len(text), fm.draw(doc_id)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = "<P>" + text[:a], "<M>" + text[a:b], "<S>" + text[b:]
    return (n, "spm", a, b - a, s + p + m) if h[3] % 100 < 20 else (n, "psm", a, b - a, p + s + m)


@pytest.mark.parametrize("units", [2, 50, 8192])
def test_fill_in_middle(spark, monkeypatch, units):
    """Frames of two units put every cut, and marks that look like markers, across frames."""
    monkeypatch.setattr(fm, "FRAME_UNITS", units)
    monkeypatch.setattr(fm, "BATCH_BYTES", 2000)
    texts = ["a<P>b", "<S>", "x<M", "<", "<<S<P", "S>", "><M<", "P><S" * 9, "\U0001f600é漢" * 40, "\x00"] * 4
    data = [r for r in rows() if len(r[1] or "") < 60_000]
    data += [(500 + i, t, "en", "s", 1, "r", 1, "l") for i, t in enumerate(texts)]
    df = table(spark, data=data)
    framed = fm.store_frames(df, ("doc_id", "text", "lines"))
    moved = fm.restored(fm.fill_in_middle(framed, ("doc_id", "text", "lines", "n")))
    hashed = fm.with_digests(moved, {"output": "a", "restored": "b"}).collect()
    assert len(hashed) == len(data)
    for x in hashed:
        n, form, head, middle, output = brute_fim(x["doc_id"], x["text"])
        assert (x["n"], x["form"], x["prefix_chars"], x["middle_chars"]) == (n, form, head, middle), x["doc_id"]
        assert (x["a"], x["b"], x["lines"]) == (sha(output), sha(x["text"] or ""), "l"), x["doc_id"]
    assert {x["form"] for x in hashed} == {"plain", "psm", "spm"}
    for x in fm.with_text(moved, "output", "out").collect():
        assert x["out"] == brute_fim(x["doc_id"], x["text"])[-1]
    spans = framed.withColumns({"low": F.lit(3).cast("long"), "high": F.lit(120).cast("long")})
    assert all(x["span"] == (x["text"] or "")[3:120] for x in fm.select_span(spans).collect())


def test_fill_in_middle_refuses(spark):
    with pytest.raises(ValueError, match="frames"):
        fm.store_frames(spark.createDataFrame([(1, "a")], "frames int, text string"), ("frames",))
    assert fm.fill_in_middle(fm.store_frames(spark.createDataFrame([], SCHEMA))).collect() == []
