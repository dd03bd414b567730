"""Work that has to stay bounded, or whole, at any size of the input."""

import random
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from llm_fixtures import groups, prose

from evalspark.llm import embedding_dedup as ed
from evalspark.llm import quality_lm as ql
from evalspark.llm import simhash as sh


def _vectors(n, seed, dimension=32):
    return np.random.default_rng(seed).normal(size=(n, dimension))


def _batch(x, first, asks):
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
    same = [pa.array(np.zeros(len(x), np.int32)), pa.array(np.zeros(len(x), np.int32)), pa.array(np.full(len(x), asks))]
    cid, w = pa.array(first + np.arange(len(x))), pa.array(np.ones(len(x), np.int64))
    return pa.RecordBatch.from_arrays([*same, cid, w, lists], ["part", "block", "asks", "cid", "w", "embedding"])


def test_a_block_does_not_hold_the_vectors_that_ask(monkeypatch):
    """A task's memory follows its block, not the number of vectors that come to it; links are those of all pairs."""
    monkeypatch.setattr(ed, "AT_ONCE", 1 << 16)
    own, n, size = _vectors(300, 1), 60, 2000
    index = SimpleNamespace(value=ed.Index(own, 300, 0.9))

    def asking(k):
        x = _vectors(size, 100 + k)
        x[:20] = own[k : k + 20] + 0.1 * x[:20]
        return x

    def batches():
        yield _batch(own, 0, False)
        for k in range(n):
            yield _batch(asking(k), 300 + k * size, True)

    expected = np.zeros(300 + n * size, np.int64)
    x = ed.unit(own)
    expected[:300] = (x @ x.T >= 0.9).sum(axis=1) - 1
    for k in range(n):
        hit = x @ ed.unit(asking(k)).T >= 0.9
        expected[:300] += hit.sum(axis=1)
        expected[300 + k * size : 300 + (k + 1) * size] = hit.sum(axis=0)
    [b.to_pydict() for b in ed._by_block(ed._Searcher, index)(iter([_batch(own, 0, False)]))]
    tracemalloc.start()
    found = [b.to_pydict() for b in ed._by_block(ed._Searcher, index)(batches())]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    got = np.zeros_like(expected)
    for b in found:
        np.add.at(got, b["cid"], b["n"])
    assert (got == expected).all() and (expected[300:] > 0).sum() > 1000
    # All that ask, in double precision, are 31 MB, and their table of near cells would come on top.
    assert peak < 15e6


def test_only_vectors_that_may_be_linked_travel_whole(spark, monkeypatch):
    """Few of many strangers reach the search, though all borders are near; none of the links is lost."""
    monkeypatch.setattr(ed, "GROUP_ROWS", 300)
    monkeypatch.setattr(ed, "BLOCK_ROWS", 200)
    x = _vectors(2000, 7, 64)
    x[1900:] = x[:100] + 0.2 * x[1900:]
    data = [(i, v.tolist()) for i, v in enumerate(x)]
    written = {}
    kept = ed.materialize
    monkeypatch.setattr(ed, "materialize", lambda df, label: written.setdefault(label, kept(df, label)))
    got = ed.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()
    y = ed.unit(x)
    links = (y @ y.T >= 0.9).sum(axis=1) - 1
    assert [g["n_links"] for g in sorted(got)] == links.tolist() and links.sum() > 100
    assert written["maybe-linked"].count() < 1000


def test_ngrams_tell_all_texts_apart():
    """Case, digits, signs and letters of all scripts count; an n-gram is the bytes themselves."""
    texts = ["ab1.", "aB1.", "ab2.", "ab1!", "äb1.", "öb1.", "漢字", "漢学", "ж", "ш"]
    codes = [tuple(ql.ngrams(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])).tolist()) for t in texts]
    assert len(set(codes)) == len(texts)
    for t, code in zip(texts, codes):
        padded = b"\n\n\n" + t.encode()
        assert [c.to_bytes(4) for c in code] == [padded[i : i + 4] for i in range(len(t.encode()))]


def test_a_model_in_parts_judges_as_in_one(spark, tmp_path, monkeypatch):
    """Weights that do not fit into memory at once are summed part by part."""
    texts = [prose(i, 2) + ("" if i % 3 else " Ünd £5 漢字") for i in range(90)] + [None, "", "zzz 999 ###"]
    data = [(i, t, "en" if i % 2 else "de") for i, t in enumerate(texts)]
    spark.createDataFrame(data, "doc_id long, text string, lang string").coalesce(2).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    labels = spark.range(80).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    found, kept = [], []
    for part in (1 << 22, 500):
        monkeypatch.setattr(ql, "PART", part)
        found.append(sorted(map(tuple, ql.quality_scores(docs, labels).collect())))
        kept.append(sorted(r["doc_id"] for r in ql.keep_good(docs, labels).collect()))
    assert ql.train(docs.select("text")).n_parts > 3
    assert [r[0::4] for r in found[0]] == [r[0::4] for r in found[1]] and kept[0] == kept[1]
    assert kept[0] == [r[0] for r in found[0] if r[4]] and 70 < len(kept[0]) < 92
    near = [np.isclose(a[2], b[2], rtol=1e-6) for a, b in zip(*found) if a[2] is not None]
    assert all(near) and len(near) == 91


def test_counts_sent_on_early_add_up(monkeypatch):
    monkeypatch.setattr(ql, "COUNTED", 50)
    texts = [prose(i, 2) for i in range(20)] * 2
    batches = [pa.RecordBatch.from_pydict({"text": pa.array(texts[i : i + 5])}) for i in range(0, 40, 5)]
    sent = [b.to_pydict() for b in ql._count(iter(batches))]
    assert len(sent) > 2
    got, expected = Counter(), Counter()
    for b in sent:
        got.update(dict(zip(b["g"], b["c"])))
    for t in texts:
        padded = b"\n\n\n" + t.encode()
        expected.update(int.from_bytes(padded[i : i + 4]) for i in range(len(t)))
    assert got == expected


def test_groups_are_connected_by_similar_documents(spark, tmp_path):
    """Two documents that only a later third one is similar to are of its group; all but the first of a group go."""
    r = random.Random(5)
    texts = []
    for i in range(40):
        words = prose(500 + i, 1, 420).split()
        chain = [words[0:300], words[50:350], words[25:325], words[75:375], words[0:300], words[100:400]]
        texts += [" ".join(w) for w in chain[: r.randint(2, 6)]]
    r.shuffle(texts)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    linked = [(i, j) for i in range(len(sets)) for j in range(i) if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))]
    alone = [i for i in range(len(sets)) if not any(x == i for x, _ in linked)]
    marks = {x["doc_id"]: x["fp"] for x in sh.fingerprints(docs, 5).collect()}
    linked += [(i, j) for i in marks for j in range(i) if ((marks[i] ^ marks[j]) & (1 << 64) - 1).bit_count() <= 3]
    first = {i for i, g in enumerate(groups(len(sets), linked)) if i == g}
    kept = [x["doc_id"] for x in sh.drop_near_duplicates(docs).collect()]
    assert sorted(kept) == sorted(first) and len(first) < len(alone)
