"""Cases that an earlier form of the operators left out."""

import random

import numpy as np
from llm_fixtures import prose

from evalspark.llm import embedding_dedup as ed
from evalspark.llm import line_dedup as ld
from evalspark.llm import simhash as sh


def _stored(spark, path, data):
    spark.createDataFrame(data, "doc_id long, text string").coalesce(1).write.parquet(str(path))
    return spark.read.parquet(str(path))


def test_short_lines(spark, tmp_path):
    """Lines of one or two words go if an earlier line has the same set, within a batch and across batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    lines = ["Les.", "And ornd.", "ornd. and", "漢字" * 400, "no no no no", "", " ", "and", "And so", "so it"]
    data = [(i, "\n".join([f"own{i}", *lines[i % 3 :], *lines[: i % 4]])) for i in range(40)]
    try:
        got = {r["doc_id"]: r["text"] for r in ld.dedup_lines(_stored(spark, tmp_path / "d", data)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    seen = set()
    for doc_id, text in data:
        left = []
        for line in text.split("\n"):
            words = frozenset(line.lower().split())
            if not words or words not in seen:
                left.append(line)
            seen.add(words)
        assert got[doc_id] == "\n".join(left), doc_id


def test_vectors_near_few_dimensions(spark, monkeypatch):
    """All links of vectors that lie near a space of 8 of 384 dimensions, in several groups and blocks."""
    monkeypatch.setattr(ed, "GROUP_ROWS", 500)
    monkeypatch.setattr(ed, "BLOCK_ROWS", 300)
    r = np.random.default_rng(4)
    x = r.normal(size=(3000, 8)) @ r.normal(size=(8, 384)) + 0.02 * r.normal(size=(3000, 384))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    data = [(i, v.tolist()) for i, v in enumerate(x)]
    got = ed.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<float>")).collect()
    y = ed.unit(x)
    cosine = y @ y.T
    links = (cosine >= 0.9).sum(axis=1) - 1
    assert links.sum() > 1000 and np.abs(cosine - 0.9).min() > 1e-12
    assert [g["n_links"] for g in sorted(got)] == links.tolist()


def test_edited_and_wrapped_copies(spark, tmp_path):
    """Of two documents with a shingle similarity of 0.8 or more the later goes, however its lines are wrapped."""
    r = random.Random(8)
    texts = []
    for i in range(40):
        words = prose(1000 + i, 1, 300).split()
        copy = words[:]
        for k in r.sample(range(300), r.randint(1, 9)):
            copy[k] = f"edit{i}"
        texts += [words, copy]
    wrapped = [
        "\n".join(" ".join(w[k : k + 11 + i % 2 * 6]) for k in range(0, 300, 11 + i % 2 * 6))
        for i, w in enumerate(texts)
    ]
    sets = [{tuple(w[k : k + 5]) for k in range(296)} for w in texts]
    similar = {
        i for i in range(80) if any(9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])) for j in range(i))
    }
    kept = sh.drop_near_duplicates(_stored(spark, tmp_path / "d", list(enumerate(wrapped)))).select("doc_id").collect()
    gone = set(range(80)) - {x["doc_id"] for x in kept}
    assert len(similar) > 15 and similar <= gone
    # Fingerprints link some pairs below the limit too, always of a text and its copy.
    assert all(i % 2 == 1 for i in gone)
    alone = sh.simhash_components(_stored(spark, tmp_path / "s", list(enumerate(wrapped))), 5, 3).collect()
    assert len(similar - {x["doc_id"] for x in alone if x["doc_id"] != x["component_id"]}) > 5
