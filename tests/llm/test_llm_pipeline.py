"""The classifier on held-out labels, and the pipeline stage by stage."""

import math
from collections import Counter, defaultdict

import corpus_pipeline as pipeline
import numpy as np
from llm_fixtures import prose, rows, table

from evalspark.llm import quality_lm as lm
from evalspark.llm.queries import documents, labels

SF_DIR = "/root/testdata/sf0.01"


def test_model_against_direct_kneser_ney(spark):
    """All probabilities of one context, computed from the definition."""
    texts = [prose(i, 5) for i in range(12)]
    model = lm.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    codes = lambda t: [lm._BREAK] * 3 + lm._CLASS[np.frombuffer(t.encode(), np.uint8)].tolist()
    grams = Counter()
    for t in texts:
        s = codes(t)
        grams.update(tuple(s[i : i + 4]) for i in range(len(s) - 3))
    orders = {4: grams}
    for k in (3, 2, 1):
        orders[k] = Counter(g[1:] for g in orders[k + 1])
    discounts = {}
    for k, c in orders.items():
        n = Counter(c.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] and n[3] else None
        raw = (0.5,) * 3 if y is None else [i - (i + 1) * y * n[i + 1] / n[i] for i in (1, 2, 3)]
        discounts[k] = raw if y is None else [min(max(d, 0.05), i - 0.05) for i, d in enumerate(raw, 1)]
    by_context = {k: defaultdict(dict) for k in orders}
    for k, c in orders.items():
        for g, n in c.items():
            by_context[k][g[:-1]][g[-1]] = n

    def p(g):
        k = len(g)
        if not k:
            return 1 / lm.SYMBOLS
        own = by_context[k].get(g[:-1])
        if not own:
            return p(g[1:])
        d, total = discounts[k], sum(own.values())
        c = own.get(g[-1], 0)
        cut = d[min(c, 3) - 1] if c else 0
        mass = sum(d[min(n, 3) - 1] for n in own.values())
        return (c - cut) / total + mass / total * p(g[1:])

    number = lambda g: sum(x * lm.SYMBOLS ** (3 - i) for i, x in enumerate(g))
    for g in [*list(grams)[:50], (0, 1, 2, 3), (39, 39, 39, 39), (29, 29, 29, 19)]:
        assert math.isclose(math.exp(model.log_p[number(g)]), p(g), rel_tol=1e-4)
    t = "the and\nof"
    s = codes(t)
    total, n = model.scores(__import__("pyarrow").array([None, t, "", t]))
    expected = sum(math.log(p(tuple(s[i : i + 4]))) for i in range(len(t)))
    assert n.tolist() == [0, len(t), 0, len(t)] and np.allclose(total[[1, 3]], expected, rtol=1e-4)


def test_held_out_accuracy(spark):
    """Trained on every second label, judged on the others."""
    docs, marks = documents(spark, SF_DIR), labels(spark, SF_DIR)
    judge = lm.Judge(docs, marks.where("doc_id % 2 = 0"))
    got = judge.judge(judge.scored).join(marks.where("doc_id % 2 = 1"), "doc_id").collect()
    good = [r["kept"] for r in got if r["quality"] == 1]
    bad = [r["kept"] for r in got if r["quality"] == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.25


def test_classifier_odd_cases(spark):
    docs = table(spark)
    none = labels(spark, SF_DIR).limit(0)
    scores = lm.quality_scores(docs, none)
    assert scores.count() == len(rows())
    assert {r["kept"] for r in scores.where("perplexity IS NULL").collect()} == {False}
    assert {r["kept"] for r in scores.where("perplexity IS NOT NULL").collect()} == {True}
    some = spark.createDataFrame([(9, 1, 0), (9, 1, 0), (10, 1, 0), (11, 1, None), (None, 1, 0), (12, 1, 1)], "doc_id long, quality int, toxic int")
    kept = lm.keep_good(docs, some)
    assert kept.columns == docs.columns and 0 < kept.count() < len(rows())
    assert {r["doc_id"] for r in lm.trusted_ids(some).collect()} == {9, 10}
    assert lm.quality_scores(table(spark, data=[]), some).count() == 0


def test_stages(spark):
    """Each stage keeps the columns, drops only what it should, and the last packs all that is left."""
    assert [n for n, _ in pipeline.STAGES] == [
        "quality", "repeated_lines", "near_duplicates", "repeated_passages", "packing"
    ]
    docs = documents(spark, SF_DIR)
    columns = docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        docs = pipeline.materialize(stage(spark, docs, SF_DIR), name)
        after = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert docs.columns == columns and len(after) == len(set(after)) and set(after) <= before
        assert docs.where("n_chars <> length(text)").count() == 0
        assert len(after) > 0.85 * len(before)
    packed = pipeline.packing(spark, docs, SF_DIR)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == set(after)


def test_run_is_reproducible(spark):
    """Survivors and their texts do not depend on the run."""
    pick = ("doc_id", "piece", "length", "ids_crc32")
    first, second = (sorted(map(tuple, pipeline.run(spark, "/root/testdata/sf0.001").select(*pick).collect())) for _ in range(2))
    assert first == second and first


def test_stage_odd_cases(spark):
    docs = table(spark)
    for name, stage in pipeline.STAGES[1:-1]:
        out = stage(spark, docs, SF_DIR)
        assert set(out.columns) >= {"doc_id", "text", "lang"}, name
        assert out.count() > 0
        assert stage(spark, table(spark, data=[]), SF_DIR).count() == 0
