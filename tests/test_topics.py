import numpy as np
import pytest
from helpers import A_L, A_S, by
from pyspark.sql import functions as F

from evalspark.operators import topics
from evalspark.session import materialize

VARIANTS = [A_S, A_L]


def _inputs(spark, texts, flagged_by_large=9):
    """Negatives that the small model flags all, the large one only the first few."""
    rows = [(i, 0, t, 1, int(i < flagged_by_large)) for i, t in enumerate(texts)]
    items = spark.createDataFrame(rows, "item_id long, truth int, text string, A_S int, A_L int")
    return items.drop("text"), items.select("item_id", "text")


TEXTS = [
    f"{'apples pears plums' if i % 2 else 'trains trams ships'} {'été' if i % 3 else 'hiver'} shared w{i}"
    for i in range(40)
]


def test_stop_words(spark):
    stops = set(topics.english_stop_words())
    assert {"the", "whereupon", "can", "is"} <= stops
    assert not {"just", "don", "did"} & stops
    assert not set(topics.MORE_STOP_WORDS) & set(topics.NOT_STOP_WORDS)


def test_tokens_and_vocabulary(spark):
    wide, items = _inputs(spark, TEXTS)
    tokens = topics.fp_tokens(wide, VARIANTS, ["ships"], items)
    assert tokens.count() == 40
    assert tokens.where("A_L_fp = 1").count() == 9
    row = by(tokens.collect(), "item_id")[4]
    assert row.words == ["trains", "trams", "été", "shared", "w4"]
    texts = topics.by_variant(tokens, VARIANTS)
    words = by(topics.vocabulary(texts, ["definition", "model"]).collect(), "model", "word")
    assert words["S", "apples"].n_texts == 20
    assert ("S", "shared") not in words  # in more than 95 % of the texts
    assert ("S", "w1") not in words  # in one text only
    assert ("L", "été") in words
    all_words = topics.vocabulary(texts, ["definition", "model"], 0.5, 1.0).collect()
    assert {r.word for r in all_words if r.model == "S"} == {"shared", "apples", "pears", "plums", "trains", "trams", "été"}


def test_topics(spark):
    wide, items = _inputs(spark, TEXTS, 9)
    tables = topics.fit_topics(topics.fp_tokens(wide, VARIANTS, texts=items), VARIANTS, 3, top_words=4)
    found = topics.topic_counts(tables).collect()
    assert {r.model for r in found} == {"S"}  # nine texts are too few
    assert len(found) == 3
    assert sum(r.n_texts for r in found) == 40 == tables.assignments.count()
    assert sum(r.share for r in found) == pytest.approx(1)
    assert [r.n_texts for r in found] == sorted((r.n_texts for r in found), reverse=True)
    for r in found:
        assert len(r.words) == len(r.weights) == 4
        assert r.weights == sorted(r.weights, reverse=True)
        assert r.label == f"Topic {r.topic + 1}: " + " ".join(r.words[:3])
    examples = topics.topic_examples(tables, items)
    per_topic = by(examples.groupBy("topic").agg(F.count("*").alias("n"), F.max("example").alias("last")).collect(), "topic")
    for r in found:
        expected = min(5, r.n_texts)
        assert expected == (per_topic[r.topic].n if expected else 0)
    smallest = tables.assignments.groupBy("topic").agg(F.min("item_id").alias("first")).collect()
    first = {r.topic: r.item_id for r in examples.where("example = 1").collect()}
    assert first == {r.topic: r.first for r in smallest}


def test_ten_texts_are_enough(spark):
    wide, items = _inputs(spark, TEXTS, 10)
    tables = topics.fit_topics(topics.fp_tokens(wide, VARIANTS, texts=items), VARIANTS, 2)
    assert {r.model for r in tables.topics.collect()} == {"S", "L"}


def test_nothing_to_model(spark):
    wide, items = _inputs(spark, TEXTS[:5])
    tables = topics.fit_topics(topics.fp_tokens(wide, VARIANTS, texts=items), VARIANTS)
    assert tables.topics.count() == tables.assignments.count() == topics.topic_counts(tables).count() == 0


def test_topics_part_disjoint_vocabularies(spark):
    texts = [("apples pears plums cherries " if i % 2 else "trains trams ships planes ") * (1 + i % 3) for i in range(60)]
    wide, items = _inputs(spark, texts)
    tables = topics.fit_topics(topics.fp_tokens(wide, [A_S], texts=items), [A_S], 2, max_iter=30)
    kinds = tables.assignments.groupBy("topic").agg(F.collect_set(F.col("item_id") % 2).alias("kinds"))
    assert sorted(r.kinds for r in kinds.collect()) == [[0], [1]]


def test_repeated_ids(spark):
    """Rows that share an id are all modelled, without multiplying each other."""
    wide, items = _inputs(spark, TEXTS)
    hot = wide.join(items, "item_id").withColumn("item_id", F.when(F.col("item_id") < 15, 0).otherwise(F.col("item_id")))
    tokens = topics.fp_tokens(hot, [A_S])
    assert tokens.count() == 40
    tables = topics.fit_topics(tokens, [A_S], 2)
    assert tables.assignments.count() == 40
    examples = topics.topic_examples(tables, hot)
    keys = examples.select("topic", "example").distinct().count()
    assert examples.count() == keys <= 10
    # The first rows by id, those that share it each with their own text.
    per_topic = {r["topic"]: r["n"] for r in tables.assignments.groupBy("topic").agg(F.count("*").alias("n")).collect()}
    assert examples.count() == sum(min(5, n) for n in per_topic.values())
    own = {(r["item_id"], r["text"]) for r in hot.select("item_id", "text").collect()}
    rows = examples.collect()
    assert {(r["item_id"], r["text"]) for r in rows} <= own
    assert len({(r["topic"], r["text"]) for r in rows if r["item_id"] == 0}) > 1


def _weights(spark, wide, items, partitions):
    tokens = topics.fp_tokens(wide, VARIANTS, texts=items).repartition(partitions)
    return topics.fit_topics(tokens, VARIANTS, 3, top_words=50)


def test_fit_does_not_depend_on_partitions(spark):
    wide, items = _inputs(spark, TEXTS, 12)
    one, many = (_weights(spark, wide, items, n) for n in (1, 23))
    key = ("model", "topic")
    a, b = by(one.topics.collect(), *key), by(many.topics.collect(), *key)
    assert set(a) == set(b)
    for k in a:
        x, y = (dict(zip(r[k].words, r[k].weights)) for r in (a, b))
        assert x == pytest.approx(y, abs=1e-9)


def test_every_text_counts_in_every_pass(spark):
    """The weights of a topic model add up to the words of all texts, and the prior."""
    wide, items = _inputs(spark, TEXTS, 12)
    tokens = topics.fp_tokens(wide, VARIANTS, texts=items).withColumn("text_no", F.col("item_id"))
    counts = topics.term_counts(tokens, VARIANTS)
    n = {r.variant: r.n for r in counts.groupBy("variant").agg(F.sum("n").alias("n")).collect()}
    words = {r.variant: r.n for r in counts.groupBy("variant").agg(F.countDistinct("word").alias("n")).collect()}
    for passes in (1, 2):
        tables = topics.fit_topics(topics.fp_tokens(wide, VARIANTS, texts=items), VARIANTS, 3, top_words=500, max_iter=passes)
        for i, v in enumerate(VARIANTS):
            total = sum(sum(r.weights) for r in tables.topics.where(F.col("model") == v.model).collect())
            assert total == pytest.approx(n[i] + words[i])


def _infer_plainly(n, beta, starts, alpha):
    """Every text on its own, word by word."""
    ends = [*starts[1:], len(n)]
    gammas, shares = [], []
    for a, b in zip(starts, ends):
        gamma, old = np.ones(len(beta)), None
        for _ in range(100):
            theta = np.exp(topics._digamma(gamma) - topics._digamma(gamma.sum(keepdims=True)))
            old, gamma = gamma, alpha + theta * (beta[:, a:b] * (n[a:b] / (theta @ beta[:, a:b]))).sum(axis=1)
            if np.abs(gamma - old).mean() < 1e-3:
                break
        theta = np.exp(topics._digamma(gamma) - topics._digamma(gamma.sum(keepdims=True)))
        gammas.append(gamma)
        shares.append(theta[:, None] * beta[:, a:b] * (n[a:b] / (theta @ beta[:, a:b])))
    return np.array(gammas), np.hstack(shares)


def test_texts_inferred_together_equal_texts_inferred_alone(monkeypatch):
    """Texts of one to many words that settle after different rounds, in groups of all kinds."""
    rng = np.random.default_rng(3)
    sizes = np.concatenate([[1, 1, 700], rng.integers(1, 60, 80)])
    starts = np.cumsum(sizes) - sizes
    n = rng.integers(1, 9, sizes.sum()).astype(float)
    beta = rng.gamma(0.3, 1, (4, len(n))) + 1e-6
    expected = _infer_plainly(n, beta, starts, 0.25)
    for together in (1, 64, 1 << 15):
        monkeypatch.setattr(topics, "TOGETHER", together)
        for found, wanted in zip(topics._infer(n, beta, starts, 0.25), expected):
            assert found == pytest.approx(wanted, abs=1e-9)


def test_small_blocks_and_shards_change_nothing(spark, monkeypatch):
    """Many blocks of few texts and many shards of few words give the topics of one block and one shard."""
    wide, items = _inputs(spark, TEXTS, 12)
    tokens = topics.fp_tokens(wide, VARIANTS, texts=items).coalesce(1)
    key = ("model", "topic")
    one = by(topics.fit_topics(tokens, VARIANTS, 3, top_words=50).topics.collect(), *key)
    monkeypatch.setattr(topics, "BLOCK_COUNTS", 20)
    monkeypatch.setattr(topics, "SHARD_WORDS", 5)
    many = by(topics.fit_topics(tokens, VARIANTS, 3, top_words=50).topics.collect(), *key)
    assert set(one) == set(many)
    for k in one:
        x, y = (dict(zip(r[k].words, r[k].weights)) for r in (one, many))
        assert x == pytest.approx(y, abs=1e-9)


def test_a_pass_moves_a_row_per_block_and_shard(spark, monkeypatch):
    """Words travel as arrays: what a shard tells is a row per block, however many words that asks for."""
    wide, items = _inputs(spark, TEXTS, 40)
    rows = {}

    def counted(df, label):
        stored = materialize(df, label)
        rows.setdefault(label, stored.count())
        return stored

    monkeypatch.setattr(topics, "materialize", counted)
    topics.fit_topics(topics.fp_tokens(wide, VARIANTS, texts=items).coalesce(1), VARIANTS, 3, max_iter=1)
    assert rows["text-blocks"] == rows["topic-words"] == rows["topic-weights"] == 2


def test_null_texts_and_texts_without_words(spark):
    texts = [*TEXTS, None, "", "the of", "alone1 alone2"]
    wide, items = _inputs(spark, texts, 12)
    tables = topics.fit_topics(topics.fp_tokens(wide, VARIANTS, texts=items), VARIANTS, 3)
    found = {r["item_id"]: r["topic"] for r in tables.assignments.where("model = 'S'").collect()}
    assert len(found) == len(texts)
    assert [found[i] for i in range(len(TEXTS), len(texts))] == [0, 0, 0, 0]
