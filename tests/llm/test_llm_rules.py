"""License scan and quality rules against plain Python."""

import math
import re
from collections import Counter

import pyarrow as pa
from llm_fixtures import WORDS, ascii_lower, rows, table
from pyspark.sql import functions as F

from evalspark.llm import filters
from evalspark.llm import quality_lm as ql
from evalspark.llm import quality_rules as qr
from evalspark.llm.licenses import PHRASES, scan_licenses

LICENSE_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def _key(row):
    return tuple((v is not None, v) for v in row)


def test_license_places(spark):
    docs = table(spark)
    got = sorted((tuple(r)[:7] for r in scan_licenses(docs).drop("matches").collect()), key=_key)
    expected = []
    for doc_id, text, *_ in rows():
        words = LICENSE_WORD.findall(ascii_lower(text))
        found = [
            (i, p) for p in PHRASES for i in range(len(words)) if tuple(words[i : i + len(p.words)]) == p.words
        ]
        base = [i for i, p in found if p.base]
        expected.append(
            (
                doc_id,
                len(words),
                len(base),
                min(base, default=None),
                max(base, default=None),
                ",".join(sorted({p.label for _, p in found if p.base})),
                ",".join(sorted({p.label for _, p in found})),
            )
        )
    assert got == sorted(expected, key=_key)
    assert sum(r[2] for r in expected) >= 3


def test_license_score(spark):
    score = {r["doc_id"]: r["score"] for r in scan_licenses(table(spark)).where("doc_id < 9").collect()}
    assert score[5] == score[6] == 1.0 and score[0] == score[3] == 0.0
    assert 0 < score[7] < 1, "an altered phrase"


def test_license_empty(spark):
    assert scan_licenses(table(spark, data=[])).count() == 0


def test_rule_counts(spark):
    got = sorted((tuple(r) for r in qr.quality_rules(table(spark), keep=("doc_id", "lang")).drop("lang").collect()), key=_key)
    expected = []
    for doc_id, text, *_ in rows():
        text = text or ""
        words = WORDS.findall(text)
        windows = Counter(zip(words, words[1:], words[2:]))
        repeated = {
            i + k for i in range(len(words) - 2) for k in range(3) if windows[tuple(words[i : i + 3])] > 1
        }
        lines = [x for x in text.split("\n") if WORDS.search(x)]
        expected.append(
            (
                doc_id,
                len(words),
                sum(map(len, words)),
                sum(text.count(c) for c in "#*$%&|<>"),
                len(lines) - len(set(lines)),
                len(repeated),
                len(words) < 50 or 100 * len(repeated) > 50 * len(words),
            )
        )
    assert [g[:7] for g in got] == sorted(expected, key=_key)
    assert all(not g[7] for g in got if g[6])


def test_rule_distances(spark):
    """Both distances against a direct computation, and the verdict that follows from them."""
    counts = [r.asDict() for r in qr.text_counts(table(spark)).collect()]
    sums = {}
    for r in counts:
        for c in ("char_counts", "word_counts"):
            old = sums.setdefault((r["lang"], c), [0.0] * len(r[c]))
            sums[r["lang"], c] = [a + b for a, b in zip(old, r[c])]

    def distance(p, q):
        p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
        kl = lambda a, b: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b) if x)
        return math.sqrt((kl(p, q) + kl(q, p)) / 2)

    expected = Counter()
    for r in counts:
        char = distance(r["char_counts"], sums[r["lang"], "char_counts"]) if r["word_chars"] >= 200 else None
        word = distance(r["word_counts"], sums[r["lang"], "word_counts"]) if r["n_words"] >= 50 else None
        expected[r["doc_id"], char and round(char, 6), word and round(word, 6)] += 1
        assert sum(r["char_counts"]) == r["word_chars"] and sum(r["word_counts"]) == r["n_words"]
    got = qr.quality_rules(table(spark)).collect()
    near = lambda x: x and round(x, 6)
    assert Counter((r["doc_id"], near(r["char_distance"]), near(r["word_distance"])) for r in got) == expected
    for r in got:
        far = (r["char_distance"] or 0) > qr.MAX_CHAR_DISTANCE or (r["word_distance"] or 0) > qr.MAX_WORD_DISTANCE
        assert r["kept"] == (not r["base_failed"] and not far)


def test_rules_empty(spark):
    assert qr.quality_rules(table(spark, data=[])).count() == 0


def test_the_quality_model_counts_every_trusted_document(spark, monkeypatch):
    n = 24_000
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('text ', id) AS text", "'en' AS lang")
    labels = spark.range(n).selectExpr("id AS doc_id", "int(id % 12 > 0) AS quality", "0 AS toxic")
    seen = []
    monkeypatch.setattr(ql, "train", lambda *texts: seen.extend(t.select("text").collect() for t in texts))
    ql.Judge(docs, labels)
    counted = Counter(seen[0]) - Counter(seen[1] if seen[1:] else [])
    assert counted == Counter(docs.where("doc_id % 12 > 0").select("text").collect()) and counted.total() == 22_000


def test_the_quality_model_is_exact_whatever_bits_ids_share(spark, monkeypatch):
    """Ids of 64 bits: nearly every document may be trusted; null and repeated ids."""
    rows = [(i % 300 if i % 7 else None, " ".join(f"word{(i * j) % 97}" for j in range(9))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    trusted = spark.range(0, 300, 3).withColumnRenamed("id", "doc_id")
    monkeypatch.setattr(filters, "FILTER_BITS", 64)
    maybe, others = ql.maybe_trusted(docs, trusted)
    assert maybe.count() > 2 * docs.where("doc_id % 3 = 0").count() and others.count() > 0
    found = ql.train(maybe, others)
    assert (found.log_p == ql.train(docs.join(trusted, "doc_id", "left_semi")).log_p).all()


def test_counts_of_a_task_are_added_over_its_batches(spark):
    batches = [pa.RecordBatch.from_pydict({"text": pa.array(x, pa.string())}) for x in (["ab", None], [], ["ab", "ba"])]
    found = [b.to_pydict() for b in ql._count(iter(batches))]
    assert len(found) == 1
    assert sorted(found[0]["c"]) == [1, 1, 2, 2]
