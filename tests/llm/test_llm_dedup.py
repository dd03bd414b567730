"""The four deduplications and connected components against brute force."""

import numpy as np
import pytest
import xxhash
from llm_fixtures import WORDS, ascii_lower, groups, rows, table

from evalspark.llm import embedding_dedup as ed
from evalspark.llm import line_dedup as ld
from evalspark.llm import simhash as sh
from evalspark.llm import substring_dedup as sd
from evalspark.llm.components import components, forest


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """One file, so that its order is that of ``rows``."""
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    table(spark).coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(7, 500), (500, 3), (9, 9), (None, 4), (11, 12)]
    hub = [(1000 + i, 1000) for i in range(1, 300)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain + hub, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {1000 + i: 1000 for i in range(300)} | {
        3: 3, 7: 3, 500: 3, 11: 11, 12: 11
    }
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest():
    r = np.random.default_rng(1)
    u, v = r.integers(0, 80, 60), r.integers(0, 80, 60)
    expected = groups(80, list(zip(u, v)))
    a, b = forest(u, v)
    assert {x: y for x, y in zip(a, b)} == {i: g for i, g in enumerate(expected) if i != g}


def _fingerprint(text, width):
    words = WORDS.findall(ascii_lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("radius", [2, 12])
def test_simhash(spark, stored, radius):
    data = [r for r in rows() if r[0] is not None]
    marks = [_fingerprint(r[1], 3) for r in data]
    pairs = [
        (i, j) for i in range(len(data)) for j in range(i) if (marks[i] ^ marks[j]).bit_count() <= radius
    ]
    member = groups(len(data), pairs)
    least = {g: min(data[i][0] for i in range(len(data)) if member[i] == g) for g in member}
    expected = sorted((r[0], f"{m:016x}", least[g]) for r, m, g in zip(data, marks, member))
    got = sh.simhash_components(stored.where("doc_id IS NOT NULL"), 3, radius)
    got = got.select("doc_id", sh.as_hex(got["fp"]).alias("f"), "component_id").collect()
    assert sorted(map(tuple, got)) == expected
    assert len(pairs) > 10


def test_simhash_shards(spark):
    """Many shards find every pair that a direct comparison finds."""
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 63, 1500).astype(np.uint64)
    flips = [base ^ (np.uint64(1) << r.integers(0, 64, len(base)).astype(np.uint64)) for _ in range(2)]
    marks = np.unique(np.concatenate([base, flips[0], flips[0] ^ flips[1] ^ base]))
    links = [(i, j) for i, j in zip(*np.nonzero(np.bitwise_count(marks[:, None] ^ marks[None]) <= 2)) if i < j]
    expected = groups(len(marks), links)
    fps = spark.createDataFrame([(int(x),) for x in marks.view(np.int64)], "fp long")
    found = sh.fingerprint_links(fps, 2, sample_rows=200, shard_rows=64).collect()
    at = {int(x): i for i, x in enumerate(marks.view(np.int64))}
    assert groups(len(marks), [(at[e["a"]], at[e["b"]]) for e in found]) == expected


def test_near_duplicates_keep_the_first(spark, stored):
    kept = sh.drop_near_duplicates(stored)
    assert kept.columns == stored.columns
    ids = [r["doc_id"] for r in kept.collect()]
    # Documents 9 to 16 are different, 17 to 20 copy the second of them; row 10 comes twice.
    assert set(range(9, 17)) <= set(ids) and not {17, 18, 19, 20} & set(ids) and ids.count(10) == 1


def test_lines(spark, stored):
    seen, kept = [], []
    for _, text, *_ in rows():
        left = []
        for line in (text or "").split("\n"):
            words = frozenset(ascii_lower(line).encode().split())
            if len(words) < ld.MIN_WORDS:
                left.append(line)
                continue
            if not any(9 * len(words & w) >= 4 * (len(words) + len(w)) for w in seen):
                left.append(line)
            seen.append(words)
        kept.append("\n".join(left) if text is not None else None)
    got = ld.dedup_lines(stored).collect()
    order = sorted(((r["doc_id"] is not None, r["doc_id"], r["text"] is not None, r["text"]) for r in got))
    assert order == sorted((r[0] is not None, r[0], t is not None, t) for r, t in zip(rows(), kept))
    assert sum(r["n_removed"] for r in got) > 30


def test_lines_that_the_nearest_leaves_open(spark, tmp_path):
    """The nearest line by parity bits is not similar, a further one is."""
    import random

    r = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    data = []
    for i in range(150):
        base = r.sample(words, 20)
        data.append((2 * i, " ".join(base)))
        other = base[:]
        for k in r.sample(range(20), r.randint(1, 4)):
            other[k] = r.choice(words)
        data.append((2 * i + 1, " ".join(other)))
    data = [(d, f"{t}\n{data[r.randrange(d + 1)][1].replace('w1', 'v1', 2)}") for d, t in data]
    spark.createDataFrame(data, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    seen, kept = [], {}
    for doc_id, text in data:
        left = []
        for line in text.split("\n"):
            w = frozenset(line.split())
            if not any(9 * len(w & x) >= 4 * (len(w) + len(x)) for x in seen):
                left.append(line)
            seen.append(w)
        kept[doc_id] = "\n".join(left)
    got = ld.dedup_lines(spark.read.parquet(str(tmp_path / "d")))
    assert {x["doc_id"]: x["text"] for x in got.collect()} == kept


def test_passages(spark, stored):
    gear = sd._GEAR.tolist()
    seen, expected = set(), []
    for row in rows():
        data = (row[1] or "").encode()
        places, h = [], 0
        for i, byte in enumerate(data):
            h = (h << 1) + gear[byte] & 0xFFFFFFFF
            if h >> 27 == 0 and sd._WINDOW <= i + 1 < len(data) and data[i + 1] & 0xC0 != 0x80:
                places.append(i + 1)
        places = [p for k, p in enumerate(places) if not k or p - places[k - 1] >= sd.MIN_GAP]
        ends = [0]
        for end in [*places, len(data)]:
            while end - ends[-1] > sd.MAX_CHUNK:
                at = ends[-1] + sd.MAX_CHUNK
                while data[at] & 0xC0 == 0x80:
                    at -= 1
                ends.append(at)
            if end > ends[-1]:
                ends.append(end)
        runs = []
        for i, j in zip(ends, ends[1:]):
            if data[i:j] in seen:
                if runs and runs[-1][1] == i:
                    runs[-1][1] = j
                else:
                    runs.append([i, j])
            seen.add(data[i:j])
        runs = [x for x in runs if x[1] - x[0] >= sd.MIN_RUN]
        left, at = b"", 0
        for i, j in runs:
            left, at = left + data[at:i], j
        expected.append((row[0] is not None, row[0], (left + data[at:]).decode(), sum(j - i for i, j in runs)))
    got = sd.dedup_substrings(stored).collect()
    assert sorted((r[0] is not None, r["doc_id"], r["text"] or "", r["n_removed"]) for r in got) == sorted(expected)
    removed = {r["doc_id"]: r["n_removed"] for r in got}
    # The shared passage of documents 33 to 37 stays once.
    assert removed[33] == 0 and all(removed[i] > 200 for i in range(34, 38))


def _vectors():
    r = np.random.default_rng(2)
    base = r.normal(size=(300, 16))
    near = base[:120] + 0.15 * r.normal(size=(120, 16))
    cluster = base[:1] + 0.02 * r.normal(size=(150, 16))
    made = [list(map(float, v)) for v in np.concatenate([base, near, cluster, base[5:9] * 7])]
    made += [made[3]] * 20
    odd = [None, [0.0] * 16, [1.0, None] + [0.0] * 14, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0] * 3, []]
    data = list(enumerate([*made, *odd]))
    return data, len(made)


def test_vectors(spark):
    data, n = _vectors()
    x = np.array([v for _, v in data[:n]])
    x /= np.linalg.norm(x, axis=1)[:, None]
    linked = x @ x.T >= 0.9
    expected_links = linked.sum(axis=1) - 1
    got = {r["vec_id"]: r for r in ed.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()}
    links = np.array([got[i]["n_links"] for i in range(n)])
    assert (links <= expected_links).all()
    assert links.sum() >= 0.99 * expected_links.sum(), "recall"
    member = groups(n, [(i, j) for i, j in zip(*np.nonzero(linked)) if j < i])
    assert np.mean([got[i]["component_id"] == member[i] for i in range(n)]) > 0.99
    for i in range(n, len(data)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_vector_blocks(spark, monkeypatch):
    """Cells that are split into blocks give the same links."""
    data, _ = _vectors()
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    whole = sorted(map(tuple, ed.near_vectors(vectors).collect()))
    monkeypatch.setattr(ed, "BLOCK_ROWS", 20)
    assert sorted(map(tuple, ed.near_vectors(vectors).collect())) == whole


def test_empty(spark):
    empty = table(spark, data=[])
    assert sh.simhash_components(empty).count() == 0
    assert ld.dedup_lines(empty).count() == 0
    assert sd.dedup_substrings(empty).count() == 0
    assert ed.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
