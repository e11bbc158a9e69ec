"""Near duplicates of texts and vectors, and components, against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leaderstream.llm import embeddings, minhash
from leaderstream.llm.components import components
from leaderstream.llm.shingles import shingle_sets


class Union:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_components_of_chains_hubs_and_repeats(spark):
    random.seed(3)
    links = [(n, n + 1) for n in range(100, 160)] + [(500, n) for n in range(501, 580)] + [(7, 7), (1, 2), (2, 1), (None, 4)]
    links += [(random.randrange(1000, 1100), random.randrange(1000, 1100)) for _ in range(70)]
    random.shuffle(links)
    union = Union({x for pair in links for x in pair if x is not None})
    for a, b in links:
        if None not in (a, b):
            union.join(a, b)
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "x bigint, y bigint")).collect()}
    assert found == {n: union.find(n) for n in union.up if union.find(n) != n}


def words(text):
    import re

    lower = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def shingles(text, width):
    w = words(text or "")
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def test_shingle_sets_count_as_python_does():
    texts = ["", None, "a", "A a a a a a", "one two\tthree\x0bfour five", "é É x y z", "  lead trail  ", "a b c d e " * 9]
    hashes, begins = shingle_sets(pa.array(texts), 5)
    assert np.diff(begins).tolist() == [len(shingles(t, 5)) for t in texts]
    assert len(shingle_sets(pa.array([], pa.string()), 5)[0]) == 0
    sliced = pa.array(["x y", *texts]).slice(1)
    assert shingle_sets(sliced, 5)[0].tolist() == hashes.tolist()


@pytest.fixture(scope="module")
def near_texts():
    """Groups of copies with a few changes each, chains, exact copies, odd rows."""
    random.seed(5)
    vocabulary = [f"w{n}" for n in range(3000)]
    rows, number = [], 0
    for _ in range(40):
        base = [random.choice(vocabulary) for _ in range(random.randrange(30, 200))]
        for _ in range(random.randrange(1, 12)):
            for _ in range(random.randrange(0, 3)):
                base = list(base) if random.random() < 0.5 else base
                base[random.randrange(len(base))] = random.choice(vocabulary)
            rows.append((number, " ".join(base)))
            number += 1
    rows += [(number, ""), (number + 1, None), (number + 2, "two words"), (number + 3, "Two  WORDS"), (number + 4, "w " * 100_000)]
    return rows


@pytest.mark.parametrize("width", [4, 5])
def test_near_groups(spark, near_texts, width):
    frame = spark.createDataFrame(near_texts, "doc_id bigint, text string").withColumns({"node": F.lit(1), "bands": F.lit("x")})
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_groups(frame, width).collect()}
    sets = {d: shingles(t, width) for d, t in near_texts}
    union = Union(sets)
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                union.join(a, b)
    assert found == {d: (len(s), union.find(d), union.find(d) == d) for d, s in sets.items()}


def test_near_groups_of_odd_tables(spark):
    schema = "doc_id bigint, text string"
    assert minhash.near_groups(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, "z y x w v u")]
    found = sorted((str(r[0]), str(r[2]), r[3]) for r in minhash.near_groups(spark.createDataFrame(rows, schema)).collect())
    assert found == [("3", "3", True), ("3", "3", True), ("None", "3", False), ("None", "None", True)]


def test_vector_groups(spark):
    random_ = np.random.default_rng(4)
    rows, number = [], 0
    for _ in range(30):
        base = random_.standard_normal(16)
        for _ in range(int(random_.integers(1, 9))):
            noise = random_.standard_normal(16) * 0.09
            rows.append((number, [float(x) for x in base + noise], int(random_.integers(0, 2))))
            number += 1
    rows += [(number + k, rows[0][1], rows[0][2]) for k in range(3)]
    number += 3
    odd = [None, [], [0.0] * 16, [None] * 16, [float("nan")] * 16, [float("inf")] * 16, [1.0] * 3, [2.0] * 3, [1e-300] * 16, [1e300] * 16]
    rows += [(number + k, v, 0) for k, v in enumerate(odd)]
    number += len(odd)
    rows += [(number, [1.0] * 16, None), (number + 1, [-1.0] * 16, 0)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumn("members", F.lit(1))
    found = {r[0]: tuple(r[1:]) for r in embeddings.vector_groups(frame, 0.98).collect()}

    def unit(v):
        if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        x = np.array(v) / max(map(abs, v))
        return x / np.sqrt(x @ x)

    units = {d: (unit(v), label) for d, v, label in rows}
    union, links = Union(units), dict.fromkeys(units, 0)
    for a, (x, la) in units.items():
        for b, (y, lb) in units.items():
            if a < b and x is not None and y is not None and la is not None and la == lb and len(x) == len(y) and x @ y >= 0.98:
                links[a] += 1
                links[b] += 1
                union.join(a, b)
    assert sum(links.values()) > 50
    assert found == {d: (links[d], union.find(d), union.find(d) == d) for d in units}
    assert embeddings.vector_groups(frame.limit(0)).count() == 0


def test_tiles_of_a_large_bucket(spark, monkeypatch):
    """All pairs of a bucket are counted once also where it is cut into tiles."""
    random_ = np.random.default_rng(6)
    base = random_.standard_normal(8)
    rows = [(n, [float(x) for x in base + 0.01 * random_.standard_normal(8)], 1) for n in range(60)]
    monkeypatch.setattr(embeddings, "TILE", 9)
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    found = embeddings.vector_groups(frame, 0.98).collect()
    assert {(r["n_links"], r["component_id"]) for r in found} == {(59, 0)}
