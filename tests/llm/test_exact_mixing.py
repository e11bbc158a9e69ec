"""Exact duplicates and mixing on odd rows."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from leaderstream.llm import exact, minhash, mixing

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, rows):
    """From ``(doc_id, text, source)``."""
    return spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in rows], DOCS)


def test_groups_of_odd_rows(spark):
    long = "word " * 200_000
    frame = docs(spark, [(1, None, "a"), (2, "", "a"), (3, long, "a"), (4, long + "x", "a"), (5, long, None), (5, long, "b"), (None, "y", "a"), (6, "y", None), (7, "Y", "a")])
    rows = exact.exact_groups(frame).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in rows) == Counter(
        [(1, 2, 2), (2, 2, 2), (3, 5, 3), (5, 5, 3), (5, 5, 3), (4, 4, 1), (None, 6, 2), (6, 6, 2), (7, 7, 1)]
    )
    assert Counter(r["doc_id"] for r in rows if r["kept"]) == Counter([2, 4, 5, 6, 7])


def test_smallest_stays_and_normal_form(spark):
    frame = docs(spark, [(1, "A b", "a"), (2, "a B", "a"), (3, "c", "a")])
    rows = exact.exact_groups(frame, normal=lambda t: F.lower(exact.unchanged(t)), keep="smallest").collect()
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in rows} == {(1, 1, True), (2, 1, False), (3, 3, True)}


def test_hot_text_is_sliced(spark):
    """A text with half of the rows is spread over slices and still one group."""
    frame = docs(spark, [(n, "same" if n % 2 else f"text {n}", "a") for n in range(400)])
    rows = exact.exact_groups(frame).collect()
    assert sum(r["kept"] for r in rows) == 201
    assert {(r["keep_id"], r["group_size"]) for r in rows if r["doc_id"] % 2} == {(399, 200)}


def test_clashing_columns_and_empty_table(spark):
    frame = docs(spark, [(1, "a", "s"), (2, "a", "s")]).withColumns({c: F.lit(9) for c in ("_norm", "_hash", "kept", "group_size", "_slice")})
    rows = exact.exact_groups(frame)
    assert {(r["doc_id"], r["kept"], r["group_size"], r["_norm"]) for r in rows.collect()} == {(1, False, 2, 9), (2, True, 2, 9)}
    assert exact.exact_groups(frame.limit(0)).count() == 0
    assert mixing.mixed(frame.limit(0)).count() == 0


def test_mixing_of_odd_rows(spark):
    rows = [(n, "w " * (n % 7 + 1), ["a", "b", None][n % 3]) for n in range(300)]
    rows += [(900, None, "empty"), (901, "", "empty"), (None, "x y", "a"), (5, "w " * 6, "c"), (5, "w " * 6, "c")]
    frame = docs(spark, rows).withColumns({"_key": F.lit(1), "size": F.lit("x"), "_rate": F.lit(1), "copies": F.lit(0)})
    first = mixing.mixed(frame).collect()
    assert len(first) == len(rows)
    by = {}
    for r in first:
        assert 0 <= r["copies"] <= 3
        size, target, taken = by.get(r["source"], (r["source_size"], r["target"], 0))
        by[r["source"]] = (size, target, taken + r["copies"] * r["size"])
    assert by["empty"][:2] == (0, 0.0)
    assert sum(t for _, t, _ in by.values()) == pytest.approx(sum(s for s, _, _ in by.values()))
    for size, target, taken in by.values():
        assert target <= 3 * size + 1e-9
        assert abs(taken - target) <= 8
    again = mixing.mixed(frame.repartition(7)).collect()
    count = lambda rows: Counter((r["doc_id"], r["text"], r["copies"]) for r in rows)
    assert count(first) == count(again)


def test_targets_by_hand(spark):
    """Sizes 10, 100, 100 and weights 1, 2, 3: the first stops at 30, the others share 180 by 2 and 3."""
    frame = docs(spark, [(1, "w " * 10, "a"), (2, "w " * 100, "b"), (3, "w " * 100, "c")])
    targets = {r["source"]: r["target"] for r in mixing.mixed(frame).collect()}
    assert targets == pytest.approx({"a": 30, "b": 72, "c": 108})


def test_mix_repeats_rows(spark):
    frame = docs(spark, [(1, "w " * 10, "a"), (2, "w " * 100, "b"), (3, "w " * 100, "c")])
    out = mixing.mix(frame)
    assert out.columns == frame.columns
    assert Counter(r["doc_id"] for r in out.collect())[1] == 3


def rate(m, size):
    return math.exp(min(m * size, math.log(mixing.MOST)))


def dual_by_halving(sizes, target):
    """The multiplier whose rates give the target, by halving; rates are held at ``MOST``."""
    low, high = mixing.LEAST_MULTIPLIER, mixing.MOST_MULTIPLIER
    for _ in range(200):
        middle = (low + high) / 2
        words = sum(s * rate(middle, s) for s in sizes)
        low, high = (middle, high) if words < target else (low, middle)
    return high


def test_multipliers_by_halving(spark):
    draw = random.Random(7)
    sizes = {f"s{k}": [draw.choice([0, 1, 2, 50, 500, 4000]) + draw.randrange(9) for _ in range(60)] for k in range(8)}
    share = [0.01, 0.2, 0.7, 1.0, 1.3, 2.0, 2.9, 3.0]
    targets = [(k, sum(v), x * sum(v)) for (k, v), x in zip(sizes.items(), share, strict=True)]
    cells = [(k, s, n) for k, v in sizes.items() for s, n in Counter(v).items()]
    found = mixing.multipliers(
        spark.createDataFrame(cells, "_c_key string, _c_size long, _n long"),
        spark.createDataFrame(targets, "_c_key string, source_size long, target double"),
    )
    for r in found.collect():
        if r.target < 3 * r.source_size:
            words = sum(s * rate(r._m, s) for s in sizes[r._c_key])
            assert words == pytest.approx(r.target, rel=1e-7)
            assert r._m == pytest.approx(dual_by_halving(sizes[r._c_key], r.target), abs=1e-9)
        else:
            assert math.exp(r._m) >= mixing.MOST - 1e-9


def test_larger_documents_are_tilted_more(spark):
    """Rates depend on sizes: a source with too many words gives up its long documents first."""
    rows = [(n, "w " * (10 if n % 2 else 400), "much") for n in range(200)] + [(1000 + n, "w " * 5, "few") for n in range(100)]
    taken = mixing.mixed(docs(spark, rows)).where("source = 'much'").groupBy("size").agg(F.avg("copies").alias("rate"))
    found = {r["size"]: r.rate for r in taken.collect()}
    assert found[400] < 1 <= found[10] <= mixing.MOST


def test_words_come_near_their_targets(spark):
    large = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    taken = F.sum(F.col("copies") * F.col("size")).alias("taken")
    for r in mixing.mixed(large).groupBy("source", "target").agg(taken).collect():
        assert abs(r.taken - r.target) <= 0.005 * r.target


def test_mixing_of_text_ids_and_reruns(spark):
    rows = [(f"d{n}" if n % 9 else None, "w " * (n % 40), ["x", "y"][n % 2]) for n in range(200)]
    frame = spark.createDataFrame(rows, "doc_id string, text string, source string")
    key = lambda f: Counter((r.doc_id, r["size"], r.source, r.copies) for r in mixing.mixed(f).collect())
    assert key(frame) == key(frame.repartition(7))


def test_one_of_each_group_whatever_the_ids(spark):
    texts = {c: " ".join(f"{c}{n}" for n in range(60)) for c in "abcd"}
    rows = [(3, texts["a"]), (3, texts["b"]), (7, texts["a"] + " x"), (2, texts["b"] + " y"), (None, texts["c"]), (None, texts["c"] + " z")]
    rows += [(11, texts["d"]), (11, texts["d"]), (12, None), (None, None), (13, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_row": F.lit(1), "_member": F.lit("x")})
    left = minhash.one_of_each(frame)
    assert left.columns == frame.columns
    found = Counter((r.doc_id, (r.text or "")[:1], len(r.text or "")) for r in left.collect())
    assert found == Counter(
        [(3, "a", len(texts["a"])), (2, "b", len(texts["b"]) + 2), (11, "d", len(texts["d"])), (12, "", 0), (None, "", 0), (13, "", 0)]
        + [next((None, "c", len(t)) for t in (texts["c"], texts["c"] + " z") if (None, "c", len(t)) in found)]
    )
    assert minhash.one_of_each(frame.limit(0)).collect() == []
