import random

import pytest
from pyspark.sql import functions as F

from leaderstream.operators import upsert

SPLIT = {"hot_key_rows": 3}


def key(row):
    return (row[0], row[1] if row[0].startswith("individual") else "", row[2])


def literal_fold(rows):
    """Batch by batch: drop the batch's keys, append the batch."""
    state = []
    for batch in sorted({r[4] for r in rows}):
        new = [r for r in rows if r[4] == batch]
        keys = {key(r) for r in new if None not in key(r)}
        state = [r for r in state if key(r) not in keys] + new
    return sorted(r[5] for r in state)


def some_rows(seed, n=300):
    rnd = random.Random(seed)
    return [
        (
            rnd.choice(["individual_era", "individual_whip", "team_whip"]),
            rnd.choice([None, "A", "A", "A", "B", "C", "D", "E"]),
            rnd.choice(["T1", "T1", "T2", None]),
            str(rnd.random()),
            rnd.randrange(6),
            i,
        )
        for i in range(n)
    ]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("balance", [{}, SPLIT])
def test_closed_form_equals_fold(stats, seed, balance):
    rows = some_rows(seed)
    got = upsert.resolve_batches(stats(rows), **balance)
    assert sorted(r.offset for r in got.collect()) == literal_fold(rows)


def test_apply_batch_equals_fold(stats):
    rows = some_rows(7, 200)
    state = stats([r for r in rows if r[4] == 0])
    for batch in range(1, 3):
        state = upsert.apply_batch(state, stats([r for r in rows if r[4] == batch]))
    assert sorted(r.offset for r in state.collect()) == literal_fold([r for r in rows if r[4] < 3])


def test_one_key_with_most_rows(stats):
    rows = [("individual_era", "A", "T", "1", i % 2, i) for i in range(500)] + [
        ("individual_era", f"P{i}", "T", "1", 0, 1000 + i) for i in range(20)
    ]
    got = sorted(r.offset for r in upsert.resolve_batches(stats(rows), hot_key_rows=10).collect())
    assert got == literal_fold(rows)


def test_latest_is_one_row_per_key(stats):
    rows = some_rows(1)
    got = upsert.upsert_latest(stats(rows), ("batch_id", "offset")).collect()
    newest = {}
    for r in rows:
        if None not in key(r):
            newest[key(r)] = max(newest.get(key(r), (-1, -1)), (r[4], r[5]))
    assert sorted((r.batch_id, r.offset) for r in got) == sorted(newest.values())


def test_salt_is_shuffled_and_facts_are_shared(spark, tmp_path, stats):
    stats(some_rows(2)).write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    before = {n: spark.conf.get(n) for n in names}
    try:
        spark.conf.set(names[0], "-1")
        spark.conf.set(names[1], "false")
        plan = upsert.resolve_batches(log)._jdf.queryExecution().executedPlan().toString()
        (join,) = [line for line in plan.split("\n") if "SortMergeJoin" in line]
        assert join.count("_salt") == 2
        shuffles = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
        assert ["ReusedExchange" in line for line in shuffles] == [False, False, True]
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_a_small_batch_leaves_the_state_where_it_is(spark, tmp_path, stats):
    stats(some_rows(2)).write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    frame = upsert.anti_join_keys(log.where("batch_id < 4"), log.where("batch_id = 4"))
    assert frame.count() > 0
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_many_hot_keys_spread(spark, stats):
    """More hot keys than any fixed number of them: none stays in one task."""
    rows = [("individual_era", f"P{i % 60}", "T", "1", 0, i) for i in range(6000)]
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    before = {n: spark.conf.get(n) for n in names}
    try:
        spark.conf.set(names[0], "-1")
        spark.conf.set(names[1], "false")
        state = upsert.resolve_batches(stats(rows), hot_key_rows=50)
        placed = state.groupBy("Name", F.spark_partition_id().alias("task")).count().collect()
        tasks = state.groupBy(F.spark_partition_id()).count().collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert sum(r["count"] for r in placed) == 6000
    assert max(r["count"] for r in placed) < 60
    assert max(r["count"] for r in tasks) < 4 * 6000 / len(tasks)


def test_rows_of_a_hot_key_spread(spark, stats):
    rows = [("individual_era", "A", "T", "1", 0, i) for i in range(3000)]
    rows += [("individual_era", None, "T", "1", 0, 3000 + i) for i in range(3000)]
    rows += [("individual_era", f"P{i}", "T", "1", 0, 6000 + i) for i in range(300)]
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    before = {n: spark.conf.get(n) for n in names}
    try:
        spark.conf.set(names[0], "-1")
        spark.conf.set(names[1], "false")
        state = upsert.resolve_batches(stats(rows), hot_key_rows=1000)
        placed = state.groupBy("Name", F.spark_partition_id().alias("task")).count().where("count > 1").collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    for name in ("A", None):
        per_task = [r["count"] for r in placed if r.Name == name]
        assert sum(per_task) == 3000 and len(per_task) == 4 and max(per_task) < 900
