import os

import pytest
from pyspark.sql.datasource import EqualTo, In
from test_streaming import rows_of, run, wanted, write_batches
from test_upsert import literal_fold, some_rows

from leaderstream import Board
from leaderstream.sources import board_tables, messages
from leaderstream.streaming.bucket_log import BucketLog


def offsets(frame):
    return sorted(r.offset for r in frame.collect())


@pytest.mark.parametrize("compact_at", [set(range(6)), {3}])
def test_state_equals_fold(spark, tmp_path, stats, compact_at):
    rows = some_rows(31, 240)
    log = BucketLog(spark, str(tmp_path), buckets=3)
    assert log.state().collect() == [] and log.compact() is None and log.vacuum(0) == []
    for batch in range(6):
        log.append(stats([r for r in rows if r[4] == batch]), batch)
        if batch in compact_at:
            log.compact(full=batch == 4)
        assert offsets(log.state()) == literal_fold([r for r in rows if r[4] <= batch])
    whip = {r[5] for r in rows if r[0] == "team_whip"}
    assert offsets(log.state("team_whip")) == sorted(whip & set(literal_fold(rows)))
    log.vacuum(retention_seconds=0)
    assert offsets(log.state()) == literal_fold(rows)


def test_only_touched_buckets_are_rewritten(spark, tmp_path, stats):
    first = [("team_whip", None, f"T{n}", "1", 0, n) for n in range(64)]
    log = BucketLog(spark, str(tmp_path), buckets=8)
    log.append(stats(first), 0)
    for epoch in range(1, 8):
        log.append(stats([("team_whip", None, "T7", str(epoch), epoch, 100 * epoch + k) for k in range(4)]), epoch)
        log.compact()
    live = log._live().collect()
    touched = {r.bucket for r in live if r.run != "e0"}
    assert len(touched) == 1 and len({r.bucket for r in live}) == 8
    merged = [f for f in os.listdir(tmp_path / "runs") if f.startswith("run=m")]
    for folder in merged:
        assert {f for f in os.listdir(tmp_path / "runs" / folder / "table_name=team_whip") if "=" in f} == {
            f"bucket={b}" for b in touched
        }
    assert offsets(log.state()) == sorted([n for n in range(64) if n != 7] + [700 + k for k in range(4)])


def test_reads_follow_the_state_and_writes_the_batch(spark, tmp_path, stats):
    """Ten batches over the same keys: what is read stays in proportion to the state, what is written to the batches."""
    log = BucketLog(spark, str(tmp_path), buckets=2)
    rewritten, rows_of_all = 0, 0
    for epoch in range(10):
        batch = [("team_whip", None, f"T{(epoch * 7 + n) % 24}", str(n), epoch, epoch * 100 + n) for n in range(10)]
        rows_of_all += len(batch)
        log.append(stats(batch), epoch)
        if log.compact() is not None:
            rewritten += log._live().where(f"run = 'm{log.versions()[-1]}'").groupBy().sum("rows").first()[0]
    state = log.state().count()
    assert state == 24 and log.read().count() <= 3 * state
    runs = log._live().groupBy("bucket").count().collect()
    assert max(r["count"] for r in runs) <= 4
    assert rewritten <= rows_of_all * 5


def test_settled_buckets_are_read_as_they_are(spark, tmp_path, stats):
    log = BucketLog(spark, str(tmp_path), buckets=4)
    log.append(stats([("team_whip", None, f"T{n}", "1", 0, n) for n in range(40)]), 0)
    assert log.state().count() == 40
    contested = log.state()._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" not in contested  # no salt, no shuffle by key: nothing is contested
    log.append(stats([("team_whip", None, "T1", "2", 1, 100)]), 1)
    assert log.compact(full=True) == 1
    assert log._live().groupBy("bucket").count().where("count > 1").count() == 0
    assert offsets(log.state()) == sorted([n for n in range(40) if n != 1] + [100])


def test_an_epoch_counts_once(spark, tmp_path, stats):
    rows = some_rows(32, 120)
    log = BucketLog(spark, str(tmp_path), buckets=2)
    for batch in range(4):
        log.append(stats([r for r in rows if r[4] == batch]), batch)
        log.compact(full=True)
    # Replayed after its merge: back to the version before it.
    log.append(stats([r for r in rows if r[4] == 3]), 3)
    assert offsets(log.state()) == literal_fold([r for r in rows if r[4] < 4])
    # An unfinished version does not count.
    os.remove(tmp_path / "live" / f"version={log.versions()[-1]}" / "_SUCCESS")
    assert offsets(log.state()) == literal_fold([r for r in rows if r[4] < 3])


def test_one_entity(spark, tmp_path, stats):
    rows = some_rows(33, 200)
    log = BucketLog(spark, str(tmp_path), buckets=4)
    for batch in range(6):
        log.append(stats([r for r in rows if r[4] == batch]), batch)
    kept = set(literal_fold(rows))
    found = log.entity("T1", "A")
    assert offsets(found) == sorted(r[5] for r in rows if r[5] in kept and r[1:3] == ("A", "T1") and r[0] != "team_whip")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(Team,T1)" in plan and "EqualTo(Name,A)" in plan
    assert log.entity("nobody").collect() == []
    # A log that exists keeps its number of buckets.
    assert BucketLog(spark, str(tmp_path), buckets=9).buckets == 4


def test_a_view_follows_the_log(spark, tmp_path, stats):
    rows = some_rows(35, 200)
    board = Board(spark, str(tmp_path), buckets=3)
    board.register_source("tables_of_test")
    assert spark.table("tables_of_test").collect() == []
    for batch in range(6):
        board.log.append(stats([r for r in rows if r[4] == batch]), batch)
        if batch == 3:
            board.log.compact(full=True)
        kept = set(literal_fold([r for r in rows if r[4] <= batch]))
        assert offsets(spark.table("tables_of_test")) == sorted(kept)
        one = spark.sql("SELECT * FROM tables_of_test WHERE table_name = 'team_whip' AND Team = 'T1'")
        assert offsets(one) == sorted(r[5] for r in rows if r[5] in kept and r[0] == "team_whip" and r[2] == "T1")
    plain = spark.table("tables_of_test").orderBy("offset").collect()
    assert plain == board.stats().orderBy("offset").collect()
    with pytest.raises(ValueError):
        Board(spark, str(tmp_path / "other")).register_source()


def test_conditions_on_the_name_choose_folders(spark, tmp_path, stats):
    log = BucketLog(spark, str(tmp_path), buckets=2)
    log.append(stats(some_rows(36, 100)), 0)
    reader = board_tables.BoardReader(str(tmp_path))
    assert list(reader.pushFilters([EqualTo(("table_name",), "team_whip"), EqualTo(("Team",), "T1")])) == [EqualTo(("Team",), "T1")]
    assert {p.table_name for p in reader.partitions()} == {"team_whip"}
    reader = board_tables.BoardReader("file://" + str(tmp_path))
    assert list(reader.pushFilters([In(("table_name",), ("team_whip", "individual_era", "none"))])) == []
    assert {p.table_name for p in reader.partitions()} == {"team_whip", "individual_era"}


def test_streams_and_boards_use_buckets(spark, tmp_path):
    rows = some_rows(34, 120)
    write_batches(str(tmp_path / "in"), rows)
    log = BucketLog(spark, str(tmp_path / "log"), buckets=2)
    run(spark, str(tmp_path / "in"), log, compact_every=1, retention_seconds=0)
    assert rows_of(log.state()) == wanted(rows)
    board = Board(spark, str(tmp_path / "board"), buckets=2)
    board.ingest(messages.file_stream(spark, str(tmp_path / "in")), available_now=True).awaitTermination()
    everything = board.ranks("individual_whip").orderBy("Rank").collect()
    assert [r.Rank for r in everything] == list(range(1, len(everything) + 1))
    assert [r.table_name for r in board.tables("team").collect()] == ["team_whip"]
