import random
import shutil

import pytest
from pyspark.sql import functions as F
from test_streaming import run, write_batches
from test_upsert import some_rows

from leaderstream.operators import ranking
from leaderstream.operators.numbering import numbered
from leaderstream.streaming.epoch_log import EpochLog
from leaderstream.streaming.served import ServedRows


def shown(frame):
    return sorted((r.table_name, r.place, r.Rank, r.Name, r.Team, r.Value, r.offset) for r in frame.collect())


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_numbers_of_all_rows(spark, parts):
    draw = random.Random(parts)
    rows = [(draw.choice(["a", "b", None]), draw.choice([1, 1, 1, 1, 2, None]), n) for n in range(400)]
    frame = spark.createDataFrame(rows, "g string, v int, place long").repartition(5)
    order = [F.col("v").asc_nulls_last(), F.col("place").asc()]
    got = numbered(frame, ["g"], order, position="number", total="n", parts=parts).collect()
    for group in ("a", "b", None):
        wanted = sorted((r for r in rows if r[0] == group), key=lambda r: (r[1] is None, r[1] or 0, r[2]))
        found = sorted((r for r in got if r.g == group), key=lambda r: r.number)
        assert [(r.g, r.v, r.place) for r in found] == wanted
        assert [r.number for r in found] == list(range(1, len(wanted) + 1))
        assert {r.n for r in found} == {len(wanted)}


def test_numbers_of_equal_rows_and_of_none(spark):
    same = spark.range(1000).select(F.lit("a").alias("g"), F.lit(7).alias("v"))
    got = numbered(same, ["g"], [F.col("v").asc()], parts=8)
    assert sorted(r.place for r in got.collect()) == list(range(1, 1001))
    # One value with all rows is split over the ranges.
    spread = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) > 1 and max(r["count"] for r in spread) <= 400
    assert numbered(same.limit(0), ["g"], [F.col("v").asc()], total="n").collect() == []
    assert [r.place for r in numbered(same.limit(3), [], [F.col("v").asc()]).orderBy("place").collect()] == [1, 2, 3]


@pytest.mark.parametrize("by", ["text", "number"])
def test_every_row_has_its_rank(spark, stats, by):
    rows = [(t, f"P{n % 17}", "T", random.Random(n).choice(["1", "2", "10", ".5", None, "-"]), 0, n) for n, t in
            enumerate(["individual_whip", "team_saves", "individual_wl_pct"] * 40)]
    frame = stats(rows)
    everything = ranking.rank_all(frame, by=by)
    assert shown(everything) == shown(ranking.leaderboards(frame, by=by, rows=1000))
    assert ranking.rank_all(frame.limit(0)).collect() == []


def test_no_window_without_a_bound(spark, stats):
    """Windows see counts of ranges, never the rows of a table."""
    plan = ranking.rank_all(stats(some_rows(3, 60)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and "sum(_size" in plan and "row_number" not in plan


def worse(rows):
    """Values of players that get worse, so that boards lose rows from the front."""
    return [(t, n, team, str(float(v or 0) + 5 * b), b, o) for t, n, team, v, b, o in rows]


@pytest.mark.parametrize("reserve", [1, 50])
def test_served_rows_equal_boards_of_the_state(spark, tmp_path, stats, reserve):
    rows = worse([r for r in some_rows(21, 240) if r[3]])
    log = EpochLog(spark, str(tmp_path))
    served = ServedRows(log, rows=4, reserve=reserve)
    assert served.read().collect() == []
    for batch in range(6):
        log.append(stats([r for r in rows if r[4] == batch]), batch)
        served.update(batch)
        assert shown(served.read()) == shown(ranking.leaderboards(log.state(), rows=4)), batch
    assert bool(served.filled) == (reserve < 50)
    # As after a failure behind the last write: the epoch counts once.
    served.update(5)
    assert shown(served.read()) == shown(ranking.leaderboards(log.state(), rows=4))


def test_an_epoch_reads_itself_and_the_served_rows(spark, tmp_path, stats):
    """The history is gone, and each epoch still gives the right rows from what it reads."""
    history = [("individual_whip", f"P{n:03}", "T", str(n), 0, n) for n in range(500)]
    log = EpochLog(spark, str(tmp_path / "log"))
    served = ServedRows(log, rows=10, reserve=10)
    log.append(stats(history), 0)
    served.update(0)
    assert served._version(0).count() == 21  # rows, reserve and the floor
    state = {r[1]: r for r in history}
    for epoch in range(1, 4):
        batch = [("individual_whip", f"P{n:03}", "T", str(900 + n), epoch, 1000 * epoch + n) for n in range(epoch * 3, epoch * 3 + 3)]
        batch += [("individual_whip", f"N{epoch}{n}", "T", f"{epoch}.{n}", epoch, 2000 * epoch + n) for n in range(2)]
        state |= {r[1]: r for r in batch}
        log.append(stats(batch), epoch)
        shutil.rmtree(tmp_path / "log" / "epochs" / f"epoch={epoch - 1}")
        read = log.epoch(epoch).count() + served._version(epoch - 1).count()
        assert read <= len(batch) + 21
        served.update(epoch)
        best = sorted(state.values(), key=lambda r: (float(r[3]), r[1]))[:10]
        assert [r.Name for r in served.read().orderBy("place").collect()] == [r[1] for r in best]
    assert not served.filled


def test_a_dry_table_alone_is_filled(spark, tmp_path, stats):
    log = EpochLog(spark, str(tmp_path))
    served = ServedRows(log, rows=3, reserve=1)
    first = [(t, f"P{n}", "T", str(n), 0, n) for t in ("individual_whip", "individual_earned_run_average") for n in range(20)]
    log.append(stats(first), 0)
    served.update(0)
    log.append(stats([("individual_whip", f"P{n}", "T", "99", 1, 100 + n) for n in range(3)]), 1)
    served.update(1)
    assert served.filled == {1: ["individual_whip"]}
    assert shown(served.read()) == shown(ranking.leaderboards(log.state(), rows=3))


def test_stream_keeps_served_rows(spark, tmp_path):
    rows = some_rows(22, 120)
    log = EpochLog(spark, str(tmp_path / "log"))
    served = ServedRows(log, rows=5, reserve=3)
    write_batches(str(tmp_path / "in"), rows)
    run(spark, str(tmp_path / "in"), log, served=served, compact_every=2, retention_seconds=0)
    assert shown(served.read()) == shown(ranking.leaderboards(log.state(), rows=5))
    whip = spark.createDataFrame([("team_whip",)], "table_name string")
    assert {r.table_name for r in served.read(whip).collect()} == {"team_whip"}
    assert len(served.versions()) >= 2
