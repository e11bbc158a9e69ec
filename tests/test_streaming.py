import json
import os
import time

import pytest
from pyspark.sql import functions as F
from test_upsert import literal_fold, some_rows

from leaderstream import Board, __main__
from leaderstream.operators import flatten as fl
from leaderstream.operators import serving
from leaderstream.plans import fixtures
from leaderstream.sources import messages
from leaderstream.streaming import ingest, latest
from leaderstream.streaming.epoch_log import EpochLog


def event(row):
    table, name, team, value, _, offset = row
    category = {"individual_era": "ERA", "individual_whip": "WHIP", "team_whip": "WHIP"}[table]
    stats = {"Team": team, "Cl": str(offset), "WHIP": value, "Value": value}
    kind = "team"
    if table.startswith("individual"):
        kind, stats["Name"] = "player", name
    payload = {k: v for k, v in stats.items() if v is not None}
    return json.dumps({"stat_category": category, f"{kind}_stats": payload, "timestamp": "2024-01-01 00:00:00"})


def write_batches(folder, rows, first=0, last=99):
    os.makedirs(folder, exist_ok=True)
    for batch in sorted({r[4] for r in rows if first <= r[4] <= last}):
        path = f"{folder}/batch-{batch}.txt"
        with open(path, "w", encoding="utf8") as out:
            out.writelines(event(r) + "\n" for r in rows if r[4] == batch)
        os.utime(path, (1_700_000_000 + batch, 1_700_000_000 + batch))


def run(spark, folder, log, **options):
    source = messages.file_stream(spark, folder, max_files=1)
    ingest.start_ingest(source, log, available_now=True, **options).awaitTermination()


def rows_of(frame):
    return sorted((r.table_name, r.Name or "", r.Team or "", r.Value) for r in frame.collect())


def wanted(rows):
    kept = set(literal_fold(rows))
    return sorted(
        (r[0], (r[1] or "") if r[0].startswith("individual") else "", r[2] or "", r[3]) for r in rows if r[5] in kept
    )


@pytest.mark.parametrize("compact_every", [None, 2])
def test_stream_equals_fold(spark, tmp_path, compact_every):
    rows = some_rows(11, 120)
    log = EpochLog(spark, str(tmp_path / "log"))
    write_batches(str(tmp_path / "in"), rows)
    run(spark, str(tmp_path / "in"), log, compact_every=compact_every)
    assert log.epochs() == list(range(6))
    assert rows_of(log.state()) == wanted(rows)


def test_restart_and_replay(spark, tmp_path):
    rows = some_rows(12, 120)
    folder, log = str(tmp_path / "in"), EpochLog(spark, str(tmp_path / "log"))
    write_batches(folder, rows, last=2)
    run(spark, folder, log)
    # As after a failure between the write and the commit of the last epoch.
    os.remove(tmp_path / "log" / "checkpoint" / "commits" / "2")
    crc = tmp_path / "log" / "checkpoint" / "commits" / ".2.crc"
    if crc.exists():
        os.remove(crc)
    write_batches(folder, rows, first=3)
    run(spark, folder, log)
    assert log.epochs() == list(range(6))
    assert rows_of(log.state()) == wanted(rows)


def test_snapshots_of_each_epoch(spark, tmp_path):
    rows = [("individual_whip", "A", "T", "1", 0, 0), ("team_whip", None, "T", "5", 0, 1)]
    rows += [("individual_whip", "B", "T", ".5", 1, 2), ("individual_whip", "A", "T", "2", 2, 3)]
    write_batches(str(tmp_path / "in"), rows)
    run(spark, str(tmp_path / "in"), EpochLog(spark, str(tmp_path / "log")), snapshots_to=str(tmp_path / "snap"))
    published = spark.read.parquet(str(tmp_path / "snap"))
    assert sorted((r.table_name, r.version) for r in published.collect()) == [
        ("individual_whip", 0), ("individual_whip", 1), ("individual_whip", 2), ("team_whip", 0),
    ]
    latest_ones = {r.category: json.loads(r.snapshot)["rows"] for r in serving.latest_snapshots(published).collect()}
    assert [(r["Name"], r["Rank"]) for r in latest_ones["Individual Whip"]] == [("B", 1), ("A", 2)]
    assert latest_ones["Team Whip"] == [{"Team": "T", "Value": "5", "Rank": 1}]


def test_unfinished_epoch_is_not_read(spark, tmp_path, stats):
    log = EpochLog(spark, str(tmp_path))
    assert log.state().count() == 0 and log.compact() is None
    log.append(stats([("individual_era", "A", "T", "1", 0, 0)]), 0)
    log.append(stats([("individual_era", "A", "T", "2", 1, 1)]), 1)
    os.remove(tmp_path / "epochs" / "epoch=1" / "_SUCCESS")
    assert [r.Value for r in log.state().collect()] == ["1"]


@pytest.mark.parametrize("full_at", [set(), {1}, {3}, {1, 3, 5}])
def test_compaction_keeps_the_state(spark, tmp_path, stats, full_at):
    rows = some_rows(13, 200)
    log = EpochLog(spark, str(tmp_path))
    for batch in range(6):
        log.append(stats([r for r in rows if r[4] == batch]), batch)
        if batch in full_at:
            assert log.compact(full=True) == batch and log.compact() is None
        elif batch in (2, 4):
            assert log.compact() == batch and log.compact() is None
    assert sorted(r.offset for r in log.state().collect()) == literal_fold(rows)
    if 5 not in full_at:
        assert log.compact(full=True) == 5
    assert log.compact(full=True) is None
    assert sorted(r.offset for r in log.state().collect()) == literal_fold(rows)


def test_rejects_are_kept(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text('garbage\n{"stat_category":"X","team_stats":{"Team":"T","Value":"1"}}\n')
    log = EpochLog(spark, str(tmp_path / "log"))
    run(spark, str(folder), log)
    rejects = spark.read.parquet(f"{log.root}/rejects")
    assert [(r.message, r.reason) for r in rejects.collect()] == [("garbage", "bad_envelope")]
    assert log.state().count() == 1


def test_latest_with_state_store(spark, tmp_path):
    rows = [r for r in some_rows(14, 120) if None not in r[1:3]]
    folder = str(tmp_path / "in")
    write_batches(folder, rows)
    source = messages.file_stream(spark, folder, max_files=2)
    numbered = fl.flatten(fl.decode_envelopes(source))
    # ``Cl`` carries the number of a player's event.
    numbered = numbered.withColumn("offset", F.col("Cl").cast("long")).withColumn("batch_id", F.lit(0).cast("long"))
    log = EpochLog(spark, str(tmp_path / "log"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    latest.start_latest(numbered.where("entity_type = 'individual'"), log, available_now=True).awaitTermination()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    newest = {}
    for r in rows:
        if r[0].startswith("individual"):
            newest[r[:3]] = max(newest.get(r[:3], (-1, "")), (r[5], r[3]))
    got = {(r.table_name, r.Name, r.Team): (r.offset, r.Value) for r in log.state().collect()}
    assert got == newest and len(log.epochs()) > 1


def test_board(spark, tmp_path):
    rows = some_rows(15, 120)
    write_batches(str(tmp_path / "in"), rows)
    board = Board(spark, str(tmp_path / "log"))
    board.ingest(messages.file_stream(spark, str(tmp_path / "in")), available_now=True).awaitTermination()
    assert [r.table_name for r in board.tables().collect()] == ["individual_era", "individual_whip"]
    top = board.leaderboard("individual_whip").orderBy("Rank").collect()
    assert [float(r.Value) for r in top] == sorted(float(r.Value) for r in top) and top[0].Rank == 1
    everything = board.leaderboard()
    assert everything.where("table_name = 'individual_whip'").count() == len(top)
    assert board.leaderboard("individual_whip", team="T2").count() == sum(r.Team == "T2" for r in top)
    assert json.loads(board.records("team_whip").where("place = 1").first().record)["Rank"] == 1
    assert {r.facet for r in board.facets("individual_whip").collect()} == {"Team", "Cl"}
    assert board.snapshots("team").count() == 1
    assert board.register_views() == ["individual_era", "individual_whip", "team_whip"]
    asked = spark.createDataFrame([(1, "whip", "team")], "question_id int, query string, type string")
    assert "Team Whip" in board.prompts(asked).first().prompt
    ingest.publish_snapshots(board.log, str(tmp_path / "snap"), 1)
    assert spark.read.parquet(str(tmp_path / "snap")).count() == 2


def test_table_filter_prunes_partitions(spark, tmp_path, stats):
    log = EpochLog(spark, str(tmp_path))
    log.append(stats(some_rows(16, 50)), 0)
    plan = log.state("individual_era")._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "FileScan parquet" in line]
    assert scans and all("PartitionFilters: [isnotnull(table_name" in line or "PartitionFilters: [(table_name" in line for line in scans)


def test_event_files_round_trip(spark, tmp_path):
    rows = [r for r in some_rows(17, 30) if r[4] == 0]
    frame = spark.createDataFrame([(event(r),) for r in rows], "value string")
    messages.write_files(frame, str(tmp_path / "out"))
    back = spark.read.text(str(tmp_path / "out"))
    assert sorted(r.value for r in back.collect()) == sorted(event(r) for r in rows)


def test_a_long_name_does_not_stop_the_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    long = json.dumps({"stat_category": "x" * 300, "team_stats": {"Team": "T", "Value": "1"}})
    (folder / "a.txt").write_text(long + '\n{"stat_category":"X","team_stats":{"Team":"T","Value":"1"}}\n')
    log = EpochLog(spark, str(tmp_path / "log"))
    run(spark, str(folder), log, snapshots_to=str(tmp_path / "snap"))
    assert [r.table_name for r in log.state().collect()] == ["team_x"]
    assert [(r.reason, r.message) for r in spark.read.parquet(f"{log.root}/rejects").collect()] == [("bad_name", long)]


def test_null_keys_can_be_rejected(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text('{"stat_category":"X","team_stats":{"Value":"1"}}\n{"stat_category":"X","team_stats":{"Team":"T","Value":"2"}}\n')
    for mode, wanted in (("keep", ["1", "2"]), ("reject", ["2"])):
        log = EpochLog(spark, str(tmp_path / mode))
        run(spark, str(folder), log, null_keys=mode)
        assert sorted(r.Value for r in log.state().collect()) == wanted
        assert [r.reason for r in spark.read.parquet(f"{log.root}/rejects").collect()] == ["null_key"]


def test_reads_are_bounded_by_the_state(spark, tmp_path):
    """One key, many epochs: folds of everything leave one row, and what is folded goes."""
    rows = [("team_whip", None, "T", str(n), n, n) for n in range(8)]
    write_batches(str(tmp_path / "in"), rows)
    log = EpochLog(spark, str(tmp_path / "log"))
    run(spark, str(tmp_path / "in"), log, compact_every=2, full_every=4, retention_seconds=0)
    assert [r.Value for r in log.state().collect()] == ["7"]
    assert log.read().count() == 1
    assert log.epochs() == [] and os.listdir(tmp_path / "log" / "folds") == []
    assert [name for name in os.listdir(tmp_path / "log" / "bases") if "=" in name] == ["upto=7"]


def test_vacuum_waits(spark, tmp_path, stats):
    log = EpochLog(spark, str(tmp_path))
    log.append(stats([("team_whip", None, "T", "1", 0, 0)]), 0)
    assert log.compact() == 0
    assert log.vacuum(retention_seconds=3600) == [] and log.epochs() == [0]
    assert len(log.vacuum(retention_seconds=0)) == 1 and log.epochs() == []
    assert log.state().count() == 1


def test_listing_many_epochs_is_quick(spark, tmp_path):
    for n in range(5000):
        folder = tmp_path / "epochs" / f"epoch={n}"
        folder.mkdir(parents=True)
        (folder / "_SUCCESS").touch()
    log = EpochLog(spark, str(tmp_path))
    log.epochs()
    start = time.perf_counter()
    assert log.epochs() == list(range(5000))
    assert time.perf_counter() - start < 2


def test_latest_keeps_rejects_and_folds(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    lines = ["garbage", '{"team_stats":{"Team":"T"}}', '{"stat_category":"X","team_stats":{"Value":"1"}}']
    for n in range(4):
        good = {"stat_category": "X", "timestamp": f"2024-01-0{n + 1} 00:00:00", "team_stats": {"Team": "T", "Value": str(n)}}
        path = folder / f"{n}.txt"
        path.write_text("\n".join([*lines, json.dumps(good)]) + "\n")
        os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))
    log = EpochLog(spark, str(tmp_path / "log"))
    source = messages.file_stream(spark, str(folder), max_files=1)
    for query in latest.start_latest_events(source, log, available_now=True, compact_every=2, retention_seconds=0):
        query.awaitTermination()
    assert [r.Value for r in log.state().collect()] == ["3"]
    assert len(log.epochs()) < 4
    rejects = spark.read.parquet(f"{log.root}/rejects").groupBy("reason").count().collect()
    assert {r.reason: r["count"] for r in rejects} == {"bad_envelope": 4, "no_category": 4, "null_key": 4}


def test_views_follow_the_stream(spark, tmp_path):
    rows = [("team_whip", None, "T", "1", 0, 0), ("team_whip", None, "T", "2", 1, 1)]
    board = Board(spark, str(tmp_path / "log"))
    for batch in (0, 1):
        write_batches(str(tmp_path / "in"), rows, first=batch, last=batch)
        board.ingest_views(messages.file_stream(spark, str(tmp_path / "in")), available_now=True).awaitTermination()
        assert [r.Value for r in spark.sql("SELECT * FROM team_whip").collect()] == [str(batch + 1)]


def test_time_zone_is_checked(spark, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", "Europe/Paris")
    try:
        with pytest.raises(ValueError, match="UTC"):
            Board(spark, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_topic_options():
    args = __main__._arguments(
        ["--root", "r", "ingest", "--topic", "t", "--servers", "s:1", "--max-offsets", "5", "--min-partitions", "9"]
        + ["--option", "kafka.security.protocol=SSL", "--option", "startingOffsets=latest"]
    )
    assert messages.topic_reader(args.servers, args.topic, **__main__.topic_options(args) | {}) == {
        "kafka.bootstrap.servers": "s:1",
        "subscribe": "t",
        "startingOffsets": "latest",
        "maxOffsetsPerTrigger": "5",
        "minPartitions": "9",
        "kafka.security.protocol": "SSL",
    }
    with pytest.raises(ValueError):
        __main__.topic_options(__main__._arguments(["--root", "r", "ingest", "--topic", "t", "--option", "x"]))


@pytest.mark.parametrize("name", ["a[1]", "b*", "c{x}", "plain"])
def test_table_stream_of_odd_paths(spark, tmp_path, name):
    path = str(tmp_path / name)
    spark.range(3).coalesce(1).write.parquet(path)
    (part,) = [f for f in os.listdir(path) if f.endswith(".parquet")]
    for n, source in enumerate((path, f"{path}/{part}")):
        query = messages.table_stream(spark, source).writeStream.format("memory").queryName(f"t{n}").trigger(availableNow=True).start()
        query.awaitTermination()
        assert spark.table(f"t{n}").count() == 3


def test_files_of_a_batch_stay_small(spark, tmp_path):
    """A large batch and one of a few rows: as many files each, none with much more than its share of the rows."""
    batch, offset = F.when(F.col("id") < 5, 0).otherwise(1).cast("bigint"), F.when(F.col("id") % 2 == 0, F.col("id"))
    rows = spark.range(4005).select(F.col("id").cast("string").cast("binary").alias("value"), offset.alias("offset"), batch.alias("batch_id"))
    path, files = fixtures.message_files(rows, "small-files", file_rows=200)
    written = spark.read.parquet(path).groupBy("batch_id", F.input_file_name().alias("file")).count().collect()
    assert files == 20
    assert max(r["count"] for r in written) < 400
    source = messages.table_stream(spark, path, max_files=files).select("value")
    epochs = {}
    take = source.writeStream.foreachBatch(lambda b, n: epochs.update({n: sorted(int(r.value.decode()) for r in b.collect())}))
    take.option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    assert epochs == {0: list(range(5)), 1: list(range(5, 4005))}
