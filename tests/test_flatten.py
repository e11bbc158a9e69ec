import json

import pytest
from pyspark.sql import functions as F

from leaderstream.operators import flatten as fl
from leaderstream.plans import fixtures as fx


def envelope(category="Slugging Percentage", kind="player", **extra):
    payload = {"Name": "A", "Team": "T1", "Cl": "Jr.", "Position": "OF", "SLG PCT": ".345"}
    base = {"stat_category": category, "stat_type": kind, "timestamp": "2024-01-01 00:00:00"}
    return json.dumps({**base, **(extra or {"player_stats": payload})})


def flat(spark, *texts):
    """Rows of the messages, the same whether parsed step by step or together."""
    raw = spark.createDataFrame([(i, bytearray(t, "utf8")) for i, t in enumerate(texts)], "offset long, value binary")
    rows = fl.flatten(fl.decode_envelopes(raw))
    together = fl.accepted_rows(fl.judge_events(raw)).select(*rows.columns)
    got = rows.orderBy("offset", "entity_type").collect()
    assert together.orderBy("offset", "entity_type").collect() == got
    return got


def payload_text(payload: str) -> str:
    return '{"stat_category":"Slugging Percentage","player_stats":%s}' % payload


def test_player_and_team(spark):
    player, team = flat(
        spark, envelope(), envelope("WL Pct", "team", team_stats={"Team": "T1", "PCT": "0.800", "Name": "ignored"})
    )
    assert (player.table_name, player.Name, player.Team, player.Cl, player.Position, player.Value) == (
        "individual_slugging_percentage", "A", "T1", "Jr.", "OF", ".345",
    )
    assert (team.table_name, team.Name, team.Team, team.Value) == ("team_wl_pct", None, "T1", "0.800")
    assert str(player.event_time) == "2024-01-01 00:00:00"


def test_both_payloads_give_two_rows(spark):
    rows = flat(spark, envelope(player_stats={"Name": "A", "Team": "T"}, team_stats={"Team": "T"}))
    assert [r.entity_type for r in rows] == ["individual", "team"]


@pytest.mark.parametrize(
    ("payload", "name", "value"),
    [
        ('"not json"', None, None),
        ("[]", None, None),
        ('{"Name":{"a":1}}', '{"a":1}', None),
        ('{"Name":"x","SLG PCT":0.5}', "x", "0.5"),
        ('{"name":"x"}', None, None),
        ('{"Name":"a","Name":"b"}', "b", None),
        ('{"Name":"ü","Value":"9"}', "ü", None),
    ],
)
def test_payload_cases(spark, payload, name, value):
    (row,) = flat(spark, payload_text(payload))
    assert (row.Name, row.Value) == (name, value)


@pytest.mark.parametrize(
    ("text", "reason"),
    [
        ("garbage", "bad_envelope"),
        ('{"stat_category":"X"', "bad_envelope"),
        ("{}", "bad_envelope"),
        ('{"stat_category":"X"}', "no_payload"),
        (payload_text("null"), "no_payload"),
        ('{"player_stats":{"Name":"A","Team":"T"}}', "no_category"),
        (payload_text('{"Team":"T"}'), "null_key"),
        ('{"stat_category":"X","team_stats":{"PCT":"1"}}', "null_key"),
        (envelope(), None),
    ],
)
def test_judgement(spark, text, reason):
    judged = fl.judge_events(spark.createDataFrame([(text,)], "value string")).persist()
    assert [r.reason for r in judged.collect()] == [reason]
    accepted = fl.accepted_rows(judged).collect()
    assert len(accepted) == (reason in (None, "null_key"))
    assert [(r.message, r.reason) for r in fl.rejected_events(judged).collect()] == ([(text, reason)] if reason else [])
    judged.unpersist()


ODD = [
    '{"stat_category":"X","player_stats":"no","team_stats":{"Team":"T","Value":"1"}}',
    '{"stat_category":"X","player_stats":{"Name":"A","Team":"T"},"team_stats":[]}',
    '{"stat_category":"X","player_stats":{"Name":"team_stats","Team":"T","Value":{"a":[1,2.50]}}}',
    '{"stat_category":"X","player_stats":null,"team_stats":{"Team":null}}',
    '{"stat_category":7,"timestamp":1704067200,"team_stats":{"Team":8,"Value":0.50}}',
    '{"stat_category":"X","team_stats":{}}',
    '[{"stat_category":"X","team_stats":{"Team":"T"}}]',
    '{"stat_category":"X","team_stats":{"Team":"T"}',
    '{"stat_category":"X","team_stats":[{"Team":"T"}]}',
    '{"stat_category":"X","team_stats":{"Team":"a"},"team_stats":{"Team":"b"}}',
    "{}",
    "",
]


def test_odd_messages_parse_alike_step_by_step(spark):
    assert len(flat(spark, *ODD)) >= 10


def test_missing_payload_column(spark):
    frame = spark.createDataFrame([("X", '{"Team":"T","Value":"1"}')], "stat_category string, team_stats string")
    assert [r.Value for r in fl.flatten(frame).collect()] == ["1"]


def test_encode_round_trip(spark):
    rows = spark.createDataFrame(
        [("individual", "WHIP", {"Name": 'Q"ü\\', "Team": "T", "WHIP": "1.0"})],
        "entity_type string, stat_category string, record map<string,string>",
    )
    events = fl.encode_events(rows, F.col("record"))
    text = events.first().value
    assert "ü" in text and list(json.loads(text)) == ["stat_category", "stat_type", "timestamp", "player_stats"]
    row = fl.flatten(fl.decode_envelopes(events.select("value"))).first()
    assert (row.Name, row.Team, row.Value, row.table_name) == ('Q"ü\\', "T", "1.0", "individual_whip")


def test_empty_table(spark):
    assert fl.empty_stats(spark).count() == 0


def test_messages_are_encoded_before_the_parse(spark):
    """Not within it, where Spark interprets them row by row."""
    text = F.col("id").cast("string")
    lines = spark.range(3).select(
        F.lit("A").alias("l_returnflag"), F.lit("F").alias("l_linestatus"), F.col("id").alias("l_suppkey"),
        text.alias("l_extendedprice"), F.timestamp_seconds("id").alias("l_shipdate"), F.col("id").alias("l_orderkey"),
        F.when(F.col("id") > 0, 1).alias("l_linenumber"),
    )
    rows = fl.flatten(fl.decode_envelopes(fx.messages(fx.team_rows(lines))))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    parses = [line for line in plan.splitlines() if "from_json(" in line]
    assert len(parses) == 2
    assert not any("StructsToJson" in line for line in parses)
    assert sorted(r.Team for r in rows.collect()) == ["Supplier 0", "Supplier 1", "Supplier 2"]


def test_fields_without_a_value_leave_no_key(spark):
    rows = spark.range(2).select(
        F.lit("individual").alias("entity_type"), F.lit("WHIP").alias("stat_category"), F.lit("A").alias("Name"),
        F.lit(None).cast("string").alias("Team"), F.lit("").alias("Cl"), F.lit(None).cast("string").alias("Position"),
        F.when(F.col("id") == 1, "1.5").alias("Value"), F.timestamp_seconds("id").alias("event_time"),
        F.col("id").alias("batch_id"), F.col("id").alias("offset"),
    )
    texts = [json.loads(r.value.decode())["player_stats"] for r in fx.messages(rows).orderBy("offset").collect()]
    assert [list(t.items()) for t in texts] == [[("Name", "A"), ("Cl", "")], [("Name", "A"), ("Cl", ""), ("WHIP", "1.5")]]
