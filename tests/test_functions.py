import math

import pytest
from pyspark.sql import functions as F

from leaderstream.functions import naming, values
from leaderstream.metrics import METRICS, STAT_PAGES, rank_direction, table_name_of, unranked_individual, value_field


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("r")).first().r


@pytest.mark.parametrize(
    ("text", "wanted"),
    [("  WL Pct ", "wl_pct"), ("K/9 -x", "k_9__x"), ("\t É x\n", "__x"), ("a😀b", "a_b"), (None, None)],
)
def test_safe_name(spark, text, wanted):
    assert one(spark, naming.safe_name, text) == wanted
def test_stated_names_are_the_safe_ones(spark):
    names = spark.createDataFrame([(m.name, m.safe_name) for m in METRICS], "name string, wanted string")
    assert names.where(naming.safe_name(F.col("name")) != F.col("wanted")).count() == 0
    # A table of a listed metric reads as that metric, so its direction may be looked up by name.
    tables = names.withColumn("table", F.concat(F.lit("team_"), "wanted"))
    assert tables.where(naming.metric_name(F.col("table")) != F.col("name")).count() == 0


@pytest.mark.parametrize(
    ("table", "metric", "title", "unranked", "direction"),
    [
        ("individual_batting_average", "Batting Average", "Individual Batting Average", False, "desc"),
        ("team_wl_pct", "WL Pct", "Team Wl Pct", False, "desc"),
        ("team_wlpct_x", "WL Pct", "Team Wlpct X", False, "desc"),
        ("individual_wl_pct", "WL Pct", "Individual Wl Pct", True, None),
        ("individual_whips", "WHIP", "Individual Whips", False, "asc"),
        ("individual_my_whip_2", "WHIP", "Individual My Whip 2", False, "asc"),
        ("individual_awhip", "Awhip", "Individual Awhip", False, None),
        ("team_awl_pct", "Awl Pct", "Team Awl Pct", False, None),
        ("team_k_9__x", "K 9  X", "Team K 9  X", False, None),
        ("team_9abc_d", "9Abc D", "Team 9Abc D", False, None),
        ("individual_wl_pct_whip", "WHIP", "Individual Wl Pct Whip", False, "asc"),
        ("team_saves", "Saves", "Team Saves", False, None),
        ("individual_hits_allowed_per_nine_innings", "Hits Allowed Per Nine Innings", "Individual Hits Allowed Per Nine Innings", False, "asc"),
    ],
)
def test_metric_and_direction(spark, table, metric, title, unranked, direction):
    assert one(spark, naming.metric_name, table) == metric
    assert one(spark, naming.display_title, table) == title
    assert one(spark, unranked_individual, table) == unranked
    assert one(spark, lambda t: rank_direction(METRICS, t), table) == direction


def test_labels(spark):
    assert one(spark, naming.menu_label, "team_wl_pct") == "wl pct"
    assert one(spark, naming.menu_label, "individual_era") == "era"
    assert one(spark, naming.section_id, "Team  Wl Pct") == "section-team-wl-pct"
    assert one(spark, values.or_unknown, None) == "Unknown"


def test_fields(spark):
    frame = spark.createDataFrame(
        [("individual", "WL Pct"), ("team", "WL Pct"), ("team", "Saves"), ("individual", "Slugging Percentage")],
        "e string, c string",
    )
    fields = frame.select(value_field(METRICS, F.col("e"), F.col("c")).alias("f"))
    assert [r.f for r in fields.collect()] == ["Value", "PCT", "Value", "SLG PCT"]
    tables = frame.select(table_name_of(METRICS, F.col("e"), F.col("c")).alias("t"))
    assert [r.t for r in tables.collect()][:3] == ["individual_wl_pct", "team_wl_pct", "team_saves"]


def test_stat_pages_know_their_metrics():
    names = {m.name for m in METRICS}
    assert len(STAT_PAGES) == 22 and all(metric in names for _, metric, _ in STAT_PAGES)
    assert len({path for _, _, path in STAT_PAGES}) == 22


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("12 wins", 12.0),
        (" -.5x", -0.5),
        ("1e3", 1000.0),
        ("3.", 3.0),
        ("1e", 1.0),
        ("abc", None),
        ("-", None),
        ("", None),
        (None, None),
        ("Infinity", math.inf),
    ],
)
def test_leading_number(spark, text, wanted):
    assert one(spark, values.leading_number, text) == wanted


@pytest.mark.parametrize(
    ("text", "wanted"), [
        (".345", 0.345),
        ("10.00", 10.0),
        (" 5. ", 5.0),
        ("-1e3", -1000.0),
        ("Infinity", math.inf),
        ("10d", None),
        ("5f", None),
        ("0x1p3", None),
        ("-", None),
        ("NaN", None),
        ("1 x", None),
        (None, None),
    ],
)
def test_number(spark, text, wanted):
    assert one(spark, values.number, text) == wanted


def test_event_time(spark):
    def time(t):
        return one(spark, lambda c: values.utc_text(values.event_time(c)), t)

    assert time("2024-01-01 00:00:07") == "2024-01-01 00:00:07"
    assert time("1704067207") == "2024-01-01 00:00:07"
    assert time("yesterday") is None
    assert len(one(spark, lambda c: values.utc_text(), "x")) == 19
