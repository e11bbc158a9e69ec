import json

from leaderstream.operators import ranking, serving


def test_catalog_and_views(spark, stats):
    frame = stats([("individual_era", "A", "T", "1", 0, 0), ("team_era", None, "T", "2", 0, 1)])
    assert [r.table_name for r in serving.list_tables(frame).collect()] == ["individual_era"]
    assert serving.table_names(frame) == ["individual_era", "team_era"]
    serving.register_view(frame, "team_era")
    assert [tuple(r) for r in spark.sql("select * from team_era").collect()] == [("T", "2")]
    assert serving.read_table(frame, "individual_none").count() == 0


def test_filters_keep_ranks(spark, stats):
    rows = [("individual_whip", f"P{i}", f"T{i % 2}", str(i), 0, i) for i in range(6)]
    served = ranking.leaderboards(stats(rows))
    assert serving.filter_rows(served).count() == 6
    assert sorted(r.Rank for r in serving.filter_rows(served, team="T1").collect()) == [2, 4, 6]
    assert serving.filter_rows(served, cl="Jr.").count() == 0
    facets = serving.facet_values(served).collect()
    assert [(r.facet, r.facet_value) for r in facets] == [("Team", "T0"), ("Team", "T1")]


def test_facets_depend_on_each_other(spark):
    """Every combination of filters has the counts that filtering the rows gives."""
    fields = "entity_type string, table_name string, Team string, Cl string, Position string"
    values = [("T1", "Jr", "P"), ("T1", "Sr", "P"), ("T1", None, "C"), ("T2", "Jr", ""), (None, "Jr", "P"), ("T1", "Jr", "P")]
    rows = [("individual", "individual_whip", *v) for v in values] + [("team", "team_whip", "T1", None, None)]
    frame = spark.createDataFrame(rows, fields)
    got = {(r.Team, r.Cl, r.Position): r.n for r in serving.facet_counts(frame).collect()}
    want = {}
    for team in ("", "T1", "T2"):
        for cl in ("", "Jr", "Sr"):
            for position in ("", "P", "C"):
                left = serving.filter_rows(frame, team, cl, position).where("entity_type = 'individual'").count()
                if left:
                    want[team, cl, position] = left
    assert got == want
    offers = serving.facet_options(serving.facet_counts(frame)).where("facet = 'Cl' and for_team = 'T1' and for_position = ''")
    assert {(r.facet_value, r.for_cl, r.n) for r in offers.collect()} == {("Jr", "", 2), ("Sr", "", 1)}
    assert serving.facet_options(serving.facet_counts(frame.limit(0))).count() == 0


def test_sorting_puts_numbers_first(spark):
    frame = spark.createDataFrame([(v,) for v in ["b", "10", "9 x", None, "A", ".5"]], "v string")
    assert [r.v for r in serving.sort_rows(frame, "v").collect()] == [".5", "9 x", "10", None, "A", "b"]
    assert [r.v for r in serving.sort_rows(frame, "v", False).collect()] == ["b", "A", None, "10", "9 x", ".5"]


def test_records_and_snapshots(spark, stats):
    rows = [
        ("individual_whip", "A", "T", None, 0, 0),
        ("individual_saves", 'x"y', "T", "3", 0, 1),
        ("team_whip", None, "T", "1", 0, 2),
    ]
    served = ranking.leaderboards(stats(rows))
    got = {r.table_name: json.loads(r.record) for r in serving.records(served).collect()}
    blank = {"Cl": None, "Position": None}
    assert got == {
        "individual_whip": {"Name": "A", "Team": "T", **blank, "Value": None, "Rank": 1},
        "individual_saves": {"Name": 'x"y', "Team": "T", **blank, "Value": "3"},
        "team_whip": {"Team": "T", "Value": "1", "Rank": 1},
    }
    documents = [json.loads(r.snapshot) for r in serving.snapshots(served).collect()]
    assert {d["category"] for d in documents} == {"Individual Whip", "Individual Saves"}
    assert all(d["rows"] in ([got["individual_whip"]], [got["individual_saves"]]) for d in documents)


def test_latest_snapshot_wins(spark):
    rows = [("A", 1, "old"), ("A", 3, "new"), ("A", 2, "mid"), ("B", 1, "only")]
    latest = serving.latest_snapshots(spark.createDataFrame(rows, "category string, version int, snapshot string"))
    assert sorted(map(tuple, latest.collect())) == [("A", 3, "new"), ("B", 1, "only")]
