import random

import pytest
from pyspark.sql import functions as F

from leaderstream.operators import ranking
from leaderstream.operators.balance import key_facts, salted_join, top_k_per_group, with_key_facts

UP = [None, "-", ".345", "0.300", "10.00", "2.00"]


def values(frame):
    return [r.Value for r in frame.orderBy("place").collect()]


@pytest.mark.parametrize("board", [ranking.leaderboards, lambda s, **k: ranking.leaderboard(s, s.first().table_name, **k)])
def test_order_of_texts_and_numbers(stats, board):
    shuffled = [UP[i] for i in (3, 0, 5, 1, 4, 2)]
    up = stats([("individual_whip", f"P{i}", "T", v, 0, i) for i, v in enumerate(shuffled)])
    down = stats([("individual_batting_average", f"P{i}", "T", v, 0, i) for i, v in enumerate(shuffled)])
    assert values(board(up, by="text")) == UP
    assert values(board(down, by="text")) == UP[:0:-1] + [None] == ["2.00", "10.00", "0.300", ".345", "-", None]
    assert values(board(up))[:4] == ["0.300", ".345", "2.00", "10.00"]
    assert values(board(down))[:4] == ["10.00", "2.00", ".345", "0.300"]
    assert [r.Rank for r in board(up).orderBy("place").collect()] == [1, 2, 3, 4, 5, 6]


def test_limits_and_unranked_tables(stats):
    tables = ["individual_wl_pct", "team_wl_pct", "individual_saves", "individual_era"]
    rows = [(t, f"P{i:03}", f"T{i:03}", str(i), 0, i) for t in tables for i in range(310)]
    frame = stats(rows).repartition(3)
    for board in (ranking.leaderboards(frame), *(ranking.leaderboard(frame, t) for t in tables)):
        for t in {r.table_name for r in board.select("table_name").distinct().collect()}:
            got = board.where(board.table_name == t).orderBy("place").collect()
            assert len(got) == (250 if t == "individual_wl_pct" else 300)
            ranked = t == "team_wl_pct"
            assert [r.Rank for r in got][:2] == ([1, 2] if ranked else [None, None])
            assert got[0].Value == ("309" if ranked else "0")
    assert ranking.leaderboard(frame, "individual_nothing").count() == 0


def test_wrong_mode(stats):
    with pytest.raises(ValueError, match="number"):
        ranking.leaderboards(stats([]), by="size")


def test_lanes_do_not_change_the_cut(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("aaaab"), rnd.randrange(1000), i) for i in range(2000)]
    frame = spark.createDataFrame(rows, "g string, v int, i int").repartition(7)
    wanted = {g: sorted((v, i) for h, v, i in rows if h == g)[:25] for g in "ab"}
    for lanes in (1, 3):
        got = top_k_per_group(frame, ["g"], [frame.v.asc(), frame.i.asc()], 25, lanes=lanes).orderBy("_pos").collect()
        assert {g: [(r.v, r.i) for r in got if r.g == g] for g in "ab"} == wanted


@pytest.mark.parametrize("hot", [{"hot_key_rows": 2}, {}])
def test_key_facts_reach_every_row_once(spark, hot):
    rows = [(k, i) for i, k in enumerate(["a"] * 50 + ["b"] * 5 + ["c"] + [None] * 7 + ["unknown"])]
    frame = spark.createDataFrame(rows, "k string, i int")
    facts = key_facts(frame.where("k <> 'unknown'"), ["k"], F.max("i").alias("f"), F.lit(1))
    assert {r.k: (r.f, r._n) for r in facts.collect()} == {"a": (49, 50), "b": (54, 5), "c": (55, 1)}
    got = with_key_facts(frame, facts, ["k"], "f", ["i"], **hot).collect()
    known = {"a": 49, "b": 54, "c": 55}
    assert sorted((r.i, r.f) for r in got) == [(i, known.get(k)) for k, i in rows]


def test_salted_join_equals_join(spark):
    rows = spark.createDataFrame([("a", i) for i in range(100)] + [("b", 100), ("x", 101)], "k string, i int")
    small = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3")], "k string, s string")
    wanted = sorted(map(tuple, rows.join(small, "k").select("k", "i", "s").collect()))
    assert sorted(map(tuple, salted_join(rows, small, ["k"], ["i"]).select("k", "i", "s").collect())) == wanted
