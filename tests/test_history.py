"""Earlier states against a fold, batch by batch."""

import pytest
from test_upsert import SPLIT, literal_fold, some_rows

from leaderstream.operators import history, upsert


@pytest.mark.parametrize("balance", [{}, SPLIT])
def test_states_at_times_equal_folds(stats, balance):
    rows = some_rows(7)
    got = history.states_at(stats(rows), [-1, 0, 2, 2, 5, 9], **balance).select("as_of", "offset").collect()
    for time in (-1, 0, 2, 5, 9):
        assert sorted(r.offset for r in got if r.as_of == time) == literal_fold([r for r in rows if r[4] <= time])
    assert len(got) == sum(len(literal_fold([r for r in rows if r[4] <= t])) for t in (0, 2, 5, 9))


def test_open_intervals_are_the_state(stats):
    frame = stats(some_rows(3))
    still = history.validity(frame).where("valid_to is null")
    want = sorted(r.offset for r in upsert.resolve_batches(frame).collect())
    assert sorted(r.offset for r in still.collect()) == want


def test_lookups_find_the_state_of_their_key(spark, stats):
    rows = some_rows(5)
    asked = [(t, n, team, at) for t in ("individual_era", "team_whip") for n in ("A", "B") for team in ("T1", "T2") for at in range(-1, 8)]
    asked += [asked[3], ("individual_era", None, "T1", 3), ("individual_none", "A", "T1", 3), ("individual_era", "A", "T1", None)]
    lookups = spark.createDataFrame(asked, "table_name string, Name string, Team string, as_of int")
    got = history.as_of(lookups, stats(rows)).collect()
    want = set()
    for table, name, team, at in asked:
        if name is None or at is None:
            continue
        state = set(literal_fold([r for r in rows if r[4] <= at]))
        same = [r for r in rows if r[0] == table and r[2] == team and (table == "team_whip" or r[1] == name)]
        want |= {(table, at, r[5]) for r in same if r[5] in state}
    found = [(r.table_name, r.as_of, r.offset) for r in got]
    assert sorted(found) == sorted(want)


def test_no_rows_and_no_times(stats):
    assert history.states_at(stats([]), [1, 2]).count() == 0
    assert history.states_at(stats(some_rows(1)), []).count() == 0
    assert history.as_of(stats([]).select("table_name", "Name", "Team", "batch_id"), stats(some_rows(1)), time="batch_id").count() == 0
