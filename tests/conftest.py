import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

from leaderstream.session import local_session

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def stats(spark):
    """Rows of the statistics table from ``(table, name, team, value, batch, offset)``."""
    from leaderstream.operators.flatten import STATS

    def make(rows):
        full = [
            (t, t.split("_")[0], t, name, team, None, None, value, None, batch, offset)
            for t, name, team, value, batch, offset in rows
        ]
        return spark.createDataFrame(full, STATS)

    return make
