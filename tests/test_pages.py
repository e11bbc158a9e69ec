import time

import pytest
from pyspark.sql import functions as F

from leaderstream.sources import pages
from leaderstream.sources.html_table import first_table


@pytest.mark.parametrize(
    ("html", "headers", "rows"),
    [
        ("<p>none</p>", None, None),
        ("<table></table>", [], []),
        ("<TABLE><TR><TH> A\n</TH></TR><tr><td>&nbsp;x &amp; <b>y</b><br>z </td></tr></TABLE>", ["A"], [["x & yz"]]),
        ("<!-- <table> --><script>'<table>'</script><table><tr><th>A</th></tr><tr><td>1</td></tr></table>", ["A"], [["1"]]),
        ("<table><tr><td>first</td></tr><tr><td>1</td></table><table><tr><td>2</td></tr></table>", [], [["1"]]),
        ("<table><tr><th>A</th></tr><tr><td>1</td></tr>", ["A"], [["1"]]),
        ("<table><tr></tr><tr><td>a<script>no</script><style>no</style></td><td/></tr></table>", [], [["a", ""]]),
        # Without an end tag a cell holds what follows; rows nest the same way.
        ("<table><tr></tr><tr><td>a<td>b</tr></table>", [], [["ab", "b"]]),
        ("<table><tr></tr><tr><td>a<table><tr><td>in</td></tr></table></td></tr></table>", [], [["ain", "in"], ["in"]]),
    ],
)
def test_first_table(html, headers, rows):
    assert first_table(html) == (None if headers is None else {"headers": headers, "rows": rows})


@pytest.mark.parametrize("row", ["<tr><td>a<td>b", "<tr><td>x", "<tr><th>h<td>x"])
def test_missing_end_tags_cost_no_more(row):
    """Time is near linear: ten times the rows, far less than a hundred times as long."""
    html = "<table><tr><th>A</th><th>B</th></tr>" + row * 10_000
    start = time.perf_counter()
    table = first_table(html, whole=False)
    assert time.perf_counter() - start < 2
    assert len(table["rows"]) == 10_000
    assert {len(r) for r in table["rows"]} <= {0, len(table["headers"])}


def test_rows_that_do_not_fit_are_empty():
    html = "<table><tr><th>A</th><th>B</th></tr><tr><td>1</td></tr><tr><td>1</td><td>2</td></tr></table>"
    assert first_table(html, whole=False)["rows"] == [[], ["1", "2"]]
    assert first_table(html)["rows"] == [["1"], ["1", "2"]]


def test_round_trip(spark):
    source = spark.range(40).select(
        (F.col("id") % 4).alias("page"), F.concat(F.lit(" N<"), "id").alias("Name"), F.col("id").cast("string").alias("Team")
    )
    cell = "<tr><td>%s</td><td> <b>%s</b></td></tr>"
    row = F.format_string(cell, F.replace("Name", F.lit("<"), F.lit("&lt;")), "Team")
    html = F.concat(F.lit("<table><tr><th>Name</th><th>Team</th></tr>"), F.array_join(F.collect_list(row), ""), F.lit("<tr><td>short</td></tr></table>"))
    stored = source.groupBy("page").agg(html.alias("html"))
    got = pages.table_records(pages.with_table(stored)).select("page", "record").collect()
    assert sorted((r.page, r.record["Name"], r.record["Team"]) for r in got) == sorted(
        (i % 4, f"N<{i}", str(i)) for i in range(40)
    )


def test_equal_headers_last_wins(spark):
    frame = spark.createDataFrame([(["A", "B", "A"], ["1", "2", "3"])], "h array<string>, c array<string>")
    assert frame.select(pages.zip_record(F.col("h"), F.col("c")).alias("r")).first().r == {"A": "3", "B": "2"}


def test_urls(spark):
    frame = spark.createDataFrame([("/stats/x", 1), ("/stats/x", 12)], "path string, n int")
    urls = frame.withColumn("url", pages.page_url("https://h.example/", F.col("path"), F.col("n")))
    back = urls.select("url", pages.page_path(F.col("url")).alias("p"), pages.page_number(F.col("url")).alias("n"))
    assert [tuple(r) for r in back.collect()] == [
        ("https://h.example/stats/x", "/stats/x", 1),
        ("https://h.example/stats/x/p12", "/stats/x", 12),
    ]


def test_sequence_stops_at_gap_bad_page_and_limit(spark):
    good = {"a": range(1, 13), "gap": [1, 2, 4], "late": [2, 3], "bad": [1, 2, 3]}
    rows = [(s, n, not (s == "bad" and n == 2)) for s, numbers in good.items() for n in numbers]
    frame = spark.createDataFrame(rows, "s string, page_no int, ok boolean")
    cut = pages.cut_page_sequence(frame, ["s"], F.col("ok")).collect()
    got = {s: sorted(r.page_no for r in cut if r.s == s) for s in good}
    assert got == {"a": list(range(1, 11)), "gap": [1, 2], "late": [], "bad": [1]}


def test_newest_copy_and_usable(spark):
    rows = [("u1", 1, "<table><tr><th>A</th></tr><tr><td>1</td></tr></table>"), ("u1", 2, "<table></table>"), ("u2", 3, "x")]
    frame = spark.createDataFrame(rows, "url string, page_id int, html string")
    once = pages.newest_copies(frame, [F.col("page_id").desc()])
    assert sorted((r.url, r.page_id) for r in once.collect()) == [("u1", 2), ("u2", 3)]
    usable = pages.with_table(frame).select("page_id", pages.usable_page().alias("ok")).orderBy("page_id")
    assert [r.ok for r in usable.collect()] == [True, False, False]


def test_cycles_and_status(spark):
    table = "<table><tr><th>Name</th><th>Team</th><th>BA</th></tr><tr><td>%s</td><td>T</td><td>.3</td></tr></table>"
    path = "https://h.example/stats/baseball/d1/current/individual/200"
    rows = [
        (1, path, 1, table % "old", 200),
        (1, path, 2, table % "a", 200),
        (1, path + "/p2", 3, table % "b", 500),
        (2, path, 4, table % "c", 200),
        (2, path + "/p2", 5, table % "d", 200),
        (2, "https://h.example/other", 6, table % "e", 200),
    ]
    frame = spark.createDataFrame(rows, "cycle int, url string, page_id int, html string, status int")
    events = pages.scrape_events(frame, [F.col("page_id").desc()], cycle=["cycle"])
    got = [(r.cycle, r.stat_category, r.record["Name"]) for r in events.orderBy("page_id").collect()]
    assert got == [(1, "Batting Average", "a"), (2, "Batting Average", "c"), (2, "Batting Average", "d")]
