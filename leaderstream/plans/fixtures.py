"""The given tables as statistics: players from events, teams from line items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leaderstream.metrics import INDIVIDUAL, METRICS, STAT_PAGES, TEAM, table_name_of, value_field, value_fields
from leaderstream.operators.flatten import STATS, encode_events
from leaderstream.session import shared_dir
from leaderstream.sources.pages import page_url

# Metric each event type stands for. ``Saves`` is in no dimension: unranked.
EVENT_METRICS = {
    "click": "Slugging Percentage",
    "view": "Strikeouts Per Nine Innings",
    "error": "Earned Run Average",
    "signup": "WHIP",
    "purchase": "Saves",
}
# Metric each pair of return flag and line status stands for.
LINE_METRICS = {
    "AF": "WL Pct",
    "NF": "Fielding Percentage",
    "NO": "Earned Run Average",
    "RF": "WHIP",
    "AO": "Slugging Percentage",
    "RO": "Saves",
}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _chosen(value: Column, names: dict[str, str]) -> Column:
    literal = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.try_element_at(literal, value)


#: Days after which ``states_at_times`` looks.
STATE_DAYS = (0, 7, 20, 90, 400)


def _money(value: Column) -> Column:
    return value.cast("decimal(18,2)").cast("string")


def player_rows(events: DataFrame) -> DataFrame:
    """Events (batch or stream) in the shape of the statistics table, table name aside."""
    k = F.get_json_object("props", "$.k").cast("int")
    user = F.col("user_id")
    return events.select(
        F.lit(INDIVIDUAL).alias("entity_type"),
        _chosen(F.col("event_type"), EVENT_METRICS).alias("stat_category"),
        F.when(user >= 3, F.concat(F.lit("Player "), user.cast("string"))).alias("Name"),
        F.concat(F.lit("Team "), (k % 5).cast("string")).alias("Team"),
        F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("Cl "), (k % 4).cast("string"))).alias("Cl"),
        (k % 3).cast("string").alias("Position"),
        _money(F.col("value")).alias("Value"),
        F.date_trunc("second", F.col("ts").cast("timestamp")).alias("event_time"),
        F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("bigint").alias("batch_id"),
        F.col("event_id").alias("offset"),
    )


def team_rows(lineitem: DataFrame) -> DataFrame:
    """Line items in the shape of the statistics table, table name aside."""
    nothing = F.lit(None).cast("string")
    return lineitem.select(
        F.lit(TEAM).alias("entity_type"),
        _chosen(F.concat("l_returnflag", "l_linestatus"), LINE_METRICS).alias("stat_category"),
        nothing.alias("Name"),
        F.concat(F.lit("Supplier "), F.col("l_suppkey").cast("string")).alias("Team"),
        nothing.alias("Cl"),
        nothing.alias("Position"),
        _money(F.col("l_extendedprice")).alias("Value"),
        F.col("l_shipdate").cast("timestamp").alias("event_time"),
        (F.year("l_shipdate") - 1995).cast("bigint").alias("batch_id"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("offset"),
    )


def _named(rows: DataFrame) -> DataFrame:
    name = table_name_of(METRICS, F.col("entity_type"), F.col("stat_category"))
    named = rows.withColumn("table_name", name)
    return named.select(*STATS.fieldNames())


def players(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(player_rows(read(spark, sf_dir, "events")))


def teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(team_rows(read(spark, sf_dir, "lineitem")))


def messages(rows: DataFrame) -> DataFrame:
    """Statistic rows as messages: ``value`` in bytes, ``offset`` and ``batch_id``."""
    field = value_field(METRICS, F.col("entity_type"), F.col("stat_category"))
    rows = rows.withColumn("_field", field)
    # A struct leaves fields without a value out of the JSON; to filter a map Spark interprets a function for each row.
    value = [F.when(F.col("_field") == f, F.col("Value")).alias(f) for f in value_fields(METRICS)]
    record = F.struct("Name", "Team", "Cl", "Position", *value)
    encoded = encode_events(rows, record, F.col("event_time"))
    return encoded.select(F.col("value").cast("binary").alias("value"), "offset", "batch_id")


def player_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(player_rows(read(spark, sf_dir, "events")))


def team_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(team_rows(read(spark, sf_dir, "lineitem")))


# Files of a batch of a stream, unless it has so many rows that it needs more or so few that it needs less.
BATCH_FILES = 8
FILE_ROWS = 500_000
SMALL_FILE_ROWS = 1_000


def message_files(messages: DataFrame, purpose: str, file_rows: int = FILE_ROWS) -> tuple[str, int]:
    """Messages in a fresh folder, and how many files each of their few batches has there.

    All batches are encoded and written in one pass. A file has about ``file_rows`` rows at most, so that files, and the
    tasks that write them, grow in number and not in size. Files of a batch are as old as its place in the order of
    batches, which is the order streams read files in.
    """
    spark = messages.sparkSession
    path = shared_dir(spark, purpose)
    # A number for each batch.
    rows = {r["batch_id"]: r["count"] for r in messages.groupBy("batch_id").count().collect()}
    batches = sorted(rows)
    largest = max(rows.values(), default=0)
    files = max(1, min(BATCH_FILES, largest // SMALL_FILE_ROWS), -(-largest // file_rows))
    tasks = max(1, min(len(batches) * files, max(BATCH_FILES, -(-sum(rows.values()) // file_rows))))
    # By the message too: rows without an offset would meet in one file.
    slot = F.pmod(F.xxhash64("offset", "value"), F.lit(files)).alias("slot")
    dealt = messages.select("value", "offset", "batch_id", slot)
    # Each file is dealt to one task, in turn: by a hash, several would meet in some tasks.
    place = F.array_position(F.array(*[F.lit(b).cast("bigint") for b in batches]), F.col("batch_id"))
    task = F.pmod(place * files + F.col("slot"), F.lit(tasks)).cast("int")
    dealt.repartitionById(tasks, task).write.partitionBy("batch_id", "slot").parquet(path)
    # A stream takes whole batches only where all have the same number of files.
    empty = f"{path}-empty"
    spark.createDataFrame([], messages.select("value", "offset").schema).coalesce(1).write.parquet(empty)
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    fs = hadoop.Path(path).getFileSystem(conf)
    (nothing,) = fs.globStatus(hadoop.Path(f"{empty}/*.parquet"))
    for age, batch in enumerate(reversed(batches)):
        folder = f"{path}/batch_id={batch}"
        paths = [status.getPath() for status in fs.globStatus(hadoop.Path(f"{folder}/*/*.parquet"))]
        for n in range(len(paths), files):
            paths.append(hadoop.Path(f"{folder}/slot={files}/part-{n}.parquet"))
            hadoop.FileUtil.copy(fs, nothing.getPath(), fs, paths[-1], False, conf)
        for file in paths:
            fs.setTimes(file, _NEWEST - 1000 * age, -1)
    return path, files


# When the last batch of a stream was written: 2024-01-01, in milliseconds.
_NEWEST = 1_704_067_200_000


def weekly(rows: DataFrame) -> DataFrame:
    """Daily batches as batches of six days."""
    return rows.withColumn("batch_id", F.floor(F.col("batch_id") / 6))


def part_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as players, with values that mix numbers and words."""
    part = read(spark, sf_dir, "part").select(
        F.lit(INDIVIDUAL).alias("entity_type"),
        F.col("p_type").alias("stat_category"),
        F.concat(F.lit("Part "), F.col("p_partkey").cast("string")).alias("Name"),
        F.col("p_brand").alias("Team"),
        F.lit(None).cast("string").alias("Cl"),
        F.lit(None).cast("string").alias("Position"),
        F.when(F.col("p_partkey") % 3 == 0, F.col("p_size").cast("string"))
        .otherwise(F.col("p_brand"))
        .alias("Value"),
        F.lit(None).cast("timestamp").alias("event_time"),
        F.lit(0).cast("bigint").alias("batch_id"),
        F.col("p_partkey").alias("offset"),
    )
    return _named(part)


def damaged_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Player messages, some of them damaged in a way the event's ``k`` decides."""
    events = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    whole = messages(player_rows(events.withColumn("event_id", F.col("event_id") * 100 + k)))
    text, kind = F.col("value").cast("string"), F.col("offset") % 10
    head = F.lit('{"stat_category":"WHIP","player_stats":')
    value = (
        F.when(kind == 0, F.concat(F.lit("garbage "), F.col("offset").cast("string")))
        .when(kind == 1, F.left(text, F.length(text) - 2))
        .when(kind == 2, F.concat(head, F.lit("null}")))
        .when(kind == 3, F.regexp_replace(text, '"stat_category":"[^"]*",', ""))
        .when(kind == 4, F.concat(head, F.lit('"not json"}')))
        .otherwise(text)
    )
    return whole.select(value.alias("value"), "offset")


def _with_table(html: Column) -> Column:
    # The navigation list becomes a statistics table. Around it stay scripts,
    # comments and entities. Cells hold blanks, tags and an entity, one row is
    # short, and a second table follows.
    table = F.lit("<table class='stats'>\n<tr><th> Name</th><th>Team\n</th><th>BA</th></tr>")
    end = F.lit(
        "<tr><td>too short</td></tr></table><!-- <table> --><table><tr><th>Name</th></tr><tr><td>other</td></tr></table>"
    )
    row = F.concat(
        F.lit('<tr><td> <a href="/$1">$1</a>\n</td><td><b>$1</b> &amp; Co</td><td>.'),
        F.col("page_id").cast("string"),
        F.lit("<br></td></tr>"),
    )
    opened = F.replace(F.replace(html, F.lit("<nav><ul>"), table), F.lit("</ul></nav>"), end)
    return F.regexp_replace(opened, F.lit('<li><a href="[^"]*">([^<]*)</a></li>'), row)


def stat_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given pages, each with a statistics table."""
    return read(spark, sf_dir, "pages").select("page_id", "url", _with_table(F.col("html")).alias("html"))


def scraped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given pages as the pages of all listed metrics, some without a table."""
    paths = F.array(*[F.lit(path) for _, _, path in STAT_PAGES])
    count = F.lit(len(STAT_PAGES))
    path = F.get(paths, (F.col("page_id") % count).cast("int"))
    number = F.floor(F.col("page_id") / count) % 12 + 1
    links = F.regexp_count("html", F.lit("<li>"))
    return read(spark, sf_dir, "pages").select(
        "page_id",
        page_url("https://www.example.com", path, number).alias("url"),
        F.when(links > 4, _with_table(F.col("html"))).otherwise(F.col("html")).alias("html"),
    )


def page_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given pages as numbered pages of their site, several copies of some."""
    pages = read(spark, sf_dir, "pages")
    site = F.regexp_extract("url", "^[a-z]+://([^/]+)/", 1)
    number = F.regexp_extract("url", "/([0-9]+)", 1).cast("int") % 12 + 1
    links = F.regexp_count("html", F.lit("<li>"))
    return pages.select("page_id", site.alias("site"), number.alias("number"), (links > 4).alias("usable"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as questions; some ask for an unknown type."""
    turns = read(spark, sf_dir, "conversations")
    kind = F.when(F.col("conv_id") % 7 == 0, "player").when(F.col("role") == "user", " Individual ").otherwise("TEAM")
    return turns.select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("question_id"),
        F.col("text").alias("query"),
        kind.alias("type"),
    )
