"""Every operator as a query over the given tables: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leaderstream.functions import naming, values
from leaderstream.metrics import INDIVIDUAL, TEAM
from leaderstream.operators import flatten as fl
from leaderstream.operators import history, prompts, ranking, serving, upsert
from leaderstream.plans import fixtures as fx
from leaderstream.session import settled, shared_dir
from leaderstream.sources import board_tables, messages, pages
from leaderstream.streaming import ingest, latest
from leaderstream.streaming.bucket_log import BucketLog
from leaderstream.streaming.epoch_log import EpochLog
from leaderstream.streaming.served import ServedRows

Query = Callable[[SparkSession, str], DataFrame]
PLAYER = ["table_name", "Name", "Team", "Cl", "Position", "Value"]


def _time() -> Column:
    return values.utc_text(F.col("event_time")).alias("event_time")


# Events to rows


def envelope_parse(spark: SparkSession, sf: str) -> DataFrame:
    decoded = fl.decode_envelopes(fx.player_messages(spark, sf))
    return decoded.select("offset", "stat_category", "stat_type", _time(), "player_stats", "team_stats")


def payload_flatten(spark: SparkSession, sf: str) -> DataFrame:
    return fl.flatten(fl.decode_envelopes(fx.player_messages(spark, sf))).select("offset", *PLAYER, _time())


def payload_flatten_team(spark: SparkSession, sf: str) -> DataFrame:
    return fl.flatten(fl.decode_envelopes(fx.team_messages(spark, sf))).select(
        "offset", "table_name", "Team", "Value", _time()
    )


def payload_routing(spark: SparkSession, sf: str) -> DataFrame:
    both = fx.player_messages(spark, sf).unionByName(fx.team_messages(spark, sf))
    return fl.route_payloads(fl.decode_envelopes(both)).select("entity_type", "offset", "stat_category", "payload")


def quarantine_counts(spark: SparkSession, sf: str) -> DataFrame:
    rejected = fl.rejected_events(fl.judge_events(fx.damaged_messages(spark, sf)))
    return rejected.groupBy("reason").agg(F.count("*").alias("messages"))


def column_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Envelopes that lack one payload column still give the rows of the other."""
    decoded = fl.decode_envelopes(fx.player_messages(spark, sf)).drop("team_stats")
    return fl.flatten(decoded).select("offset", *PLAYER)


def empty_table(spark: SparkSession, sf: str) -> DataFrame:
    """The typed empty table, as the state that the first batch meets."""
    return upsert.apply_batch(fl.empty_stats(spark), fx.teams(spark, sf)).select("offset", "table_name", "Team", "Value")


def batch_categories(spark: SparkSession, sf: str) -> DataFrame:
    both = fx.players(spark, sf).unionByName(fx.teams(spark, sf))
    return both.select("entity_type", "batch_id", "stat_category").distinct()


def event_out(spark: SparkSession, sf: str) -> DataFrame:
    return fx.player_messages(spark, sf).select("offset", F.col("value").cast("string").alias("value"))


# Names


def table_names(spark: SparkSession, sf: str) -> DataFrame:
    part = fx.read(spark, sf, "part")
    text = F.concat(F.lit(" "), F.col("p_brand"), F.lit(" K/9x "), F.col("p_type"), F.lit("\t"))
    metrics = part.select(text.alias("category")).distinct()
    categories = metrics.unionByName(fx.players(spark, sf).select(F.col("stat_category").alias("category")).distinct())
    categories = categories.unionByName(
        fx.teams(spark, sf).select(F.col("stat_category").alias("category")).distinct()
    ).distinct()
    name = F.concat(F.lit("team_"), naming.safe_name(F.col("category")))
    return categories.withColumn("table_name", name).select(
        "category",
        "table_name",
        naming.metric_name(F.col("table_name")).alias("metric"),
        naming.display_title(F.col("table_name")).alias("title"),
        naming.menu_label(F.col("table_name")).alias("label"),
        naming.section_id(naming.display_title(F.col("table_name"))).alias("section"),
        values.or_unknown(F.nullif(F.regexp_extract("category", "Brand#[0-9]+", 0), F.lit(""))).alias("brand"),
    )


def list_tables(spark: SparkSession, sf: str) -> DataFrame:
    both = fx.players(spark, sf).unionByName(fx.teams(spark, sf))
    return serving.list_tables(both, INDIVIDUAL).unionByName(serving.list_tables(both, TEAM))


# Upserts


def anti_join_keys(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.players(spark, sf)
    # One number: the last batch.
    last = rows.agg(F.max("batch_id")).scalar()
    state, batch = rows.where(F.col("batch_id") < last), rows.where(F.col("batch_id") == last)
    return upsert.anti_join_keys(state, batch).select("offset", *PLAYER)


def upsert_one_batch(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.teams(spark, sf)
    last = rows.agg(F.max("batch_id")).scalar()
    state, batch = rows.where(F.col("batch_id") < last), rows.where(F.col("batch_id") == last)
    return upsert.apply_batch(state, batch).select("offset", "table_name", "Team", "Value", "batch_id")


def upsert_individual(spark: SparkSession, sf: str) -> DataFrame:
    return upsert.resolve_batches(fx.players(spark, sf)).select("offset", *PLAYER, "batch_id")


def upsert_team(spark: SparkSession, sf: str) -> DataFrame:
    return upsert.resolve_batches(fx.teams(spark, sf)).select("offset", "table_name", "Team", "Value", "batch_id")


def upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    latest_rows = upsert.upsert_latest(fx.teams(spark, sf))
    return latest_rows.select("table_name", "Team", "Value", _time(), "offset")


def upsert_latest_individual(spark: SparkSession, sf: str) -> DataFrame:
    return upsert.upsert_latest(fx.players(spark, sf)).select(*PLAYER, _time(), "offset")


# Earlier states


def validity_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return history.validity(fx.teams(spark, sf)).select("offset", "table_name", "Team", "Value", "batch_id", "valid_to")


def states_at_times(spark: SparkSession, sf: str) -> DataFrame:
    """The individual tables as they were after some days."""
    states = history.states_at(fx.players(spark, sf), fx.STATE_DAYS)
    return states.select("as_of", "offset", *PLAYER, "batch_id")


def as_of_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """What was current a week before each day on which a player's row came."""
    rows = fx.players(spark, sf)
    week_before = rows.select("table_name", "Name", "Team", (F.col("batch_id") - 7).alias("as_of"))
    return history.as_of(week_before, rows).select("as_of", "offset", *PLAYER, "batch_id")


# Leaderboards


def rank_lexicographic(spark: SparkSession, sf: str) -> DataFrame:
    state = upsert.resolve_batches(fx.players(spark, sf))
    return ranking.leaderboards(state, by="text").select(*PLAYER, "Rank", "offset")


def rank_numeric(spark: SparkSession, sf: str) -> DataFrame:
    state = upsert.resolve_batches(fx.teams(spark, sf))
    return ranking.leaderboards(state).select("table_name", "Team", "Value", "Rank", "offset")


def rank_all_rows(spark: SparkSession, sf: str) -> DataFrame:
    both = upsert.resolve_batches(fx.players(spark, sf)).unionByName(upsert.resolve_batches(fx.teams(spark, sf)))
    return ranking.rank_all(both).select(*PLAYER, "Rank", "place", "offset")


def rank_all_text(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.rank_all(fx.teams(spark, sf), by="text").select("table_name", "Team", "Value", "Rank", "place", "offset")


def leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: messages of players and teams parsed into a log, upserted and ranked."""
    log = EpochLog(spark, shared_dir(spark, "leaderboard"))
    # In one pass, the longer tasks first, so that cores don't wait for the last tasks of either part.
    sent = fx.team_messages(spark, sf).unionByName(fx.player_messages(spark, sf))
    log.append(fl.flatten(fl.decode_envelopes(sent)), 0, batch="batch_id")
    return ranking.leaderboards(log.state()).select(*PLAYER, "Rank")


def unranked_limit(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.players(spark, sf).withColumn("table_name", F.lit("individual_wl_pct"))
    return ranking.leaderboard(rows, "individual_wl_pct").select(*PLAYER, "Rank", "offset")


def leaderboard_filtered(spark: SparkSession, sf: str) -> DataFrame:
    served = ranking.leaderboards(fx.players(spark, sf))
    return serving.filter_rows(served, team="Team 1", cl="Cl 2").select(*PLAYER, "Rank")


def facet_values(spark: SparkSession, sf: str) -> DataFrame:
    return serving.facet_values(ranking.leaderboards(fx.players(spark, sf)))


def facet_counts(spark: SparkSession, sf: str) -> DataFrame:
    return serving.facet_counts(upsert.resolve_batches(fx.players(spark, sf)))


def facet_options(spark: SparkSession, sf: str) -> DataFrame:
    return serving.facet_options(serving.facet_counts(ranking.leaderboards(fx.players(spark, sf))))


def numeric_aware_sort(spark: SparkSession, sf: str) -> DataFrame:
    served = ranking.leaderboards(fx.part_rows(spark, sf))
    up = serving.sort_served(served, "Value").withColumn("direction", F.lit("up"))
    down = serving.sort_served(served, "Value", ascending=False).withColumn("direction", F.lit("down"))
    return up.unionByName(down).select("table_name", "Name", "Value", "direction", "sort_position")


def table_by_name(spark: SparkSession, sf: str) -> DataFrame:
    served = ranking.leaderboard(fx.teams(spark, sf), "team_whip", by="text")
    return serving.records(served).select("table_name", "place", "record")


def table_view(spark: SparkSession, sf: str) -> DataFrame:
    serving.register_view(fx.players(spark, sf), "individual_whip")
    return spark.sql("SELECT Name, Team, Cl, Position, Value FROM individual_whip WHERE Team = 'Team 3'")


def snapshot_json(spark: SparkSession, sf: str) -> DataFrame:
    both = fx.players(spark, sf).unionByName(fx.teams(spark, sf))
    return serving.snapshots(ranking.leaderboards(both), prefix="")


def latest_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    both = fx.players(spark, sf).unionByName(fx.teams(spark, sf))
    first = serving.snapshots(ranking.leaderboards(both, by="text"), prefix="")
    second = serving.snapshots(ranking.leaderboards(both))
    published = first.withColumn("version", F.lit(1)).unionByName(second.withColumn("version", F.lit(2)))
    return serving.latest_snapshots(published)


# Prompts


def _prompt_records(spark: SparkSession, sf: str) -> DataFrame:
    both = fx.players(spark, sf).unionByName(fx.teams(spark, sf))
    return serving.records(ranking.leaderboards(both, rows=prompts.PROMPT_ROWS))


def request_check(spark: SparkSession, sf: str) -> DataFrame:
    return prompts.check_requests(fx.questions(spark, sf)).select("question_id", "type", "valid")


def _asked_and_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    both = fx.players(spark, sf).unionByName(fx.teams(spark, sf))
    tables = serving.list_tables(both, INDIVIDUAL).unionByName(serving.list_tables(both, TEAM))
    return prompts.check_requests(fx.questions(spark, sf)).where("valid"), settled(tables)


def relevance_scores(spark: SparkSession, sf: str) -> DataFrame:
    return prompts.relevance(*_asked_and_tables(spark, sf)).select("question_id", "table_name", "score")


def relevance_top_tables(spark: SparkSession, sf: str) -> DataFrame:
    picks = prompts.relevant_tables(*_asked_and_tables(spark, sf))
    return picks.select("question_id", "table_name", "score", "place")


def prompt_context(spark: SparkSession, sf: str) -> DataFrame:
    return prompts.build_prompts(fx.questions(spark, sf), _prompt_records(spark, sf))


# Pages


def html_table_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = pages.table_records(pages.with_table(fx.stat_pages(spark, sf)))
    cells = [F.try_element_at("record", F.lit(h)).alias(h) for h in ("Name", "Team", "BA")]
    return rows.select("page_id", "row_no", *cells)


def page_events(spark: SparkSession, sf: str) -> DataFrame:
    rows = pages.table_records(pages.with_table(fx.stat_pages(spark, sf))).withColumn(
        "stat_category", F.lit("Batting Average")
    )
    time = F.timestamp_seconds(1704067200 + F.col("page_id"))
    return fl.encode_events(rows, F.col("record"), time, F.lit(INDIVIDUAL)).select("page_id", "row_no", "value")


def page_sequence_cut(spark: SparkSession, sf: str) -> DataFrame:
    visits = fx.page_visits(spark, sf)
    path = F.concat(F.lit("/stats/"), F.col("site"))
    urls = visits.withColumn("url", pages.page_url("https://www.example.com/", path, F.col("number")))
    once = pages.newest_copies(urls, [F.col("page_id").desc()])
    sequence = once.select(
        pages.page_path(F.col("url")).alias("path"),
        pages.page_number(F.col("url")).alias("page_no"),
        "url",
        "page_id",
        "usable",
    )
    cut = pages.cut_page_sequence(sequence, ["path"], F.col("usable"))
    return cut.select("path", "page_no", "url", "page_id")


def scrape_events(spark: SparkSession, sf: str) -> DataFrame:
    time = F.timestamp_seconds(1704067200 + F.col("page_id"))
    events = pages.scrape_events(fx.scraped_pages(spark, sf), [F.col("page_id").desc()], time)
    return events.select("url", "page_no", "row_no", "value")


# Streams: one epoch for each batch


def _stream(spark: SparkSession, sent: DataFrame, purpose: str) -> DataFrame:
    path, files = fx.message_files(sent, purpose)
    return messages.table_stream(spark, path, max_files=files).select("value", "offset")


def _player_stream(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.weekly(fx.player_rows(fx.read(spark, sf, "events")))
    return _stream(spark, fx.messages(rows), "player-messages")


def _team_stream(spark: SparkSession, sf: str) -> DataFrame:
    return _stream(spark, fx.messages(fx.team_rows(fx.read(spark, sf, "lineitem"))), "team-messages")


def _ingested(spark: SparkSession, source: DataFrame, purpose: str, **options) -> EpochLog:
    log = EpochLog(spark, shared_dir(spark, purpose))
    ingest.start_ingest(source, log, available_now=True, **options).awaitTermination()
    return log


def stream_upsert(spark: SparkSession, sf: str) -> DataFrame:
    state = _ingested(spark, _player_stream(spark, sf), "stream-upsert", compact_every=2).state()
    return state.select("offset", *PLAYER, "batch_id")


def stream_upsert_team(spark: SparkSession, sf: str) -> DataFrame:
    options = {"compact_every": 2, "full_every": 4, "retention_seconds": 0}
    state = _ingested(spark, _team_stream(spark, sf), "stream-upsert-team", **options).state()
    return state.select("offset", "table_name", "Team", "Value", "batch_id")


def stream_buckets(spark: SparkSession, sf: str) -> DataFrame:
    log = BucketLog(spark, shared_dir(spark, "stream-buckets"), buckets=4)
    ingest.start_ingest(_player_stream(spark, sf), log, available_now=True, compact_every=1).awaitTermination()
    return log.state().select("offset", *PLAYER, "batch_id")


def stream_buckets_team(spark: SparkSession, sf: str) -> DataFrame:
    log = BucketLog(spark, shared_dir(spark, "stream-buckets-team"), buckets=4)
    options = {"compact_every": 1, "retention_seconds": 0}
    ingest.start_ingest(_team_stream(spark, sf), log, available_now=True, **options).awaitTermination()
    return log.state().select("offset", "table_name", "Team", "Value", "batch_id")


def stream_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Tables by name from a source that was registered before the stream began."""
    log = BucketLog(spark, shared_dir(spark, "stream-tables"), buckets=4)
    board_tables.register_table(spark, log.root, "board_tables_query")
    ingest.start_ingest(_player_stream(spark, sf), log, available_now=True).awaitTermination()
    return spark.sql(
        "SELECT table_name, Name, Team, Cl, Position, Value, offset FROM board_tables_query "
        "WHERE table_name IN ('individual_whip', 'individual_saves')"
    )


def stream_latest(spark: SparkSession, sf: str) -> DataFrame:
    log = EpochLog(spark, shared_dir(spark, "stream-latest"))
    for query in latest.start_latest_events(_player_stream(spark, sf), log, available_now=True, compact_every=3):
        query.awaitTermination()
    return log.state().select(*PLAYER, _time(), "offset")


def stream_rejects(spark: SparkSession, sf: str) -> DataFrame:
    log = EpochLog(spark, shared_dir(spark, "stream-rejects"))
    damaged = fx.damaged_messages(spark, sf).withColumn("batch_id", F.col("offset") % 4)
    source = _stream(spark, damaged, "damaged-messages")
    for query in latest.start_latest_events(source, log, available_now=True):
        query.awaitTermination()
    rejects = spark.read.parquet(f"{log.root}/rejects")
    return rejects.groupBy("reason").agg(F.count("*").alias("messages"))


def stream_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    log = EpochLog(spark, shared_dir(spark, "stream-snapshots"))
    served = ServedRows(log)
    ingest.start_ingest(_team_stream(spark, sf), log, available_now=True, served=served).awaitTermination()
    path = f"{log.root}/snapshots"
    ingest.publish_snapshots(log, path, 1, prefix=TEAM, served=served)
    return serving.latest_snapshots(spark.read.parquet(path))


def stream_served(spark: SparkSession, sf: str) -> DataFrame:
    """Served rows kept up over the epochs of a stream, with a reserve so small that tables run dry."""
    log = EpochLog(spark, shared_dir(spark, "stream-served"))
    served = ServedRows(log, reserve=20)
    ingest.start_ingest(_player_stream(spark, sf), log, available_now=True, served=served).awaitTermination()
    return served.read().select(*PLAYER, "Rank", "place", "offset")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        envelope_parse,
        payload_flatten,
        payload_flatten_team,
        payload_routing,
        quarantine_counts,
        column_guard,
        empty_table,
        batch_categories,
        event_out,
        table_names,
        list_tables,
        anti_join_keys,
        upsert_one_batch,
        upsert_individual,
        upsert_team,
        upsert_latest,
        upsert_latest_individual,
        validity_intervals,
        states_at_times,
        as_of_lookup,
        rank_lexicographic,
        rank_numeric,
        rank_all_rows,
        rank_all_text,
        leaderboard,
        unranked_limit,
        leaderboard_filtered,
        facet_values,
        facet_counts,
        facet_options,
        numeric_aware_sort,
        table_by_name,
        table_view,
        snapshot_json,
        latest_snapshot,
        request_check,
        relevance_scores,
        relevance_top_tables,
        prompt_context,
        html_table_rows,
        page_events,
        page_sequence_cut,
        scrape_events,
        stream_upsert,
        stream_upsert_team,
        stream_buckets,
        stream_buckets_team,
        stream_tables,
        stream_latest,
        stream_rejects,
        stream_snapshots,
        stream_served,
    )
}
