"""Commands for ``spark-submit``: ingest events, look at the boards."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from leaderstream.board import Board
from leaderstream.operators import serving
from leaderstream.sources import messages, pages


def topic_options(args: argparse.Namespace) -> dict[str, str]:
    """Options of the topic reader: those with a name of their own, then any other."""
    options = {"maxOffsetsPerTrigger": str(args.max_offsets)}
    if args.min_partitions:
        options["minPartitions"] = str(args.min_partitions)
    for option in args.option:
        name, equals, value = option.partition("=")
        if not equals:
            raise ValueError(f"{option} is not NAME=VALUE")
        options[name] = value
    return options


def _arguments(given: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="leaderstream", description=__doc__)
    parser.add_argument("--root", required=True, help="shared folder of the board")
    parser.add_argument("--by", choices=("number", "text"), default="number", help="how values are compared")
    steps = parser.add_subparsers(dest="step", required=True)
    ingest = steps.add_parser("ingest", help="run a stream of events into the board")
    source = ingest.add_mutually_exclusive_group(required=True)
    source.add_argument("--files", help="folder of text files, one event per line")
    source.add_argument("--topic", help="topic to subscribe to")
    ingest.add_argument("--servers", help="brokers of the topic")
    ingest.add_argument("--every", default="5 seconds", help="time between batches")
    ingest.add_argument("--once", action="store_true", help="stop when all present events are read")
    ingest.add_argument(
        "--option", action="append", default=[], metavar="NAME=VALUE", help="option of the topic reader, repeatable"
    )
    ingest.add_argument("--max-offsets", type=int, default=1_000_000, help="messages of a batch at most")
    ingest.add_argument("--min-partitions", type=int, help="tasks that read a batch at least")
    ingest.add_argument("--compact-every", type=int, default=500, help="epochs between folds")
    ingest.add_argument("--full-every", type=int, default=20_000, help="epochs between folds of everything")
    ingest.add_argument("--retention", type=float, default=3600, help="seconds that folded epochs stay")
    ingest.add_argument("--null-keys", choices=("keep", "reject"), default="keep")
    ingest.add_argument("--snapshots", help="folder for JSON snapshots of changed tables")
    scrape = steps.add_parser("scrape", help="events from a parquet table of stored pages (url, html, page_id)")
    scrape.add_argument("--pages", required=True)
    scrape.add_argument("--out", required=True, help="folder for the events")
    tables = steps.add_parser("tables", help="names of the tables")
    tables.add_argument("--type", default="individual")
    show = steps.add_parser("show", help="served rows of one table")
    show.add_argument("table")
    show.add_argument("--team", default="")
    show.add_argument("--cl", default="")
    show.add_argument("--position", default="")
    show.add_argument("--sort", help="column to sort by")
    show.add_argument("--descending", action="store_true")
    ask = steps.add_parser("prompt", help="prompt for one question")
    ask.add_argument("question")
    ask.add_argument("--type", default="individual")
    compact = steps.add_parser("compact", help="fold the epochs since the last time")
    compact.add_argument("--full", action="store_true", help="fold everything into a new base")
    return parser.parse_args(given)


def main() -> None:
    args = _arguments()
    spark = (
        SparkSession.builder.appName("leaderstream").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    board = Board(spark, args.root, by=args.by)
    if args.step == "ingest":
        if args.files:
            source = messages.file_stream(spark, args.files)
        else:
            source = messages.topic_stream(spark, args.servers, args.topic, **topic_options(args))
        trigger = {"available_now": True} if args.once else {"processing_time": args.every}
        board.ingest(
            source,
            compact_every=args.compact_every,
            full_every=args.full_every,
            retention_seconds=args.retention,
            null_keys=args.null_keys,
            snapshots_to=args.snapshots,
            **trigger,
        ).awaitTermination()
    elif args.step == "scrape":
        events = pages.scrape_events(spark.read.parquet(args.pages), [F.col("page_id").desc()])
        messages.write_files(events, args.out)
    elif args.step == "tables":
        for row in board.tables(args.type).toLocalIterator():
            print(row.table_name)
    elif args.step == "show":
        rows = board.leaderboard(args.table, args.team, args.cl, args.position)
        column = args.sort or "place"
        ordered = serving.sort_rows(rows, column, not args.descending, ties=("place",))
        ordered.select("Rank", "Name", "Team", "Cl", "Position", "Value").show(300, truncate=False)
    elif args.step == "prompt":
        asked = spark.createDataFrame([(1, args.question, args.type)], "question_id int, query string, type string")
        answer = board.prompts(asked).first()
        print(answer.prompt or answer.message)
    elif args.step == "compact":
        print(board.compact(args.full))


if __name__ == "__main__":
    main()
