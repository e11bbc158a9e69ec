"""Stored web pages to statistic records."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leaderstream.metrics import STAT_PAGES
from leaderstream.operators.balance import top_k_per_group
from leaderstream.operators.flatten import encode_events
from leaderstream.sources.html_table import first_table_udf

# Fixed value: pages read per metric.
MAX_PAGES = 10


def page_url(base: str, path: Column, page_no: Column) -> Column:
    """URL of a metric's page: ``/p{n}`` is appended from page 2 on."""
    root = F.lit(base.rstrip("/"))
    return F.concat(root, path, F.when(page_no > 1, F.concat(F.lit("/p"), page_no)).otherwise(F.lit("")))


def page_number(url: Column) -> Column:
    """Inverse of ``page_url``: 1 unless the URL ends in ``/p{n}``."""
    return F.coalesce(F.regexp_extract(url, r"/p(\d+)$", 1).try_cast("int"), F.lit(1))


def page_path(url: Column) -> Column:
    """Path of a metric's pages, without host and page number."""
    return F.regexp_replace(F.regexp_replace(url, r"^[a-z]+://[^/]+", ""), r"/p\d+$", "")


def newest_copies(pages: DataFrame, newest: Sequence[Column]) -> DataFrame:
    """One page per URL: a URL is visited once."""
    return top_k_per_group(pages, ["url"], newest, 1).drop("_pos")


def with_table(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds ``table`` (``headers``, ``rows``), both NULL for a page without one.

    Only pages that contain a table tag are handed to Python.
    """
    candidate = F.when(F.col(html).rlike("(?i)<table"), F.col(html))
    return pages.withColumn("table", first_table_udf(candidate))


def usable_page() -> Column:
    """A page with a table that has at least one row below the header."""
    return F.coalesce(F.size("table.rows") > 0, F.lit(False))


def cut_page_sequence(
    pages: DataFrame, sequence: Sequence[str], usable: Column, page_no: str = "page_no", max_pages: int = MAX_PAGES
) -> DataFrame:
    """Pages of each sequence up to the first missing or unusable one.

    ``pages`` holds each page number of a sequence once (see
    ``newest_copies``), so a window covers at most ``max_pages`` rows.
    """
    in_order = W.partitionBy(*sequence).orderBy(page_no)
    so_far = in_order.rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        pages.where(F.col(page_no).between(1, max_pages))
        .withColumn("_stop", ~usable | (F.row_number().over(in_order) != F.col(page_no)))
        .withColumn("_stopped", F.max("_stop").over(so_far))
        .where(~F.col("_stopped"))
        .drop("_stop", "_stopped")
    )


def zip_record(headers: Column, cells: Column) -> Column:
    """Header to cell map. Of equal headers the last one counts."""
    entries = F.transform(headers, lambda h, i: F.struct(h.alias("key"), F.get(cells, i).alias("value")))
    last = F.filter(entries, lambda e, i: ~F.array_contains(F.slice(headers, i + 2, F.size(headers)), e["key"]))
    return F.map_from_entries(last)


def table_records(pages: DataFrame) -> DataFrame:
    """One row per table row with as many cells as there are headers.

    Expects ``with_table``; adds ``row_no`` (from 1) and the ``record`` map.
    """
    rest = [c for c in pages.columns if c not in {"table", "html"}]
    rows = pages.select(
        *rest, F.col("table.headers").alias("_headers"), F.posexplode("table.rows").alias("_pos", "_cells")
    )
    valid = (F.size("_cells") > 0) & (F.size("_cells") == F.size("_headers"))
    return rows.where(valid).select(
        *rest,
        (F.col("_pos") + 1).alias("row_no"),
        zip_record(F.col("_headers"), F.col("_cells")).alias("record"),
    )


def known_pages(
    pages: DataFrame, stat_pages: Sequence[tuple[str, str, str]] = STAT_PAGES, max_pages: int = MAX_PAGES
) -> DataFrame:
    """Pages of the listed metrics with ``path, page_no, entity_type, stat_category``."""

    def lookup(pairs: list[tuple[str, str]]) -> Column:
        literal = F.create_map(*[F.lit(v) for v in chain.from_iterable(pairs)])
        return F.try_element_at(literal, F.col("path"))

    located = pages.withColumns({"path": page_path(F.col("url")), "page_no": page_number(F.col("url"))})
    named = located.withColumns(
        {
            "entity_type": lookup([(path, entity) for entity, _, path in stat_pages]),
            "stat_category": lookup([(path, metric) for _, metric, path in stat_pages]),
        }
    )
    return named.where(F.col("entity_type").isNotNull() & F.col("page_no").between(1, max_pages))


def scrape_events(
    pages: DataFrame,
    newest: Sequence[Column],
    time: Column | None = None,
    cycle: Sequence[str] = (),
    stat_pages: Sequence[tuple[str, str, str]] = STAT_PAGES,
) -> DataFrame:
    """Stored pages (``url, html`` and, if known, ``status``) to event messages.

    Per metric, pages count in order up to the first that is missing, failed or
    without table rows. A page stored more than once counts in its ``newest``
    copy; with ``cycle`` columns each scrape cycle stands for itself. ``time``
    is the time of the events, now by default.
    """
    once = top_k_per_group(known_pages(pages, stat_pages), [*cycle, "url"], newest, 1).drop("_pos")
    parsed = with_table(once)
    usable = usable_page()
    if "status" in pages.columns:
        usable = usable & (F.col("status") == 200)
    read = cut_page_sequence(parsed, [*cycle, "path"], usable)
    return encode_events(table_records(read), F.col("record"), time)
