"""Views on the statistics table: catalog, filters, facets, sorting, JSON."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leaderstream.functions.naming import display_title
from leaderstream.functions.values import leading_number, text_key
from leaderstream.metrics import INDIVIDUAL, TEAM

FACETS = ("Team", "Cl", "Position")
_KEEP_NULLS = {"ignoreNullFields": "false"}


def list_tables(stats: DataFrame, prefix: str = INDIVIDUAL) -> DataFrame:
    """Names of the tables that start with ``prefix``, in order."""
    return (
        stats.select("table_name")
        .where(F.col("table_name").startswith(prefix))
        .distinct()
        .orderBy("table_name")
    )


def read_table(stats: DataFrame, name: str) -> DataFrame:
    """Rows of one table; none for an unknown name."""
    return stats.where(F.col("table_name") == name)


def table_names(stats: DataFrame) -> list[str]:
    """The names of all tables, for what is done by name on the driver, like views."""
    found = stats.select("table_name").where(F.col("table_name").isNotNull()).distinct()
    return sorted(r["table_name"] for r in found.toLocalIterator())


def register_view(stats: DataFrame, name: str) -> None:
    """Name one metric table as a view for ``spark.sql``, replacing an older one."""
    columns = ["Team", "Value"] if name.startswith(TEAM) else ["Name", "Team", "Cl", "Position", "Value"]
    read_table(stats, name).select(*columns).createOrReplaceTempView(name)


def filter_rows(rows: DataFrame, team: str = "", cl: str = "", position: str = "") -> DataFrame:
    """Rows with the chosen facet values; an empty text chooses all.

    Meant for served rows: ranks stay as they are. Team tables have no filters.
    """
    for column, wanted in zip(FACETS, (team, cl, position), strict=True):
        if wanted:
            rows = rows.where((F.col("entity_type") != INDIVIDUAL) | (F.col(column) == wanted))
    return rows


def facet_values(rows: DataFrame) -> DataFrame:
    """Distinct values on offer for each filter, per table, neither NULL nor empty."""
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).alias("facet_value")) for c in FACETS])
    return (
        rows.where(F.col("entity_type") == INDIVIDUAL)
        .select("table_name", F.inline(pairs))
        .where(F.col("facet_value") != "")
        .distinct()
        .orderBy("table_name", "facet", "facet_value")
    )


def facet_counts(rows: DataFrame) -> DataFrame:
    """``table_name, Team, Cl, Position, n``: rows of individual tables under every combination of chosen values.

    An empty text chooses all, as in ``filter_rows``; combinations without rows are left out. Rows whose value is
    NULL or empty count where that facet is not chosen. Rows are counted by all three facets first, before the shuffle;
    the eight grouping sets add up these counts.
    """
    given = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in FACETS]
    cells = rows.where(F.col("entity_type") == INDIVIDUAL).select("table_name", *given)
    cells = cells.groupBy("table_name", *FACETS).agg(F.count("*").alias("_n"))
    sets = [("table_name", *chosen) for k in range(len(FACETS) + 1) for chosen in combinations(FACETS, k)]
    # A facet that is not chosen is NULL in its set, and no value is.
    counts = cells.groupingSets(sets, "table_name", *FACETS).agg(F.sum("_n").alias("n"))
    for facet in FACETS:
        counts = counts.where(F.col(facet).isNull() | (F.col(facet) != ""))
    return counts.select("table_name", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in FACETS], "n")


def facet_options(counts: DataFrame) -> DataFrame:
    """``table_name, for_team, for_cl, for_position, facet, facet_value, n`` from ``facet_counts``.

    The values on offer for a facet while the others are chosen as the ``for_`` columns say, and the rows
    each would leave. A facet's own choice doesn't narrow its offer. No shuffle: each count is an offer of every facet it chooses.
    """

    def offer(facet: str) -> Column:
        others = [(F.lit("") if c == facet else F.col(c)).alias(f"for_{c.lower()}") for c in FACETS]
        one = F.struct(*others, F.lit(facet).alias("facet"), F.col(facet).alias("facet_value"))
        return F.when(F.col(facet) != "", one)

    offers = F.array_compact(F.array(*[offer(c) for c in FACETS]))
    return counts.select("table_name", F.inline(offers), "n")


def sort_order(column: str, ascending: bool = True) -> list[Column]:
    """Sort keys that put numbers in numeric order and before other texts."""
    value = F.col(column).cast("string")
    numeric = leading_number(value)
    words = F.when(numeric.isNull(), text_key(value))
    if ascending:
        return [numeric.asc_nulls_last(), words.asc_nulls_first()]
    return [words.desc_nulls_last(), numeric.desc_nulls_last()]


def sort_rows(rows: DataFrame, column: str, ascending: bool = True, ties: Sequence[str] = ()) -> DataFrame:
    """Rows in the order of one column. A global sort, split by ranges."""
    return rows.orderBy(*sort_order(column, ascending), *ties)


def sort_served(
    served: DataFrame, column: str, ascending: bool = True, ties: Sequence[str] = ("place",)
) -> DataFrame:
    """Served rows (a bounded number per table) numbered in ``sort_position``."""
    order = W.partitionBy("table_name").orderBy(*sort_order(column, ascending), *ties)
    return served.withColumn("sort_position", F.row_number().over(order))


def record_json() -> Column:
    """A served row as a JSON record: the fields its table has, NULLs kept."""
    fields = {INDIVIDUAL: ["Name", "Team", "Cl", "Position", "Value"], TEAM: ["Team", "Value"]}

    def record(entity_type: str) -> Column:
        plain = F.to_json(F.struct(*fields[entity_type]), _KEEP_NULLS)
        ranked = F.to_json(F.struct(*fields[entity_type], "Rank"), _KEEP_NULLS)
        return F.when(F.col("Rank").isNull(), plain).otherwise(ranked)

    return F.when(F.col("entity_type") == TEAM, record(TEAM)).otherwise(record(INDIVIDUAL))


def records(served: DataFrame) -> DataFrame:
    """Served rows as ``table_name, place, record`` with the record as JSON."""
    return served.select("table_name", "place", record_json().alias("record"))


def snapshots(served: DataFrame, prefix: str = INDIVIDUAL) -> DataFrame:
    """One JSON document ``{category, rows}`` per table of served rows.

    Served tables have a bounded number of rows, so a document has too.
    """
    row = F.struct("place", record_json().alias("record"))
    rows = F.transform(F.array_sort(F.collect_list(row)), lambda r: r["record"])
    category = display_title(F.col("table_name"))
    body = F.concat(
        F.lit('{"category":"'), category, F.lit('","rows":['), F.array_join("_rows", ","), F.lit("]}")
    )
    return (
        served.where(F.col("table_name").startswith(prefix))
        .groupBy("table_name")
        .agg(rows.alias("_rows"))
        .select("table_name", category.alias("category"), body.alias("snapshot"))
    )


def latest_snapshots(published: DataFrame, version: str = "version") -> DataFrame:
    """The newest document of each category: the last one written wins."""
    return published.groupBy("category").agg(
        F.max(version).alias(version), F.max_by("snapshot", version).alias("snapshot")
    )
