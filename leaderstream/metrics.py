"""The metric dimension: payload field and rank direction of every metric."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from leaderstream.functions import naming

INDIVIDUAL = "individual"
TEAM = "team"


class Metric(NamedTuple):
    """``safe_name`` is what ``naming.safe_name`` makes of ``name``."""

    name: str
    safe_name: str
    individual_field: str | None
    team_field: str | None
    direction: str | None


# Table name part, payload field per entity type and rank direction of each metric.
METRICS: tuple[Metric, ...] = (
    Metric("Stolen Bases Per Game", "stolen_bases_per_game", "PG", "PG", "desc"),
    Metric("Batting Average", "batting_average", "BA", "BA", "desc"),
    Metric("Earned Run Average", "earned_run_average", "ERA", "ERA", "asc"),
    Metric("Slugging Percentage", "slugging_percentage", "SLG PCT", "SLG PCT", "desc"),
    Metric("WHIP", "whip", "WHIP", "WHIP", "asc"),
    Metric("Home Runs Per Game", "home_runs_per_game", "PG", "PG", "desc"),
    Metric("On Base Percentage", "on_base_percentage", "PCT", "PCT", "desc"),
    Metric("Complete Games", "complete_games", "CG", "CG", "desc"),
    Metric("Hits Allowed Per Nine Innings", "hits_allowed_per_nine_innings", "PG", "PG", "asc"),
    Metric("Strikeouts Per Nine Innings", "strikeouts_per_nine_innings", "K/9", "K/9", "desc"),
    Metric("Walks Allowed Per Nine Innings", "walks_allowed_per_nine_innings", "PG", "PG", "asc"),
    Metric("WL Pct", "wl_pct", None, "PCT", "desc"),
    Metric("Fielding Percentage", "fielding_percentage", None, "PCT", "desc"),
)

# Payload field of a metric that is not listed, rows per served
# table, and the row limit of the individual WL Pct table, served unranked.
DEFAULT_FIELD = "Value"
SERVED_ROWS = 300
UNRANKED_INDIVIDUAL_ROWS = 250

# Statistic pages, as (entity type, metric, URL path).
STAT_PAGES: tuple[tuple[str, str, str], ...] = (
    (INDIVIDUAL, "Stolen Bases Per Game", "/stats/baseball/d1/current/individual/206"),
    (INDIVIDUAL, "Batting Average", "/stats/baseball/d1/current/individual/200"),
    (INDIVIDUAL, "Earned Run Average", "/stats/baseball/d1/current/individual/205"),
    (INDIVIDUAL, "Slugging Percentage", "/stats/baseball/d1/current/individual/321"),
    (INDIVIDUAL, "WHIP", "/stats/baseball/d1/current/individual/596"),
    (INDIVIDUAL, "Home Runs Per Game", "/stats/baseball/d1/current/individual/201"),
    (INDIVIDUAL, "On Base Percentage", "/stats/baseball/d1/current/individual/504"),
    (INDIVIDUAL, "Complete Games", "/stats/baseball/d1/current/individual/587"),
    (INDIVIDUAL, "Hits Allowed Per Nine Innings", "/stats/baseball/d1/current/individual/505"),
    (INDIVIDUAL, "Strikeouts Per Nine Innings", "/stats/baseball/d1/current/individual/207"),
    (INDIVIDUAL, "Walks Allowed Per Nine Innings", "/stats/baseball/d1/current/individual/508"),
    (TEAM, "WL Pct", "/stats/baseball/d1/current/team/319"),
    (TEAM, "Batting Average", "/stats/baseball/d1/current/team/210"),
    (TEAM, "Earned Run Average", "/stats/baseball/d1/current/team/211"),
    (TEAM, "Slugging Percentage", "/stats/baseball/d1/current/team/327"),
    (TEAM, "WHIP", "/stats/baseball/d1/current/team/597"),
    (TEAM, "Home Runs Per Game", "/stats/baseball/d1/current/team/323"),
    (TEAM, "Fielding Percentage", "/stats/baseball/d1/current/team/212"),
    (TEAM, "On Base Percentage", "/stats/baseball/d1/current/team/589"),
    (TEAM, "Strikeouts Per Nine Innings", "/stats/baseball/d1/current/team/425"),
    (TEAM, "Hits Allowed Per Nine Innings", "/stats/baseball/d1/current/team/506"),
    (TEAM, "Walks Allowed Per Nine Innings", "/stats/baseball/d1/current/team/509"),
)


def _lookup(pairs: list[tuple[str, str]], key: Column) -> Column:
    if not pairs:
        return F.lit(None).cast("string")
    literal = F.create_map(*[F.lit(v) for v in chain.from_iterable(pairs)])
    return F.try_element_at(literal, key)


def value_field(metrics: Sequence[Metric], entity_type: Column, category: Column) -> Column:
    """Payload field that holds the value of a metric; ``Value`` when unlisted."""
    individual = [(m.name, m.individual_field) for m in metrics if m.individual_field]
    team = [(m.name, m.team_field) for m in metrics if m.team_field]
    found = F.when(entity_type == TEAM, _lookup(team, category)).otherwise(
        _lookup(individual, category)
    )
    return F.coalesce(found, F.lit(DEFAULT_FIELD))


def value_fields(metrics: Sequence[Metric]) -> list[str]:
    """Every payload field a value can be read from, in a stable order."""
    names = {f for m in metrics for f in (m.individual_field, m.team_field) if f}
    return sorted(names | {DEFAULT_FIELD})


def table_name_of(metrics: Sequence[Metric], entity_type: Column, category: Column) -> Column:
    """``individual_…`` or ``team_…``; NULL when the category is NULL.

    Listed metrics take the name from a literal map: a regular expression per
    row would cost more than the rest of the plan.
    """
    known = _lookup([(m.name, m.safe_name) for m in metrics], category)
    return F.concat(entity_type, F.lit("_"), F.coalesce(known, naming.safe_name(category)))


def rank_direction(metrics: Sequence[Metric], table: Column) -> Column:
    """``asc``, ``desc``, or NULL when a table is served unranked.

    The direction belongs to the metric a table name reads as, see
    ``naming.metric_name``. Here that is worked out without building the title
    of every row: a literal map holds the names of the listed metrics, and the
    two metrics that any name containing them reads as are tested directly.
    """
    directions = {m.name: m.direction for m in metrics if m.direction}
    pairs = []
    for m in metrics:
        if m.direction:
            pairs += [(f"{entity}_{m.safe_name}", m.direction) for entity in (INDIVIDUAL, TEAM)]
    return (
        F.when(naming.reads_as_whip(table), F.lit(directions.get("WHIP")))
        .when(unranked_individual(table), F.lit(None))
        .when(naming.reads_as_wl_pct(table), F.lit(directions.get("WL Pct")))
        .otherwise(_lookup(pairs, table))
    )


def unranked_individual(table: Column) -> Column:
    """True for individual tables of the metric that is served unranked."""
    return (
        table.startswith(f"{INDIVIDUAL}_") & naming.reads_as_wl_pct(table) & ~naming.reads_as_whip(table)
    )
