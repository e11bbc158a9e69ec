"""Event envelopes to rows of the long statistics table, and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leaderstream.functions.values import event_time, utc_text
from leaderstream.metrics import INDIVIDUAL, METRICS, TEAM, Metric, table_name_of, value_field, value_fields

# The payloads stay raw JSON text here: their fields depend on the metric.
ENVELOPE = T.StructType(
    [
        T.StructField("stat_category", T.StringType()),
        T.StructField("stat_type", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("player_stats", T.StringType()),
        T.StructField("team_stats", T.StringType()),
    ]
)

# Bytes of a table name: it becomes a folder name, and file systems end at 255.
MAX_NAME = 200

PAYLOADS = {"player_stats": INDIVIDUAL, "team_stats": TEAM}

STATS_COLUMNS = ["Name", "Team", "Cl", "Position", "Value"]

STATS = T.StructType(
    [
        T.StructField("table_name", T.StringType()),
        T.StructField("entity_type", T.StringType()),
        T.StructField("stat_category", T.StringType()),
        *[T.StructField(c, T.StringType()) for c in STATS_COLUMNS],
        T.StructField("event_time", T.TimestampType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("offset", T.LongType()),
    ]
)


def decode_envelopes(raw: DataFrame, value: str = "value") -> DataFrame:
    """Parse message values (text or bytes). Other columns, like offsets, stay.

    Text that is no JSON object gives NULL in every envelope field.
    """
    rest = [c for c in raw.columns if c != value]
    # Spark interprets a parse and all that it puts into it. A text that is used twice is computed before, in generated code.
    text = F.col(value).cast("string")
    parsed = raw.select(*rest, F.when(text != "", F.from_json(text, ENVELOPE)).alias("data"))
    envelopes = parsed.select(*rest, "data.*")
    return envelopes.withColumn("event_time", event_time(F.col("timestamp"))).drop("timestamp")


def route_payloads(envelopes: DataFrame, keep_others: bool = False) -> DataFrame:
    """One row per payload of a categorised event: ``entity_type`` and ``payload``.

    ``keep_others`` also gives events without a payload or category a row each
    instead of none. The conditions are part of the generated rows: as filters
    on the envelope they would move below the JSON parse and repeat it.
    """
    present = [c for c in PAYLOADS if c in envelopes.columns]
    usable = F.lit(True) if keep_others else F.col("stat_category").isNotNull()
    entries = [(F.lit(PAYLOADS[c]), F.when(usable, F.col(c)), F.lit(False)) for c in present]
    if keep_others:
        entries.append((F.lit(None), F.lit(None).cast("string"), F.coalesce(*present).isNull()))
    names = ["entity_type", "payload", "_without"]
    rows = F.array(*[F.struct(*[v.alias(n) for v, n in zip(e, names, strict=True)]) for e in entries])
    rest = [F.col(c) for c in envelopes.columns if c not in PAYLOADS]
    routed = envelopes.select(*rest, F.inline(rows))
    return routed.where(F.col("payload").isNotNull() | F.col("_without")).drop("_without")


def _parse_payloads(routed: DataFrame, metrics: Sequence[Metric], carried: Sequence[str]) -> DataFrame:
    fields = value_fields(metrics)
    names = ["Name", "Team", "Cl", "Position", *[f for f in fields if f not in STATS_COLUMNS[:4]]]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    entity, category = F.col("entity_type"), F.col("stat_category")
    # One struct with every field a value can sit in: each payload is parsed once.
    parsed = routed.withColumn("_p", F.from_json("payload", schema)).withColumn(
        "_field", value_field(metrics, entity, category)
    )
    value = F.coalesce(*[F.when(F.col("_field") == f, F.col("_p").getField(f)) for f in fields])

    def individual(field: str) -> Column:
        return F.when(entity == INDIVIDUAL, F.col("_p").getField(field)).alias(field)

    return parsed.select(
        table_name_of(metrics, entity, category).alias("table_name"),
        "entity_type",
        "stat_category",
        individual("Name"),
        F.col("_p.Team").alias("Team"),
        individual("Cl"),
        individual("Position"),
        value.alias("Value"),
        *carried,
    )


def flatten(envelopes: DataFrame, metrics: Sequence[Metric] = METRICS) -> DataFrame:
    """Rows of all metrics in one plan: ``Name, Team, Cl, Position, Value`` as text.

    Events without a category belong to no table and are left to
    ``judge_events``.
    """
    carried = [c for c in envelopes.columns if c not in {*PAYLOADS, "stat_category", "stat_type"}]
    return _parse_payloads(route_payloads(envelopes), metrics, carried)


def null_key() -> Column:
    """True for rows whose entity key has a NULL part: they can never be replaced."""
    return F.col("Team").isNull() | (F.col("Name").isNull() & (F.col("entity_type") == INDIVIDUAL))


def judge_events(raw: DataFrame, metrics: Sequence[Metric] = METRICS, value: str = "value") -> DataFrame:
    """Every message as rows of ``flatten`` with its ``message`` and ``reason``.

    ``reason`` is NULL for sound rows. It is ``bad_envelope``, ``no_payload``,
    ``no_category`` or ``bad_name`` (too long for a table) for messages that reach
    no table, and ``null_key`` for rows that reach one without a usable key. Filter a persisted result, so that the
    messages are parsed once.
    """
    decoded = decode_envelopes(raw.withColumn("message", F.col(value).cast("string")), value)
    nothing = F.coalesce("stat_category", "stat_type", F.col("event_time").cast("string"))
    marked = decoded.withColumn("_empty", nothing.isNull())
    rest = [c for c in raw.columns if c != value]
    rows = _parse_payloads(
        route_payloads(marked, keep_others=True), metrics, [*rest, "event_time", "message", "_empty"]
    )
    reason = (
        F.when(F.col("entity_type").isNull(), F.when(F.col("_empty"), "bad_envelope").otherwise("no_payload"))
        .when(F.col("stat_category").isNull(), "no_category")
        .when(F.octet_length("table_name") > MAX_NAME, "bad_name")
        .when(null_key(), "null_key")
    )
    return rows.withColumn("reason", reason).drop("_empty")


def accepted_rows(judged: DataFrame, null_keys: str = "keep") -> DataFrame:
    """Rows that belong to a table; with ``null_keys="reject"`` only those with a usable key."""
    if null_keys not in ("keep", "reject"):
        raise ValueError("null_keys is keep or reject")
    sound = F.col("reason").isNull()
    if null_keys == "keep":
        sound = sound | (F.col("reason") == "null_key")
    return judged.where(sound).drop("message", "reason")


def rejected_events(judged: DataFrame) -> DataFrame:
    """Messages that reach no table or carry no usable key, with the reason."""
    return judged.where(F.col("reason").isNotNull()).drop(
        "table_name", "entity_type", "stat_category", *STATS_COLUMNS
    )


def empty_stats(spark) -> DataFrame:
    """The statistics table before the first event."""
    return spark.createDataFrame([], STATS)


def encode_events(
    rows: DataFrame, record: Column, time: Column | None = None, entity_type: Column | None = None
) -> DataFrame:
    """Statistic records (map of text to text) as event messages in ``value``.

    ``time`` is a timestamp; the current time by default. Absent payloads, and
    absent fields of a record, leave no key in the JSON.
    """
    entity = F.col("entity_type") if entity_type is None else entity_type
    envelope = F.struct(
        F.col("stat_category"),
        F.when(entity == TEAM, "team").otherwise("player").alias("stat_type"),
        utc_text(time).alias("timestamp"),
        F.when(entity != TEAM, record).alias("player_stats"),
        F.when(entity == TEAM, record).alias("team_stats"),
    )
    return rows.withColumn("value", F.to_json(envelope))
