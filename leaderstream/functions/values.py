"""Conversions of statistic values, which are text end to end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"

_LEADING_NUMBER = r"^\s*([-+]?(?:Infinity|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?))"


def number(text: Column) -> Column:
    """The whole text as a double; NULL when it is not a number.

    A cast alone would also take type suffixes like ``10d``.
    """
    return F.when(text.rlike(_LEADING_NUMBER + r"\s*$"), text.try_cast("double"))


def leading_number(text: Column) -> Column:
    """The number a text starts with (``12 wins`` gives 12); NULL without one."""
    return F.regexp_extract(text, _LEADING_NUMBER, 1).try_cast("double")


def text_key(text: Column) -> Column:
    """Case-blind sort key; NULL sorts like an empty text."""
    return F.lower(F.coalesce(text, F.lit("")))


def utc_text(time: Column | None = None) -> Column:
    """A time (now by default) as text. The session time zone must be UTC."""
    return F.date_format(F.current_timestamp() if time is None else time, TIME_FORMAT)


def event_time(text: Column) -> Column:
    """Time of an event, sent as text or as epoch seconds; NULL when neither."""
    return F.coalesce(
        F.try_to_timestamp(text, F.lit(TIME_FORMAT)),
        F.timestamp_seconds(text.try_cast("double")),
    )


def or_unknown(text: Column) -> Column:
    return F.coalesce(text, F.lit("Unknown"))
