"""Time parsing, period starts, buckets and display forms. The session zone must be UTC."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from wrenchlight.functions.text import col

# Fixed value: the zone in which the business year starts and times are shown.
BUSINESS_ZONE = "America/Chicago"

# Fixed format: 'Aug 01, 2001 02:03 PM'.
DISPLAY_FORMAT = "MMM dd, yyyy hh:mm a"


def parse_time(c: Column | str) -> Column:
    """ISO text as a UTC timestamp, each value on its own; bad text becomes NULL."""
    return col(c).try_cast("timestamp")


def instant(moment: datetime | str | Column) -> Column:
    """A timestamp literal; a datetime or text without a zone is taken as UTC."""
    if isinstance(moment, Column):
        return moment
    if isinstance(moment, str):
        moment = datetime.fromisoformat(moment)
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=timezone.utc)
    return F.lit(moment.astimezone(timezone.utc).isoformat()).cast("timestamp")


def local_time(ts: Column | str, zone: str = BUSINESS_ZONE) -> Column:
    """The wall-clock time of ``zone``, held in a UTC timestamp."""
    return F.from_utc_timestamp(col(ts), zone)


def year_start(as_of: Column, zone: str = BUSINESS_ZONE) -> Column:
    """First instant of the year of ``as_of`` in ``zone``. Folds to a literal, so it is pushed down."""
    return F.to_utc_timestamp(F.date_trunc("year", F.from_utc_timestamp(as_of, zone)), zone)


def utc_year_start(as_of: Column) -> Column:
    return F.date_trunc("year", as_of)


def month_of(ts: Column | str) -> Column:
    return F.date_format(col(ts), "yyyy-MM")


def day_of(ts: Column | str) -> Column:
    return F.to_date(col(ts))


def display(ts: Column | str, zone: str = BUSINESS_ZONE) -> Column:
    """Wall-clock text in ``zone``, '' for NULL."""
    return F.coalesce(F.date_format(local_time(ts, zone), DISPLAY_FORMAT), F.lit(""))


def zone_label(ts: Column | str, zone: str = BUSINESS_ZONE) -> Column:
    """'CST' or 'CDT' for US Central, else the offset as 'UTC+hh:mm'."""
    offset = F.unix_seconds(local_time(ts, zone)) - F.unix_seconds(col(ts))
    minutes = F.abs(offset) / 60
    text = F.format_string(
        "UTC%s%02d:%02d",
        F.when(offset < 0, "-").otherwise("+"),
        F.floor(minutes / 60).cast("int"),
        (minutes % 60).cast("int"),
    )
    if zone == BUSINESS_ZONE:
        return F.when(offset == -5 * 3600, "CDT").when(offset == -6 * 3600, "CST").otherwise(text)
    return text


def display_with_zone(ts: Column | str, zone: str = BUSINESS_ZONE) -> Column:
    """As ``display``, with the zone behind; '' for NULL."""
    shown = F.concat_ws(" ", display(ts, zone), zone_label(ts, zone))
    return F.when(col(ts).isNull(), "").otherwise(shown)


def worked_micros(start: Column | str, end: Column | str, minutes: Column | str | None = None) -> Column:
    """Length of a visit in microseconds: the given minutes where they are above 0, else end - start, 0 where one of them is NULL."""
    span = F.coalesce(F.unix_micros(col(end)) - F.unix_micros(col(start)), F.lit(0))
    if minutes is None:
        return span
    given = F.coalesce(col(minutes), F.lit(0.0))
    return F.when(given > 0, F.round(given * 60_000_000).cast("bigint")).otherwise(span)
