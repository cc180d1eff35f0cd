"""Periods as columns and literals. `as_of` is always given; no clock is read."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPOCH = date(2000, 1, 1)


def start_of(period: str, as_of: date) -> date:
    """semana: Monday; mes, ano: their first days; any other name: everything since EPOCH."""
    return {"semana": as_of - timedelta(as_of.weekday()), "mes": as_of.replace(day=1), "ano": as_of.replace(month=1, day=1)}.get(period, EPOCH)


def start_before(period: str, as_of: date) -> date:
    """The start of the period before; for everything the same start, which means no comparison."""
    start = start_of(period, as_of)
    if period == "semana":
        return start - timedelta(7)
    if period == "mes":
        return (start - timedelta(1)).replace(day=1)
    return start.replace(year=start.year - 1) if period == "ano" else start


def closed_month(as_of: date) -> date:
    """The first day of the month before that of as_of."""
    return (as_of.replace(day=1) - timedelta(1)).replace(day=1)


#: In the metadata of a column `mes`: the time column whose months its values are. A stored table's partitions are marked so.
MONTH_OF = "month_of"


def has_month(df: DataFrame, ts: str) -> bool:
    return "mes" in df.columns and df.schema["mes"].metadata.get(MONTH_OF) == ts


def by_month(df: DataFrame, ts: str) -> DataFrame:
    """df with `mes`, the first day of the row's month. A month ends at 23:59:59: what is later in its last second belongs to none. Where `mes` is the table's partition it is taken as it is, so that filters on it choose partitions."""
    end = F.last_day(ts).cast("timestamp_ntz") + F.expr("interval 86399 seconds")
    rows = df.where(F.col(ts).cast("timestamp_ntz") <= end)
    return rows if has_month(df, ts) else rows.withColumn("mes", F.trunc(ts, "month"))


def within(df: DataFrame, ts: str, since: date | None = None, until: date | None = None) -> DataFrame:
    """Rows from one day on, and to the end of the month of another; on a table parted by month, of its months alone."""
    if since:
        df = df.where(F.col(ts) >= F.lit(since))
    if until:
        df = df.where(F.col(ts) < F.add_months(F.trunc(F.lit(until), "month"), 1))
    if has_month(df, ts):
        df = df.where(F.col("mes") >= F.lit(since.replace(day=1))) if since else df
        df = df.where(F.col("mes") <= F.lit(until.replace(day=1))) if until else df
    return df


def in_months(df: DataFrame, ts: str, months: list[date]) -> DataFrame:
    return df.where((F.col("mes") if has_month(df, ts) else F.trunc(ts, "month").cast("date")).isin(*months))


def days_in(month: Column | str) -> Column:
    return F.dayofmonth(F.last_day(month))


def time_left(target: Column | str, as_of: Column | str) -> Column:
    """Whole days, hours, minutes and seconds to a time; zeros once it has come."""
    at = lambda c: F.unix_timestamp(c)
    left = F.greatest(F.lit(0).cast("long"), at(target) - at(as_of))
    part = lambda unit, most: F.pmod(F.floor(left / unit), F.lit(most)).cast("int")
    return F.struct(F.floor(left / 86400).cast("int").alias("dias"), part(3600, 24).alias("horas"), part(60, 60).alias("minutos"), part(1, 60).alias("segundos"))


def progress(begin: Column | str, target: Column | str, as_of: Column | str) -> Column:
    """The share of the days from begin to target that have passed, in percent; 100 at most."""
    total = F.ceil((F.unix_timestamp(target) - F.unix_timestamp(begin)) / 86400)
    return F.least(F.lit(100.0), F.try_divide((total - time_left(target, as_of)["dias"]).cast("double") * 100, total.cast("double")))
