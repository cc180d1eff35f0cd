"""Latest-first pages, named lists, and adherence to a weekly plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import periods


def beyond(ts: str, tie: list[str], cursor: Sequence[object]) -> Column:
    """Whether a row comes after the one with the cursor's values of ts and tie: older, or as old and later by tie. Rows without a time come last, nulls of a tie first."""
    out = F.lit(False)
    for name, value in reversed(list(zip([ts, *tie], cursor, strict=True))):
        c = F.col(name)
        if name == ts:
            later = F.lit(False) if value is None else c.isNull() | (c < F.lit(value))
        else:
            later = c.isNotNull() if value is None else c > F.lit(value)
        out = later | (c.eqNullSafe(F.lit(value)) & out)
    return F.coalesce(out, F.lit(False))


def latest(df: DataFrame, ts: str, tie: list[str], skip: int = 0, limit: int = 100, after: Sequence[object] | None = None) -> DataFrame:
    """A page: the newest first, a top-k without a full sort. The next page is best asked for by the last row's values of ts and tie (`after`): then what lies before is filtered out where it is read, and a table parted by month leaves out
    later months. A large skip costs as much as the rows it passes over."""
    if after is not None:
        df = df.where(beyond(ts, tie, after))
        if after[0] is not None and periods.has_month(df, ts):
            df = df.where(F.col("mes").isNull() | (F.col("mes") <= F.trunc(F.lit(after[0]), "month")))
    return df.orderBy(F.desc(ts), *tie).offset(skip).limit(limit)


def named_list(df: DataFrame, name: str = "nome", key: str | None = None, value: object = None) -> DataFrame:
    """Subjects or topics by name; with `key`, those of one value of it, as the topics of a subject."""
    return (df.where(F.col(key) == F.lit(value)) if key else df).orderBy(name)


def minutes_of(text: Column) -> Column:
    """Minutes since midnight of HH:MM."""
    parts = F.split(text, ":")
    return parts[0].cast("int") * 60 + parts[1].cast("int")


def plan_slots(plan: DataFrame) -> DataFrame:
    """dia_semana (0: Monday) and `HH:MM-HH:MM` as first and last minutes."""
    ends = F.split("horario", "-")
    return plan.select("dia_semana", "atividade", minutes_of(F.trim(ends[0])).alias("inicio"), minutes_of(F.trim(ends[1])).alias("fim"))


def plan_adherence(rows: DataFrame, plan: DataFrame, ts: str, keys: list[str]) -> DataFrame:
    """For each key and activity, rows within a slot of their weekday, both ends included; null: rows in none. The plan is small and has the weekday as an equality, so the join stays an equi-join with a range condition."""
    at = rows.withColumn("dia_semana", F.weekday(ts)).withColumn("minuto", F.hour(ts) * 60 + F.minute(ts))
    slots = plan_slots(plan)
    hit = (at["dia_semana"] == slots["dia_semana"]) & at["minuto"].between(slots["inicio"], slots["fim"])
    return at.join(slots, hit, "left").groupBy(*keys, "atividade").agg(F.count("*").alias("registros"))
