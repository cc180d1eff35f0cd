"""The middle layer: scored facts, days and months. Every operator takes `keys`, the columns that tell students apart ([]: one student)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import periods, scores
from ..functions.scores import rounded

KEYS = ["aluno_id"]
Tables = dict[str, DataFrame]


def prepared(t: Tables) -> Tables:
    """t with the scored blocks kept, for jobs of many sections; unpersist t["bloco_pontuado"] after them. They come again from their sources where an executor is lost."""
    return {**t, "bloco_pontuado": scored_blocks(t).persist()}


def scored_blocks(t: Tables) -> DataFrame:
    """Blocks with month, day, careless errors and score. Errors are summed before the join, so nothing fans out."""
    if "bloco_pontuado" in t:
        return t["bloco_pontuado"]
    careless = t["erro"].where(F.col("tipo_erro").isin(*scores.CARELESS)).groupBy("bloco_id").agg(F.sum("quantidade").alias("erros_criticos"))
    blocks = periods.by_month(t["bloco"], "data").withColumn("dia", F.to_date("data"))
    return blocks.join(careless, "bloco_id", "left").withColumn("ipr", scores.block_ipr())


def scored_mocks(t: Tables) -> DataFrame:
    return periods.by_month(t["simulado"], "criado_em").withColumn("dia", F.to_date("criado_em")).withColumn("ipr", scores.mock_ipr())


def sessions(t: Tables) -> DataFrame:
    return periods.by_month(t["sessao"], "data").withColumn("dia", F.to_date("data"))


def activity(t: Tables, keys: list[str] = KEYS) -> DataFrame:
    """One long table of what all three facts add, so that days and months take one shuffle."""
    none = lambda kind: F.lit(None).cast(kind)
    shape = {"minutos": "long", "seg_bloco": "long", "seg_simulado": "long", "questoes": "long", "acertos": "long", "ipr_bloco": "decimal(6,4)", "ipr_simulado": "decimal(6,4)", "fato": "string"}

    def part(df: DataFrame, **have) -> DataFrame:
        return df.select(*keys, "mes", "dia", *(F.col(have[c]).cast(k).alias(c) if c in have else none(k).alias(c) for c, k in shape.items() if c != "fato"), F.lit(have["fato"]).alias("fato"))

    return (
        part(sessions(t), fato="sessao", minutos="minutos_liquidos")
        .unionByName(part(scored_blocks(t), fato="bloco", seg_bloco="tempo_total_segundos", questoes="total_questoes", acertos="total_acertos", ipr_bloco="ipr"))
        .unionByName(part(scored_mocks(t), fato="simulado", seg_simulado="tempo_total_segundos", questoes="total_questoes", acertos="total_acertos", ipr_simulado="ipr"))
    )


def summed(df: DataFrame, by: list[str]) -> DataFrame:
    zero = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    have = set(df.columns)
    counts = [F.count(F.when(F.col("fato") == k, 1)).alias(f"n_{k}") for k in ("sessao", "bloco", "simulado")] if "fato" in have else [F.sum(f"n_{k}").alias(f"n_{k}") for k in ("sessao", "bloco", "simulado")]
    return df.groupBy(*by).agg(*(zero(c, c) for c in ("minutos", "seg_bloco", "seg_simulado", "questoes", "acertos", "ipr_bloco", "ipr_simulado")), *counts, *([F.count("*").alias("dias")] if "fato" not in have else []))


def days(t: Tables, keys: list[str] = KEYS) -> DataFrame:
    """The sums of each day. A stored table of them (`dias`) is taken as it is."""
    return t["dias"] if "dias" in t else summed(activity(t, keys), [*keys, "mes", "dia"])


def months(t: Tables, keys: list[str] = KEYS) -> DataFrame:
    """From the days, which are few for each month."""
    return summed(days(t, keys), [*keys, "mes"])


def minutes(c: Callable[[str], Column] = F.col) -> Column:
    return c("minutos") + c("seg_bloco") / 60 + c("seg_simulado") / 60


def month_ipr(c: Callable[[str], Column] = F.col) -> Column:
    ipr = scores.blend(scores.mean(c("ipr_bloco"), c("n_bloco"), 4), scores.mean(c("ipr_simulado"), c("n_simulado"), 4))
    return rounded(ipr * 100, 2)


def summary_columns() -> list[Column]:
    """What a month's sums, with its days of activity as `dias`, come to."""
    return [
        rounded(minutes() / 60, 2).alias("horas_totais"),
        F.col("n_sessao").alias("total_sessoes"),
        F.col("n_bloco").alias("total_blocos"),
        F.col("n_simulado").alias("total_simulados"),
        F.col("questoes").alias("total_questoes"),
        F.col("acertos").alias("total_acertos"),
        (F.col("questoes") - F.col("acertos")).alias("total_erros"),
        scores.pct("acertos", "questoes").alias("percentual_acerto"),
        month_ipr().alias("ipr_geral"),
        rounded(scores.ratio("questoes", "dias"), 1).alias("questoes_por_dia"),
        rounded(scores.ratio(minutes(), "dias"), 1).alias("minutos_por_dia"),
        F.col("dias").alias("dias_estudados"),
        rounded(F.col("dias") / periods.days_in("mes") * 100, 1).alias("percentual_dias"),
    ]


def month_summary(t: Tables, keys: list[str] = KEYS) -> DataFrame:
    return months(t, keys).select(*keys, "mes", *summary_columns())


def block_days(t: Tables, keys: list[str] = KEYS) -> DataFrame:
    """Hours, questions, hit share and score of each day with sessions or blocks; mocks don't count here."""
    part = activity(t, keys).where("fato <> 'simulado'")
    out = summed(part, [*keys, "mes", "dia"])
    ipr = F.coalesce(scores.mean("ipr_bloco", "n_bloco", 2), F.lit(0.0))
    return out.select(*keys, "mes", "dia", scores.weekday_name(F.col("dia")).alias("dia_semana"), (F.col("minutos") / 60 + F.col("seg_bloco") / 3600).alias("horas_exatas"), rounded(F.col("minutos") / 60 + F.col("seg_bloco") / 3600, 2).alias("horas"), "questoes", scores.pct("acertos", "questoes").alias("percentual_acerto"), rounded(ipr * 100, 2).alias("ipr_dia"), "n_bloco")


def best_worst_day(t: Tables, keys: list[str] = KEYS) -> DataFrame:
    """Ties: the earliest day."""
    late = -F.unix_date("dia")
    d = block_days(t, keys)
    pick = d.groupBy(*keys, "mes").agg(F.max_by("dia", F.struct("ipr_dia", late)).alias("melhor_dia"), F.max("ipr_dia").alias("melhor_ipr"), F.min_by("dia", F.struct("ipr_dia", "dia")).alias("pior_dia"), F.min("ipr_dia").alias("pior_ipr"))
    return pick


def active_days(t: Tables, keys: list[str] = KEYS) -> DataFrame:
    return activity(t, keys).select(*keys, "mes", "dia").distinct()


def streaks(active: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """From distinct days of activity: longest run, longest gap (both within a month, its ends included) and the run open on its last day."""
    w = Window.partitionBy(*keys, "mes").orderBy("dia")
    first, last = F.col("mes"), F.last_day("mes")
    d = active.withColumn("ilha", F.date_sub("dia", F.row_number().over(w)))
    d = d.withColumn("falta", F.coalesce(F.datediff(F.lead("dia").over(w), "dia") - 1, F.datediff(last, "dia")))
    d = d.withColumn("antes", F.when(F.row_number().over(w) == 1, F.datediff("dia", first)).otherwise(0))
    islands = d.groupBy(*keys, "mes", "ilha").agg(F.count("*").alias("n"), F.max("dia").alias("fim"), F.max(F.greatest("falta", "antes")).alias("falta"), F.sum("antes").alias("antes"))
    return islands.groupBy(*keys, "mes").agg(
        F.max("n").alias("maior_streak"),
        F.max("falta").cast("long").alias("maior_falta"),
        F.coalesce(F.max(F.when(F.col("fim") == F.last_day("mes"), F.col("n"))), F.lit(0)).alias("streak_atual"),
        F.sum("n").alias("dias_estudados"),
    )


def consistency_columns() -> list[Column]:
    """From streaks and the spreads of hours (sh) and questions (sq) by day, null where there are none."""
    hours = rounded(F.coalesce("sh", F.lit(0.0)), 2)
    score = rounded(F.greatest(F.col("dias_estudados") / periods.days_in("mes") - F.least(hours * 0.05, F.lit(0.2)), F.lit(0.0)) * 100, 1)
    return [score.alias("score"), scores.consistency_class(score).alias("classificacao"), *map(F.col, ("streak_atual", "maior_streak", "maior_falta")), hours.alias("variacao_horas"), rounded(F.coalesce("sq", F.lit(0.0)), 1).alias("variacao_questoes")]


def consistency(t: Tables, keys: list[str] = KEYS) -> DataFrame:
    spread = block_days(t, keys).groupBy(*keys, "mes").agg(
        F.stddev_pop(rounded(F.col("horas_exatas"), 6)).alias("sh"), F.stddev_pop(F.when(F.col("n_bloco") > 0, F.col("questoes"))).alias("sq")
    )
    return streaks(active_days(t, keys), keys).join(spread, [*keys, "mes"], "left").select(*keys, "mes", *consistency_columns())
