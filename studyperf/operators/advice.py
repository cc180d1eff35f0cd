"""Advice from a dashboard, essay advice, and labels of months."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores, texts
from ..functions.scores import rounded
from . import essays, facts, reports
from .facts import KEYS, Tables


def one_digit(x: Column) -> Column:
    return rounded(x, 1).cast("decimal(20,1)").cast("string")


def advised(d: DataFrame, period: str) -> DataFrame:
    """Dashboards of a period with `recomendacoes`, their texts in order. Row by row, without a shuffle."""
    hours_goal, questions_goal = scores.GOALS.get(period, scores.YEAR_GOAL)
    own = d.columns
    d = d.withColumns(
        {
            "periodo": F.lit(period),
            "ipr": F.col("ipr_medio"),
            "ipr_pct": one_digit(F.col("ipr_medio") * 100),
            "acerto": F.col("percentual_medio"),
            "meta_h": F.lit(hours_goal),
            "meta_q": F.lit(questions_goal),
            "falta_h": one_digit(hours_goal - F.col("horas")),
            "sobra_h": one_digit(F.col("horas") - hours_goal),
            "falta_q": questions_goal - F.col("questoes"),
            "n_criticos": F.when(F.col("assuntos_criticos") == "", 0).otherwise(F.size(F.split("assuntos_criticos", ","))),
        }
    )
    given = F.array_compact(F.array(*(F.when(F.expr(cond), texts.filled(text)) for cond, text in texts.DASHBOARD_ADVICE)))
    d = d.withColumn("recomendacoes", given)
    return d.select(*own, F.when(F.size("recomendacoes") == 0, F.array(F.lit(texts.DASHBOARD_FALLBACK))).otherwise(F.col("recomendacoes")).alias("recomendacoes"))


def dashboard_advice(t: Tables, period: str, as_of: date, keys: list[str] = KEYS) -> DataFrame:
    return advised(reports.dashboard(t, period, as_of, keys), period)


def essay_advice(t: Tables) -> DataFrame:
    """For each essay and competency: its name, diagnosis and exercise. Row by row, without a shuffle."""
    c, n = F.col("competencia"), F.col("nota")
    return essays.essay_long(t["redacao"]).select("redacao_id", "competencia", texts.competency_name(c).alias("nome"), "nota", texts.by_score(texts.DIAGNOSES, c, n).alias("diagnostico"), texts.by_score(texts.EXERCISES, c, n).alias("recomendacao"))


def month_labels(t: Tables, keys: list[str] = KEYS, passing: float = 70) -> DataFrame:
    """What a list of months shows: name, hours as text, days from its first to the next month's, whether its hits pass."""
    s = facts.month_summary(t, keys)
    days = F.datediff(F.add_months("mes", 1), F.col("mes"))
    return s.select(*keys, "mes", texts.month_label("mes").alias("rotulo"), texts.hours_text(F.col("horas_totais")).alias("horas_texto"), days.alias("dias_ate_proximo"), (F.col("percentual_acerto") >= passing).alias("aprovado"))
