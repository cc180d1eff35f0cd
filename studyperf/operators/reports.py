"""What a period or a month comes to: comparison, projection, dashboard, performance by subject."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import periods, scores
from ..functions.scores import mean, pct, rounded
from .breakdowns import before
from .facts import KEYS, Tables, month_summary, months, scored_blocks, scored_mocks


COMPARED = ("horas", "questoes", "acerto", "ipr", "redacoes")


def compared_columns(c: Callable[[str], Column] = F.col) -> list[Column]:
    """Each of COMPARED against its value of the month before, `_anterior`."""
    out = []
    for n in COMPARED:
        now, old = c(n).cast("double"), c(f"{n}_anterior").cast("double")
        delta, change = scores.variation(now, old)
        out += [now.alias(n), old.alias(f"{n}_anterior"), delta.alias(f"{n}_variacao")]
        if n != "redacoes":
            out += [change.alias(f"{n}_percentual"), scores.arrow(change).alias(f"{n}_rotulo")]
    return out


def month_compare(t: Tables, keys: list[str] = KEYS) -> DataFrame:
    """A month against the one before (zeros where that has no rows)."""
    essays = periods.by_month(t["redacao"], "data_escrita").groupBy(*keys, "mes").agg(F.count("*").alias("redacoes"))
    s = month_summary(t, keys).select(*keys, "mes", F.col("horas_totais").alias("horas"), F.col("total_questoes").cast("double").alias("questoes"), F.col("percentual_acerto").alias("acerto"), F.col("ipr_geral").alias("ipr"))
    s = s.join(essays, [*keys, "mes"], "full").na.fill(0)
    return s.withColumns({f"{n}_anterior": before(n, keys) for n in COMPARED}).select(*keys, "mes", *compared_columns())


def closed_month(t: Tables, as_of: date, keys: list[str] = KEYS) -> DataFrame:
    """The summary of the month before that of as_of."""
    return month_summary(t, keys).where(F.col("mes") == F.lit(periods.closed_month(as_of)))


def projection_columns(as_of: date, c: Callable[[str], Column] = F.col) -> list[Column]:
    """From the columns of a month's summary."""
    hours_goal, questions_goal = scores.GOALS["mes"]
    n = periods.days_in("mes")
    now = F.col("mes") == F.lit(as_of.replace(day=1))
    past = F.when(now, as_of.day).otherwise(n)
    left = n - past
    hours, questions = c("horas_totais"), c("total_questoes").cast("double")
    daily_h, daily_q = rounded(hours / past, 2), rounded(questions / past, 1)
    to_h = F.when(now, rounded(hours + daily_h * left, 1)).otherwise(hours)
    to_q = F.when(now, rounded(questions + daily_q * left, 0)).otherwise(questions)
    need = lambda goal, value, digits: F.when(now, rounded(F.greatest(goal - value, F.lit(0.0)) / F.greatest(left, F.lit(1)), digits)).otherwise(0.0)
    return [
        daily_h.alias("horas_por_dia"),
        daily_q.alias("questoes_por_dia"),
        to_h.alias("horas_projetadas"),
        to_q.alias("questoes_projetadas"),
        rounded(c("dias_estudados") / past * 100, 1).alias("percentual_dias"),
        (to_h >= hours_goal).alias("horas_no_rumo"),
        (to_q >= questions_goal).alias("questoes_no_rumo"),
        past.alias("dias_passados"),
        left.alias("dias_restantes"),
        need(F.lit(float(hours_goal)), hours, 2).alias("horas_necessarias"),
        need(F.lit(float(questions_goal)), questions, 1).alias("questoes_necessarias"),
    ]


def month_projection(t: Tables, as_of: date, keys: list[str] = KEYS) -> DataFrame:
    """Of the month of as_of: where it leads by its daily means. Closed months project to what they are."""
    return month_summary(t, keys).select(*keys, "mes", *projection_columns(as_of))


def _since(t: Tables, name: str, ts: str, start: date) -> DataFrame:
    return periods.within(t[name], ts, start)


def _scored_since(t: Tables, start: date) -> tuple[DataFrame, DataFrame]:
    """Blocks and mock exams since a day, scored. Errors are cut down to those of these blocks before they are summed; where the blocks are few, Spark does so as it reads them."""
    blocks = _since(t, "bloco", "data", start)
    own = t["erro"].where(F.col("tipo_erro").isin(*scores.CARELESS)).join(blocks.select("bloco_id"), "bloco_id", "left_semi")
    careless = own.groupBy("bloco_id").agg(F.sum("quantidade").alias("erros_criticos"))
    return blocks.join(careless, "bloco_id", "left").withColumn("ipr", scores.block_ipr()), _since(t, "simulado", "criado_em", start).withColumn("ipr", scores.mock_ipr())


def is_critical(period: str) -> Column:
    """Of a topic's questions (questoes) and scores times questions (soma): enough questions, and below 0.70 by them."""
    return (F.col("questoes") >= (1 if period == "semana" else 10)) & (_weighted() < 0.70)


def _weighted() -> Column:
    return F.try_divide(F.col("soma").cast("double"), F.col("questoes").cast("double"))


def _period_topics(t: Tables, period: str, as_of: date, keys: list[str]) -> DataFrame:
    """By key and topic: minutes, seconds, questions, hits and scores since the period's start, and scores of the period before. Sessions and mock exams have no topic here. One pass over each fact."""
    start, old = periods.start_of(period, as_of), periods.start_before(period, as_of)
    blocks, mocks = _scored_since(t, min(start, old))
    now = F.col("quando") >= F.lit(start)
    none = F.lit(None).cast(t["bloco"].schema["assunto_id"].dataType)

    def part(df: DataFrame, kind: str, when: str, time: str, topic: Column = none, *, scored: bool = True) -> DataFrame:
        q, a, ipr = ("total_questoes", "total_acertos", "ipr") if scored else (F.lit(0), F.lit(0), F.lit(None).cast("decimal(6,4)"))
        named = {"quando": when, "fato": F.lit(kind), "assunto_id": topic, "tempo": F.col(time).cast("long"), "q": q, "a": a, "ipr": ipr}
        return df.select(*keys, *((F.col(c) if isinstance(c, str) else c).alias(n) for n, c in named.items()))

    rows = part(_since(t, "sessao", "data", start), "s", "data", "minutos_liquidos", scored=False)
    rows = rows.unionByName(part(blocks, "b", "data", "tempo_total_segundos", F.col("assunto_id"))).unionByName(part(mocks, "m", "criado_em", "tempo_total_segundos"))
    pick = lambda c, cond: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))
    is_ = lambda k: F.col("fato") == k
    of_topic = now & is_("b")
    aggs = [
        pick("tempo", now & is_("s")).alias("minutos"), pick("tempo", now & ~is_("s")).alias("segundos"), pick("q", now).alias("q"), pick("a", now).alias("a"),
        F.count(F.when(now & is_("s"), 1)).alias("n_sessoes"), F.count(F.when(now & is_("b"), 1)).alias("n_blocos"), F.count(F.when(now & is_("m"), 1)).alias("n_simulados"),
        pick("q", of_topic).alias("questoes"), F.sum(F.when(of_topic, F.col("ipr") * F.col("q"))).alias("soma"),
    ]
    for k in "bm":
        for tag, cond in (("", now), ("_ant", ~now)):
            aggs += [F.sum(F.when(cond & is_(k), F.col("ipr"))).alias(f"ipr_{k}{tag}"), F.count(F.when(cond & is_(k), 1)).alias(f"n_{k}{tag}")]
    return rows.groupBy(*keys, "assunto_id").agg(*aggs)


def period_sums(t: Tables, period: str, as_of: date, keys: list[str] = KEYS) -> DataFrame:
    """Minutes, seconds, questions, hits and scores since the period's start, scores of the period before, and the critical topics: their number and their ids in order."""
    topics = _period_topics(t, period, as_of, keys)
    critical = F.when(F.coalesce(is_critical(period), F.lit(False)), 1)
    added = ["minutos", "segundos", "n_sessoes", "n_blocos", "n_simulados", *(f"{x}_{k}{tag}" for x in ("ipr", "n") for k in "bm" for tag in ("", "_ant"))]
    ids = F.sort_array(F.collect_list(F.when(critical == 1, F.col("assunto_id"))))
    return topics.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in added), F.sum("q").alias("questoes"), F.sum("a").alias("acertos"), F.count(critical).alias("n_criticos"), ids.alias("criticos"))


def period_hours(t: Tables, period: str, as_of: date, keys: list[str] = KEYS) -> DataFrame:
    s = period_sums(t, period, as_of, keys)
    return s.where("n_sessoes + n_blocos + n_simulados > 0").select(*keys, rounded((F.col("minutos") + F.col("segundos") / 60) / 60, 2).alias("horas"))


def critical_topics(t: Tables, period: str, as_of: date, keys: list[str] = KEYS) -> DataFrame:
    """Topics whose score, weighted by questions, is below 0.70, with enough questions."""
    blocks, _ = _scored_since(t, periods.start_of(period, as_of))
    g = blocks.groupBy(*keys, "assunto_id").agg(F.sum("total_questoes").alias("questoes"), F.sum(F.col("ipr") * F.col("total_questoes")).alias("soma"))
    return g.where(is_critical(period)).select(*keys, "assunto_id", "questoes", rounded(_weighted(), 4).alias("ipr_ponderado"))


def dashboard(t: Tables, period: str, as_of: date, keys: list[str] = KEYS) -> DataFrame:
    s = period_sums(t, period, as_of, keys).where("n_sessoes + n_blocos + n_simulados > 0")
    exact = lambda a, n: F.try_divide(F.col(a).cast("double"), F.col(n).cast("double"))
    ipr, old = scores.blend(exact("ipr_b", "n_b"), exact("ipr_m", "n_m")), scores.blend(exact("ipr_b_ant", "n_b_ant"), exact("ipr_m_ant", "n_m_ant"))
    if periods.start_before(period, as_of) >= periods.start_of(period, as_of):
        old = F.lit(0.0)
    hours_goal, questions_goal = scores.GOALS.get(period, scores.YEAR_GOAL)
    hours = rounded((F.col("minutos") + F.col("segundos") / 60) / 60, 2)
    s = s.withColumns({"horas": hours, "ipr_medio": ipr, "ipr_anterior": old})
    s = s.withColumns({"tendencia": scores.trend(F.col("ipr_medio"), F.col("ipr_anterior")), "status_horas": scores.goal_status(F.col("horas"), hours_goal), "status_questoes": scores.goal_status(F.col("questoes"), questions_goal)})
    s = s.withColumn("status_missao", scores.mission_status(F.col("ipr_medio"), F.col("status_horas"), F.col("status_questoes"), F.col("tendencia")))
    topics = F.array_join(F.col("criticos").cast("array<string>"), ",")
    return s.select(*keys, "horas", "questoes", "acertos", pct("acertos", "questoes").alias("percentual_medio"), "ipr_medio", "ipr_anterior", "tendencia", "status_horas", "status_questoes", "status_missao", topics.alias("assuntos_criticos"))


def analytics_counts(t: Tables, period: str, as_of: date, keys: list[str] = KEYS) -> DataFrame:
    s = period_sums(t, period, as_of, keys).where("n_sessoes + n_blocos + n_simulados > 0")
    exact = lambda k: F.try_divide(F.col(f"ipr_{k}").cast("double"), F.col(f"n_{k}").cast("double"))
    return s.select(*keys, rounded((F.col("minutos") + F.col("segundos") / 60) / 60, 2).alias("horas"), "questoes", scores.blend(exact("b"), exact("m")).alias("ipr_medio"), "n_sessoes", "n_blocos", "n_simulados", "n_criticos")


def subject_performance(t: Tables, period: str, as_of: date, keys: list[str] = KEYS) -> DataFrame:
    """One row for each key and subject with blocks in the period, in place of a dashboard for each subject."""
    blocks, _ = _scored_since(t, periods.start_of(period, as_of))
    g = blocks.groupBy(*keys, "materia_id").agg(F.sum("total_questoes").alias("questoes"), F.sum("total_acertos").alias("acertos"), F.sum("ipr").alias("s"), F.count("*").alias("n"))
    ipr = mean("s", "n", 4)
    band = F.when(ipr >= 0.8, "Excelente").when(ipr >= 0.7, "Operacional").otherwise("Crítico")
    out = g.select(*keys, "materia_id", "questoes", "acertos", pct("acertos", "questoes").alias("percentual"), ipr.alias("ipr"), band.alias("faixa"))
    return t["materia"].select("materia_id", F.col("nome").alias("materia_nome")).join(out, "materia_id")
