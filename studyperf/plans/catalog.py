"""All queries of the library by name, each over the tables of a folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import periods, scores, texts
from ..operators import advice, breakdowns, essays, facts, ingest, listing, monthly, reports, series
from ..sources import testviews
from . import oracles

FLAGSHIP = "blocks_by_subject"
AS_OF = date(2000, 6, 15)
FACTS = ("sessao", "bloco", "erro", "simulado")
#: A weekly plan: weekday (0: Monday), slot, activity.
PLAN = [(d, slot, name) for d in range(7) for slot, name in (("06:00-08:00", "TEORIA"), ("12:30-14:00", "QUESTOES"), ("19:00-22:30", "REVISAO")) if (d, name) != (6, "REVISAO")]

Query = Callable[[SparkSession, str], DataFrame]


def over(names: tuple[str, ...], use: Callable[[dict[str, DataFrame]], DataFrame]) -> Query:
    return lambda spark, folder: use(testviews.tables(spark, folder, *names))


def _block_ipr(t):
    return facts.scored_blocks(t).select("bloco_id", "aluno_id", F.col("ipr").cast("double").alias("ipr"), scores.pct("total_acertos", "total_questoes").alias("percentual_acerto"))


def _mock_ipr(t):
    return facts.scored_mocks(t).select("simulado_id", "aluno_id", F.col("ipr").cast("double").alias("ipr"))


def _streaks(t):
    days = t["atividade"].select("aluno_id", F.to_date("data").alias("dia")).distinct().withColumn("mes", F.trunc("dia", "month"))
    return facts.streaks(days)


def _plan(spark: SparkSession, folder: str) -> DataFrame:
    plan = spark.createDataFrame(PLAN, "dia_semana int, horario string, atividade string")
    return listing.plan_adherence(testviews.view(spark, folder, "atividade"), plan, "data", ["aluno_id"])


def _new_subjects(t):
    """Names of topics, cut to their first words, offered as subjects: many alike, some with weight 0."""
    offered = t["assunto"].select("assunto_id", F.regexp_replace("nome", " [0-9]+$", "").alias("nome"), (F.col("assunto_id") % 5).alias("peso_prova"))
    return ingest.new_subjects(offered, t["materia"], "assunto_id").select("assunto_id", "nome", "peso_prova")


def _invalid(t):
    return ingest.checked(t["prova"], "prova").where(F.size("motivos") > 0).select("prova_id", "ano", F.array_join("motivos", ",").alias("motivos"))


def _invalid_blocks(t):
    """Blocks with doubled hits, so that some have more hits than questions."""
    doubled = t["bloco"].withColumn("total_acertos", F.col("total_acertos") * 2 - 12)
    return ingest.checked(doubled, "bloco").where(F.size("motivos") > 0).select("bloco_id", F.array_join("motivos", ",").alias("motivos"))


def _failing(df: DataFrame, table: str, *columns: str) -> DataFrame:
    return ingest.checked(df, table).where(F.size("motivos") > 0).select(*columns, F.array_join("motivos", ",").alias("motivos"))


def _invalid_sessions(t):
    """Sessions ten minutes shorter, of doubled focus and with one kind renamed."""
    changed = t["sessao"].withColumns({"minutos_liquidos": F.col("minutos_liquidos") - 10, "nivel_foco": F.col("nivel_foco") * 2, "tipo_sessao": F.when(F.col("tipo_sessao") != "REVISAO", F.col("tipo_sessao"))})
    return _failing(changed, "sessao", "pai_id", "minutos_liquidos", "nivel_foco")


def _invalid_errors(t):
    """Error rows with one less each and one kind renamed."""
    changed = t["erro"].withColumns({"quantidade": F.col("quantidade") - 1, "tipo_erro": F.when(F.col("tipo_erro") == "PRESSA", "OUTRO").otherwise(F.col("tipo_erro"))})
    return _failing(changed, "erro", "bloco_id", "tipo_erro", "quantidade")


def _invalid_mocks(t):
    """Mock exams a week later, with a cycle less and more fatigue. More hits than questions are allowed."""
    changed = t["simulado"].withColumns({"numero_semana": F.col("numero_semana") + 1, "numero_ciclo": F.col("numero_ciclo") - 1, "nivel_fadiga": F.col("nivel_fadiga") + 1, "total_acertos": F.col("total_acertos") * 3})
    return _failing(changed, "simulado", "simulado_id")


def _invalid_mock_subjects(t):
    changed = t["desempenho_simulado"].withColumns({"total_questoes": F.col("total_questoes") - 5, "total_acertos": F.col("total_acertos") - 2, "tempo_total_segundos": F.col("tempo_total_segundos") - 300})
    return _failing(changed, "desempenho_simulado", "simulado_id", "total_questoes", "total_acertos", "tempo_total_segundos")


def _invalid_exam_subjects(t):
    changed = t["desempenho_prova"].withColumns({"percentual_acerto": F.col("percentual_acerto") - 10, "tempo_total_segundos": F.col("tempo_total_segundos") - 700})
    return _failing(changed, "desempenho_prova", "prova_id", "materia_id", "tempo_total_segundos")


def _invalid_essays(t):
    """Essays with their theme fifty times over, one score raised and one lowered."""
    changed = t["redacao"].withColumns({"tema": F.repeat("tema", 50), "competencia1": F.col("competencia1") + 20, "competencia5": F.col("competencia5") - 20})
    return _failing(changed, "redacao", "redacao_id")


def _filled_essays(t):
    """Essays of which some lack their time or axis, as they are stored."""
    gaps = t["redacao"].withColumns({"data_escrita": F.when(F.col("redacao_id") % 3 != 0, F.col("data_escrita")), "eixo_tematico": F.when(F.col("competencia1") > 100, F.col("eixo_tematico")).when(F.col("competencia2") > 100, "")})
    filled = ingest.with_defaults(gaps, F.lit(AS_OF).cast("timestamp"), "data_escrita")
    return filled.select("redacao_id", F.to_date("data_escrita").alias("dia"), "eixo_tematico")


def _new_topics(t):
    """Each topic offered in a later week, for a later subject and by a name without its number, so that many are alike, unknown or there already."""
    offered = t["assunto"].select("assunto_id", (F.col("materia_id") + F.col("assunto_id") % 3).alias("materia_id"), F.when(F.col("assunto_id") % 2 == 0, F.upper("nome")).otherwise(F.regexp_replace("nome", " [0-9]+$", "")).alias("nome"), (F.col("semana_do_ciclo") + 1).alias("semana_do_ciclo"))
    return ingest.new_topics(offered, t["assunto"], t["materia"], "assunto_id").select("assunto_id", "materia_id", "nome", "semana_do_ciclo")


def _stored_essays(t):
    e = t["redacao"]
    back = essays.read_back(e, essays.essay_long(e), essays.essay_analysis(e))
    return back.select("redacao_id", "aluno_id", F.to_date("data_escrita").alias("dia"), "tema", *scores.COMPETENCIES, "nota_total", "status", "competencia_mais_fraca", "diagnostico", "recomendacao")


def _band_labels(t):
    name, span = scores.band_label(F.col("status"))
    return essays.essay_scores(t["redacao"]).select("redacao_id", "status", name.alias("rotulo"), span.alias("faixa"))


def _first_pairs(t):
    return breakdowns.corr_first_pairs(t, ["pai_id", "aluno_id", "materia_id", "assunto_id", "nivel_foco"], [])


def _nested(df: DataFrame, column: str, *fields: str) -> DataFrame:
    """An array of rows as one text: fields parted by colons, rows by commas."""
    return df.withColumn(column, F.array_join(F.transform(column, lambda x: F.concat_ws(":", *(x[f].cast("string") for f in fields))), ","))


def _status_map(t):
    found = essays.essay_status_map(t)
    return _nested(found.withColumn("distribuicao", F.map_entries("distribuicao")), "distribuicao", "key", "value")


def _latest(t):
    tie = ["pai_id", "aluno_id", "materia_id", "assunto_id", "tipo_sessao", "minutos_liquidos", "nivel_foco", "nivel_energia"]
    return listing.latest(t["sessao"], "data", tie).select("pai_id", "aluno_id", "materia_id", "assunto_id", "tipo_sessao", "minutos_liquidos")


ESSAY_COLUMNS = ("redacao_id", "aluno_id", "tema", *scores.COMPETENCIES, "nota_total", "status", "competencia_mais_fraca", "diagnostico", "recomendacao")


def _essay_page(t):
    """A page far from the first, after the essay 500 of a day."""
    e = t["redacao"]
    page = essays.essay_page(e, essays.essay_long(e), essays.essay_analysis(e), after=[datetime(1998, 5, 20), 500])
    return page.select(F.to_date("data_escrita").alias("dia"), *ESSAY_COLUMNS)


def _one_essay(t):
    e = t["redacao"]
    return essays.one_essay(e, essays.essay_long(e), essays.essay_analysis(e), 77).select(*ESSAY_COLUMNS)


def _essay_points(t):
    """Points of texts in which topics' names stand after bullets and line ends."""
    text = F.concat(F.lit(" • "), "nome", F.lit(" - "), F.upper("nome"), F.lit("\n\n"), F.when(F.col("assunto_id") % 3 == 0, F.col("nome")).otherwise("  "), F.lit("\r\nbem-vindo ▸ fim "))
    return t["assunto"].select("assunto_id", F.array_join(texts.points(text), "|").alias("pontos"))


def _countdown(t):
    """Official exams as targets, some past, seen from a fixed time half a year after an arbitrary start."""
    at = F.lit(datetime(2000, 1, 1, 6, 30, 15)).cast("timestamp")
    begin = F.lit(datetime(1999, 7, 1)).cast("timestamp")
    left = periods.time_left("criado_em", at)
    return t["prova"].select("prova_id", *(left[n].alias(n) for n in ("dias", "horas", "minutos", "segundos")), scores.rounded(periods.progress(begin, "criado_em", at), 6).alias("progresso"))


def _dashboard_advice(t):
    return advice.dashboard_advice(t, "ano", AS_OF).select("aluno_id", F.array_join("recomendacoes", " | ").alias("recomendacoes"))


def _report(t):
    """Each student's reports, the sections as JSON."""
    report = monthly.monthly_report(t, AS_OF)
    return report.select("aluno_id", "mes", *(F.to_json(c).alias(c) for c in report.columns if c not in ("aluno_id", "mes")))


SESSIONS, BLOCKS, MOCKS = ("sessao", "materia"), ("bloco", "erro", "materia"), ("simulado",)
ESSAYS = ("redacao",)

QUERIES: dict[str, Query] = {
    "blocks_by_subject": over(BLOCKS, breakdowns.blocks_by_subject),
    "block_ipr": over(("bloco", "erro"), _block_ipr),
    "mock_ipr": over(MOCKS, _mock_ipr),
    "month_summary": over(FACTS, facts.month_summary),
    "sessions_by_type": over(SESSIONS, breakdowns.sessions_by_type),
    "sessions_by_subject": over(SESSIONS, breakdowns.sessions_by_subject),
    "blocks_by_topic": over((*BLOCKS, "assunto"), breakdowns.blocks_by_topic),
    "blocks_by_difficulty": over(BLOCKS, breakdowns.blocks_by_difficulty),
    "blocks_grouping_sets": over(BLOCKS, breakdowns.blocks_grouping_sets),
    "errors_by_type": over(BLOCKS, breakdowns.errors_by_type),
    "error_group_share": over(BLOCKS, breakdowns.error_group_share),
    "error_trend": over(BLOCKS, breakdowns.error_trend),
    "mock_detail": over(("simulado", "desempenho_simulado"), lambda t: _nested(breakdowns.mock_detail(t), "materias", "materia_id", "total_questoes", "total_acertos", "tempo_total_segundos")),
    "official_exam_detail": over(("prova", "desempenho_prova"), lambda t: _nested(breakdowns.official_exam_detail(t), "materias", "materia_id", "percentual_acerto", "tempo_total_segundos")),
    "essay_scores": over(ESSAYS, lambda t: essays.essay_scores(t["redacao"]).select("redacao_id", "nota_total", "competencia_mais_fraca", "status")),
    "essay_long": over(ESSAYS, lambda t: essays.essay_long(t["redacao"])),
    "essay_wide": over(ESSAYS, lambda t: essays.essay_wide(essays.essay_long(t["redacao"]))),
    "essay_stats": over(ESSAYS, essays.essay_stats),
    "essay_status_dist": over(ESSAYS, essays.essay_status_dist),
    "essay_progress": over(ESSAYS, essays.essay_progress),
    "mental_state": over(FACTS, breakdowns.mental_state),
    "month_compare": over((*FACTS, "redacao"), reports.month_compare),
    "month_projection": over(FACTS, lambda t: reports.month_projection(t, AS_OF, [])),
    "day_rollup": over(FACTS, lambda t: facts.block_days(t, []).drop("horas_exatas", "n_bloco")),
    "best_worst_day": over(FACTS, lambda t: facts.best_worst_day(t, [])),
    "streaks": over(("atividade",), _streaks),
    "consistency": over(FACTS, lambda t: facts.consistency(t, [])),
    "corr_focus_ipr": over(FACTS, lambda t: breakdowns.corr_focus_ipr(t, [])),
    "corr_sleep_hits": over(MOCKS, lambda t: breakdowns.corr_sleep_hits(t, [])),
    "corr_anxiety_errors": over(MOCKS, lambda t: breakdowns.corr_anxiety_errors(t, [])),
    "subject_balance": over((*FACTS, "materia"), lambda t: breakdowns.subject_balance(t, [])),
    "period_hours": over(FACTS, lambda t: reports.period_hours(t, "ano", AS_OF)),
    "dashboard": over(FACTS, lambda t: reports.dashboard(t, "ano", AS_OF)),
    "dashboard_single": over(FACTS, lambda t: reports.dashboard(t, "mes", AS_OF, [])),
    "critical_topics": over(FACTS, lambda t: reports.critical_topics(t, "ano", AS_OF)),
    "analytics_counts": over(FACTS, lambda t: reports.analytics_counts(t, "ano", AS_OF)),
    "subject_performance": over((*FACTS, "materia"), lambda t: reports.subject_performance(t, "ano", AS_OF)),
    "subject_dashboard": over((*FACTS, "materia"), lambda t: series.subject_dashboard(t, "ano", AS_OF)),
    "subject_outlook": over((*FACTS, "materia"), lambda t: series.subject_outlook(t, "ano", AS_OF)),
    "mean_subject_ipr": over((*FACTS, "materia"), lambda t: series.mean_subject_ipr(t, "ano", AS_OF)),
    "block_series": over(("bloco",), lambda t: series.block_series(t, "ano", AS_OF)),
    "mock_series": over(MOCKS, series.mock_series),
    "first_topics": over((*BLOCKS, "assunto"), lambda t: series.first_topics(t, keys=[])),
    "competency_rows": over(ESSAYS, series.competency_rows),
    "correlations": over(FACTS, lambda t: series.correlations(t, [])),
    "scaled_ipr": over(("bloco", "erro"), series.scaled_ipr),
    "dashboard_advice": over(FACTS, _dashboard_advice),
    "monthly_advice": over((*FACTS, "materia", "assunto", "redacao"), lambda t: monthly.month_advice_rows(t, AS_OF, [])),
    "essay_advice": over(ESSAYS, advice.essay_advice),
    "month_labels": over(FACTS, advice.month_labels),
    "monthly_report": lambda spark, folder: over(REPORT_TABLES, _report)(spark, folder),
    "essay_page": over(ESSAYS, _essay_page),
    "one_essay": over(ESSAYS, _one_essay),
    "advice_points": over(("assunto",), _essay_points),
    "countdown": over(("prova",), _countdown),
    "subject_topics": over(("assunto",), lambda t: listing.named_list(t["assunto"], key="materia_id", value=3).select("assunto_id", "nome", "semana_do_ciclo")),
    "plan_adherence": _plan,
    "latest_sessions": over(("sessao",), _latest),
    "invalid_exams": over(("prova",), _invalid),
    "invalid_blocks": over(("bloco",), _invalid_blocks),
    "new_subjects": over(("assunto", "materia"), _new_subjects),
    "new_topics": over(("assunto", "materia"), _new_topics),
    "invalid_sessions": over(("sessao",), _invalid_sessions),
    "invalid_errors": over(("erro",), _invalid_errors),
    "invalid_mocks": over(MOCKS, _invalid_mocks),
    "invalid_mock_subjects": over(("desempenho_simulado",), _invalid_mock_subjects),
    "invalid_exam_subjects": over(("desempenho_prova",), _invalid_exam_subjects),
    "invalid_essays": over(ESSAYS, _invalid_essays),
    "filled_essays": over(ESSAYS, _filled_essays),
    "stored_essays": over(ESSAYS, _stored_essays),
    "band_labels": over(ESSAYS, _band_labels),
    "essay_status_map": over(ESSAYS, _status_map),
    "essay_evolution": over(ESSAYS, lambda t: _nested(essays.essay_evolution(t), "evolucao", "dia", "redacao_id", "nota")),
    "closed_month": over(FACTS, lambda t: reports.closed_month(t, AS_OF)),
    "corr_first_pairs": over(FACTS, _first_pairs),
}
ORACLES = oracles.build()

#: Sections of the monthly report, each as a table that must equal the query of that name and its SQL; those of the second kind over all students together.
REPORTED = {
    "month_summary": "resumo_geral", "sessions_by_type": "sessoes_por_tipo", "sessions_by_subject": "sessoes_por_materia", "blocks_by_subject": "blocos_por_materia", "blocks_by_topic": "blocos_por_assunto",
    "blocks_by_difficulty": "blocos_por_dificuldade", "errors_by_type": "erros_por_tipo", "error_group_share": "erros", "error_trend": "tendencia_erros", "mock_detail": "simulados", "official_exam_detail": "provas_oficiais",
    "essay_stats": "redacoes", "essay_status_dist": "status_redacoes", "mental_state": "estado_mental", "month_compare": "comparativo_mes_anterior",
}
REPORTED_OVERALL = {
    "month_projection": "projecao_fechamento", "consistency": "consistencia", "best_worst_day": "melhor_e_pior_dia", "corr_focus_ipr": "foco_ipr", "corr_sleep_hits": "sono_acerto", "corr_anxiety_errors": "ansiedade_erro",
    "subject_balance": "balanceamento_materias",
}
REPORT_TABLES = (*FACTS, "materia", "assunto", "redacao", "desempenho_simulado", "prova", "desempenho_prova")


def _section(name: str, section: str, keys: list[str]) -> Query:
    def rows(t):
        found = monthly.section_rows(monthly.monthly_report(t, AS_OF, keys, (section,)), section, keys)
        fields = {"simulados": ("materia_id", "total_questoes", "total_acertos", "tempo_total_segundos"), "provas_oficiais": ("materia_id", "percentual_acerto", "tempo_total_segundos")}
        return _nested(found, "materias", *fields[section]) if section in fields else found

    return over(REPORT_TABLES, rows)


QUERIES |= {f"report_{n}": _section(n, s, ["aluno_id"]) for n, s in REPORTED.items()} | {f"report_{n}": _section(n, s, []) for n, s in REPORTED_OVERALL.items()}
ORACLES |= {f"report_{n}": ORACLES[n] for n in (*REPORTED, *REPORTED_OVERALL)}
