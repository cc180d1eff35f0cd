"""Advice, texts and the nested report: worked cases, and the report's sections against their own tables."""

import json
import os
import subprocess
import sys
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F
from studyperf.functions import scores, texts
from studyperf.operators import advice, breakdowns, essays, facts, monthly, reports, series
from studyperf.plans import catalog
from studyperf.sources import testviews

SMALL = "/root/testdata/sf0.001"


def one(spark, value, kind, column):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("hours", "text"), [(0.0, "0h"), (1.5, "1h 30min"), (2.0, "2h"), (0.1, "0h 6min"), (10.25, "10h 15min"), (1.01, "1h 1min"), (None, None)])
def test_hours_text(spark, hours, text):
    assert one(spark, hours, "double", texts.hours_text) == text


@pytest.mark.parametrize(("text", "points"), [(None, []), ("", []), ("  ", []), ("um só", ["um só"]), ("• um • dois\n três", ["um", "dois", "três"]), ("bem-vindo", ["bem-vindo"]), ("a\r\n\r\nb ", ["a", "b"])])
def test_points(spark, text, points):
    assert one(spark, text, "string", texts.points) == points


@pytest.mark.parametrize(("note", "band"), [(0, 0), (80, 0), (81, 1), (140, 1), (141, 2), (200, 2)])
def test_texts_by_score(spark, note, band):
    for k in range(1, 6):
        assert one(spark, note, "int", lambda n: texts.by_score(texts.DIAGNOSES, F.lit(k), n)) == texts.DIAGNOSES[k - 1][band]
    assert one(spark, note, "int", lambda n: texts.by_score(texts.EXERCISES, F.lit(6), n)) == ""


@pytest.mark.parametrize(("hits", "questions", "seconds", "difficulty", "careless", "ipr"), [(10, 10, 1200, 5, 0, 1.0), (5, 10, 3000, 1, 0, 0.34), (5, 10, 2100, 3, 10, 0.42), (0, 10, 9000, 1, 90, 0.0), (0, 0, 0, 3, 0, 0.0)])
def test_block_score(spark, hits, questions, seconds, difficulty, careless, ipr):
    row = spark.createDataFrame([(hits, questions, seconds, difficulty, careless)], "total_acertos int, total_questoes int, tempo_total_segundos int, dificuldade int, erros_criticos int")
    assert float(row.select(scores.block_ipr().alias("ipr")).first()["ipr"]) == ipr


@pytest.mark.parametrize(("total", "band"), [(399, "critica"), (400, "fraca"), (599, "fraca"), (600, "regular"), (700, "boa"), (799, "boa"), (800, "muito_boa"), (899, "muito_boa"), (900, "excelente")])
def test_essay_bands(spark, total, band):
    assert one(spark, total, "int", scores.essay_band) == band


@pytest.mark.parametrize(("now", "before", "label"), [(1.0, 0.0, "ESTÁVEL"), (0.5, 0.4, "ASCENDENTE"), (0.4, 0.5, "DECLÍNIO"), (0.52, 0.5, "ESTÁVEL")])
def test_trend(spark, now, before, label):
    assert one(spark, now, "double", lambda x: scores.trend(x, F.lit(before))) == label


def test_report_holds_its_sections(spark):
    names = ("sessao", "bloco", "erro", "simulado", "materia", "assunto", "redacao", "desempenho_simulado", "prova", "desempenho_prova")
    t = testviews.tables(spark, SMALL, *names)
    rows = catalog.QUERIES["monthly_report"](spark, SMALL).collect()
    months = {tuple(r) for df in (facts.month_summary(t), essays.essay_stats(t), breakdowns.official_exam_detail(t)) for r in df.select("aluno_id", "mes").collect()}
    assert len(rows) == len(months) and {(r["aluno_id"], r["mes"]) for r in rows} == months
    assert any(r["resumo_geral"] is None and r["redacoes"] is not None for r in rows)  # essays alone
    got = sorted((r["aluno_id"], r["mes"], b["materia_id"], b["ipr_medio"]) for r in rows for b in json.loads(r["blocos_por_materia"] or "[]"))
    want = sorted(tuple(r) for r in breakdowns.blocks_by_subject(t).select("aluno_id", "mes", "materia_id", "ipr_medio").collect())
    assert got == want
    whole = [r for r in rows if r["resumo_geral"] is not None]
    assert all(json.loads(r["recomendacoes_estrategicas"]) for r in whole)
    assert all(len(json.loads(r["balanceamento_materias"])) == 8 for r in whole)


def cells(df):
    """Rows with numbers to nine digits, whatever the order."""
    plain = lambda x: f"{x:.9g}" if isinstance(x, float) else [plain(y) for y in x] if isinstance(x, (list, tuple)) else str(x)
    return sorted(str([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())


@pytest.mark.parametrize("keys", [["pessoa", "turma"], []])
def test_every_section_equals_its_own_table(spark, keys):
    """Keys other than the usual one, and none."""
    t = testviews.tables(spark, SMALL, *catalog.REPORT_TABLES)
    changed = {n: df.withColumnsRenamed({"aluno_id": "pessoa"}).withColumn("turma", F.col("pessoa") % 3) if "aluno_id" in df.columns else df for n, df in t.items()}
    report = monthly.monthly_report(changed, catalog.AS_OF, keys).persist()
    progress = {"mock_detail": lambda: breakdowns.mock_detail(changed, keys), "official_exam_detail": lambda: breakdowns.official_exam_detail(changed, keys), "month_projection": lambda: reports.month_projection(changed, catalog.AS_OF, keys)}
    homes = (facts, breakdowns, essays, reports)
    for name, section in (catalog.REPORTED | catalog.REPORTED_OVERALL).items():
        own = progress[name]() if name in progress else next(getattr(m, name) for m in homes if hasattr(m, name))(changed, keys)
        got = monthly.section_rows(report, section, keys)
        assert {c: k for c, k in got.dtypes if c not in keys} == {c: k for c, k in own.dtypes if c not in keys}, name  # ids take the widest type of all facts
        assert cells(got) == cells(own), name
    assert set(report.columns) == {*keys, "mes", *monthly.SECTIONS}
    report.unpersist()


def test_report_takes_few_shuffles(spark):
    t = testviews.tables(spark, SMALL, *catalog.REPORT_TABLES)
    plans = {"report": (monthly.monthly_report(t, catalog.AS_OF), 10), "dashboard": (reports.dashboard(t, "ano", catalog.AS_OF), 5), "outlook": (series.subject_outlook(t, "ano", catalog.AS_OF), 6)}
    for name, (df, most) in plans.items():
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= most, name


def test_subjects_of_a_report_come_by_weight(spark):
    t = testviews.tables(spark, SMALL, *catalog.REPORT_TABLES)
    rows = monthly.monthly_report(t, catalog.AS_OF, []).select("balanceamento_materias").collect()
    weights = [[x["peso_prova"] for x in r[0]] for r in rows if r[0]]
    assert weights and all(w == sorted(w, reverse=True) for w in weights)


def test_counts_without_keys(spark):
    t = testviews.tables(spark, SMALL, "sessao", "bloco", "erro", "simulado", "materia", "assunto")
    one = reports.analytics_counts(t, "ano", catalog.AS_OF, []).collect()
    each = reports.analytics_counts(t, "ano", catalog.AS_OF).collect()
    assert len(one) == 1 and one[0]["n_blocos"] == sum(r["n_blocos"] for r in each) and one[0]["questoes"] == sum(r["questoes"] for r in each)


def test_entry_without_what_the_text_queries_import():
    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; assert len(e.queries()) > 50 and 'op8_phrases' not in e.queries() and 'pipeline' not in e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_kept_blocks_change_nothing(spark):
    t = testviews.tables(spark, SMALL, "sessao", "bloco", "erro", "simulado")
    kept = facts.prepared(t)
    try:
        assert sorted(facts.month_summary(kept).collect()) == sorted(facts.month_summary(t).collect())
    finally:
        kept["bloco_pontuado"].unpersist()


def test_no_rows(spark):
    names = ("sessao", "bloco", "erro", "simulado", "materia", "assunto", "redacao")
    t = {n: df.limit(0) for n, df in testviews.tables(spark, SMALL, *names).items()}
    assert monthly.month_advice_rows(t, date(2000, 6, 15)).count() == 0
    assert advice.dashboard_advice(t, "mes", date(2000, 6, 15)).count() == 0
    assert advice.essay_advice(t).count() == 0


def test_sections_alone_make_only_their_own_cells(spark):
    """A section asked for alone reads no table that it does not need, and no cell meets the table of topics."""
    t = testviews.tables(spark, SMALL, *catalog.REPORT_TABLES)
    plan = lambda section: monthly.monthly_report(t, catalog.AS_OF, ["aluno_id"], (section,))._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan("redacoes") and "o_orderkey" not in plan("redacoes") and "doc_id" in plan("redacoes")
    assert "doc_id" not in plan("sessoes_por_tipo") and "p_partkey" not in plan("comparativo_mes_anterior")
    whole = monthly.cells(t, ["aluno_id"])
    assert "p_partkey" not in whole._jdf.queryExecution().optimizedPlan().toString()
    assert len(whole.columns) <= 16  # cells are narrow: key, month, tag, what they are broken down by, and a few numbers


def test_report_deals_its_cells_once(spark):
    """By key alone: the sums of cells and months, and the month before, come without a further shuffle, and no cell is given twice."""
    t = testviews.tables(spark, SMALL, "sessao", "bloco", "erro", "simulado", "materia", "assunto", "redacao")
    for section in ("estado_mental", "comparativo_mes_anterior", "tendencia_erros", "blocos_por_dificuldade"):
        plan = monthly.monthly_report(t, catalog.AS_OF, sections=(section,))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(aluno_id") == 1, section
        assert "explode" not in plan, section


def test_the_month_before_is_no_earlier_one(spark):
    at = "timestamp'2020-%02d-10 08:00:00'"
    t = testviews.tables(spark, SMALL, "sessao", "bloco", "erro", "simulado", "materia", "assunto", "redacao")
    rows = " union all ".join(f"select 1L pai_id, {k}L aluno_id, {at % month} data, 1L materia_id, 1L assunto_id, 'TEORIA' tipo_sessao, {minutes} minutos_liquidos, 3 nivel_foco, 3 nivel_energia" for k, month, minutes in ((1, 1, 60), (1, 2, 120), (1, 4, 180), (2, 3, 240)))
    t = {n: df.where("false") for n, df in t.items()} | {"sessao": spark.sql(rows)}
    for keys, before in ((["aluno_id"], [0.0, 1.0, 0.0, 0.0]), ([], [0.0, 1.0, 2.0, 4.0])):
        found = monthly.monthly_report(t, catalog.AS_OF, keys, ("comparativo_mes_anterior",)).orderBy(*keys, "mes").collect()
        assert [r["comparativo_mes_anterior"]["horas_anterior"] for r in found] == before


def test_critical_topics_come_by_their_ids(spark):
    """Not by their subjects; those without id come last, and without a name there is no text."""
    t = {n: df.where("false") for n, df in testviews.tables(spark, SMALL, "sessao", "bloco", "erro", "simulado", "materia", "assunto", "redacao").items()}
    t["assunto"] = spark.createDataFrame([(k, s, f"T{k}", 1) for k, s in ((10, 3), (11, 1), (12, 2), (13, 0))], "assunto_id long, materia_id long, nome string, semana_do_ciclo int")
    rows = [(1, None), (1, 13), (1, 12), (1, 10), (1, 11), (2, 11), (2, None), (3, None)] * 2
    kinds = "bloco_id long, aluno_id long, data timestamp, materia_id long, assunto_id long, dificuldade int, total_questoes int, total_acertos int, tempo_total_segundos int, nivel_confianca_medio int"
    t["bloco"] = spark.createDataFrame([(k, 1, datetime(2020, month, 10, 8), 1, topic, 1, 10, 2, 3000, 3) for k, (month, topic) in enumerate(rows)], kinds)
    found = sorted((r["mes"], r["mensagem"]) for r in monthly.month_advice_rows(t, catalog.AS_OF, []).collect() if r["categoria"] == "ASSUNTOS_CRÍTICOS")
    assert [text for _, text in found] == ["5 assunto(s) com IPR abaixo de 70%: T10, T11, T12.", "2 assunto(s) com IPR abaixo de 70%: T11.", None]


def test_report_makes_its_cells_after_dealing(spark):
    """What is shuffled by key are facts, exams and essays, a row each; their many cells are not."""
    t = testviews.tables(spark, SMALL, *catalog.REPORT_TABLES)
    plan = monthly.monthly_report(t, catalog.AS_OF)._jdf.queryExecution().optimizedPlan().toString()
    made, dealt = plan.index("Generate inline"), plan.index("RepartitionByExpression [aluno_id")
    assert made < dealt and "Generate" not in plan[dealt:]
    assert plan.count("RepartitionByExpression [aluno_id") == 2  # facts, and what stands beside them


@pytest.mark.parametrize("few", [True, False])
def test_repeated_and_unknown_topics(spark, monkeypatch, few):
    """A repeated topic is a row for each of its names and doubles no block; an unknown one has its id as its name. Wherever topics are named."""
    monkeypatch.setattr(monthly, "_few_topics", lambda t: few)
    t = {n: df.where("false") for n, df in testviews.tables(spark, SMALL, "sessao", "bloco", "erro", "simulado", "redacao").items()} | testviews.tables(spark, SMALL, "materia")
    t["assunto"] = spark.createDataFrame([(10, 1, "A", 1), (10, 2, "B", 2), (11, 99, "C", 3)], "assunto_id long, materia_id long, nome string, semana_do_ciclo int")
    kinds = "bloco_id long, aluno_id long, data timestamp, materia_id long, assunto_id long, dificuldade int, total_questoes int, total_acertos int, tempo_total_segundos int, nivel_confianca_medio int"
    t["bloco"] = spark.createDataFrame([(k, 1, datetime(2020, 1, 10, 8), 1, topic, 1, 10, 2, 3000, 3) for k, topic in enumerate((10, 10, 11, 12, None))], kinds)
    row = monthly.monthly_report(t, catalog.AS_OF, sections=("resumo_geral", "blocos_por_assunto")).collect()[0]
    got = [(x["assunto_id"], x["assunto_nome"], x["materia_nome"], x["total_blocos"]) for x in row["blocos_por_assunto"]]
    assert sorted(got, key=str) == sorted([(10, "A", "MATERIA_1", 2), (10, "B", "MATERIA_2", 2), (11, "C", None, 1), (12, "12", None, 1), (None, None, None, 1)], key=str)
    assert row["resumo_geral"]["total_blocos"] == 5


def test_few_topics_in_use_of_a_large_table(spark, monkeypatch):
    t = testviews.tables(spark, SMALL, "bloco", "assunto")
    assert monthly._few_topics(t)
    t["assunto"] = spark.createDataFrame(t["assunto"].rdd, t["assunto"].schema)  # of unknown size
    used = t["bloco"].select("assunto_id").distinct().count()
    for most, few in ((used, True), (used - 1, False)):
        monkeypatch.setattr(monthly, "FEW", most)
        assert monthly._few_topics(t) == few


@pytest.mark.parametrize(("own", "then"), [(None, "16m"), ("4m", "4m")])
def test_report_parts_are_put_together_up_to_16_mb(spark, own, then):
    """Facts are packed small, so that 64 MB of them are a large task; a size that the user has set stays."""
    spark.conf.unset(monthly.PART)
    try:
        if own:
            spark.conf.set(monthly.PART, own)
        monthly.monthly_report(testviews.tables(spark, SMALL, *catalog.REPORT_TABLES), catalog.AS_OF, sections=("estado_mental",))
        assert spark.conf.get(monthly.PART) == then
    finally:
        spark.conf.unset(monthly.PART)


def test_report_parts_follow_the_facts(spark, monkeypatch):
    """With a fixed number of parts each would grow with the facts; a number that the user has set stays."""
    t = testviews.tables(spark, SMALL, *catalog.REPORT_TABLES)
    dealt = lambda: monthly.cells(t, ["aluno_id"], ("sessoes",))._jdf.queryExecution().optimizedPlan().toString()
    asked = lambda: monthly._set_parts(t)  # noqa: E731  as the report does
    spark.conf.unset(monthly.BEGUN)
    spark.conf.unset(monthly.PART)
    try:
        asked()
        assert spark.conf.get(monthly.BEGUN) == "8" and "RepartitionByExpression [aluno_id#" in dealt() and ", 8" in dealt()
        monkeypatch.setattr(monthly, "FILES", 1000)
        asked()
        many = int(spark.conf.get(monthly.BEGUN))
        assert many > monthly.MANY and spark.conf.get(monthly.PART) == "4m"
        assert f", {monthly._parts(t['sessao'])}" in dealt() and monthly._parts(t["sessao"]) > 8
        monkeypatch.setattr(monthly, "FILES", 1 << 30)
        asked()
        assert spark.conf.get(monthly.BEGUN) == "8" and spark.conf.get(monthly.PART) == "16m"
        spark.conf.set(monthly.BEGUN, "20")
        asked()
        assert spark.conf.get(monthly.BEGUN) == "20"
        assert monthly._parts(spark.sparkContext.parallelize([(1,)]).toDF(["a"])) == 8  # of unknown size
    finally:
        spark.conf.unset(monthly.BEGUN)
        spark.conf.unset(monthly.PART)
