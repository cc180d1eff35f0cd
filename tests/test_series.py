"""Numbered series, subject dashboards, time left, lists, stores: worked cases."""

import re
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F
from studyperf.functions import periods, scores
from studyperf.operators import essays, listing, series
from studyperf.sources import store, testviews

BLOCK = "bloco_id long, aluno_id long, data timestamp, materia_id long, assunto_id long, dificuldade int, total_questoes int, total_acertos int, tempo_total_segundos int"
MOCK = "simulado_id long, aluno_id long, numero_ciclo int, numero_semana int, total_questoes int, total_acertos int, tempo_total_segundos int, nivel_ansiedade int, nivel_fadiga int, qualidade_sono int, criado_em timestamp"
SESSION = "aluno_id long, data timestamp, materia_id long, minutos_liquidos int"
AS_OF = date(2000, 6, 15)


def tables(spark):
    blocks = [(k, 1, datetime(2000, 1 + k % 3, 1 + k // 3, 9), 1, 1, 5, 10, 10, 1200) for k in range(9)]
    mocks = [(k, 1, k, 1 + k % 4, 90, 45, 3600, None, None, None, datetime(2000, 2, 1 + k)) for k in range(12)]
    return {
        "bloco": spark.createDataFrame(blocks, BLOCK),
        "erro": spark.createDataFrame([(0, "PRESSA", 2)], "bloco_id long, tipo_erro string, quantidade int"),
        "simulado": spark.createDataFrame(mocks, MOCK),
        "sessao": spark.createDataFrame([(1, datetime(2000, 3, 1), 2, 60), (2, datetime(1999, 3, 1), 2, 60)], SESSION),
        "materia": spark.createDataFrame([(1, "B"), (2, "A"), (3, "C")], "materia_id long, nome string"),
    }


def test_blocks_are_numbered_from_the_oldest(spark):
    rows = series.block_series(tables(spark), "ano", AS_OF).orderBy("posicao").collect()
    assert [r["bloco_id"] for r in rows] == [0, 3, 6, 1, 4, 7, 2, 5, 8] and [r["rotulo"] for r in rows] == [f"B{k}" for k in range(1, 10)]


def test_newest_mocks(spark):
    rows = series.mock_series(tables(spark)).orderBy("nth").collect()
    assert [r["simulado_id"] for r in rows] == list(range(11, 1, -1)) and rows[0]["rotulo"] == "C11S4" and rows[0]["percentual_acerto"] == 50.0


def test_subject_dashboard_shares_mocks(spark):
    got = {r["materia_id"]: tuple(r)[3:] for r in series.subject_dashboard(tables(spark), "ano", AS_OF).collect()}
    # twelve mock exams: 12 hours, 1080 questions (a seventh: 154), 540 hits
    assert got[1] == (15.0, 244, 630, 258.2, 0.9978, 630) and got[2][:3] == (13.0, 154, 540) and got[3][:3] == (12.0, 154, 540)
    alone = {r["materia_id"]: tuple(r)[3:] for r in series.subject_dashboard(tables(spark), "ano", AS_OF, mocks_in_subject=False).collect()}
    assert alone[1] == (3.0, 90, 90, 100.0, 0.9978, 90) and alone[3] == (0.0, 0, 0, 0.0, 0.0, 0)
    assert series.mean_subject_ipr(tables(spark), "ano", AS_OF).collect() == [(1, 3, 0.3326)]


def test_empty_tables(spark):
    none = {n: df.limit(0) for n, df in tables(spark).items()}
    assert series.block_series(none, "ano", AS_OF).count() == series.mock_series(none).count() == series.subject_dashboard(none, "ano", AS_OF).count() == 0


def test_time_left_and_progress(spark):
    at = lambda *x: F.lit(datetime(*x))
    row = spark.range(1).select(
        periods.time_left(at(2000, 1, 3, 1, 2, 3), at(2000, 1, 1)).alias("a"), periods.time_left(at(2000, 1, 1), at(2000, 1, 2)).alias("b"),
        periods.progress(at(2000, 1, 1), at(2000, 1, 11), at(2000, 1, 6)).alias("c"), periods.progress(at(2000, 1, 1), at(2000, 1, 11), at(2001, 1, 1)).alias("d"),
        scores.normalised(F.lit(3), F.lit(1), F.lit(5)).alias("e"), scores.normalised(F.lit(3), F.lit(3), F.lit(3)).alias("f"),
    ).first()
    assert tuple(row["a"]) == (2, 1, 2, 3) and tuple(row["b"]) == (0, 0, 0, 0) and tuple(row)[2:] == (50.0, 100.0, 0.5, 0.0)


def test_named_lists(spark):
    subjects = tables(spark)["materia"]
    assert [r["nome"] for r in listing.named_list(subjects).collect()] == ["A", "B", "C"]
    assert [r["nome"] for r in listing.named_list(subjects, "nome", "materia_id", 3).collect()] == ["C"]


def test_facts_and_essays_are_appended(spark, tmp_path):
    folder = str(tmp_path)
    store.append(tables(spark)["bloco"], folder, "bloco")
    store.append(tables(spark)["bloco"].limit(1), folder, "bloco")
    assert spark.read.parquet(f"{folder}/bloco").count() == 10 and len(list((tmp_path / "bloco").glob("mes=*"))) == 3
    essay = "redacao_id string, aluno_id string, tema string, eixo_tematico string, data_escrita timestamp, tempo_escrita_min int, " + ", ".join(f"competencia{k} int" for k in range(1, 6))
    rows = [("a", "1", "t", None, datetime(2000, 1, 1), 30, 100, 120, 80, 200, 160), ("b", "1", "t", None, datetime(2000, 1, 1), 30, 100, 120, 80, 201, 160)]
    rejected = store.append_essays(spark.createDataFrame(rows, essay), folder)
    assert [r["redacao_id"] for r in rejected.collect()] == ["b"]
    assert spark.read.parquet(f"{folder}/competencia").count() == 5
    assert spark.read.parquet(f"{folder}/analise").select("nota_total", "status", "competencia_mais_fraca").collect() == [(660, "regular", 3)]
    store.write_json(spark.createDataFrame([(1, date(2000, 3, 1))], "n int, mes date"), f"{folder}/json")
    assert spark.read.json(f"{folder}/json").where("ano = 2000 and mes_n = 3").count() == 1


def progress(rows, last):
    """By a plain loop: total, latest, change against the others' mean, and the last scores in order."""
    rows = sorted(rows)
    notes = [n for *_, n in rows]
    others = notes[:-1]
    return len(notes), notes[-1], round(notes[-1] - (sum(others) / len(others) if others else notes[-1]), 1), ",".join(map(str, notes[-last:]))


@pytest.mark.parametrize("keys", [["aluno_id"], []])
def test_progress_of_essays(spark, keys):
    rng = [(k * 7919) % 1000 for k in range(60)]
    rows = [(None if k % 4 == 0 else k % 4, datetime(2000, 1, 1 + x % 9), k, x % 3 * 40, x % 5 * 40, 40, 80, x % 6 * 20) for k, x in enumerate(rng)] + [(9, datetime(2000, 1, 1), 99, 0, 0, 0, 0, 0)]
    df = spark.createDataFrame(rows, "aluno_id int, data_escrita timestamp_ntz, redacao_id int, " + ", ".join(f"competencia{k} int" for k in range(1, 6))).repartition(4)
    out = essays.essay_progress({"redacao": df}, keys, last=5)
    groups = {}
    for who, when, i, *notes in rows:
        groups.setdefault(who if keys else "all", []).append((when, i, sum(notes)))
    got = {r["aluno_id"] if keys else "all": (r["total"], r["ultima"], r["variacao"], r["ultimas_notas"]) for r in out.collect()}
    assert got == {who: progress(x, 5) for who, x in groups.items()}
    assert essays.essay_progress({"redacao": df.limit(0)}, keys).count() == 0


def test_top_rows_are_chosen_in_each_task(spark):
    t = testviews.tables(spark, "/root/testdata/sf0.001", "redacao", "simulado")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for top in (essays.essay_progress, lambda t, keys: series.mock_series(t, keys=keys)):
        assert "TakeOrderedAndProject" in plan(top(t, [])) and re.search(r"WindowGroupLimit \[aluno_id.*Partial", plan(top(t, ["aluno_id"])))
