"""Stored tables as they are read again, and the small helpers around them."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from studyperf.functions import periods, scores
from studyperf.operators import breakdowns, essays, facts, ingest, listing, reports
from studyperf.sources import store

COLUMNS = "redacao_id string, aluno_id string, tema string, eixo_tematico string, data_escrita timestamp_ntz, tempo_escrita_min int, competencia1 int, competencia2 int, competencia3 int, competencia4 int, competencia5 int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored"))
    rows = [("a", "s", "x", None, None, None, 200, 160, 40, 40, 120), ("b", "s", "y", "", None, 60, 0, 0, 0, 0, 0), ("c", "s", "z" * 301, "e", None, 1, 0, 0, 0, 0, 0), ("d", "s", "w", "e", None, 1, 0, 0, 0, 0, 201)]
    rejected = store.append_essays(spark.createDataFrame(rows, COLUMNS), path)
    assert {r["redacao_id"]: r["motivos"] for r in rejected.collect()} == {"c": ["tema"], "d": ["competencia5"]}
    return path


def test_stored_tables_have_their_schemas(spark, folder):
    for name in ("redacao", "competencia", "analise"):
        wanted = spark.createDataFrame([], store.SCHEMAS[name])
        assert store.read(spark, folder, name).select(wanted.columns).dtypes == wanted.dtypes
    raw = spark.read.parquet(f"{folder}/analise")
    assert dict(raw.drop("lote").dtypes) == dict(spark.createDataFrame([], store.SCHEMAS["analise"]).dtypes)


def test_essays_are_read_back_with_their_analysis(spark, folder):
    read = lambda name: store.read(spark, folder, name)
    got = {r["redacao_id"]: r for r in essays.read_back(read("redacao"), read("competencia"), read("analise")).collect()}
    a, b = got["a"], got["b"]
    assert set(got) == {"a", "b"} and a["eixo_tematico"] == b["eixo_tematico"] == "geral" and a["data_escrita"] is not None
    assert [a[c] for c in scores.COMPETENCIES] == [200, 160, 40, 40, 120]
    assert (a["nota_total"], a["status"], a["competencia_mais_fraca"]) == (560, "fraca", 3)
    assert (a["diagnostico"], a["recomendacao"]) == ("A competência 3 foi a mais fraca.", "Treinar mais a competência 3.")


def test_reading_back_bears_missing_rows(spark, folder):
    read = lambda name: store.read(spark, folder, name)
    got = essays.read_back(read("redacao"), read("competencia").where("competencia <> 2"), read("analise").where("false")).where("redacao_id = 'a'").first()
    assert got["competencia2"] is None and got["nota_total"] is None and got["competencia1"] == 200


def test_closed_month_goes_over_the_year():
    assert periods.closed_month(date(2026, 1, 31)) == date(2025, 12, 1)
    assert periods.closed_month(date(2026, 3, 1)) == date(2026, 2, 1)


def test_labels_of_unknown_bands(spark):
    df = spark.createDataFrame([(" MUITO_BOA ",), ("nova",), (None,)], "status string")
    assert [tuple(r) for r in df.select(*scores.band_label(F.col("status"))).collect()] == [("Muito Boa", "800–899"), ("—", ""), ("—", "")]


@pytest.mark.parametrize("table", ["sessao", "bloco", "erro", "simulado", "desempenho_simulado", "prova", "desempenho_prova", "redacao"])
def test_checks_take_empty_and_null_rows(spark, table):
    schema = store.SCHEMAS[table]
    assert ingest.checked(spark.createDataFrame([], schema), table).count() == 0
    nulls = spark.createDataFrame([(None,) * len(schema.split(", "))], schema)
    assert ingest.checked(nulls, table).first()["motivos"]


def test_first_pairs_are_the_first(spark):
    """Forty equal sessions and three blocks on a day, a better day after: only the first day's pairs count."""
    stamp = "timestamp_ntz"
    s = spark.sql(f"select 's' as aluno_id, cast('2000-01-0' || d || ' 08:00:00' as {stamp}) as data, 1 as materia_id, 1 as assunto_id, 'TEORIA' as tipo_sessao, 30 as minutos_liquidos, 1 + cast(i % 5 as int) as nivel_foco, 3 as nivel_energia, i from range(40) t(i) cross join (values (1), (2)) v(d)")
    b = spark.sql(f"select i as bloco_id, 's' as aluno_id, cast('2000-01-0' || d || ' 09:00:00' as {stamp}) as data, 1 as materia_id, 1 as assunto_id, 3 as dificuldade, 10 as total_questoes, cast(i * d + 1 as int) as total_acertos, 600 as tempo_total_segundos, 3 as nivel_confianca_medio from range(3) t(i) cross join (values (1), (2)) v(d)")
    e = spark.createDataFrame([], "bloco_id long, tipo_erro string, quantidade int")
    t = {"sessao": s, "bloco": b, "erro": e}
    got = breakdowns.corr_first_pairs(t, ["i"], max_pairs=30).first()
    assert (got["pares"], got["correlacao"]) == (30, 0.0)  # ten sessions, two of each focus, with all three blocks
    assert breakdowns.corr_first_pairs(t, ["i"], max_pairs=1000).first()["pares"] == breakdowns.corr_focus_ipr(t).first()["pares"] == 240


def block(spark, *rows):
    """Blocks of (id, day): ten questions each."""
    made = [(i, "s", datetime.fromisoformat(day) if day else None, "m", "a", 3, 10, 7, 600, 3) for i, day in rows]
    return spark.createDataFrame(made, store.SCHEMAS["bloco"])


def scanned(df):
    """The part of a plan that tells what is read."""
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_the_months_asked_for_are_read(spark, tmp_path):
    folder = str(tmp_path)
    store.append(block(spark, *((f"{y}{m}", f"{y}-{m:02}-10") for y in (1999, 2000) for m in range(1, 13)), ("none", None)), folder, "bloco")
    spark.createDataFrame([("20005", "PRESSA", 2)], store.SCHEMAS["erro"]).write.parquet(f"{folder}/erro")
    read = lambda *ends: store.read(spark, folder, "bloco", *ends)
    assert read().count() == 25 and len(read().inputFiles()) == 25
    some = read(date(2000, 3, 5), date(2000, 5, 1))
    assert sorted(r["bloco_id"] for r in some.collect()) == ["20003", "20004", "20005"] and len(files(some)) == 3
    assert {r["bloco_id"] for r in read(date(2000, 11, 15)).collect()} == {"200012"} and {r["bloco_id"] for r in read(None, date(1999, 1, 31)).collect()} == {"19991"}
    # a filter on the month of what is computed, and a period's start, reach the partitions
    t = {"bloco": read(), "erro": store.read(spark, folder, "erro")}
    one = breakdowns.blocks_by_difficulty(t).where(F.col("mes") == F.lit(date(2000, 5, 1)))
    assert "PartitionFilters: [isnotnull(mes" in scanned(one) and one.first()["total_blocos"] == 1
    none = {"sessao": empty(spark, "sessao"), "simulado": empty(spark, "simulado")}
    sums = reports.period_sums(t | none, "mes", date(2000, 12, 20))
    assert "PartitionFilters: [isnotnull(mes" in scanned(sums) and sums.first()["n_blocos"] == 1


def files(df):
    return {r[0] for r in df.select(F.input_file_name()).distinct().collect()}


def empty(spark, table):
    return spark.createDataFrame([], store.SCHEMAS[table])


def test_a_foreign_month_column_is_not_trusted(spark):
    df = block(spark, ("a", "2000-05-10")).withColumn("mes", F.lit("clash"))
    assert periods.by_month(df, "data").first()["mes"] == date(2000, 5, 1)


def test_reports_of_other_months_survive(spark, tmp_path):
    folder, report = str(tmp_path / "json"), lambda month, n: spark.createDataFrame([("s", date(2000, month, 1), n)], "aluno_id string, mes date, n int")
    store.write_json(report(5, 1), folder)
    store.write_json(report(6, 2), folder)
    store.write_json(report(5, 3), folder)
    assert sorted((r["ano"], r["mes_n"], r["n"]) for r in spark.read.json(folder).collect()) == [(2000, 5, 3), (2000, 6, 2)]


def essays_of(spark, *ids):
    return spark.createDataFrame([(i, "s", "x", None, None, None, 200, 160, 40, 40, 120) for i in ids], COLUMNS)


def counted(spark, folder):
    return [store.read(spark, folder, name).count() for name in store.BATCHED]


@pytest.mark.parametrize("broken", ["competencia", "analise", store.MARKS])
def test_a_broken_batch_is_not_seen_and_comes_again(spark, tmp_path, monkeypatch, broken):
    folder, put = str(tmp_path), store._replace

    def failing(df, path, *by):
        if path.endswith(broken):
            raise OSError("no space")
        put(df, path, *by)

    store.append_essays(essays_of(spark, "a"), folder, "one")
    monkeypatch.setattr(store, "_replace", failing)
    with pytest.raises(OSError):
        store.append_essays(essays_of(spark, "b", "c"), folder, "two")
    assert counted(spark, folder) == [1, 5, 1]
    monkeypatch.setattr(store, "_replace", put)
    for _ in range(2):  # comes again, and once more
        store.append_essays(essays_of(spark, "b", "c"), folder, "two")
        assert counted(spark, folder) == [3, 15, 3]


def test_no_batch_yet(spark, tmp_path):
    for name in store.BATCHED:
        empty_ = spark.createDataFrame([], store.SCHEMAS[name] + ", lote string" + (", mes date" if name == "redacao" else ""))
        empty_.write.parquet(f"{tmp_path}/{name}")
    assert counted(spark, str(tmp_path)) == [0, 0, 0]


@pytest.fixture(scope="module")
def database(spark):
    """A database in memory, of the engine that Spark brings along."""
    url = "jdbc:derby:memory:study;create=true"
    made = spark.sparkContext._jvm.java.sql.DriverManager.getConnection(url)
    run = made.createStatement()
    run.execute("create table bloco (bloco_id varchar(10), aluno_id varchar(10), data timestamp, materia_id varchar(10), assunto_id varchar(10), dificuldade int, total_questoes int, total_acertos int, tempo_total_segundos int, nivel_confianca_medio int)")
    rows = ", ".join(f"('b{k}', 's{k % 3}', {'null' if k % 10 == 0 else f'''timestamp('2000-0{k % 9 + 1}-1{k % 7} 08:30:00')'''}, 'm', 'a', {k % 5 + 1}, {10 + k}, {k}, {600 + k}, {'null' if k % 4 == 0 else 3})" for k in range(40))
    run.execute(f"insert into bloco values {rows}")
    run.execute("create table vazia (bloco_id varchar(10), tipo_erro varchar(20), quantidade int)")
    yield url
    made.close()


@pytest.mark.parametrize("column", ["data", "total_questoes", "nivel_confianca_medio", None])
def test_a_database_table_equals_the_stored_one(spark, database, tmp_path, column):
    df = store.read_jdbc(spark, database, "bloco", column, parts=4, driver="org.apache.derby.jdbc.EmbeddedDriver")
    assert df.rdd.getNumPartitions() == (1 if column in (None, "nivel_confianca_medio") else 4)  # all of one confidence
    store.append(df, str(tmp_path), "bloco")
    back = store.read(spark, str(tmp_path), "bloco").drop("mes")
    assert back.dtypes == df.dtypes == empty(spark, "bloco").dtypes
    rows = df.collect()
    assert len(rows) == 40 and sorted(map(str, rows)) == sorted(map(str, back.collect())) and sum(r["data"] is None for r in rows) == 4
    assert facts.days({"bloco": df, "erro": empty(spark, "erro"), "sessao": empty(spark, "sessao"), "simulado": empty(spark, "simulado")}).agg(F.sum("questoes")).first()[0] == sum(10 + k for k in range(40) if k % 10)


def test_given_ends_hold_all_rows(spark, database):
    assert store.read_jdbc(spark, database, "bloco", "total_questoes", "20", "30", 3).count() == 40
    assert store.read_jdbc(spark, database, "vazia", "quantidade").count() == 0


def test_filters_and_columns_reach_the_database(spark, database):
    found = store.read_jdbc(spark, database, "bloco", "total_questoes").where("total_acertos > 30").select("bloco_id")
    assert "PushedFilters: [*IsNotNull(TOTAL_ACERTOS), *GreaterThan(TOTAL_ACERTOS,30)]" in scanned(found) and "ReadSchema: struct<BLOCO_ID:string>" in scanned(found) and found.count() == 9


def test_days_are_refreshed_by_month(spark, tmp_path):
    folder = str(tmp_path)
    for name in ("erro",):
        spark.createDataFrame([("c", "PRESSA", 4)], store.SCHEMAS[name]).write.parquet(f"{folder}/{name}")
    store.append(empty(spark, "sessao").unionByName(spark.sql("select 'x' as sessao_id, 's' as aluno_id, timestamp_ntz'2000-05-02 10:00:00' as data, 'm' as materia_id, 'a' as assunto_id, 'TEORIA' as tipo_sessao, 50 as minutos_liquidos, 3 as nivel_foco, 3 as nivel_energia")), folder, "sessao")
    stored = lambda: {n: store.read(spark, folder, n) for n in ("sessao", "bloco", "erro")} | {"simulado": empty(spark, "simulado")}
    for came in (block(spark, ("a", "2000-04-30"), ("b", "2000-05-02")), block(spark, ("c", "2000-05-31"), ("d", "2000-06-01")), block(spark, ("late", "2000-04-01"), ("e", None)), block(spark)):
        store.append(came, folder, "bloco")
        store.refresh_days(stored(), folder, store.months_of(came, "bloco"))
        kept, whole = stored() | {"dias": store.read_days(spark, folder)}, stored()
        assert rows_of(facts.month_summary(kept)) == rows_of(facts.month_summary(whole)) and rows_of(facts.days(kept)) == rows_of(facts.days(whole))
    assert store.months_of(block(spark, ("late", "2000-04-01"), ("e", None)), "bloco") == [date(2000, 4, 1)]
    assert facts.month_summary(kept).count() == 3


def rows_of(df):
    return sorted(str(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())


def test_pages_by_seek_are_the_pages_by_skip(spark):
    rows = [(k, None if k % 11 == 0 else datetime(2000, 1, 1 + k % 5), None if k % 7 == 0 else k % 3) for k in range(60)]
    df = spark.createDataFrame(rows, "id int, data timestamp_ntz, nota int").repartition(5)
    tie, after, seen = ["nota", "id"], None, []
    while page := listing.latest(df, "data", tie, limit=7, after=after).collect():
        assert page == listing.latest(df, "data", tie, skip=len(seen), limit=7).collect()
        seen += page
        after = [page[-1][c] for c in ("data", *tie)]
    assert len(seen) == 60


def test_a_page_of_essays_has_their_analysis(spark, folder):
    read = lambda name: store.read(spark, folder, name)
    tables = [read(n) for n in store.BATCHED]
    first = essays.essay_page(*tables, limit=1).collect()
    rest = essays.essay_page(*tables, after=[first[0]["data_escrita"], first[0]["redacao_id"]]).collect()
    assert [r["redacao_id"] for r in first + rest] == ["a", "b"] and first[0]["nota_total"] == 560 and rest[0]["competencia5"] == 0
    assert essays.one_essay(*tables, "b").first()["status"] == "critica" and essays.one_essay(*tables, "c").count() == 0
