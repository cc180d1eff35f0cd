"""Reading and writing the tables: JDBC or Parquet in, monthly partitions, whole batches and JSON out."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import periods
from ..operators import facts
from ..operators.essays import essay_analysis, essay_long
from ..operators.facts import KEYS, Tables
from ..operators.ingest import split, with_defaults

#: Columns and types of the tables; a source is read with these, never by inference.
SCHEMAS = {
    "materia": "materia_id string, nome string, peso_prova decimal(5,2), ativa boolean, criado_em timestamp_ntz",
    "assunto": "assunto_id string, materia_id string, nome string, semana_do_ciclo int, ativo boolean, criado_em timestamp_ntz",
    "sessao": "sessao_id string, aluno_id string, data timestamp_ntz, materia_id string, assunto_id string, tipo_sessao string, minutos_liquidos int, nivel_foco int, nivel_energia int",
    "bloco": "bloco_id string, aluno_id string, data timestamp_ntz, materia_id string, assunto_id string, dificuldade int, total_questoes int, total_acertos int, tempo_total_segundos int, nivel_confianca_medio int",
    "erro": "bloco_id string, tipo_erro string, quantidade int",
    "simulado": "simulado_id string, aluno_id string, numero_ciclo int, numero_semana int, total_questoes int, total_acertos int, tempo_total_segundos int, nivel_ansiedade int, nivel_fadiga int, qualidade_sono int, criado_em timestamp_ntz",
    "desempenho_simulado": "simulado_id string, materia_id string, total_questoes int, total_acertos int, tempo_total_segundos int",
    "prova": "prova_id string, aluno_id string, ano int, nota_total decimal(5,2), tempo_total_segundos int, nivel_ansiedade int, nivel_fadiga int, qualidade_sono int, criado_em timestamp_ntz",
    "desempenho_prova": "prova_id string, materia_id string, percentual_acerto decimal(5,2), tempo_total_segundos int",
    "redacao": "redacao_id string, aluno_id string, tema string, eixo_tematico string, data_escrita timestamp_ntz, tempo_escrita_min int, competencia1 int, competencia2 int, competencia3 int, competencia4 int, competencia5 int",
    "competencia": "redacao_id string, competencia int, nota int",
    "analise": "redacao_id string, nota_total int, status string, competencia_mais_fraca int, diagnostico string, recomendacao string",
}
TIMES = {"sessao": "data", "bloco": "data", "simulado": "criado_em", "prova": "criado_em", "redacao": "data_escrita"}


#: Tables that are written together, a batch (`lote`) at a time.
BATCHED = ("redacao", "competencia", "analise")
MARKS = "lotes"


def read(spark: SparkSession, folder: str, table: str, since: date | None = None, until: date | None = None) -> DataFrame:
    """A stored table. Facts come with `mes`, their partition: with since or until, only the months from the one to the other are read, and later filters on a month or a period leave out the others too.

    Of the tables that are written in batches, only whole batches are seen.
    """
    parts = (["lote string"] if table in BATCHED else []) + (["mes date"] if table in TIMES else [])
    df = spark.read.schema(", ".join([SCHEMAS[table], *parts])).parquet(f"{folder}/{table}")
    if table in BATCHED:
        df = df.join(_whole(spark, folder), "lote", "left_semi").drop("lote")
    return periods.within(df.withMetadata("mes", {periods.MONTH_OF: TIMES[table]}), TIMES[table], since, until) if table in TIMES else df


def typed(df: DataFrame, table: str) -> DataFrame:
    """df with the columns of a table, by name without regard to case, in its types."""
    fields = (f.split(" ", 1) for f in SCHEMAS[table].split(", "))
    return df.select(*(F.col(name).cast(kind).alias(name) for name, kind in fields))


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, low: str | None = None, high: str | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A database table. With a number or time column, in parts by ranges of it, read side by side; ranges whose ends are not given are found by a query. Rows without a value come with the first part, those beyond the ends with the outer ones.

    Filters and columns that are asked of the result reach the database.
    """
    source = spark.read.format("jdbc").options(url=url, **options)
    if column and (low is None or high is None):
        ends = source.option("query", f"select min({column}) as lo, max({column}) as hi from {table}").load().first()
        low, high = (given if given is not None else None if found is None else str(found) for given, found in ((low, ends[0]), (high, ends[1])))
    source = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if column and low is not None and high is not None:  # else no column to part by, or no value in it
        source = source.options(partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts)
    df = source.load()
    return typed(df, table) if table in SCHEMAS else df


def append(df: DataFrame, folder: str, table: str) -> None:
    """Adds rows, facts with a time in monthly partitions."""
    out = df.withColumn("mes", F.trunc(TIMES[table], "month")) if table in TIMES else df
    writer = out.write.mode("append")
    (writer.partitionBy("mes") if table in TIMES else writer).parquet(f"{folder}/{table}")


def _replace(df: DataFrame, path: str, *by: str) -> None:
    """Replaces those partitions of path that df has rows of; the others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _whole(spark: SparkSession, folder: str) -> DataFrame:
    """The batches that are whole, a row each."""
    try:
        return spark.read.schema("id long, lote string").parquet(f"{folder}/{MARKS}").select("lote")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "lote string")


def append_essays(essays: DataFrame, folder: str, lote: str | None = None) -> DataFrame:
    """Writes the valid essays, their five competencies each and an analysis each; returns the rejected ones.

    The three tables are one batch, which readers see once its mark is there; that is written last. A batch that broke off is written anew when it comes again under its name, and one that is whole is left as it is.
    """
    spark, lote = essays.sparkSession, lote or uuid.uuid4().hex
    stamped = with_defaults(essays, F.current_timestamp(), TIMES["redacao"])
    valid, rejected = split(stamped, "redacao")
    if not _whole(spark, folder).where(F.col("lote") == lote).isEmpty():
        return rejected
    valid = valid.withColumn("lote", F.lit(lote)).persist()  # one time of writing, one reading of the source
    try:
        _replace(valid.withColumn("mes", F.trunc(TIMES["redacao"], "month")), f"{folder}/redacao", "lote", "mes")
        for table, rows in (("competencia", essay_long(valid)), ("analise", essay_analysis(valid))):
            _replace(rows.withColumn("lote", F.lit(lote)), f"{folder}/{table}", "lote")
        _replace(spark.range(1).withColumn("lote", F.lit(lote)), f"{folder}/{MARKS}", "lote")
    finally:
        valid.unpersist()
    return rejected


def write_json(report: DataFrame, folder: str) -> None:
    """A report by year and month. The months that it has are replaced, others stay."""
    parts = report.withColumn("ano", F.year("mes")).withColumn("mes_n", F.month("mes"))
    parts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ano", "mes_n").json(folder)


def months_of(df: DataFrame, table: str) -> list[date]:
    """The months that rows fall in: as many as a calendar has, however many the rows."""
    found = df.where(F.col(TIMES[table]).isNotNull()).select(F.trunc(TIMES[table], "month").alias("mes")).distinct()
    return sorted(r["mes"] for r in found.collect())


def refresh_days(t: Tables, folder: str, months: list[date], keys: list[str] = KEYS) -> None:
    """Computes the day table of some months anew from the facts and replaces these months in `dias`. After an append, with the months of the rows that came, `dias` is again what all facts give."""
    part = {n: periods.in_months(df, TIMES[n], months) if n in TIMES else df for n, df in t.items() if n in ("sessao", "bloco", "simulado", "erro")}
    if months:
        _replace(facts.days(part, keys), f"{folder}/dias", "mes")


def read_days(spark: SparkSession, folder: str) -> DataFrame:
    """The stored day table; as t["dias"] it stands for the facts where months are summed, for the keys it was made with."""
    return spark.read.parquet(f"{folder}/dias")
