"""Checks of new rows, and keys and duplicates against what is there. A row is valid if no reason applies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("TEORIA", "QUESTOES", "REVISAO")
ERRORS = ("CONCEITO", "INTERPRETACAO", "CALCULO", "DISTRACAO", "PRESSA", "CONTEUDO_ESQUECIDO")


def level(c: str) -> Column:
    return F.col(c).isNull() | F.col(c).between(1, 5)


def positive(c: str) -> Column:
    return F.col(c) > 0


def at_least(c: str, least: int) -> Column:
    return F.col(c) >= least


def _levels(*names: str) -> dict[str, Column]:
    return {n: level(n) for n in names}




def rules(table: str) -> dict[str, Column]:
    """What must hold in a table, by the reason that is given otherwise. Nulls fail all but the levels."""
    c = F.col
    mock_levels = _levels("nivel_ansiedade", "nivel_fadiga", "qualidade_sono")
    counts = {"total_questoes": at_least("total_questoes", 1), "total_acertos": at_least("total_acertos", 0), "tempo_total_segundos": positive("tempo_total_segundos")}
    return {
        "sessao": lambda: {"tipo_sessao": c("tipo_sessao").isin(*KINDS), "minutos_liquidos": positive("minutos_liquidos"), **_levels("nivel_foco", "nivel_energia")},
        "bloco": lambda: {"dificuldade": c("dificuldade").between(1, 5), **counts, **_levels("nivel_confianca_medio"), "acertos_acima": c("total_acertos") <= c("total_questoes")},
        "erro": lambda: {"tipo_erro": c("tipo_erro").isin(*ERRORS), "quantidade": at_least("quantidade", 1)},
        "simulado": lambda: {"numero_ciclo": at_least("numero_ciclo", 1), "numero_semana": c("numero_semana").between(1, 4), **counts, **mock_levels},
        "desempenho_simulado": lambda: counts,
        "prova": lambda: {"ano": at_least("ano", 2000), "nota_total": at_least("nota_total", 0), "tempo_total_segundos": positive("tempo_total_segundos"), **mock_levels},
        "desempenho_prova": lambda: {"percentual_acerto": at_least("percentual_acerto", 0), "tempo_total_segundos": positive("tempo_total_segundos")},
        "redacao": lambda: {"tema": F.length("tema") <= 300, **{f"competencia{k}": c(f"competencia{k}").between(0, 200) for k in range(1, 6)}},
    }[table]()


def checked(df: DataFrame, table: str) -> DataFrame:
    """df with `motivos`, the names of what fails, in order."""
    return df.withColumn("motivos", F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules(table).items()))))


def split(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and rejected ones with their reasons."""
    c = checked(df, table)
    return c.where(F.size("motivos") == 0).drop("motivos"), c.where(F.size("motivos") > 0)


def with_defaults(df: DataFrame, as_of: Column, ts: str = "data") -> DataFrame:
    """A missing time is the given one; a missing essay axis is `geral`."""
    df = df.withColumn(ts, F.coalesce(ts, as_of))
    return df.withColumn("eixo_tematico", F.when(F.coalesce("eixo_tematico", F.lit("")) == "", "geral").otherwise(F.col("eixo_tematico"))) if "eixo_tematico" in df.columns else df


def _first(df: DataFrame, by: list[str], order: str) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where("__n = 1").drop("__n")


def new_subjects(candidates: DataFrame, subjects: DataFrame, order: str) -> DataFrame:
    """Named, weighing more than 0, and not there yet, without regard to case and outer blanks; of several alike the first by `order`."""
    key = F.lower(F.trim("nome"))
    named = candidates.withColumn("nome", F.trim("nome")).where("nome <> '' and peso_prova > 0").withColumn("__nome", key)
    return _first(named.join(subjects.select(key.alias("__nome")), "__nome", "left_anti"), ["__nome"], order).drop("__nome")


def new_topics(candidates: DataFrame, topics: DataFrame, subjects: DataFrame, order: str) -> DataFrame:
    """Of a known subject, in week 1 to 4, with a name new within it."""
    key = F.lower(F.trim("nome"))
    named = candidates.withColumn("nome", F.trim("nome")).where("nome <> '' and semana_do_ciclo between 1 and 4").withColumn("__nome", key)
    known = named.join(subjects.select("materia_id"), "materia_id", "left_semi")
    return _first(known.join(topics.select("materia_id", key.alias("__nome")), ["materia_id", "__nome"], "left_anti"), ["materia_id", "__nome"], order).drop("__nome")
