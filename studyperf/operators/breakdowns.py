"""Breakdowns of a month: sessions, blocks, errors, exams, state of mind, subject balance, correlations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import periods, scores
from ..functions.scores import mean, pct, ratio, rounded
from .facts import KEYS, Tables, months, scored_blocks, scored_mocks, sessions


def named(df: DataFrame, dimension: DataFrame, key: str, name: str) -> DataFrame:
    """A dimension's name, the id where it is missing. Dimensions are small tables; Spark broadcasts them by their size."""
    return df.join(dimension.select(key, F.col("nome").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.col(key).cast("string")))


def _sessions_by(t: Tables, keys: list[str], by: str) -> DataFrame:
    present = lambda c: F.nullif(c, F.lit(0))
    g = sessions(t).groupBy(*keys, "mes", by).agg(
        F.count("*").alias("quantidade"), F.sum("minutos_liquidos").alias("total_minutos"), F.avg(present("nivel_foco")).alias("foco"), F.avg(present("nivel_energia")).alias("energia")
    )
    all_ = F.sum("total_minutos").over(Window.partitionBy(*keys, "mes"))
    share = rounded(F.col("total_minutos") / F.when(all_ == 0, 1).otherwise(all_) * 100, 1)
    return g.select(*keys, "mes", by, "quantidade", "total_minutos", share.alias("percentual_do_total"), rounded(F.col("foco"), 2).alias("media_foco"), rounded(F.col("energia"), 2).alias("media_energia"))


def sessions_by_type(t: Tables, keys: list[str] = KEYS) -> DataFrame:
    return _sessions_by(t, keys, "tipo_sessao")


def sessions_by_subject(t: Tables, keys: list[str] = KEYS) -> DataFrame:
    return named(_sessions_by(t, keys, "materia_id"), t["materia"], "materia_id", "materia_nome")


def block_sums() -> list[Column]:
    per_question = ratio("tempo_total_segundos", "total_questoes").cast("decimal(18,6)")
    return [F.count("*").alias("total_blocos"), F.sum("total_questoes").alias("total_questoes"), F.sum("total_acertos").alias("total_acertos"), F.sum(per_question).alias("tempo"), F.sum("ipr").alias("soma_ipr")]


def two_digit_ipr(c: Callable[[str], Column] = F.col) -> Column:
    """The mean score is rounded to two decimals before it becomes a percentage, as in all breakdowns."""
    return F.coalesce(mean(c("soma_ipr"), c("total_blocos"), 2), F.lit(0.0))


def block_measures(timed: bool = True, c: Callable[[str], Column] = F.col) -> list[Column]:
    speed = [rounded(F.coalesce(mean(c("tempo"), c("total_blocos"), 2), F.lit(0.0)), 1).alias("tempo_por_questao")] if timed else []
    return [*(c(n).alias(n) for n in ("total_blocos", "total_questoes", "total_acertos")), pct(c("total_acertos"), c("total_questoes")).alias("percentual_acerto"), *speed, rounded(two_digit_ipr(c) * 100, 2).alias("ipr_medio")]


def blocks_by_subject(t: Tables, keys: list[str] = KEYS) -> DataFrame:
    g = scored_blocks(t).groupBy(*keys, "mes", "materia_id").agg(*block_sums())
    return named(g.select(*keys, "mes", "materia_id", *block_measures()), t["materia"], "materia_id", "materia_nome")


def blocks_by_topic(t: Tables, keys: list[str] = KEYS) -> DataFrame:
    """The subject comes through the topic; both are null where the topic is missing."""
    g = scored_blocks(t).groupBy(*keys, "mes", "assunto_id").agg(*block_sums())
    g = g.select(*keys, "mes", "assunto_id", *block_measures(timed=False), scores.topic_status(two_digit_ipr()).alias("status"))
    topics = t["assunto"].select("assunto_id", F.col("nome").alias("assunto_nome"), "materia_id", "semana_do_ciclo")
    subjects = t["materia"].select("materia_id", F.col("nome").alias("materia_nome"))
    out = g.join(topics, "assunto_id", "left").join(subjects, "materia_id", "left")
    return out.withColumn("assunto_nome", F.coalesce("assunto_nome", F.col("assunto_id").cast("string")))


def blocks_by_difficulty(t: Tables, keys: list[str] = KEYS) -> DataFrame:
    g = scored_blocks(t).groupBy(*keys, "mes", "dificuldade").agg(*block_sums())
    return g.select(*keys, "mes", "dificuldade", *block_measures(timed=False))


def blocks_grouping_sets(t: Tables, keys: list[str] = KEYS) -> DataFrame:
    """Subject, topic, difficulty and total in one pass over the scored blocks; `nivel` says which a row is of."""
    dims = ["materia_id", "assunto_id", "dificuldade"]
    head = [F.col(c) for c in (*keys, "mes")]
    g = scored_blocks(t).groupingSets([[*head, F.col(d)] for d in dims] + [head], *head, *map(F.col, dims)).agg(F.grouping_id().alias("g"), *block_sums())
    low = F.col("g").bitwiseAND(7)
    level = F.when(low == 3, "materia").when(low == 5, "assunto").when(low == 6, "dificuldade").otherwise("total")
    return g.select(*keys, "mes", level.alias("nivel"), *dims, *block_measures())


def month_errors(t: Tables, keys: list[str] = KEYS) -> DataFrame:
    blocks = periods.by_month(t["bloco"], "data").select(*keys, "mes", "bloco_id")
    return t["erro"].groupBy("bloco_id", "tipo_erro").agg(F.sum("quantidade").alias("quantidade")).join(blocks, "bloco_id")


def errors_by_type(t: Tables, keys: list[str] = KEYS) -> DataFrame:
    """With the rank by occurrences (ties: by name). Errors are already one row for each block and type, so blocks are counted, not told apart again."""
    g = month_errors(t, keys).groupBy(*keys, "mes", "tipo_erro").agg(F.sum("quantidade").alias("total_ocorrencias"), F.count("*").alias("blocos_afetados"))
    w = Window.partitionBy(*keys, "mes")
    rank = F.row_number().over(w.orderBy(F.desc("total_ocorrencias"), "tipo_erro"))
    return g.select(*keys, "mes", "tipo_erro", "total_ocorrencias", pct("total_ocorrencias", F.sum("total_ocorrencias").over(w), 1).alias("percentual_do_total"), "blocos_afetados", rank.alias("posicao"))


def trend_label(now: Column, old: Column) -> Column:
    return F.when(old == 0, "SEM_DADOS_ANTERIORES").when(now > old * 1.1, "PIORANDO").when(now < old * 0.9, "MELHORANDO").otherwise("ESTÁVEL")


def error_group_share(t: Tables, keys: list[str] = KEYS) -> DataFrame:
    part = lambda kinds: F.sum(F.when(F.col("tipo_erro").isin(*kinds), F.col("quantidade")).otherwise(0))
    g = month_errors(t, keys).groupBy(*keys, "mes").agg(F.sum("quantidade").alias("total"), part(scores.CARELESS).alias("d"), part(scores.CONCEPTUAL).alias("c"))
    return g.select(*keys, "mes", F.col("total").alias("total_erros_registrados"), pct("d", "total", 1).alias("taxa_distracao_pressa"), pct("c", "total", 1).alias("taxa_conceito_calculo"))


def before(c: str, keys: list[str]) -> Column:
    """c of the month before, 0 where that month has no rows."""
    w = Window.partitionBy(*keys).orderBy("mes")
    return F.when(F.lag("mes").over(w) == F.add_months("mes", -1), F.lag(c).over(w)).otherwise(F.lit(0))


def error_trend(t: Tables, keys: list[str] = KEYS) -> DataFrame:
    blocks = periods.by_month(t["bloco"], "data").select(*keys, "mes", "bloco_id")
    per_block = t["erro"].groupBy("bloco_id").agg(F.sum("quantidade").alias("erros"))
    g = blocks.join(per_block, "bloco_id", "left").groupBy(*keys, "mes").agg((F.coalesce(F.sum("erros"), F.lit(0)) / F.count("*")).alias("atual"))
    g = g.withColumn("antes", before("atual", keys).cast("double"))
    now, old = F.col("atual"), F.col("antes")
    return g.select(*keys, "mes", rounded(now, 2).alias("erros_por_bloco"), rounded(old, 2).alias("erros_por_bloco_anterior"), trend_label(now, old).alias("tendencia_erro"))


def mock_detail(t: Tables, keys: list[str] = KEYS) -> DataFrame:
    """Mock exams with the number and sums of their subject rows; `materias` nests these in order of their ids."""
    own = t["desempenho_simulado"]
    row = F.struct("materia_id", "total_questoes", "total_acertos", "tempo_total_segundos")
    parts = own.groupBy("simulado_id").agg(F.count("*").alias("n_materias"), F.sum("total_acertos").alias("acertos_materias"), F.sort_array(F.collect_list(row)).alias("materias"))
    m = scored_mocks(t).join(parts, "simulado_id", "left")
    return m.select("simulado_id", *keys, "mes", "numero_ciclo", "numero_semana", "total_questoes", "total_acertos", pct("total_acertos", "total_questoes").alias("percentual_acerto"), rounded(ratio("tempo_total_segundos", "total_questoes"), 1).alias("tempo_por_questao"), F.col("ipr").cast("double").alias("ipr"), F.coalesce("n_materias", F.lit(0)).alias("n_materias"), F.coalesce("acertos_materias", F.lit(0)).alias("acertos_materias"), "materias")


def official_exam_detail(t: Tables, keys: list[str] = KEYS) -> DataFrame:
    row = F.struct("materia_id", "percentual_acerto", "tempo_total_segundos")
    parts = t["desempenho_prova"].groupBy("prova_id").agg(F.count("*").alias("n_materias"), F.max("percentual_acerto").cast("double").alias("melhor_percentual"), F.sort_array(F.collect_list(row)).alias("materias"))
    p = periods.by_month(t["prova"], "criado_em").join(parts, "prova_id", "left")
    return p.select("prova_id", *keys, "mes", "ano", F.col("nota_total").cast("double").alias("nota_total"), rounded(F.col("tempo_total_segundos") / 3600, 2).alias("horas"), F.coalesce("n_materias", F.lit(0)).alias("n_materias"), "melhor_percentual", "materias")


def mental_state(t: Tables, keys: list[str] = KEYS) -> DataFrame:
    """Means of what is known, from one long table of the three facts."""
    shape = ("nivel_foco", "nivel_energia", "nivel_confianca_medio", "nivel_ansiedade", "nivel_fadiga", "qualidade_sono")
    part = lambda df: df.select(*keys, "mes", *((F.col(c) if c in df.columns else F.lit(None)).cast("int").alias(c) for c in shape))
    rows = part(sessions(t)).unionByName(part(periods.by_month(t["bloco"], "data"))).unionByName(part(scored_mocks(t)))
    g = rows.groupBy(*keys, "mes").agg(*(F.avg(c).alias(c) for c in shape))
    return g.select(*keys, "mes", *(rounded(F.col(c), 2).alias(c) for c in shape))


def pearson(n: Column, x: Column, y: Column, xx: Column, yy: Column, xy: Column) -> Column:
    """From sums; null below three pairs or without variance. Exact where the sums are."""
    vx, vy = n * xx - x * x, n * yy - y * y
    r = F.try_divide((n * xy - x * y).cast("double"), F.sqrt(vx.cast("double")) * F.sqrt(vy.cast("double")))
    return F.when((n >= 3) & (vx > 0) & (vy > 0), rounded(r, 3))


def corr_focus_ipr(t: Tables, keys: list[str] = KEYS) -> DataFrame:
    """Focus of sessions against scores of blocks of the same subject and day, over all pairs, without forming pairs: sums for each subject and day on either side, joined one to one."""
    by = [*keys, "mes", "materia_id", "dia"]
    y = (F.col("ipr") * 10000).cast("long")
    focus = sessions(t).where("nivel_foco > 0").groupBy(*by).agg(F.count("*").alias("ns"), F.sum("nivel_foco").alias("x"), F.sum(F.col("nivel_foco") * F.col("nivel_foco")).alias("xx"))
    blocks = scored_blocks(t).groupBy(*by).agg(F.count("*").alias("nb"), F.sum(y).alias("y"), F.sum(y * y).alias("yy"))
    d = lambda e: F.sum(F.expr(e).cast("decimal(38,0)"))
    g = focus.join(blocks, by).groupBy(*keys, "mes").agg(d("ns * nb").alias("n"), d("x * nb").alias("x"), d("y * ns").alias("y"), d("xx * nb").alias("xx"), d("yy * ns").alias("yy"), d("x * y").alias("xy"))
    c = [F.col(k).cast("decimal(19,0)") for k in ("n", "x", "y", "xx", "yy", "xy")]
    return g.select(*keys, "mes", F.col("n").cast("long").alias("pares"), pearson(*c).alias("correlacao"))


def corr_first_pairs(t: Tables, tie: list[str], keys: list[str] = KEYS, max_pairs: int = 30) -> DataFrame:
    """corr_focus_ipr over a month's first pairs alone: sessions in order of their time and `tie`, for each its blocks in order.

    Each session in a pair has a block, so one with max_pairs sessions before it in its month, or in its subject and day, can't be among the first pairs; the finer rank comes first, so few rows reach the month's.
    """
    by = [*keys, "mes", "materia_id", "dia"]
    order = ["data", *tie]
    blocks = scored_blocks(t).withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy("data", "bloco_id"))).where(F.col("__k") <= max_pairs)
    blocks = blocks.select(*by, "__k", (F.col("ipr") * 10000).cast("long").alias("y"))
    rows = sessions(t).where("nivel_foco > 0").join(blocks.select(*by).distinct(), by, "left_semi")
    for group in (by, [*keys, "mes"]):
        rows = rows.withColumn("__rank", F.rank().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("__rank") <= max_pairs)
    pairs = rows.join(blocks, by).withColumn("__n", F.row_number().over(Window.partitionBy(*keys, "mes").orderBy(*order, "__k"))).where(F.col("__n") <= max_pairs)
    x, y = F.col("nivel_foco").cast("long"), F.col("y")
    g = pairs.groupBy(*keys, "mes").agg(F.count("*").alias("pares"), *(F.sum(e).alias(a) for a, e in (("sx", x), ("sy", y), ("xx", x * x), ("yy", y * y), ("xy", x * y))))
    c = [F.col(k).cast("decimal(19,0)") for k in ("pares", "sx", "sy", "xx", "yy", "xy")]
    return g.select(*keys, "mes", "pares", pearson(*c).alias("correlacao"))


def _corr_mocks(t: Tables, keys: list[str], x: str, y: Column) -> DataFrame:
    """y in units of 1e-6, so that sums are exact."""
    m = scored_mocks(t).where(F.col(x) > 0).where("total_questoes > 0").select(*keys, "mes", F.col(x).cast("long").alias("x"), F.round(y * 1e6).cast("long").alias("y"))
    g = m.groupBy(*keys, "mes").agg(F.count("*").alias("n"), *(F.sum(F.expr(e).cast("decimal(20,0)")).alias(a) for a, e in (("sx", "x"), ("sy", "y"), ("xx", "x * x"), ("yy", "y * y"), ("xy", "x * y"))))
    c = [F.col(k).cast("decimal(19,0)") for k in ("n", "sx", "sy", "xx", "yy", "xy")]
    return g.select(*keys, "mes", F.col("n").alias("pares"), pearson(*c).alias("correlacao"))


def corr_sleep_hits(t: Tables, keys: list[str] = KEYS) -> DataFrame:
    return _corr_mocks(t, keys, "qualidade_sono", ratio("total_acertos", "total_questoes"))


def corr_anxiety_errors(t: Tables, keys: list[str] = KEYS) -> DataFrame:
    return _corr_mocks(t, keys, "nivel_ansiedade", ratio(F.col("total_questoes") - F.col("total_acertos"), "total_questoes"))


def subject_balance(t: Tables, keys: list[str] = KEYS) -> DataFrame:
    """Every subject in every month of a key, with or without activity there. The months' list is exploded with the subjects, a dimension of a few rows."""
    per = sessions(t).select(*keys, "mes", "materia_id", F.col("minutos_liquidos").cast("long").alias("minutos"), F.lit(0).alias("segundos"), F.lit(0).alias("questoes"), F.lit(None).cast("decimal(6,4)").alias("ipr"))
    per = per.unionByName(scored_blocks(t).select(*keys, "mes", "materia_id", F.lit(0).cast("long").alias("minutos"), F.col("tempo_total_segundos").alias("segundos"), F.col("total_questoes").alias("questoes"), "ipr"))
    own = per.groupBy(*keys, "mes", "materia_id").agg(F.sum("minutos").alias("min_m"), F.sum("segundos").alias("seg_m"), F.sum("questoes").alias("q_m"), F.sum("ipr").alias("ipr_m"), F.count("ipr").alias("n_m"))
    subjects = F.broadcast(t["materia"].agg(F.collect_list(F.struct("materia_id", F.col("nome").alias("materia_nome"), "peso_prova")).alias("todas")))
    every = months(t, keys).crossJoin(subjects)  # one row on the right
    every = every.select(*keys, "mes", "minutos", "seg_bloco", "questoes", F.explode("todas").alias("m")).select(*keys, "mes", "minutos", "seg_bloco", "questoes", "m.*")
    out = every.join(own, [*keys, "mes", "materia_id"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    ipr = F.coalesce(mean("ipr_m", "n_m", 4), F.lit(0.0))
    cells = balance_columns(F.col("peso_prova"), zero("min_m"), zero("seg_m"), zero("q_m"), ipr, F.col("minutos") + F.col("seg_bloco") / 60, F.col("questoes"))
    return out.select(*keys, "mes", "materia_id", "materia_nome", *cells)


def balance_columns(weight: Column, minutes: Column, seconds: Column, questions: Column, ipr: Column, all_minutes: Column, all_questions: Column) -> list[Column]:
    """A subject's share of a month against its weight."""
    spent, weight = minutes + seconds / 60, weight.cast("double")
    share = rounded(spent / F.when(all_minutes == 0, 1.0).otherwise(all_minutes) * 100, 1)
    of_questions = rounded(questions / F.when(all_questions == 0, 1).otherwise(all_questions) * 100, 1)
    named_ = {"peso_prova": weight, "minutos": rounded(spent, 1), "percentual_tempo": share, "questoes": questions, "percentual_questoes": of_questions, "ipr": rounded(ipr * 100, 2), "peso_vs_tempo": scores.weight_balance(share, weight), "status": scores.subject_status(ipr)}
    return [c.alias(n) for n, c in named_.items()]
