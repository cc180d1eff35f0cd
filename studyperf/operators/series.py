"""Numbered series, first rows of each group, and tables over all subjects, as the pages of a study site show them."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import periods, scores
from ..functions.scores import mean, pct, rounded
from .breakdowns import blocks_by_topic, corr_anxiety_errors, corr_focus_ipr, corr_sleep_hits
from .essays import essay_stats
from .facts import KEYS, Tables, scored_blocks
from .reports import _scored_since, _since, is_critical


def block_series(t: Tables, period: str, as_of: date, keys: list[str] = KEYS) -> DataFrame:
    """Hit rates of a period's blocks, numbered from the oldest. A block's number is its place in its day after the blocks of earlier days, so no task sorts all blocks of a key."""
    day = [*keys, "dia"]
    blocks = _since(t, "bloco", "data", periods.start_of(period, as_of)).withColumn("dia", F.to_date("data"))
    earlier = Window.partitionBy(*keys).orderBy("dia").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.groupBy(*day).count().select(*day, F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("antes"))
    nth = F.row_number().over(Window.partitionBy(*day).orderBy("data", "bloco_id")) + F.col("antes")
    numbered = blocks.join(before, day).withColumn("posicao", nth.cast("long"))
    return numbered.select(*keys, "bloco_id", "posicao", F.concat(F.lit("B"), F.col("posicao").cast("string")).alias("rotulo"), pct("total_acertos", "total_questoes").alias("percentual_acerto"))


def mock_series(t: Tables, last: int = 10, keys: list[str] = KEYS) -> DataFrame:
    """Each key's newest mock exams, `nth` 1 the newest."""
    w = Window.partitionBy(*keys).orderBy(F.desc("criado_em"), F.desc("simulado_id"))
    label = F.concat(F.lit("C"), F.col("numero_ciclo").cast("string"), F.lit("S"), F.col("numero_semana").cast("string"))
    newest = t["simulado"].withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= last)
    return newest.select(*keys, "simulado_id", "nth", label.alias("rotulo"), pct("total_acertos", "total_questoes").alias("percentual_acerto"))


def first_topics(t: Tables, first: int = 20, keys: list[str] = KEYS) -> DataFrame:
    """Each month's weakest topics: by score, then id."""
    w = Window.partitionBy(*keys, "mes").orderBy("ipr_medio", "assunto_id")
    return blocks_by_topic(t, keys).withColumn("posicao", F.row_number().over(w)).where(F.col("posicao") <= first).select(*keys, "mes", "posicao", "assunto_id", "assunto_nome", "ipr_medio", "status")


def competency_rows(t: Tables, keys: list[str] = KEYS) -> DataFrame:
    """The competencies' means as rows, those above 0."""
    wide = essay_stats(t, keys).select(*keys, "mes", *(F.col(f"media_{c}").alias(f"C{k}") for k, c in enumerate(scores.COMPETENCIES, 1)))
    return wide.unpivot([*keys, "mes"], [f"C{k}" for k in range(1, 6)], "competencia", "nota").where("nota > 0")


def correlations(t: Tables, keys: list[str] = KEYS, strong: float = 0.5) -> DataFrame:
    """All three correlations as rows; `forte` from an absolute value of `strong` on, false where there is none."""
    parts = {"foco_ipr": corr_focus_ipr, "sono_acerto": corr_sleep_hits, "ansiedade_erro": corr_anxiety_errors}
    rows = [f(t, keys).withColumn("correlacao_de", F.lit(name)) for name, f in parts.items()]
    every = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return every.withColumn("forte", F.coalesce(F.abs("correlacao") >= strong, F.lit(False)))


def scaled_ipr(t: Tables, keys: list[str] = KEYS) -> DataFrame:
    """Each block's score between the key's least (0) and greatest (1); 0 where these are equal."""
    blocks = scored_blocks(t)
    ends = blocks.groupBy(*keys).agg(F.min("ipr").alias("menor"), F.max("ipr").alias("maior"))
    both = blocks.join(ends, keys) if keys else blocks.crossJoin(ends)
    return both.select("bloco_id", *keys, rounded(scores.normalised("ipr", "menor", "maior"), 6).alias("ipr_normalizado"))


def _by_subject(t: Tables, period: str, as_of: date, keys: list[str], before: bool) -> DataFrame:
    """A row for every subject of every key with activity in the period: its own sums, those of the key's mock exams, and its critical topics; with `before`, also the scores of the period before.

    Facts are read once and summed by topic, then by subject, then gathered by key, where each subject's sums are an entry of a map. Subjects are a dimension of a few rows.
    """
    start, old = periods.start_of(period, as_of), periods.start_before(period, as_of)
    blocks, mocks = _scored_since(t, min(start, old) if before else start)
    c, zero = F.col, F.lit(0).cast("long")
    subject, topic = (F.lit(None).cast(t["bloco"].schema[n].dataType) for n in ("materia_id", "assunto_id"))

    def part(df: DataFrame, kind: str, when: str, **have: Column) -> DataFrame:
        shape = {"materia_id": subject, "assunto_id": topic, "m": zero, "s": zero, "q": zero, "a": zero, "ipr": F.lit(None).cast("decimal(6,4)")}
        return df.select(*keys, F.lit(kind).alias("fato"), (c(when) >= F.lit(start)).alias("agora"), *(have.get(n, x).alias(n) for n, x in shape.items()))

    asked = {"s": c("tempo_total_segundos").cast("long"), "q": c("total_questoes").cast("long"), "a": c("total_acertos").cast("long")}
    rows = part(_since(t, "sessao", "data", start), "s", "data", materia_id=c("materia_id"), m=c("minutos_liquidos").cast("long"))
    rows = rows.unionByName(part(blocks, "b", "data", materia_id=c("materia_id"), assunto_id=c("assunto_id"), ipr=c("ipr"), **asked))
    rows = rows.unionByName(part(mocks.where(c("criado_em") >= F.lit(start)), "m", "criado_em", **asked)).withColumn("de_simulado", c("fato") == "m")
    now = lambda x: F.sum(F.when(c("agora"), x))
    by_topic = rows.groupBy(*keys, "de_simulado", "materia_id", "assunto_id").agg(
        *(F.coalesce(now(c(x)), zero).alias(x) for x in "msqa"), now(c("ipr")).alias("ipr"), F.count(F.when(c("agora"), c("ipr"))).alias("n"), F.count(F.when(c("agora"), 1)).alias("linhas"),
        F.sum(F.when(~c("agora"), c("ipr"))).alias("ipr_antes"), F.count(F.when(~c("agora"), c("ipr"))).alias("n_antes"),
        F.sum(F.when(c("agora") & (c("fato") == "b"), c("q"))).alias("questoes"), now(c("ipr") * c("q")).alias("soma"),
    )
    added = ("m", "s", "q", "a", "ipr", "n", "linhas", "ipr_antes", "n_antes")
    critical = F.sort_array(F.collect_list(F.when(F.coalesce(is_critical(period), F.lit(False)), c("assunto_id")))).alias("criticos")
    sums = by_topic.groupBy(*keys, "de_simulado", "materia_id").agg(*(F.sum(x).alias(x) for x in added), critical)
    entry = F.when(~c("de_simulado") & c("materia_id").isNotNull(), F.struct("materia_id", F.struct(*added, "criticos")))
    whole = sums.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("de_cada"), F.sum("linhas").alias("linhas"), *(F.coalesce(F.sum(F.when(c("de_simulado"), c(x))), zero).alias(f"{x}_simulados") for x in "sqa"))
    subjects = t["materia"].agg(F.collect_list(F.struct("materia_id", F.col("nome").alias("materia_nome"))).alias("todas"))
    every = whole.where("linhas > 0").crossJoin(F.broadcast(subjects)).withColumn("x", F.explode("todas"))  # one row on the right
    own = F.try_element_at("de_cada", c("x.materia_id"))
    return every.select(*keys, "x.*", *(f"{x}_simulados" for x in "sqa"), *(F.coalesce(own[x], F.lit(0)).alias(x) for x in added), own["criticos"].alias("criticos"))


def _shares(s: DataFrame, mocks_in_subject: bool) -> DataFrame:
    c = F.col
    of_mocks = lambda x: c(f"{x}_simulados") if mocks_in_subject else F.lit(0)
    asked, hit = c("q") + F.round(of_mocks("q") / 7).cast("long"), c("a") + of_mocks("a")
    s = s.withColumns({"questoes": asked, "acertos": hit, "horas": rounded((c("m") + (c("s") + of_mocks("s")) / 60) / 60, 2), "ipr_medio": F.coalesce(mean("ipr", "n", 4), F.lit(0.0))})
    s = s.withColumn("percentual_medio", pct("acertos", "questoes"))
    return s.withColumn("acertos_estimados", rounded(c("questoes") * c("percentual_medio") / 100, 0).cast("long"))


def subject_dashboard(t: Tables, period: str, as_of: date, keys: list[str] = KEYS, mocks_in_subject: bool = True) -> DataFrame:
    """What a dashboard filtered by a subject says, for every subject of every key with activity in the period.

    Mock exams have no subject. By default each subject gets all their time and hits but a seventh of their questions, so a share may pass 100; mocks_in_subject=False leaves them out.
    `acertos_estimados` are the hits that the share and the questions give again.
    """
    s = _shares(_by_subject(t, period, as_of, keys, before=False), mocks_in_subject)
    return s.select(*keys, "materia_id", "materia_nome", "horas", "questoes", "acertos", "percentual_medio", "ipr_medio", "acertos_estimados")


def subject_outlook(t: Tables, period: str, as_of: date, keys: list[str] = KEYS) -> DataFrame:
    """The subject dashboard with the score of the period before, trend, goals, mission and critical topics. Scores are those of blocks: mock exams have no subject."""
    s = _shares(_by_subject(t, period, as_of, keys, before=True), mocks_in_subject=True)
    s = s.withColumn("ipr_anterior", F.coalesce(mean("ipr_antes", "n_antes", 4), F.lit(0.0)))
    hours_goal, questions_goal = scores.GOALS.get(period, scores.YEAR_GOAL)
    s = s.withColumns({"tendencia": scores.trend(F.col("ipr_medio"), F.col("ipr_anterior")), "status_horas": scores.goal_status(F.col("horas"), hours_goal), "status_questoes": scores.goal_status(F.col("questoes"), questions_goal)})
    s = s.withColumn("status_missao", scores.mission_status(F.col("ipr_medio"), F.col("status_horas"), F.col("status_questoes"), F.col("tendencia")))
    topics = F.coalesce(F.array_join(F.col("criticos").cast("array<string>"), ","), F.lit(""))
    return s.select(*keys, "materia_id", "horas", "questoes", "ipr_medio", "ipr_anterior", "tendencia", "status_horas", "status_questoes", "status_missao", topics.alias("assuntos_criticos"))


def mean_subject_ipr(t: Tables, period: str, as_of: date, keys: list[str] = KEYS) -> DataFrame:
    """The plain mean of all subjects' scores, those without blocks counting 0."""
    every = subject_dashboard(t, period, as_of, keys, mocks_in_subject=False)
    return every.groupBy(*keys).agg(F.count("*").alias("materias"), rounded(F.avg(F.greatest("ipr_medio", F.lit(0.0))), 4).alias("ipr_medio_materias"))
