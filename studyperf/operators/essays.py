"""Essays: scores, long and wide forms, statistics, progress."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import periods, scores, texts
from ..functions.scores import COMPETENCIES, rounded
from .facts import KEYS, Tables
from .listing import latest


def essay_scores(essays: DataFrame) -> DataFrame:
    total = scores.essay_total()
    return essays.withColumns({"nota_total": total, "competencia_mais_fraca": scores.weakest_competency(), "status": scores.essay_band(total)})


def essay_analysis(essays: DataFrame) -> DataFrame:
    """What is stored beside an essay: its scores and two short texts on the weakest competency."""
    told = {name: F.format_string(text, "competencia_mais_fraca") for name, text in texts.STORED_NOTES.items()}
    return essay_scores(essays).withColumns(told).select("redacao_id", "nota_total", "status", "competencia_mais_fraca", *told)


def read_back(essays: DataFrame, long: DataFrame, analyses: DataFrame) -> DataFrame:
    """Stored essays with their competencies side by side (null where one is missing; of repeated ones the highest) and their analysis (null where it is missing)."""
    wide = long.groupBy("redacao_id").pivot("competencia", [1, 2, 3, 4, 5]).agg(F.max("nota"))
    wide = wide.select("redacao_id", *(F.col(str(k)).alias(f"competencia{k}") for k in range(1, 6)))
    return essays.drop(*COMPETENCIES).join(wide, "redacao_id", "left").join(analyses, "redacao_id", "left")


def essay_page(essays: DataFrame, long: DataFrame, analyses: DataFrame, limit: int = 100, after: Sequence[object] | None = None) -> DataFrame:
    """Stored essays with their analysis, the latest first, then by id. Only a page's own competencies and analyses are read back. after: time and id of the last essay of the page before."""
    page = latest(essays, "data_escrita", ["redacao_id"], limit=limit, after=after)
    own = page.select("redacao_id")
    mine = lambda df: df.join(own, "redacao_id", "left_semi")
    return read_back(page, mine(long), mine(analyses)).orderBy(F.desc("data_escrita"), "redacao_id")


def one_essay(essays: DataFrame, long: DataFrame, analyses: DataFrame, redacao_id: object) -> DataFrame:
    """A stored essay by its id, with its analysis; no row if there is none. The id is looked for in each table where it is read."""
    mine = lambda df: df.where(F.col("redacao_id") == F.lit(redacao_id))
    return read_back(mine(essays), mine(long), mine(analyses))


def essay_long(essays: DataFrame) -> DataFrame:
    long = essays.unpivot("redacao_id", list(COMPETENCIES), "nome", "nota")
    return long.select("redacao_id", F.substring("nome", -1, 1).cast("int").alias("competencia"), "nota")


def essay_wide(long: DataFrame) -> DataFrame:
    """Missing competencies count 0; of repeated ones the highest holds."""
    wide = long.groupBy("redacao_id").pivot("competencia", [1, 2, 3, 4, 5]).agg(F.max("nota"))
    wide = wide.select("redacao_id", *(F.coalesce(F.col(str(k)), F.lit(0)).alias(f"competencia{k}") for k in range(1, 6)))
    return wide.withColumn("nota_total", scores.essay_total())


def _monthly(t: Tables) -> DataFrame:
    return periods.by_month(essay_scores(t["redacao"]), "data_escrita")


def essay_stats(t: Tables, keys: list[str] = KEYS) -> DataFrame:
    note = F.col("nota_total")
    return (
        _monthly(t)
        .groupBy(*keys, "mes")
        .agg(
            F.count("*").alias("total_redacoes"),
            rounded(F.avg(note), 1).alias("nota_media"),
            F.max(note).alias("nota_maxima"),
            F.min(note).alias("nota_minima"),
            *(rounded(rounded(F.avg(c), 2), 1).alias(f"media_{c}") for c in COMPETENCIES),
            F.mode("competencia_mais_fraca", deterministic=True).alias("mais_fraca_comum"),
        )
    )


def essay_status_dist(t: Tables, keys: list[str] = KEYS) -> DataFrame:
    """A row for each status; as a map: map_from_entries(collect_list(struct(status, n)))."""
    return _monthly(t).groupBy(*keys, "mes", "status").agg(F.count("*").alias("n"))


def essay_status_map(t: Tables, keys: list[str] = KEYS) -> DataFrame:
    """The statuses of a month as one map."""
    entry = F.struct("status", "n")
    return essay_status_dist(t, keys).groupBy(*keys, "mes").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("distribuicao"))


def essay_evolution(t: Tables, keys: list[str] = KEYS) -> DataFrame:
    """The scores of a month's essays in order of their days and ids."""
    entry = F.struct(F.col("dia"), F.col("redacao_id"), F.col("nota_total").alias("nota"))
    dated = _monthly(t).withColumn("dia", F.to_date("data_escrita"))
    return dated.groupBy(*keys, "mes").agg(F.sort_array(F.collect_list(entry)).alias("evolucao"))


def essay_progress(t: Tables, keys: list[str] = KEYS, last: int = 10) -> DataFrame:
    """For each key: mean of all essays, the latest against the mean of the others, level, and the last scores in order.

    Sums need no order. Of the essays in order only the latest few are wanted: each task keeps its own few, and no task sorts a key's essays, also where all are one key.
    """
    e = essay_scores(t["redacao"]).select(*keys, "data_escrita", "redacao_id", "nota_total")
    sums = e.groupBy(*keys).agg(F.count("*").alias("total"), F.avg("nota_total").alias("media"), F.sum("nota_total").alias("soma"))
    w = Window.partitionBy(*keys).orderBy(F.desc("data_escrita"), F.desc("redacao_id"))
    latest_ = e.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= last)
    series = latest_.groupBy(*keys).agg(F.max(F.when(F.col("nth") == 1, F.col("nota_total"))).alias("ultima"), F.sort_array(F.collect_list(F.struct(-F.col("nth"), "nota_total"))).alias("serie"))
    # a row of each for a key, put together as groups are, so that a null key is one as well
    either = sums.where("total > 0").unionByName(series, allowMissingColumns=True)
    g = either.groupBy(*keys).agg(*(F.max(c).alias(c) for c in ("total", "media", "soma", "ultima", "serie"))).where("total > 0")
    others = F.try_divide((F.col("soma") - F.col("ultima")).cast("double"), (F.col("total") - 1).cast("double"))
    average = rounded(F.col("media"), 1)
    return g.select(*keys, "total", average.alias("media"), "ultima", rounded(F.col("ultima") - F.coalesce(others, F.col("ultima").cast("double")), 1).alias("variacao"), scores.essay_level(F.col("media")).alias("nivel"), F.least(rounded(F.col("media") / 900 * 100, 0), F.lit(100.0)).alias("progresso"), F.array_join(F.transform("serie", lambda x: x["nota_total"].cast("string")), ",").alias("ultimas_notas"))
