"""The monthly report of all keys and months in one pass, and the advice that follows from it.

Facts give cells: a tag, the value it is broken down by, and what it adds. Cells are summed by (key, month, tag, value); what is left, a few rows for each month, meets the month's topics, exams and essays
in one aggregation by (key, month), where all sections are built as columns. The month before is the row before, of the key's months in order. So the number of shuffles does not grow with the number of sections.

Where each key has few rows a month, summing leaves about as many cells as there were. So cells are narrow: all tags share a few numbers, LAYOUT says what they are; only the cells that the sections asked for take (NEEDS) are made, with no more
numbers and values than these have. And they are made where they are summed: it is the facts that are dealt by key, a row each with the columns that the cells take, into as many parts as a shuffle has, or more where their files are large. Both sums, and the months in
order, then need no further shuffle; exams and essays are dealt alike beside them. Without keys cells are summed map-side first.
Topics may be many: blocks carry the names of their own, so that no cell has to meet their table; only where those in use are few they are sent to all parts. Without keys topics are summed and named apart.
"""

from __future__ import annotations

from collections.abc import Callable, Collection
from datetime import date
from decimal import Decimal
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import periods, scores, texts
from ..functions.scores import COMPETENCIES, mean, pct, ratio, rounded
from . import breakdowns, essays, facts, reports
from .facts import KEYS, Tables

#: What the cells of a tag add up, in the order of the columns v0, v1 and so on.
LAYOUT = {
    "sessoes": ("n_sessao", "minutos", "s_nivel_foco", "n_nivel_foco", "s_nivel_energia", "n_nivel_energia"),
    "blocos": ("n_bloco", "q_bloco", "a_bloco", "ipr_bloco", "seg_bloco", "s_nivel_confianca_medio", "n_nivel_confianca_medio"),
    "mocks": ("n_simulado", "q_simulado", "a_simulado", "ipr_simulado", "seg_simulado"),
    "estado": ("s_nivel_ansiedade", "n_nivel_ansiedade", "s_nivel_fadiga", "n_nivel_fadiga", "s_qualidade_sono", "n_qualidade_sono"),
    "dia": ("n_sessao", "n_bloco", "minutos", "seg_bloco", "q_bloco", "ipr_bloco"),
    "tipo": ("n_sessao", "minutos", "s_nivel_foco", "n_nivel_foco", "s_nivel_energia", "n_nivel_energia"),
    "materia": ("n_sessao", "minutos", "s_nivel_foco", "n_nivel_foco", "s_nivel_energia", "n_nivel_energia"),
    "blocos_materia": ("n_bloco", "q_bloco", "a_bloco", "ipr_bloco", "seg_bloco", "tempo"),
    "dificuldade": ("n_bloco", "q_bloco", "a_bloco", "ipr_bloco"),
    "assunto": ("n_bloco", "q_bloco", "a_bloco", "ipr_bloco"),
    "par": ("n_sessao", "n_bloco", "x", "xx", "y", "yy"),
    "erro": ("n_bloco", "erros"),
    "sono": ("n_simulado", "x", "y", "xx", "yy_alto", "yy_baixo", "xy"),
    "ansiedade": ("n_simulado", "x", "y", "xx", "yy_alto", "yy_baixo", "xy"),
    "status": ("n_redacao",),
    "ensaios": ("n_redacao",),
}
SLOTS = max(map(len, LAYOUT.values()))
#: The tags whose cells need no table of topics.
PLAIN = tuple(tag for tag in LAYOUT if tag != "assunto")
#: Decimals that cells add up as whole numbers: their digits, and the type of their sums.
SCALED = {"ipr_bloco": (4, "decimal(16,4)"), "ipr_simulado": (4, "decimal(16,4)"), "tempo": (6, "decimal(28,6)")}
#: Squares that might grow large are added up in two parts.
HALF = 1 << 20
STATE = {"nivel_foco": "sessoes", "nivel_energia": "sessoes", "nivel_confianca_medio": "blocos", "nivel_ansiedade": "estado", "nivel_fadiga": "estado", "qualidade_sono": "estado"}
MONTH = ("sessoes", "blocos", "mocks")
#: Where a month's sums stand.
TOTALS = {"minutos": "sessoes", "seg_bloco": "blocos", "seg_simulado": "mocks", "n_sessao": "sessoes", "n_bloco": "blocos", "n_simulado": "mocks", "q_bloco": "blocos", "q_simulado": "mocks", "a_bloco": "blocos", "a_simulado": "mocks", "ipr_bloco": "blocos", "ipr_simulado": "mocks"}
#: What cells are broken down by.
DIMS = {"tipo": ("valor",), "erro": ("valor",), "status": ("valor",), "materia": ("materia_id",), "blocos_materia": ("materia_id",), "dificuldade": ("dificuldade",), "dia": ("dia",), "par": ("materia_id", "dia"), "assunto": ("materia_id", "topico")}
#: The tags that each section is made of; those of CARRIED look at the month before too.
NEEDS = {
    "resumo_geral": (*MONTH, "dia"), "sessoes_por_tipo": ("sessoes", "tipo"), "sessoes_por_materia": ("sessoes", "materia"), "blocos_por_materia": ("blocos_materia",), "blocos_por_assunto": ("assunto",), "blocos_por_dificuldade": ("dificuldade",),
    "erros_por_tipo": ("erro",), "erros": ("erro",), "tendencia_erros": ("blocos", "erro"), "simulados": ("simulado",), "provas_oficiais": ("prova",), "redacoes": ("redacao", "ensaios"), "evolucao_redacoes": ("redacao",), "status_redacoes": ("status",),
    "estado_mental": (*MONTH, "estado"), "comparativo_mes_anterior": (*MONTH, "ensaios"), "projecao_fechamento": (*MONTH, "dia"), "consistencia": (*MONTH, "dia"), "melhor_e_pior_dia": ("dia",), "foco_ipr": ("par",), "sono_acerto": ("sono",),
    "ansiedade_erro": ("ansiedade",), "balanceamento_materias": (*MONTH, "materia", "blocos_materia"),
    "recomendacoes_estrategicas": (*MONTH, "dia", "assunto", "materia", "blocos_materia", "erro", "redacao", "ensaios"),
}
CARRIED = ("tendencia_erros", "comparativo_mes_anterior")
SECTIONS = tuple(NEEDS)

#: Spark puts parts together up to so many bytes. Facts are packed some ten times smaller than they are in memory, so its own 64 MB are a large task.
PART = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
#: How many parts Spark begins with, before it puts them together.
BEGUN = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
#: A shuffle has a part for each so many bytes of files, so that what a task holds does not grow with the facts; but not more than MOST. From MANY on parts are put together up to 4 MB alone: there are enough of them for all cores.
FILES, MANY, MOST = 2 << 20, 128, 10_000
#: So many topics in use are sent to all.
FEW = 50_000


def _parts(*tables: DataFrame) -> int:
    """As many parts as a shuffle has, or more where the tables come from large files. Tables of unknown size don't count."""
    leaves = [seq.apply(i) for df in tables if (seq := df._jdf.queryExecution().optimizedPlan().collectLeaves()) is not None for i in range(seq.size())]
    sizes = [int(str(x.stats().sizeInBytes())) for x in leaves if x.nodeName().endswith("Relation") and x.nodeName() != "InMemoryRelation"]
    size = sum(s for s in sizes if s < 1 << 60)
    return max(int(tables[0].sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST, -(-size // FILES)))


def _dealt(df: DataFrame, *by: str) -> DataFrame:
    """df in that many parts. Cells are mostly zeros: parts that Spark puts together by their compressed size would be too large."""
    return df.repartition(_parts(df), *by) if by else df


def _set_parts(t: Tables) -> None:
    """Lets the facts' own joins begin with that many parts, for with a fixed number each would grow with the facts. What the user has set stays; what a report has set follows the tables of the next one."""
    conf, n = t["bloco"].sparkSession.conf, _parts(*(t[n] for n in ("sessao", "bloco", "erro", "simulado") if n in t))
    for name, value in ((BEGUN, str(n)), (PART, "16m" if n < MANY else "4m")):
        if conf.get(name, None) in (None, conf.get(f"studyperf.{name}", None)):
            conf.set(name, value)
            conf.set(f"studyperf.{name}", value)


def _blocks(t: Tables) -> DataFrame:
    """Scored blocks with their errors by type. Errors are summed by block and type before they are gathered, so an array has an entry for each type; a block's are brought together once for both."""
    by_type = _dealt(t["erro"], "bloco_id").groupBy("bloco_id", "tipo_erro").agg(F.sum("quantidade").alias("quantidade"))
    each = by_type.groupBy("bloco_id").agg(F.collect_list(F.struct("tipo_erro", "quantidade")).alias("erros"))
    careless = F.aggregate(F.filter("erros", lambda e: e["tipo_erro"].isin(*scores.CARELESS)), F.lit(0).cast("long"), lambda s, e: s + F.coalesce(e["quantidade"], F.lit(0)))
    blocks = periods.by_month(t["bloco"], "data").withColumn("dia", F.to_date("data")).join(each, "bloco_id", "left")
    return blocks.withColumn("erros_criticos", careless).withColumn("ipr", scores.block_ipr())


def _errors(t: Tables) -> DataFrame:
    """Blocks with the sum of their errors of a type, a row for each type that they have."""
    by_type = t["erro"].groupBy("bloco_id", "tipo_erro").agg(F.sum("quantidade").alias("quantidade"))
    return periods.by_month(t["bloco"], "data").join(by_type, "bloco_id")


def _few_topics(t: Tables) -> bool:
    """Whether the topics that blocks have can be sent to all. Where their table is not small, the ids in use are counted: they may be few in a large table, which no plan knows beforehand."""
    small = int(t["assunto"].sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())
    if int(str(t["assunto"]._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= small:
        return True
    return t["bloco"].select("assunto_id").distinct().limit(FEW + 1).count() <= FEW


def _with_topics(t: Tables, blocks: DataFrame, few: bool) -> DataFrame:
    """Blocks with `topicos`: the topics of their id, one without name where there is none. As an array, for a repeated topic must not repeat the block."""
    named = F.collect_list(F.struct("materia_id", F.col("nome").alias("assunto_nome"), "semana_do_ciclo"))
    own = t["assunto"].join(t["bloco"].select("assunto_id").distinct(), "assunto_id", "left_semi").groupBy("assunto_id").agg(named.alias("topicos"))
    return blocks.join(F.broadcast(own) if few else own, "assunto_id", "left")


def _topic_kind(t: Tables, *more: str) -> str:
    own = dict(t["assunto"].dtypes) | {"assunto_nome": "string"}
    return "struct<" + ",".join(f"{c}:{own[c]}" for c in ("materia_id", *more, "assunto_nome", "semana_do_ciclo")) + ">"


def _cell(dims: dict[str, str], slots: int, tag: str, *by: str, valor: Column | None = None, topico: dict[str, Column] | None = None, **adds: Column) -> Column:
    """One row of the table of cells: broken down by the columns named, by a text or by a topic and its subject."""
    own = {n: F.col(n) for n in by} | ({"valor": valor} if valor is not None else {}) | (topico or {})
    whole = {n: x * 10 ** SCALED[n][0] if n in SCALED else x for n, x in adds.items()}
    sums = [F.coalesce(whole[n].cast("long"), F.lit(0).cast("long")) if n in whole else F.lit(0).cast("long") for n in LAYOUT[tag]]
    sums += [F.lit(0).cast("long")] * (slots - len(sums))
    return F.struct(F.lit(tag).alias("tag"), *(own.get(c, F.lit(None)).cast(k).alias(c) for c, k in dims.items()), *(v.alias(f"v{i}") for i, v in enumerate(sums)))


def _sum_of(tag: str) -> Callable[[str], Column]:
    """What the cells of a tag hold by name."""
    return lambda name: _scaled(name, _held(tag, name))


def _held(tag: str, name: str) -> Column:
    return F.col(f"v{LAYOUT[tag].index(name)}")


def _scaled(name: str, v: Column) -> Column:
    """The decimal that v stands for."""
    if name not in SCALED:
        return v
    digits, kind = SCALED[name]
    return (v.cast("decimal(19,0)") * F.lit(Decimal(1).scaleb(-digits))).cast(kind)


def _known(c: str, present: Column | None = None) -> dict[str, Column]:
    """Sum and number of the values of a level."""
    here = F.col(c).isNotNull() if present is None else F.coalesce(present, F.lit(False))
    return {f"s_{c}": F.when(here, F.col(c)), f"n_{c}": here.cast("int")}


def cells(t: Tables, keys: list[str], tags: Collection[str] = PLAIN, beside: DataFrame | None = None) -> DataFrame | None:
    """The cells of these tags, from sessions, blocks, errors, mock exams and essays; None if there are no such tags. The rows `beside` them come along, dealt alike."""
    kinds = {"valor": "string", "materia_id": dict(t["bloco"].dtypes)["materia_id"], "dificuldade": "int", "dia": "date", "topico": _topic_kind(t, "assunto_id")}
    dims = {c: k for c, k in kinds.items() if any(c in DIMS.get(tag, ()) for tag in tags)}
    slots = max((len(LAYOUT[tag]) for tag in tags if tag in LAYOUT), default=0)
    cell, one = partial(_cell, dims, slots), F.lit(1)
    tables, made = [], []

    def give(df: Callable[[Tables], DataFrame], columns: str, own: dict[str, Column], *more: Column) -> None:
        """Rows of a fact with the columns that cells take, and the cells that one gives. Spark leaves out the columns that no cell asked for takes; the month comes from the day again."""
        given = [c for n, c in own.items() if n in tags]
        if given or more:
            rows = df(t)
            kept = [F.col(c).cast(kinds[c]).alias(c) if c == "materia_id" else F.col(c) for c in columns.split()]
            number, day = F.lit(len(tables)).cast("tinyint"), F.col("dia" if "dia" in rows.columns else "mes")
            tables.append(rows.select(*keys, number.alias("fato"), day.alias("dia"), *kept))
            lists = [*([F.array(*given)] if given else []), *more]
            made.append(F.when(F.col("fato") == number, F.concat(*lists) if len(lists) > 1 else lists[0]))

    nonzero = {**_known("nivel_foco", F.col("nivel_foco") != 0), **_known("nivel_energia", F.col("nivel_energia") != 0)}
    focus = F.col("nivel_foco") > 0
    x = F.when(focus, F.col("nivel_foco"))
    session = {"n_sessao": one, "minutos": F.col("minutos_liquidos")}
    give(facts.sessions, "materia_id tipo_sessao minutos_liquidos nivel_foco nivel_energia", {
        "sessoes": cell("sessoes", **session, **_known("nivel_foco"), **_known("nivel_energia")),
        "tipo": cell("tipo", valor=F.col("tipo_sessao"), **session, **nonzero),
        "materia": cell("materia", "materia_id", **session, **nonzero),
        "dia": cell("dia", "dia", **session),
        "par": cell("par", "materia_id", "dia", n_sessao=focus.cast("int"), x=x, xx=x * x),
    })

    y = (F.col("ipr") * 10000).cast("long")
    block = {"n_bloco": one, "q_bloco": F.col("total_questoes"), "a_bloco": F.col("total_acertos"), "ipr_bloco": F.col("ipr"), "seg_bloco": F.col("tempo_total_segundos"), "tempo": ratio("tempo_total_segundos", "total_questoes").cast("decimal(18,6)"), **_known("nivel_confianca_medio")}
    block = lambda tag, *by, every=block, **other: cell(tag, *by, **{n: every[n] for n in LAYOUT[tag] if n in every}, **other)
    by_block = {"blocos": block("blocos"), "blocos_materia": block("blocos_materia", "materia_id"), "dificuldade": block("dificuldade", "dificuldade"), "dia": block("dia", "dia"), "par": cell("par", "materia_id", "dia", n_bloco=one, y=y, yy=y * y)}
    error = lambda kind, n: cell("erro", valor=kind, n_bloco=one, erros=n)
    of_block = "materia_id dificuldade total_questoes total_acertos tempo_total_segundos nivel_confianca_medio ipr"
    more, scored = [], facts.scored_blocks
    few = "assunto" in tags and _few_topics(t)
    if "assunto" in tags:
        topic = lambda x: F.struct(x["materia_id"], F.col("assunto_id"), F.coalesce(x["assunto_nome"], F.col("assunto_id").cast("string")), x["semana_do_ciclo"])
        unnamed = F.array(F.lit(None).cast(_topic_kind(t)))
        more.append(F.transform(F.coalesce("topicos", unnamed), lambda x: block("assunto", topico={"topico": topic(x), "materia_id": x["materia_id"]})))
        of_block += " assunto_id" if few else " assunto_id topicos"
    if "erro" in tags and len(by_block.keys() & set(tags)) + len(more) > 1:
        more.append(F.transform(F.coalesce("erros", F.array().cast("array<struct<tipo_erro:string,quantidade:bigint>>")), lambda e: error(e["tipo_erro"], e["quantidade"])))
        of_block, scored = of_block + " erros", _blocks
    elif "erro" in tags:
        give(_errors, "tipo_erro quantidade", {"erro": error(F.col("tipo_erro"), F.col("quantidade"))})
    give(lambda t: _with_topics(t, scored(t), few) if "assunto" in tags and not few else scored(t), of_block, by_block, *more)

    def paired(tag: str, level: str, hits: Column) -> Column:
        held = (F.col(level) > 0) & (F.col("total_questoes") > 0)
        x, y = F.when(held, F.col(level).cast("long")), F.when(held, F.round(ratio(hits, "total_questoes") * 1e6).cast("long"))
        return cell(tag, n_simulado=F.coalesce(held, F.lit(False)).cast("int"), x=x, y=y, xx=x * x, yy_alto=F.floor(y * y / HALF), yy_baixo=F.pmod(y * y, F.lit(HALF)), xy=x * y)

    give(facts.scored_mocks, "total_questoes total_acertos tempo_total_segundos nivel_ansiedade nivel_fadiga qualidade_sono ipr", {
        "mocks": cell("mocks", n_simulado=one, seg_simulado=F.col("tempo_total_segundos"), q_simulado=F.col("total_questoes"), a_simulado=F.col("total_acertos"), ipr_simulado=F.col("ipr")),
        "estado": cell("estado", **{k: v for c, tag in STATE.items() if tag == "estado" for k, v in _known(c).items()}),
        "dia": cell("dia", "dia"),
        "sono": paired("sono", "qualidade_sono", F.col("total_acertos")),
        "ansiedade": paired("ansiedade", "nivel_ansiedade", F.col("total_questoes") - F.col("total_acertos")),
    })
    give(lambda t: periods.by_month(essays.essay_scores(t["redacao"]), "data_escrita"), "status", {"status": cell("status", valor=F.col("status"), n_redacao=one), "ensaios": cell("ensaios", n_redacao=one)})
    if not tables:
        return None
    all_ = reduce(partial(DataFrame.unionByName, allowMissingColumns=True), tables)
    both = [all_] if beside is None else [all_, beside]
    dealt = lambda df: df.repartition(_parts(*both), *keys) if keys else df
    all_ = dealt(all_)
    if few:  # names stay at home, then
        all_ = _with_topics(t, all_, few)
    # made by a projection of their own, which is compiled, unlike what a generator takes
    each = all_.select(*keys, F.trunc("dia", "month").alias("mes"), F.coalesce(*made).alias("c")).select(*keys, "mes", F.inline("c"))
    # without anything that they are broken down by, the month's sums alone will do
    summed = each.groupBy(*keys, "mes", "tag", *dims).agg(*(F.sum(f"v{i}").alias(f"v{i}") for i in range(slots))) if dims else each
    lacking = {c: k for c, k in kinds.items() if c not in dims} | {f"v{i}": "long" for i in range(slots, SLOTS)}
    out = summed.select(*keys, "mes", "tag", *dims, *(f"v{i}" for i in range(slots)), *(F.lit(None).cast(k).alias(c) for c, k in lacking.items()))
    return out if beside is None else out.unionByName(dealt(beside), allowMissingColumns=True)


def _of(tag: str, value: Column | str, present: str | None = None) -> Column:
    """value where a row is a cell of the tag (with rows of a fact)."""
    own = _sum_of(tag)
    here = F.col("tag") == tag
    return F.when(here & (own(present) > 0) if present else here, own(value) if isinstance(value, str) else value)


def _listed(tag: str, cells_: list[Column | str], present: str | None = None) -> Column:
    return F.sort_array(F.collect_list(_of(tag, F.struct(*cells_), present)))


def _level(c: str, of: Callable[[str], Column] = F.col) -> Column:
    return rounded(F.try_divide(of(f"s_{c}").cast("double"), of(f"n_{c}")), 2)


def _gathered(t: Tables, keys: list[str], sections: Collection[str] = SECTIONS) -> DataFrame:
    """A row for each key and month: sums, arrays of cells, topics, exams and essays. What only other sections are made of is empty."""
    tags = {tag for n in sections for tag in NEEDS[n]}
    by = [*keys, "mes"]
    scored = periods.by_month(essays.essay_scores(t["redacao"]), "data_escrita")
    made = {"redacao": scored.select(*by, "data_escrita", "redacao_id", "nota_total", "status", "competencia_mais_fraca", *COMPETENCIES)}
    if not keys:  # few rows once they are summed
        made["assunto"] = breakdowns.blocks_by_topic(t, keys)
    if "desempenho_simulado" in t:
        made["simulado"] = breakdowns.mock_detail(t, keys)
    if "prova" in t:
        made["prova"] = breakdowns.official_exam_detail(t, keys)
    # rows of tags that no section needs are no rows at all, so Spark leaves out what would make them
    rows = [df.where(F.lit(tag in tags)).select(*by, F.lit(tag).alias("tag"), F.struct(*(c for c in df.columns if c not in by)).alias(tag)) for tag, df in made.items()]
    beside = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    needed = tags & made.keys()
    all_ = cells(t, keys, tags - made.keys(), beside if needed else None)
    if all_ is None:
        all_ = _dealt(cells(t, keys).where(F.lit(False)).unionByName(beside, allowMissingColumns=True), *keys)
    elif not needed:
        all_ = all_.unionByName(beside, allowMissingColumns=True)
    if tags & {"materia", "blocos_materia", "assunto"}:
        all_ = all_.join(t["materia"].select("materia_id", F.col("nome").alias("materia_nome")), "materia_id", "left")
    else:
        all_ = all_.withColumn("materia_nome", F.lit(None).cast("string"))

    total = lambda tag, c: F.coalesce(_scaled(c, F.sum(F.when(F.col("tag") == tag, _held(tag, c)))), F.lit(0))
    kinds = lambda names: F.coalesce(F.sum(_of("erro", F.when(F.col("valor").isin(*names), _sum_of("erro")("erros")))), F.lit(0))
    measures = {"total_blocos": "n_bloco", "total_questoes": "q_bloco", "total_acertos": "a_bloco", "soma_ipr": "ipr_bloco", "tempo": "tempo"}
    measured = lambda tag, timed: breakdowns.block_measures(timed, lambda n: _sum_of(tag)(measures[n]))

    def session(tag: str) -> list[Column]:
        c = _sum_of(tag)
        return [c("n_sessao").alias("quantidade"), c("minutos").alias("total_minutos"), _level("nivel_foco", c).alias("media_foco"), _level("nivel_energia", c).alias("media_energia")]

    subject = F.coalesce("materia_nome", F.col("materia_id").cast("string")).alias("materia_nome")

    # a day's hours, questions and score: sessions and blocks, not mock exams
    c = _sum_of("dia")
    day = (F.col("tag") == "dia") & (c("n_sessao") + c("n_bloco") > 0)
    hours = c("minutos") / 60 + c("seg_bloco") / 3600
    day_ipr = F.when(day, rounded(breakdowns.two_digit_ipr(lambda n: c(measures[n])) * 100, 2))
    par = _sum_of("par")
    pairs = (F.col("tag") == "par") & (par("n_sessao") > 0) & (par("n_bloco") > 0)
    product = lambda a, b: F.sum(F.when(pairs, (par(a).cast("decimal(19,0)") * par(b).cast("decimal(19,0)")).cast("decimal(38,0)")))
    squares = lambda tag: F.sum(_of(tag, _sum_of(tag)("yy_alto").cast("decimal(19,0)") * HALF + _sum_of(tag)("yy_baixo")))
    subjects = lambda tag, *names: F.map_from_entries(F.collect_list(F.when((F.col("tag") == tag) & F.col("materia_id").isNotNull(), F.struct("materia_id", F.struct(*(_sum_of(tag)(n).alias(n) for n in names))))))
    note = F.col("redacao.nota_total")
    out = {
        **{n: total(tag, n) for n, tag in TOTALS.items()},
        **{f"{k}_{n}": total(tag, f"{k}_{n}") for n, tag in STATE.items() for k in "sn"},
        "dias": F.count(_of("dia", F.lit(1))),
        "mascara": F.bit_or(_of("dia", F.expr("shiftleft(1L, dayofmonth(dia) - 1)"))),
        "sh": F.stddev_pop(F.when(day, rounded(hours, 6))),
        "sq": F.stddev_pop(F.when(day & (c("n_bloco") > 0), c("q_bloco"))),
        "melhor_dia": F.max_by(F.when(day, F.col("dia")), F.when(day, F.struct(day_ipr, -F.unix_date("dia")))),
        "melhor_ipr": F.max(day_ipr),
        "pior_dia": F.min_by(F.when(day, F.col("dia")), F.when(day, F.struct(day_ipr, F.col("dia")))),
        "pior_ipr": F.min(day_ipr),
        "total_erros_registrados": total("erro", "erros"),
        "distracao": kinds(scores.CARELESS),
        "conceito": kinds(scores.CONCEPTUAL),
        "n_redacao": total("ensaios", "n_redacao"),
        "por_tipo": _listed("tipo", [F.col("valor").alias("tipo_sessao"), *session("tipo")], "n_sessao"),
        "por_materia": _listed("materia", ["materia_id", *session("materia"), subject], "n_sessao"),
        "blocos_por_materia": _listed("blocos_materia", ["materia_id", *measured("blocos_materia", True), subject], "n_bloco"),
        "blocos_por_assunto": F.sort_array(F.collect_list("assunto")) if "assunto" in made else _listed("assunto", ["topico.materia_id", "topico.assunto_id", *measured("assunto", False), scores.topic_status(breakdowns.two_digit_ipr(lambda n: _sum_of("assunto")(measures[n]))).alias("status"), "topico.assunto_nome", "topico.semana_do_ciclo", "materia_nome"]),
        "blocos_por_dificuldade": _listed("dificuldade", ["dificuldade", *measured("dificuldade", False)]),
        "por_erro": _listed("erro", [(-_sum_of("erro")("erros")).alias("menos"), F.col("valor").alias("tipo_erro"), _sum_of("erro")("n_bloco").alias("blocos_afetados")]),
        "propria": subjects("materia", "minutos"),
        "blocos_propria": subjects("blocos_materia", "seg_bloco", "q_bloco", "ipr_bloco", "n_bloco"),
        "status_redacoes": _listed("status", [F.col("valor").alias("status"), _sum_of("status")("n_redacao").alias("n")]),
        "evolucao_redacoes": F.sort_array(F.collect_list("redacao")),
        "nota_media": rounded(F.avg(note), 1), "nota_maxima": F.max(note), "nota_minima": F.min(note),
        **{f"media_{n}": rounded(rounded(F.avg(F.col(f"redacao.{n}")), 2), 1) for n in COMPETENCIES},
        "mais_fraca_comum": F.mode(F.col("redacao.competencia_mais_fraca"), deterministic=True),
        "pares": F.coalesce(product("n_sessao", "n_bloco"), F.lit(0)),
        "p_x": product("x", "n_bloco"), "p_y": product("y", "n_sessao"), "p_xx": product("xx", "n_bloco"), "p_yy": product("yy", "n_sessao"), "p_xy": product("x", "y"),
        **{f"{tag}_{n}": F.sum(_of(tag, n)) for tag in ("sono", "ansiedade") for n in ("n_simulado", "x", "y", "xx", "xy")},
        **{f"{tag}_yy": squares(tag) for tag in ("sono", "ansiedade")},
        **{name: F.sort_array(F.collect_list(tag)) for name, tag in (("simulados", "simulado"), ("provas_oficiais", "prova")) if tag in made},
    }
    m = all_.groupBy(*by).agg(*(c.alias(n) for n, c in out.items()))
    # rows are months here, few for each key, so that they can stand in order
    w = Window.partitionBy(*keys).orderBy("mes")
    follows = F.lag("mes").over(w) == F.add_months("mes", -1) if set(sections) & set(CARRIED) else F.lit(False)
    before = lambda c: F.coalesce(F.when(follows, F.lag(c).over(w)), F.lit(0))
    return m.withColumns({f"{n}_ant": before(n) for n in (*TOTALS, "n_redacao")} | {"erros_ant": before("total_erros_registrados")})


def _some(array: Column | str) -> Column:
    """Null in place of an empty array."""
    array = F.col(array) if isinstance(array, str) else array
    return F.when(F.size(array) > 0, array)


def _first_names(array: Column, name: str) -> Column:
    """Of the first three, those that have a name; null if none has."""
    names = F.array_compact(F.transform(F.slice(array, 1, 3), lambda x: x[name]))
    return F.when(F.size(names) > 0, F.array_join(names, ", "))


def _summed(m: DataFrame) -> DataFrame:
    """The month's totals, its days as runs, and the month before."""
    old = lambda c: F.col(f"{c}_ant")
    m = m.withColumns({"questoes": F.col("q_bloco") + F.col("q_simulado"), "acertos": F.col("a_bloco") + F.col("a_simulado"), "questoes_ant": old("q_bloco") + old("q_simulado"), "acertos_ant": old("a_bloco") + old("a_simulado"), "ativo": F.col("n_sessao") + F.col("n_bloco") + F.col("n_simulado") > 0})
    # the days as a text of ones and zeros, the month's last day first
    m = m.withColumn("traco", F.lpad(F.bin("mascara"), periods.days_in("mes"), "0"))
    longest = lambda other: F.array_max(F.transform(F.split("traco", other), F.length)).cast("long")
    return m.withColumns({"maior_streak": longest("0"), "maior_falta": longest("1"), "streak_atual": F.length(F.regexp_extract("traco", "^1*", 0)).cast("long"), "dias_estudados": F.col("dias")})


def _balanced(t: Tables, m: DataFrame) -> DataFrame:
    """`balanceamento_materias`: every subject against its weight, the heaviest first, then by id."""
    subjects = t["materia"].agg(F.collect_list(F.struct("materia_id", F.col("nome").alias("materia_nome"), "peso_prova")).alias("todas"))
    m = m.crossJoin(F.broadcast(subjects))  # one row on the right

    def row(s: Column) -> Column:
        own = lambda c: F.coalesce(F.try_element_at("propria" if c == "minutos" else "blocos_propria", s["materia_id"])[c], F.lit(0))
        ipr = F.coalesce(mean(own("ipr_bloco"), own("n_bloco"), 4), F.lit(0.0))
        made = breakdowns.balance_columns(s["peso_prova"], own("minutos"), own("seg_bloco"), own("q_bloco"), ipr, F.col("minutos") + F.col("seg_bloco") / 60, F.col("questoes"))
        return F.struct((-s["peso_prova"]).alias("menos"), s["materia_id"].alias("materia_id"), F.struct(s["materia_id"].alias("materia_id"), s["materia_nome"].alias("materia_nome"), *made).alias("linha"))

    lines = F.transform(F.sort_array(F.transform("todas", row)), lambda x: x["linha"])
    return m.withColumn("balanceamento_materias", F.when(F.col("ativo"), lines))


def _with_sections(t: Tables, m: DataFrame, as_of: date) -> DataFrame:
    old = lambda c: F.col(f"{c}_ant")
    held = lambda cond, columns: F.when(cond, F.struct(*columns))
    active, blocks, errors = F.col("ativo"), F.col("n_bloco") > 0, F.size("por_erro") > 0
    m = _balanced(t, _summed(m))
    m = m.withColumn("resumo_geral", held(active, facts.summary_columns()))
    shared = lambda x: x.withField("percentual_do_total", rounded(x["total_minutos"] / F.when(F.col("minutos") == 0, 1).otherwise(F.col("minutos")) * 100, 1))
    ranked = lambda e, k: F.struct((k + 1).alias("posicao"), e["tipo_erro"].alias("tipo_erro"), (-e["menos"]).alias("total_ocorrencias"), pct(-e["menos"], "total_erros_registrados", 1).alias("percentual_do_total"), e["blocos_afetados"].alias("blocos_afetados"))
    now_errors = F.try_divide(F.col("total_erros_registrados").cast("double"), F.col("n_bloco").cast("double"))
    old_errors = F.coalesce(F.try_divide(old("erros").cast("double"), old("n_bloco").cast("double")), F.lit(0.0))
    correlated = lambda n, *c: F.struct(F.col(n).cast("long").alias("pares"), breakdowns.pearson(*(F.col(x).cast("decimal(19,0)") for x in (n, *c))).alias("correlacao"))
    of_mocks = lambda tag: F.when(F.col(f"{tag}_n_simulado") > 0, correlated(*(f"{tag}_{c}" for c in ("n_simulado", "x", "y", "xx", "yy", "xy"))))
    m = m.withColumns({
        "sessoes_por_tipo": _some(F.transform("por_tipo", shared)),
        "sessoes_por_materia": _some(F.transform("por_materia", shared)),
        **{c: _some(c) for c in ("blocos_por_materia", "blocos_por_assunto", "blocos_por_dificuldade", "evolucao_redacoes", "status_redacoes")},
        **{c: _some(c) for c in ("simulados", "provas_oficiais") if c in m.columns},
        "erros_por_tipo": _some(F.transform("por_erro", ranked)),
        "erros": held(errors, [F.col("total_erros_registrados"), pct("distracao", "total_erros_registrados", 1).alias("taxa_distracao_pressa"), pct("conceito", "total_erros_registrados", 1).alias("taxa_conceito_calculo")]),
        "tendencia_erros": held(blocks, [rounded(now_errors, 2).alias("erros_por_bloco"), rounded(old_errors, 2).alias("erros_por_bloco_anterior"), breakdowns.trend_label(now_errors, old_errors).alias("tendencia_erro")]),
        "redacoes": held(F.size("evolucao_redacoes") > 0, [F.col("n_redacao").alias("total_redacoes"), "nota_media", "nota_maxima", "nota_minima", *(f"media_{c}" for c in COMPETENCIES), "mais_fraca_comum"]),
        "estado_mental": held(active, [_level(c).alias(c) for c in STATE]),
        "consistencia": held(active, facts.consistency_columns()),
        "melhor_e_pior_dia": held(F.col("melhor_dia").isNotNull(), ["melhor_dia", "melhor_ipr", "pior_dia", "pior_ipr"]),
        "foco_ipr": F.when(F.col("pares") > 0, correlated("pares", "p_x", "p_y", "p_xx", "p_yy", "p_xy")),
        "sono_acerto": of_mocks("sono"),
        "ansiedade_erro": of_mocks("ansiedade"),
    })
    sides = {}
    for tag, c in (("", F.col), ("_anterior", old)):
        sides |= {f"horas{tag}": rounded(facts.minutes(c) / 60, 2), f"questoes{tag}": c("questoes").cast("double"), f"acerto{tag}": rounded(ratio(c("acertos"), c("questoes")) * 100, 2), f"ipr{tag}": facts.month_ipr(c), f"redacoes{tag}": c("n_redacao")}
    # the comparison's names are others' too; as plain columns they are computed once, as fields of a struct wherever one is used
    compared = m.select(*m.columns, *(v.alias(f"lado_{n}") for n, v in sides.items()))
    names = {n: F.col(f"lado_{n}") for n in sides}
    compared = compared.withColumn("comparativo_mes_anterior", F.when(F.col("ativo") | (F.col("n_redacao") > 0), F.struct(*reports.compared_columns(names.__getitem__))))
    projected = reports.projection_columns(as_of, lambda n: F.col(f"resumo_geral.{n}"))
    return compared.withColumn("projecao_fechamento", F.when(F.col("ativo"), F.struct(*projected)))


def _with_advice(m: DataFrame) -> DataFrame:
    """`recomendacoes_estrategicas` of the months with a session, block or mock exam."""
    critical = F.filter(F.coalesce("blocos_por_assunto", F.array()), lambda a: (a["ipr_medio"] < 70) & (a["total_blocos"] >= 2))
    # the section itself begins with the subject, and stands in its order
    critical = F.sort_array(F.transform(critical, lambda a: F.struct(a["assunto_id"].isNull().alias("sem_id"), a["assunto_id"].alias("assunto_id"), a["assunto_nome"].alias("assunto_nome"))))
    neglected = F.filter("balanceamento_materias", lambda b: b["peso_vs_tempo"] == "SUBINVESTIDA")
    tenth = lambda x: rounded(x, 1).cast("decimal(20,1)").cast("string")
    told = {
        "ipr": F.col("resumo_geral.ipr_geral"), "ipr_pct": tenth(F.col("resumo_geral.ipr_geral")), "score": F.col("consistencia.score"),
        "n_criticos": F.size(critical), "criticos": _first_names(critical, "assunto_nome"), "subinvestidas": _first_names(neglected, "materia_nome"),
        "distracao": F.coalesce("erros.taxa_distracao_pressa", F.lit(0.0)), "projetadas": F.col("projecao_fechamento.horas_projetadas"), "necessarias": F.col("projecao_fechamento.horas_necessarias"),
        "redacoes": F.coalesce("redacoes.total_redacoes", F.lit(0)), "nota_media": F.col("redacoes.nota_media"), "fraca": F.col("redacoes.mais_fraca_comum"),
    }
    m = m.select(F.struct(*m.columns).alias("m"), *(v.alias(n) for n, v in told.items()))
    return m.select("m.*", F.when(F.col("m.ativo"), month_texts()).alias("recomendacoes_estrategicas"))


def month_texts() -> Column:
    """The advice on a month, as structs in order, from columns that tell of it; the general one where no condition holds."""
    names = ("categoria", "prioridade", "mensagem", "acao_sugerida")
    row = lambda cells_: F.struct(*(texts.filled(c).alias(n) for c, n in zip(cells_, names)))
    given = F.array_compact(F.array(*(F.when(F.expr(cond), row(c)) for cond, *c in texts.MONTH_ADVICE)))
    return F.when(F.size(given) == 0, F.array(row(texts.MONTH_FALLBACK))).otherwise(given)


def monthly_report(t: Tables, as_of: date, keys: list[str] = KEYS, sections: Collection[str] = SECTIONS) -> DataFrame:
    """A row for each month with a session, block, mock exam, official exam or essay, with all sections nested; sections without rows are null. With some sections alone: a row for each month with anything that these are made of.

    Arrays hold what one key does in one month, and none grows with anything but that. Without the tables of exams (`desempenho_simulado`, `prova`, `desempenho_prova`) their sections are left out.
    """
    # so many columns make methods that the JVM would not compile; below this size Spark makes several of them
    conf = t["bloco"].sparkSession.conf
    conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    _set_parts(t)
    m = _with_advice(_with_sections(t, _gathered(t, keys, sections), as_of))
    return m.select(*keys, "mes", *(c for c in SECTIONS if c in sections and c in m.columns))


def month_advice(t: Tables, as_of: date, keys: list[str] = KEYS) -> DataFrame:
    """For each month with a session, block or mock exam: `recomendacoes`, structs of category, priority, message and action, in order.

    Critical topics (two blocks or more, score below 70) come by their ids, neglected subjects by weight, then id.
    """
    report = monthly_report(t, as_of, keys, ("resumo_geral", "recomendacoes_estrategicas"))
    return report.where("resumo_geral is not null").select(*keys, "mes", F.col("recomendacoes_estrategicas").alias("recomendacoes"))


def month_advice_rows(t: Tables, as_of: date, keys: list[str] = KEYS) -> DataFrame:
    """A row for each piece of advice, with its place."""
    rows = month_advice(t, as_of, keys).select(*keys, "mes", F.posexplode("recomendacoes").alias("k", "r"))
    return rows.select(*keys, "mes", (F.col("k") + 1).alias("posicao"), "r.*")


def section_rows(report: DataFrame, section: str, keys: list[str] = KEYS) -> DataFrame:
    """A section as a table: a row for each entry of an array, or for each month that has it."""
    kind = report.schema[section].dataType.typeName()
    own = report.where(F.col(section).isNotNull()).select(*keys, "mes", section)
    return own.select(*keys, "mes", F.inline(section)) if kind == "array" else own.select(*keys, "mes", f"{section}.*")
