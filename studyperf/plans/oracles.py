"""The queries as DuckDB SQL over the same tables."""

from __future__ import annotations

import re

from ..functions import texts
from ..sources.testviews import ctes


def r(x: str, n: int) -> str:
    return f"cast(round(cast({x} as decimal(28,12)), {n}) as double)"


def ratio(a: str, b: str) -> str:
    return f"coalesce(cast({a} as double) / nullif(cast({b} as double), 0), 0.0)"


def pct(a: str, b: str, n: int = 2) -> str:
    return r(f"{ratio(a, b)} * 100", n)


def month(ts: str) -> str:
    return f"cast(date_trunc('month', {ts}) as date) as mes, cast({ts} as date) as dia"


def blend(b: str, m: str) -> str:
    return r(f"case when coalesce({m}, 0.0) > 0 then coalesce({b}, 0.0) * 0.7 + coalesce({m}, 0.0) * 0.3 else coalesce({b}, 0.0) end", 4)


IPR_BLOCK = f"cast(case when b.total_questoes <= 0 then 0 else {r(f'greatest(0.0, least(1.0, {ratio('b.total_acertos', 'b.total_questoes')} * 0.6 + greatest(0.0, least(1.0, (300.0 - {ratio('b.tempo_total_segundos', 'b.total_questoes')}) / 180.0)) * 0.2 + cast(b.dificuldade as double) / 5 * 0.2 - coalesce(p.n, 0) * 0.01::double))', 4)} end as decimal(6,4))"
IPR_MOCK = f"cast(case when s.total_questoes <= 0 then 0 else {r(f'greatest(0.0, least(1.0, {ratio('s.total_acertos', 's.total_questoes')} * 0.7 + greatest(0.0, least(1.0, (300.0 - {ratio('s.tempo_total_segundos', 's.total_questoes')}) / 180.0)) * 0.3 - (coalesce(s.nivel_ansiedade, 0) + coalesce(s.nivel_fadiga, 0) - coalesce(s.qualidade_sono, 0)) * 0.01::double))', 4)} end as decimal(6,4))"
LAST = "cast({ts} as timestamp) <= cast(last_day(cast({ts} as date)) as timestamp) + interval 86399 second"

SHARED = {
    "sb": f"select b.*, {month('b.data')}, {IPR_BLOCK} as ipr from bloco b left join (select bloco_id, sum(quantidade) as n from erro where tipo_erro in ('DISTRACAO', 'PRESSA') group by 1) p on p.bloco_id = b.bloco_id where {LAST.format(ts='b.data')}",
    "sm": f"select s.*, {month('s.criado_em')}, {IPR_MOCK} as ipr from simulado s where {LAST.format(ts='s.criado_em')}",
    "ss": f"select *, {month('data')} from sessao where {LAST.format(ts='data')}",
    "ativ": "select aluno_id, mes, dia, 's' as fato, minutos_liquidos as minutos, 0 as seg_b, 0 as seg_m, 0 as q, 0 as a, null::decimal(6,4) as ib, null::decimal(6,4) as im from ss union all select aluno_id, mes, dia, 'b', 0, tempo_total_segundos, 0, total_questoes, total_acertos, ipr, null from sb union all select aluno_id, mes, dia, 'm', 0, 0, tempo_total_segundos, total_questoes, total_acertos, null, ipr from sm",
    "re": f"select *, {month('data_escrita')}, competencia1 + competencia2 + competencia3 + competencia4 + competencia5 as nota_total, list_position([competencia1, competencia2, competencia3, competencia4, competencia5], least(competencia1, competencia2, competencia3, competencia4, competencia5)) as fraca from redacao",
}
NEEDS = {"sb": ["bloco", "erro"], "sm": ["simulado"], "ss": ["sessao"], "ativ": ["sessao", "bloco", "erro", "simulado", "ss", "sb", "sm"], "re": ["redacao"]}

BAND = "case when nota_total < 400 then 'critica' when nota_total < 600 then 'fraca' when nota_total < 700 then 'regular' when nota_total < 800 then 'boa' when nota_total < 900 then 'muito_boa' else 'excelente' end"
MEASURES = f"count(*) as total_blocos, sum(total_questoes) as total_questoes, sum(total_acertos) as total_acertos, {pct('sum(total_acertos)', 'sum(total_questoes)')} as percentual_acerto"
SPEED = f"{r(r('cast(sum(cast(' + ratio('tempo_total_segundos', 'total_questoes') + ' as decimal(18,6))) as double) / count(*)', 2), 1)} as tempo_por_questao"
TWO = r("cast(sum(ipr) as double) / count(*)", 2)
IPR = f"{r(f'{TWO} * 100', 2)} as ipr_medio"


def status(x: str, names: tuple[str, ...], cuts=(0.6, 0.7, 0.8)) -> str:
    return "case " + " ".join(f"when {x} < {c} then '{n}'" for c, n in zip(cuts, names)) + f" else '{names[3]}' end"


def query(needs: list[str], sql: str, more: dict[str, str] | None = None) -> str:
    """sql with the common table expressions that it needs."""
    views, shared = set(), []

    def take(n: str) -> None:
        if n in SHARED:
            for m in NEEDS[n]:
                take(m)
            if n not in shared:
                shared.append(n)
        else:
            views.add(n)

    for n in needs:
        take(n)
    parts = ctes(*views) + [f"{n} as ({SHARED[n]})" for n in shared] + [f"{n} as ({x})" for n, x in (more or {}).items()]
    return "with " + ",\n".join(parts) + "\n" + sql


def corr(x: str, y: str, where: str) -> str:
    base = f"select mes, cast({x} as double) as x, {y} as y from sm where {x} > 0 and total_questoes > 0"
    return query(["sm"], f"select mes, count(*) as pares, case when count(*) >= 3 and var_pop(x) > 1e-15 and var_pop(y) > 1e-3 then {r('covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y))', 3)} end as correlacao from ({base}) t group by mes")


def sessions(by: str) -> str:
    return f"select aluno_id, mes, {by}, count(*) as quantidade, sum(minutos_liquidos) as total_minutos, {r('cast(sum(minutos_liquidos) as double) / case when sum(sum(minutos_liquidos)) over (partition by aluno_id, mes) = 0 then 1 else sum(sum(minutos_liquidos)) over (partition by aluno_id, mes) end * 100', 1)} as percentual_do_total, {r('avg(nullif(nivel_foco, 0))', 2)} as media_foco, {r('avg(nullif(nivel_energia, 0))', 2)} as media_energia from ss group by aluno_id, mes, {by}"


def months(keys: str) -> dict[str, str]:
    return {
        "mm": f"select {keys}mes, sum(minutos) as minutos, sum(seg_b) as seg_b, sum(seg_m) as seg_m, sum(q) as q, sum(a) as a, sum(ib) as ib, sum(im) as im, count(*) filter (fato = 's') as ns, count(*) filter (fato = 'b') as nb, count(*) filter (fato = 'm') as nm, count(distinct dia) as dias, dayofmonth(last_day(mes)) as dim from ativ group by {keys}mes",
        "resumo": f"select {keys}mes, dim, {r('(minutos + cast(seg_b as double) / 60 + cast(seg_m as double) / 60) / 60', 2)} as horas_totais, ns as total_sessoes, nb as total_blocos, nm as total_simulados, q as total_questoes, a as total_acertos, q - a as total_erros, {pct('a', 'q')} as percentual_acerto, {r(blend(r('cast(ib as double) / nullif(nb, 0)', 4), r('cast(im as double) / nullif(nm, 0)', 4)) + ' * 100', 2)} as ipr_geral, {r(ratio('q', 'dias'), 1)} as questoes_por_dia, {r(ratio('minutos + cast(seg_b as double) / 60 + cast(seg_m as double) / 60', 'dias'), 1)} as minutos_por_dia, dias as dias_estudados, {r('cast(dias as double) / dim * 100', 1)} as percentual_dias from mm",
    }


DAYS = f"select mes, dia, case dayofweek(dia) when 1 then 'Segunda' when 2 then 'Terça' when 3 then 'Quarta' when 4 then 'Quinta' when 5 then 'Sexta' when 6 then 'Sábado' else 'Domingo' end as dia_semana, sum(minutos) / 60::double + sum(seg_b) / 3600::double as he, {r('sum(minutos) / 60::double + sum(seg_b) / 3600::double', 2)} as horas, sum(q) as questoes, {pct('sum(a)', 'sum(q)')} as percentual_acerto, {r('coalesce(' + r('cast(sum(ib) as double) / nullif(count(*) filter (fato = ' + chr(39) + 'b' + chr(39) + '), 0)', 2) + ', 0.0) * 100', 2)} as ipr_dia, count(*) filter (fato = 'b') as nb from ativ where fato <> 'm' group by mes, dia"


def streaks(keys: str) -> dict[str, str]:
    """From the table `ad` of distinct days."""
    return {
        "isl": f"select {keys}mes, dia - cast(row_number() over (partition by {keys}mes order by dia) as int) as ilha, dia, coalesce(lead(dia) over (partition by {keys}mes order by dia) - dia - 1, last_day(mes) - dia) as falta, case when row_number() over (partition by {keys}mes order by dia) = 1 then dia - mes else 0 end as antes from ad",
        "agr": f"select {keys}mes, ilha, count(*) as n, max(dia) as fim, max(greatest(falta, antes)) as falta from isl group by {keys}mes, ilha",
        "stk": f"select {keys}mes, max(n) as maior_streak, max(falta) as maior_falta, coalesce(max(n) filter (fim = last_day(mes)), 0) as streak_atual, cast(sum(n) as bigint) as dias_estudados from agr group by {keys}mes",
    }


def period(keys: str, start: str, old: str) -> dict[str, str]:
    n = lambda k: f"count(*) filter (quando >= date '{start}' and fato = '{k}')"
    now, past = f"quando >= date '{start}'", f"quando < date '{start}' and quando >= date '{old}'"
    group = f"group by {keys[:-2]}" if keys else ""
    return {
        "sb2": f"select b.*, {IPR_BLOCK} as ipr from bloco b left join (select bloco_id, sum(quantidade) as n from erro where tipo_erro in ('DISTRACAO', 'PRESSA') group by 1) p on p.bloco_id = b.bloco_id",
        "sm2": f"select s.*, {IPR_MOCK} as ipr from simulado s",
        "ev": f"select aluno_id, data as quando, 's' as fato, minutos_liquidos as tempo, 0 as q, 0 as a, null::decimal(6,4) as ipr from sessao where data >= date '{start}' union all select aluno_id, data, 'b', tempo_total_segundos, total_questoes, total_acertos, ipr from sb2 where data >= date '{old}' union all select aluno_id, criado_em, 'm', tempo_total_segundos, total_questoes, total_acertos, ipr from sm2 where criado_em >= date '{old}'",
        "ps": f"select {keys}coalesce(sum(tempo) filter ({now} and fato = 's'), 0) as minutos, coalesce(sum(tempo) filter ({now} and fato <> 's'), 0) as segundos, coalesce(sum(q) filter ({now}), 0) as questoes, coalesce(sum(a) filter ({now}), 0) as acertos, {n('s')} as n_sessoes, {n('b')} as n_blocos, {n('m')} as n_simulados, "
        + ", ".join(f"cast(sum(ipr) filter ({c} and fato = '{k}') as double) / nullif(count(*) filter ({c} and fato = '{k}'), 0) as i{k}{tag}" for k in "bm" for tag, c in (("", now), ("o", past)))
        + f" from ev {group} having {n('s')} + {n('b')} + {n('m')} > 0",
        "crit": f"select {keys}assunto_id, sum(total_questoes) as questoes, {r('cast(sum(ipr * total_questoes) as double) / sum(total_questoes)', 4)} as ipr_ponderado from sb2 where data >= date '{start}' group by {keys}assunto_id having sum(total_questoes) >= 10 and cast(sum(ipr * total_questoes) as double) / sum(total_questoes) < 0.70",
    }


HOURS = r("(minutos + cast(segundos as double) / 60) / 60", 2)


def board(keys: str, goals: tuple[int, int]) -> str:
    goal = lambda x, g: f"case when {x} < {g} then 'ABAIXO' when {x} > {g} then 'ACIMA' else 'DENTRO' end"
    a = f"select {keys}{HOURS} as horas, questoes, acertos, {pct('acertos', 'questoes')} as percentual_medio, {blend('ib', 'im')} as ipr_medio, {blend('ibo', 'imo')} as ipr_anterior from ps"
    b = f"select *, case when ipr_anterior = 0 then 'ESTÁVEL' when (ipr_medio - ipr_anterior) / ipr_anterior > 0.05 then 'ASCENDENTE' when (ipr_medio - ipr_anterior) / ipr_anterior < -0.05 then 'DECLÍNIO' else 'ESTÁVEL' end as tendencia, {goal('horas', goals[0])} as status_horas, {goal('questoes', goals[1])} as status_questoes from ({a}) x"
    points = "(case when ipr_medio >= 0.75 then 3 when ipr_medio >= 0.7 then 2 when ipr_medio >= 0.6 then 1 else 0 end + case when status_horas <> 'ABAIXO' then 2 else 0 end + case when status_questoes <> 'ABAIXO' then 2 else 0 end + case tendencia when 'ASCENDENTE' then 2 when 'ESTÁVEL' then 1 else 0 end)"
    c = f"select *, case when ipr_medio >= 0.7 and {points} >= 6 then 'CUMPRIDA' when {points} >= 5 then 'PARCIAL' else 'INSUFICIENTE' end as status_missao from ({b}) y"
    lists = f"select {keys}string_agg(cast(assunto_id as varchar), ',' order by assunto_id) as l from crit {'group by ' + keys[:-2] if keys else ''}"
    on = "c.aluno_id = l.aluno_id" if keys else "true"
    return f"select c.*, coalesce(l.l, '') as assuntos_criticos from ({c}) c left join ({lists}) l on {on}"


PLAN_ROWS = ", ".join(f"({d}, {a}, {b}, '{n}')" for d in range(7) for a, b, n in ((360, 480, "TEORIA"), (750, 840, "QUESTOES"), (1140, 1350, "REVISAO")) if (d, n) != (6, "REVISAO"))


def compared() -> str:
    names = {"horas": "horas", "questoes": "questoes", "acerto": "acerto", "ipr": "ipr", "redacoes": "redacoes"}
    lag = lambda n: f"cast(case when lag(mes) over w = cast(mes - interval 1 month as date) then lag({n}) over w else 0 end as double) as {n}_anterior"
    base = "select aluno_id, mes, coalesce(horas_totais, 0) as horas, coalesce(cast(total_questoes as double), 0) as questoes, coalesce(percentual_acerto, 0) as acerto, coalesce(ipr_geral, 0) as ipr, cast(coalesce(n, 0) as double) as redacoes from resumo full join (select aluno_id, mes, count(*) as n from re group by 1, 2) e using (aluno_id, mes)"
    old = f"select *, {', '.join(map(lag, names))} from ({base}) b window w as (partition by aluno_id order by mes)"
    change = lambda n: f"case when {n}_anterior = 0 then 0.0 else {r(f'({n} - {n}_anterior) / nullif({n}_anterior, 0) * 100', 1)} end"
    out = ["aluno_id", "mes"]
    for n in names:
        out += [n, f"{n}_anterior", f"{r(f'{n} - {n}_anterior', 2)} as {n}_variacao"]
        if n != "redacoes":
            text = f"cast(cast({change(n)} as decimal(20,1)) as varchar) || '%'"
            out += [f"{change(n)} as {n}_percentual", f"case when {change(n)} > 5 then '↑ +' || {text} when {change(n)} < -5 then '↓ ' || {text} else '→ ' || {text} end as {n}_rotulo"]
    return f"select {', '.join(out)} from ({old}) o"


def projected() -> str:
    now = "mes = date '2000-06-01'"
    a = f"select *, cast(case when {now} then 15 else dim end as int) as dias_passados, cast(case when {now} then dim - 15 else 0 end as int) as dias_restantes from resumo"
    b = f"select *, {r('horas_totais / dias_passados', 2)} as hd, {r('cast(total_questoes as double) / dias_passados', 1)} as qd from ({a}) x"
    c = f"select *, case when {now} then {r('horas_totais + hd * dias_restantes', 1)} else horas_totais end as hp, case when {now} then {r('total_questoes + qd * dias_restantes', 0)} else cast(total_questoes as double) end as qp from ({b}) y"
    return f"select mes, hd as horas_por_dia, qd as questoes_por_dia, hp as horas_projetadas, qp as questoes_projetadas, {r('cast(dias_estudados as double) / dias_passados * 100', 1)} as percentual_dias, hp >= 88 as horas_no_rumo, qp >= 1400 as questoes_no_rumo, dias_passados, dias_restantes, case when {now} then {r('greatest(88.0 - horas_totais, 0.0) / greatest(dias_restantes, 1)', 2)} else 0.0 end as horas_necessarias, case when {now} then {r('greatest(1400.0 - total_questoes, 0.0) / greatest(dias_restantes, 1)', 1)} else 0.0 end as questoes_necessarias from ({c}) z"


def balance() -> str:
    spent = "(coalesce(min_m, 0) + cast(coalesce(seg_o, 0) as double) / 60)"
    every = "(minutos + cast(seg_b as double) / 60)"
    share = r(f"{spent} / case when {every} = 0 then 1.0 else {every} end * 100", 1)
    ipr = f"coalesce({r('cast(ipr_m as double) / nullif(n_m, 0)', 4)}, 0.0)"
    own = "select mes, materia_id, sum(mi) as min_m, sum(se) as seg_o, sum(qu) as q_m, sum(ip) as ipr_m, count(ip) as n_m from (select mes, materia_id, minutos_liquidos as mi, 0 as se, 0 as qu, null::decimal(6,4) as ip from ss union all select mes, materia_id, 0, tempo_total_segundos, total_questoes, ipr from sb) u group by 1, 2"
    peso = "cast(peso_prova as double)"
    return f"select mm.mes, m.materia_id, m.nome as materia_nome, {peso} as peso_prova, {r(spent, 1)} as minutos, {share} as percentual_tempo, cast(coalesce(q_m, 0) as bigint) as questoes, {r('cast(coalesce(q_m, 0) as double) / case when q = 0 then 1 else q end * 100', 1)} as percentual_questoes, {r(f'{ipr} * 100', 2)} as ipr, case when {peso} <= 0 then 'SEM_PESO_DEFINIDO' when {share} / ({peso} * 10) < 0.7 then 'SUBINVESTIDA' when {share} / ({peso} * 10) > 1.4 then 'SUPERINVESTIDA' else 'EQUILIBRADA' end as peso_vs_tempo, {status(ipr, ('CRÍTICA', 'FRACA', 'REGULAR', 'BOA'))} as status from mm cross join materia m left join ({own}) o on o.mes = mm.mes and o.materia_id = m.materia_id"


def said(text: str) -> str:
    parts = re.split(r"\{(\w+)\}", text)
    return " || ".join(f"cast({p} as varchar)" if i % 2 else f"'{p}'" for i, p in enumerate(parts) if p)


def tenth(x: str) -> str:
    return f"cast(cast({r(x, 1)} as decimal(20,1)) as varchar)"


def advised() -> str:
    """The year's dashboards with their advice."""
    h, q = 1056, 16800
    d = f"select *, 'ano' as periodo, ipr_medio as ipr, {tenth('ipr_medio * 100')} as ipr_pct, percentual_medio as acerto, {h} as meta_h, {q} as meta_q, {tenth(f'{h} - horas')} as falta_h, {tenth(f'horas - {h}')} as sobra_h, {q} - questoes as falta_q, case when assuntos_criticos = '' then 0 else len(string_split(assuntos_criticos, ',')) end as n_criticos from ({board('aluno_id, ', (h, q))}) b"
    every = ", ".join(f"case when {cond} then {said(text)} end" for cond, text in texts.DASHBOARD_ADVICE)
    return f"select aluno_id, coalesce(nullif(concat_ws(' | ', {every}), ''), '{texts.DASHBOARD_FALLBACK}') as recomendacoes from ({d}) d"


def month_advised() -> str:
    """From the tables resumo, con, proj, bal, top, dis and ess, a row for each month."""
    base = f"select mes, ipr_geral as ipr, {tenth('ipr_geral')} as ipr_pct, score, coalesce(n_criticos, 0) as n_criticos, criticos, subinvestidas, coalesce(distracao, 0.0) as distracao, horas_projetadas as projetadas, horas_necessarias as necessarias, coalesce(redacoes, 0) as redacoes, nota_media, fraca from resumo left join con using (mes) left join proj using (mes) left join top using (mes) left join sub using (mes) left join dis using (mes) left join ess using (mes)"
    cells = lambda four: ", ".join(f"{said(c)} as {n}" for c, n in zip(four, ("categoria", "prioridade", "mensagem", "acao_sugerida")))
    rules = " union all ".join(f"select mes, {k} as k, {cells(four)} from base where {cond}" for k, (cond, *four) in enumerate(texts.MONTH_ADVICE))
    none = " and ".join(f"not coalesce({cond}, false)" for cond, *_ in texts.MONTH_ADVICE)
    return f"with base as ({base}) select mes, cast(row_number() over (partition by mes order by k) as int) as posicao, categoria, prioridade, mensagem, acao_sugerida from ({rules} union all select mes, 99, {cells(texts.MONTH_FALLBACK)} from base where {none}) u"


def essay_advised() -> str:
    flat = lambda table: "[" + ", ".join(f"'{t}'" for row in table for t in row) + "]"
    at = "[(competencia - 1) * 3 + case when nota <= 80 then 1 when nota <= 140 then 2 else 3 end]"
    names = "[" + ", ".join(f"'{n}'" for n in texts.COMPETENCY_NAMES) + "]"
    long = " union all ".join(f"select redacao_id, {k} as competencia, competencia{k} as nota from redacao" for k in range(1, 6))
    return f"select redacao_id, competencia, {names}[competencia] as nome, nota, {flat(texts.DIAGNOSES)}{at} as diagnostico, {flat(texts.EXERCISES)}{at} as recomendacao from ({long}) l"


def by_subject(start: str, mocks: bool) -> str:
    """The dashboards of all subjects since a day, for the students with activity since then."""
    seventh = "cast(round(coalesce(mq, 0) / 7.0) as bigint)" if mocks else "0"
    whole = lambda c: f"coalesce({c}, 0)" if mocks else "0"
    rows = f"select aluno_id, materia_id, minutos_liquidos as m, 0 as s, 0 as q, 0 as a, null::decimal(6,4) as ipr from sessao where data >= date '{start}' union all select aluno_id, materia_id, 0, tempo_total_segundos, total_questoes, total_acertos, ipr from sb2 where data >= date '{start}'"
    exams = f"select aluno_id, sum(tempo_total_segundos) as ms, sum(total_questoes) as mq, sum(total_acertos) as ma from simulado where criado_em >= date '{start}' group by 1"
    sums = f"select aluno_id, materia_id, sum(m) as m, sum(s) as s, sum(q) as q, sum(a) as a, cast(sum(ipr) as double) / nullif(count(ipr), 0) as ipr from ({rows}) e group by 1, 2"
    flat = f"select k.aluno_id, d.materia_id, d.nome as materia_nome, coalesce(m, 0) as m, coalesce(s, 0) + {whole('ms')} as s, coalesce(q, 0) + {seventh} as questoes, coalesce(a, 0) + {whole('ma')} as acertos, coalesce({r('ipr', 4)}, 0.0) as ipr_medio from (select aluno_id from ({rows}) e union select aluno_id from ({exams}) f) k cross join materia d left join ({sums}) g on g.aluno_id = k.aluno_id and g.materia_id = d.materia_id left join ({exams}) x on x.aluno_id = k.aluno_id"
    shares = f"select aluno_id, materia_id, materia_nome, {r('(m + cast(s as double) / 60) / 60', 2)} as horas, questoes, acertos, {pct('acertos', 'questoes')} as percentual_medio, ipr_medio from ({flat}) y"
    return f"select *, cast({r('questoes * percentual_medio / 100', 0)} as bigint) as acertos_estimados from ({shares}) z"


def subject_board(start: str, old: str, goals: tuple[int, int]) -> str:
    """by_subject with the score since `old`, trend, goals, mission and critical topics of each subject."""
    goal = lambda x, g: f"case when {x} < {g} then 'ABAIXO' when {x} > {g} then 'ACIMA' else 'DENTRO' end"
    before = f"select aluno_id, materia_id, {r('cast(sum(ipr) as double) / count(*)', 4)} as i from sb2 where data >= date '{old}' and data < date '{start}' group by 1, 2"
    topics = f"select aluno_id, materia_id, assunto_id from sb2 where data >= date '{start}' group by 1, 2, 3 having sum(total_questoes) >= 10 and cast(sum(ipr * total_questoes) as double) / sum(total_questoes) < 0.70"
    lists = f"select aluno_id, materia_id, string_agg(cast(assunto_id as varchar), ',' order by assunto_id) as l from ({topics}) t group by 1, 2"
    a = f"select v.aluno_id, v.materia_id, horas, questoes, ipr_medio, coalesce(i, 0.0) as ipr_anterior, {goal('horas', goals[0])} as status_horas, {goal('questoes', goals[1])} as status_questoes, coalesce(l, '') as assuntos_criticos from ({by_subject(start, True)}) v left join ({before}) b on b.aluno_id = v.aluno_id and b.materia_id = v.materia_id left join ({lists}) l on l.aluno_id = v.aluno_id and l.materia_id = v.materia_id"
    b = f"select *, case when ipr_anterior = 0 then 'ESTÁVEL' when (ipr_medio - ipr_anterior) / ipr_anterior > 0.05 then 'ASCENDENTE' when (ipr_medio - ipr_anterior) / ipr_anterior < -0.05 then 'DECLÍNIO' else 'ESTÁVEL' end as tendencia from ({a}) x"
    points = "(case when ipr_medio >= 0.75 then 3 when ipr_medio >= 0.7 then 2 when ipr_medio >= 0.6 then 1 else 0 end + case when status_horas <> 'ABAIXO' then 2 else 0 end + case when status_questoes <> 'ABAIXO' then 2 else 0 end + case tendencia when 'ASCENDENTE' then 2 when 'ESTÁVEL' then 1 else 0 end)"
    return f"select *, case when ipr_medio >= 0.7 and {points} >= 6 then 'CUMPRIDA' when {points} >= 5 then 'PARCIAL' else 'INSUFICIENTE' end as status_missao from ({b}) y"


def stored_essay() -> str:
    scores_ = ", ".join(f"competencia{k}" for k in range(1, 6))
    return f"redacao_id, aluno_id, tema, {scores_}, nota_total, {BAND} as status, cast(fraca as int) as competencia_mais_fraca, 'A competência ' || fraca || ' foi a mais fraca.' as diagnostico, 'Treinar mais a competência ' || fraca || '.' as recomendacao"


def failing(table: str, columns: str, changed: str, **holds: str) -> str:
    """Rows of a changed table for which not all holds, with the names of what doesn't."""
    reasons = ", ".join(f"case when not coalesce({ok}, false) then '{name}' end" for name, ok in holds.items())
    return query([table], f"select * from (select {columns}, concat_ws(',', {reasons}) as motivos from (select * replace ({changed}) from {table}) c) x where motivos <> ''")


def checks() -> dict[str, str]:
    ok = lambda c: f"({c} is null or {c} between 1 and 5)"
    levels = {c: ok(c) for c in ("nivel_ansiedade", "nivel_fadiga", "qualidade_sono")}
    counts = {"total_questoes": "total_questoes >= 1", "total_acertos": "total_acertos >= 0", "tempo_total_segundos": "tempo_total_segundos > 0"}
    notes = {f"competencia{k}": f"competencia{k} between 0 and 200" for k in range(1, 6)}
    return {
        "invalid_sessions": failing("sessao", "pai_id, minutos_liquidos, nivel_foco", "minutos_liquidos - 10 as minutos_liquidos, nivel_foco * 2 as nivel_foco, nullif(tipo_sessao, 'REVISAO') as tipo_sessao", tipo_sessao="tipo_sessao in ('TEORIA', 'QUESTOES', 'REVISAO')", minutos_liquidos="minutos_liquidos > 0", nivel_foco=ok("nivel_foco"), nivel_energia=ok("nivel_energia")),
        "invalid_errors": failing("erro", "bloco_id, tipo_erro, quantidade", "quantidade - 1 as quantidade, case tipo_erro when 'PRESSA' then 'OUTRO' else tipo_erro end as tipo_erro", tipo_erro="tipo_erro in ('CONCEITO', 'INTERPRETACAO', 'CALCULO', 'DISTRACAO', 'PRESSA', 'CONTEUDO_ESQUECIDO')", quantidade="quantidade >= 1"),
        "invalid_mocks": failing("simulado", "simulado_id", "numero_semana + 1 as numero_semana, numero_ciclo - 1 as numero_ciclo, nivel_fadiga + 1 as nivel_fadiga, total_acertos * 3 as total_acertos", numero_ciclo="numero_ciclo >= 1", numero_semana="numero_semana between 1 and 4", **counts, **levels),
        "invalid_mock_subjects": failing("desempenho_simulado", "simulado_id, total_questoes, total_acertos, tempo_total_segundos", "total_questoes - 5 as total_questoes, total_acertos - 2 as total_acertos, tempo_total_segundos - 300 as tempo_total_segundos", **counts),
        "invalid_exam_subjects": failing("desempenho_prova", "prova_id, materia_id, tempo_total_segundos", "percentual_acerto - 10 as percentual_acerto, tempo_total_segundos - 700 as tempo_total_segundos", percentual_acerto="percentual_acerto >= 0", tempo_total_segundos="tempo_total_segundos > 0"),
        "invalid_essays": failing("redacao", "redacao_id", "repeat(tema, 50) as tema, competencia1 + 20 as competencia1, competencia5 - 20 as competencia5", tema="length(tema) <= 300", **notes),
        "filled_essays": query(["redacao"], "select redacao_id, coalesce(case when redacao_id % 3 <> 0 then cast(data_escrita as date) end, date '2000-06-15') as dia, case when competencia1 > 100 and eixo_tematico <> '' then eixo_tematico else 'geral' end as eixo_tematico from redacao"),
        "new_topics": query(["assunto", "materia"], "select assunto_id, materia_id, nome, semana_do_ciclo from (select *, row_number() over (partition by materia_id, lower(nome) order by assunto_id) as k from (select assunto_id, materia_id + assunto_id % 3 as materia_id, trim(case when assunto_id % 2 = 0 then upper(nome) else regexp_replace(nome, ' [0-9]+$', '') end) as nome, semana_do_ciclo + 1 as semana_do_ciclo from assunto) o where nome <> '' and semana_do_ciclo between 1 and 4 and materia_id in (select materia_id from materia) and not exists (select 1 from assunto a where a.materia_id = o.materia_id and lower(trim(a.nome)) = lower(o.nome))) y where k = 1"),
    }


def build() -> dict[str, str]:
    year = period("aluno_id, ", "2000-01-01", "1999-01-01")
    month_ = period("", "2000-06-01", "2000-05-01")
    facts = ["sessao", "bloco", "erro", "simulado"]
    levels = ("nivel_foco", "nivel_energia", "nivel_confianca_medio", "nivel_ansiedade", "nivel_fadiga", "qualidade_sono")
    errs = {"me": "select b.aluno_id, b.mes, e.bloco_id, e.tipo_erro, sum(e.quantidade) as n from erro e join sb b on b.bloco_id = e.bloco_id group by 1, 2, 3, 4"}
    ad = {"ad": "select distinct mes, dia from ativ"}
    active = {"ad": "select distinct aluno_id, cast(date_trunc('month', data) as date) as mes, cast(data as date) as dia from atividade"}
    dayt = {"dd": DAYS}
    score = r("greatest(cast(dias_estudados as double) / dayofmonth(last_day(s.mes)) - least(vh * 0.05, 0.2), 0.0) * 100", 1)
    steady = f"select s.mes, {score} as score, {status(score, ('IRREGULAR', 'REGULAR', 'BOA', 'EXCELENTE'), (50, 70, 85))} as classificacao, streak_atual, maior_streak, maior_falta, vh as variacao_horas, {r('coalesce(vq, 0.0)', 1)} as variacao_questoes from stk s left join (select mes, {r('coalesce(stddev_pop(' + r('he', 6) + '), 0.0)', 2)} as vh, stddev_pop(case when nb > 0 then questoes end) as vq from dd group by 1) v on v.mes = s.mes"
    first = "count(*) as n, string_agg(nome, ', ' order by k) filter (k <= 3) as nomes"
    topics = f"select mes, assunto_id, count(*) as n, {IPR} from sb group by 1, 2"
    sections = {
        "con": steady,
        "proj": projected(),
        "bal": balance(),
        "top": f"select mes, n as n_criticos, nomes as criticos from (select mes, {first} from (select mes, coalesce(a.nome, cast(g.assunto_id as varchar)) as nome, row_number() over (partition by mes order by g.assunto_id) as k from ({topics}) g left join assunto a on a.assunto_id = g.assunto_id where ipr_medio < 70 and n >= 2) x group by 1) y",
        "sub": f"select mes, nomes as subinvestidas from (select mes, {first} from (select mes, materia_nome as nome, row_number() over (partition by mes order by peso_prova desc, materia_id) as k from bal where peso_vs_tempo = 'SUBINVESTIDA') x group by 1) y",
        "dis": f"select mes, {pct('coalesce(sum(n) filter (tipo_erro in (' + repr('DISTRACAO') + ', ' + repr('PRESSA') + ')), 0)', 'sum(n)', 1)} as distracao from me group by 1",
        "ess": f"select mes, count(*) as redacoes, {r('avg(nota_total)', 1)} as nota_media, (select cast(f as int) from (select fraca as f, count(*) as c from re q where q.mes = re.mes group by 1) z order by c desc, f limit 1) as fraca from re group by 1",
    }
    label = "case month(mes) " + " ".join(f"when {k} then '{n}'" for k, n in enumerate(("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"), 1)) + " end || '/' || year(mes)"
    rest = "cast(floor(cast(horas_totais - floor(horas_totais) as decimal(28,12)) * 60 + 0.5) as int)"
    out = {
        "dashboard_advice": query(facts, advised(), year),
        "monthly_advice": query(["ativ", "re", "erro", "materia", "assunto"], f"select * from ({month_advised()}) z", months("") | ad | streaks("") | dayt | errs | sections),
        "essay_advice": query(["redacao"], essay_advised()),
        "month_labels": query(["ativ"], f"select aluno_id, mes, {label} as rotulo, cast(cast(floor(horas_totais) as bigint) as varchar) || 'h' || case when {rest} = 0 then '' else ' ' || {rest} || 'min' end as horas_texto, cast(dim as int) as dias_ate_proximo, percentual_acerto >= 70 as aprovado from resumo", months("aluno_id, ")),
        "essay_page": query(["re"], f"select dia, {stored_essay()} from re where data_escrita < timestamp '1998-05-20' or (data_escrita = timestamp '1998-05-20' and redacao_id > 500) order by data_escrita desc, redacao_id limit 100"),
        "one_essay": query(["re"], f"select {stored_essay()} from re where redacao_id = 77"),
        "advice_points": query(["assunto"], "select assunto_id, nome || '|' || upper(nome) || '|' || case when assunto_id % 3 = 0 then nome || '|' else '' end || 'bem-vindo|fim' as pontos from assunto"),
        "countdown": query(["prova"], "select prova_id, cast(s // 86400 as int) as dias, cast(s % 86400 // 3600 as int) as horas, cast(s % 3600 // 60 as int) as minutos, cast(s % 60 as int) as segundos, " + r("least(100.0, cast(d - s // 86400 as double) * 100 / nullif(cast(d as double), 0))", 6) + " as progresso from (select prova_id, greatest(0, epoch(criado_em)::bigint - epoch(timestamp '2000-01-01 06:30:15')::bigint) as s, cast(ceil((epoch(criado_em) - epoch(timestamp '1999-07-01')) / 86400) as bigint) as d from prova) x"),
        "subject_topics": query(["assunto"], "select assunto_id, nome, semana_do_ciclo from assunto where materia_id = 3"),
        "blocks_by_subject": query(["sb", "materia"], f"select g.*, coalesce(m.nome, cast(g.materia_id as varchar)) as materia_nome from (select aluno_id, mes, materia_id, {MEASURES}, {SPEED}, {IPR} from sb group by 1, 2, 3) g left join materia m on m.materia_id = g.materia_id"),
        "block_ipr": query(["sb"], f"select bloco_id, aluno_id, cast(ipr as double) as ipr, {pct('total_acertos', 'total_questoes')} as percentual_acerto from sb"),
        "mock_ipr": query(["sm"], "select simulado_id, aluno_id, cast(ipr as double) as ipr from sm"),
        "month_summary": query(["ativ"], "select * exclude (dim) from resumo", months("aluno_id, ")),
        "sessions_by_type": query(["ss"], sessions("tipo_sessao")),
        "sessions_by_subject": query(["ss", "materia"], f"select g.*, coalesce(m.nome, cast(g.materia_id as varchar)) as materia_nome from ({sessions('materia_id')}) g left join materia m on m.materia_id = g.materia_id"),
        "blocks_by_topic": query(["sb", "materia", "assunto"], f"select g.*, coalesce(a.nome, cast(g.assunto_id as varchar)) as assunto_nome, a.materia_id, a.semana_do_ciclo, m.nome as materia_nome from (select aluno_id, mes, assunto_id, {MEASURES}, {IPR}, {status(TWO, ('CRÍTICO', 'FRACO', 'REGULAR', 'BOM'))} as status from sb group by 1, 2, 3) g left join assunto a on a.assunto_id = g.assunto_id left join materia m on m.materia_id = a.materia_id"),
        "blocks_by_difficulty": query(["sb"], f"select aluno_id, mes, dificuldade, {MEASURES}, {IPR} from sb group by 1, 2, 3"),
        "blocks_grouping_sets": query(["sb"], f"select aluno_id, mes, case when grouping(materia_id) = 0 then 'materia' when grouping(assunto_id) = 0 then 'assunto' when grouping(dificuldade) = 0 then 'dificuldade' else 'total' end as nivel, materia_id, assunto_id, dificuldade, {MEASURES}, {SPEED}, {IPR} from sb group by grouping sets ((aluno_id, mes, materia_id), (aluno_id, mes, assunto_id), (aluno_id, mes, dificuldade), (aluno_id, mes))"),
        "errors_by_type": query(["sb", "erro"], f"select aluno_id, mes, tipo_erro, cast(sum(n) as bigint) as total_ocorrencias, {pct('sum(n)', 'sum(sum(n)) over (partition by aluno_id, mes)', 1)} as percentual_do_total, count(distinct bloco_id) as blocos_afetados, row_number() over (partition by aluno_id, mes order by sum(n) desc, tipo_erro) as posicao from me group by 1, 2, 3", errs),
        "error_group_share": query(["sb", "erro"], f"select aluno_id, mes, cast(sum(n) as bigint) as total_erros_registrados, {pct(chr(99) + 'oalesce(sum(n) filter (tipo_erro in (' + repr('DISTRACAO') + ', ' + repr('PRESSA') + ')), 0)', 'sum(n)', 1)} as taxa_distracao_pressa, {pct('coalesce(sum(n) filter (tipo_erro in (' + repr('CONCEITO') + ', ' + repr('CALCULO') + ')), 0)', 'sum(n)', 1)} as taxa_conceito_calculo from me group by 1, 2", errs),
        "error_trend": query(["sb", "erro"], f"select aluno_id, mes, {r('atual', 2)} as erros_por_bloco, {r('antes', 2)} as erros_por_bloco_anterior, case when antes = 0 then 'SEM_DADOS_ANTERIORES' when atual > antes * 1.1::double then 'PIORANDO' when atual < antes * 0.9::double then 'MELHORANDO' else 'ESTÁVEL' end as tendencia_erro from (select *, case when lag(mes) over w = cast(mes - interval 1 month as date) then lag(atual) over w else 0.0::double end as antes from (select b.aluno_id, b.mes, cast(coalesce(sum(e.n), 0) as double) / count(*) as atual from sb b left join (select bloco_id, sum(quantidade) as n from erro group by 1) e on e.bloco_id = b.bloco_id group by 1, 2) x window w as (partition by aluno_id order by mes)) y"),
        "mock_detail": query(["sm", "desempenho_simulado"], f"select s.simulado_id, aluno_id, mes, numero_ciclo, numero_semana, total_questoes, total_acertos, {pct('total_acertos', 'total_questoes')} as percentual_acerto, {r(ratio('tempo_total_segundos', 'total_questoes'), 1)} as tempo_por_questao, cast(ipr as double) as ipr, coalesce(d.n, 0) as n_materias, cast(coalesce(d.a, 0) as bigint) as acertos_materias, d.l as materias from sm s left join (select simulado_id, count(*) as n, sum(total_acertos) as a, string_agg(concat_ws(':', materia_id, total_questoes, total_acertos, tempo_total_segundos), ',' order by materia_id, total_questoes, total_acertos, tempo_total_segundos) as l from desempenho_simulado group by 1) d on d.simulado_id = s.simulado_id"),
        "official_exam_detail": query(["prova", "desempenho_prova"], f"select p.prova_id, aluno_id, cast(date_trunc('month', criado_em) as date) as mes, ano, cast(nota_total as double) as nota_total, {r('cast(tempo_total_segundos as double) / 3600', 2)} as horas, coalesce(d.n, 0) as n_materias, d.m as melhor_percentual, d.l as materias from prova p left join (select prova_id, count(*) as n, cast(max(percentual_acerto) as double) as m, string_agg(concat_ws(':', materia_id, percentual_acerto, tempo_total_segundos), ',' order by materia_id, percentual_acerto, tempo_total_segundos) as l from desempenho_prova group by 1) d on d.prova_id = p.prova_id"),
        "essay_scores": query(["re"], f"select redacao_id, nota_total, cast(fraca as int) as competencia_mais_fraca, {BAND} as status from re"),
        "essay_long": query(["redacao"], " union all ".join(f"select redacao_id, {k} as competencia, competencia{k} as nota from redacao" for k in range(1, 6))),
        "essay_wide": query(["re"], f"select redacao_id, {', '.join(f'competencia{k}' for k in range(1, 6))}, nota_total from re"),
        "essay_stats": query(["re"], f"select aluno_id, mes, count(*) as total_redacoes, {r('avg(nota_total)', 1)} as nota_media, max(nota_total) as nota_maxima, min(nota_total) as nota_minima, {', '.join(f'{r(r(f"avg(competencia{k})", 2), 1)} as media_competencia{k}' for k in range(1, 6))}, (select cast(f as int) from (select fraca as f, count(*) as c from re q where q.aluno_id = re.aluno_id and q.mes = re.mes group by 1) z order by c desc, f limit 1) as mais_fraca_comum from re group by aluno_id, mes"),
        "essay_status_dist": query(["re"], f"select aluno_id, mes, {BAND} as status, count(*) as n from re group by 1, 2, 3"),
        "essay_progress": query(["re"], f"select aluno_id, count(*) as total, {r('avg(nota_total)', 1)} as media, max(nota_total) filter (k = 1) as ultima, {r('max(nota_total) filter (k = 1) - coalesce(avg(nota_total) filter (k > 1), max(nota_total) filter (k = 1))', 1)} as variacao, case when avg(nota_total) >= 900 then 'Elite' when avg(nota_total) >= 800 then 'Avançado' when avg(nota_total) >= 600 then 'Intermediário' when avg(nota_total) >= 400 then 'Básico' else 'Iniciante' end as nivel, least({r('avg(nota_total) / 900 * 100', 0)}, 100.0::double) as progresso, string_agg(cast(nota_total as varchar), ',' order by k desc) filter (k <= 10) as ultimas_notas from (select *, row_number() over (partition by aluno_id order by data_escrita desc, redacao_id desc) as k from re) x group by aluno_id"),
        "mental_state": query(["ss", "sb", "sm"], "select aluno_id, mes, " + ", ".join(f"{r(f'avg({c})', 2)} as {c}" for c in levels) + " from (" + " union all by name ".join(f"select aluno_id, mes, {', '.join(c if c in have else f'null::int as {c}' for c in levels)} from {t}" for t, have in (("ss", levels[:2]), ("sb", levels[2:3]), ("sm", levels[3:]))) + ") u group by 1, 2"),
        "month_compare": query(["ativ", "re"], compared(), months("aluno_id, ")),
        "month_projection": query(["ativ"], projected(), months("")),
        "day_rollup": query(["ativ"], "select * exclude (he, nb) from dd", dayt),
        "best_worst_day": query(["ativ"], "select mes, arg_max(dia, ipr_dia * 100000 - epoch(dia::timestamp) / 86400.0 / 100000) as melhor_dia, max(ipr_dia) as melhor_ipr, arg_min(dia, ipr_dia * 100000 + epoch(dia::timestamp) / 86400.0 / 100000) as pior_dia, min(ipr_dia) as pior_ipr from dd group by mes", dayt),
        "streaks": query(["atividade"], "select * from stk", active | streaks("aluno_id, ")),
        "consistency": query(["ativ"], steady, ad | streaks("") | dayt),
        "corr_focus_ipr": query(["ss", "sb"], f"select mes, count(*) as pares, case when count(*) >= 3 and var_pop(x) > 1e-15 and var_pop(y) > 1e-15 then {r('covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y))', 3)} end as correlacao from (select s.mes, cast(s.nivel_foco as double) as x, cast(b.ipr as double) as y from ss s join sb b on b.materia_id = s.materia_id and b.dia = s.dia where s.nivel_foco > 0) t group by mes"),
        "corr_sleep_hits": corr("qualidade_sono", f"round({ratio('total_acertos', 'total_questoes')} * 1e6)", ""),
        "corr_anxiety_errors": corr("nivel_ansiedade", f"round({ratio('total_questoes - total_acertos', 'total_questoes')} * 1e6)", ""),
        "subject_balance": query(["ativ", "materia"], balance(), {"mm": months("")["mm"]}),
        "period_hours": query(facts, f"select aluno_id, {HOURS} as horas from ps", year),
        "dashboard": query(facts, board("aluno_id, ", (1056, 16800)), year),
        "dashboard_single": query(facts, board("", (88, 1400)), month_),
        "critical_topics": query(facts, "select aluno_id, assunto_id, questoes, ipr_ponderado from crit", year),
        "analytics_counts": query(facts, f"select ps.aluno_id, {HOURS} as horas, questoes, {blend('ib', 'im')} as ipr_medio, n_sessoes, n_blocos, n_simulados, coalesce(c.n, 0) as n_criticos from ps left join (select aluno_id, count(*) as n from crit group by 1) c on c.aluno_id = ps.aluno_id", year),
        "subject_performance": query([*facts, "materia"], f"select m.materia_id, m.nome as materia_nome, g.* exclude (materia_id), case when g.ipr >= 0.8 then 'Excelente' when g.ipr >= 0.7 then 'Operacional' else 'Crítico' end as faixa from (select aluno_id, materia_id, sum(total_questoes) as questoes, sum(total_acertos) as acertos, {pct('sum(total_acertos)', 'sum(total_questoes)')} as percentual, {r('cast(sum(ipr) as double) / count(*)', 4)} as ipr from sb2 where data >= date '2000-01-01' group by 1, 2) g join materia m on m.materia_id = g.materia_id", year),
        "subject_dashboard": query([*facts, "materia"], by_subject("2000-01-01", True), year),
        "subject_outlook": query([*facts, "materia"], subject_board("2000-01-01", "1999-01-01", (1056, 16800)), year),
        "mean_subject_ipr": query([*facts, "materia"], f"select aluno_id, count(*) as materias, {r('avg(greatest(ipr_medio, 0.0))', 4)} as ipr_medio_materias from ({by_subject('2000-01-01', False)}) v group by 1", year),
        "block_series": query(["bloco"], f"select aluno_id, bloco_id, posicao, concat('B', posicao) as rotulo, percentual_acerto from (select aluno_id, bloco_id, row_number() over (partition by aluno_id order by data, bloco_id) as posicao, {pct('total_acertos', 'total_questoes')} as percentual_acerto from bloco where data >= date '2000-01-01') b"),
        "mock_series": query(["simulado"], f"select aluno_id, simulado_id, nth, concat('C', numero_ciclo, 'S', numero_semana) as rotulo, {pct('total_acertos', 'total_questoes')} as percentual_acerto from (select *, row_number() over (partition by aluno_id order by criado_em desc, simulado_id desc) as nth from simulado) s where nth <= 10"),
        "first_topics": query(["sb", "assunto"], f"select mes, posicao, g.assunto_id, coalesce(nome, cast(g.assunto_id as varchar)) as assunto_nome, ipr_medio, status from (select *, row_number() over (partition by mes order by ipr_medio, assunto_id) as posicao from (select mes, assunto_id, {IPR}, {status(TWO, ('CRÍTICO', 'FRACO', 'REGULAR', 'BOM'))} as status from sb group by 1, 2) x) g left join assunto a on a.assunto_id = g.assunto_id where posicao <= 20"),
        "competency_rows": query(["re"], "select * from (" + " union all ".join(f"select aluno_id, mes, 'C{k}' as competencia, {r(r(f'avg(competencia{k})', 2), 1)} as nota from re group by 1, 2" for k in range(1, 6)) + ") c where nota > 0"),
        "scaled_ipr": query(["sb"], f"select bloco_id, aluno_id, {r('coalesce(cast(ipr - lo as double) / nullif(cast(hi - lo as double), 0), 0.0)', 6)} as ipr_normalizado from (select *, min(ipr) over (partition by aluno_id) as lo, max(ipr) over (partition by aluno_id) as hi from sb) b"),
        "plan_adherence": query(["atividade"], f"select a.aluno_id, p.n as atividade, count(*) as registros from atividade a left join (values {PLAN_ROWS}) p(d, i, f, n) on p.d = isodow(a.data) - 1 and hour(a.data) * 60 + minute(a.data) between p.i and p.f group by 1, 2"),
        "latest_sessions": query(["sessao"], "select pai_id, aluno_id, materia_id, assunto_id, tipo_sessao, minutos_liquidos from sessao order by data desc, pai_id, aluno_id, materia_id, assunto_id, tipo_sessao, minutos_liquidos, nivel_foco nulls first, nivel_energia nulls first limit 100"),
        "invalid_exams": query(["prova"], "select prova_id, ano, 'ano' as motivos from prova where ano < 2000"),
        "invalid_blocks": query(["bloco"], "select bloco_id, case when a < 0 then 'total_acertos' else 'acertos_acima' end as motivos from (select bloco_id, total_questoes, total_acertos * 2 - 12 as a from bloco) b where a < 0 or a > total_questoes"),
        "new_subjects": query(["assunto", "materia"], "select assunto_id, nome, peso_prova from (select *, row_number() over (partition by lower(nome) order by assunto_id) as k from (select assunto_id, trim(regexp_replace(nome, ' [0-9]+$', '')) as nome, assunto_id % 5 as peso_prova from assunto) x where nome <> '' and peso_prova > 0 and lower(nome) not in (select lower(trim(nome)) from materia)) y where k = 1"),
    }
    names, spans = ("Crítica", "Fraca", "Regular", "Boa", "Muito Boa", "Excelente"), ("< 400", "400–599", "600–699", "700–799", "800–899", "≥ 900")
    by_band = lambda six: "case " + " ".join(f"when nota_total < {cut} then '{x}'" for cut, x in zip((400, 600, 700, 800, 900), six)) + f" else '{six[5]}' end"
    pairs = "select s.mes, cast(s.nivel_foco as double) as x, cast(b.ipr as double) as y, row_number() over (partition by s.mes order by s.data, s.pai_id, s.aluno_id, s.materia_id, s.assunto_id, s.nivel_foco, b.data, b.bloco_id) as k from ss s join sb b on b.materia_id = s.materia_id and b.dia = s.dia where s.nivel_foco > 0"
    out |= checks() | {
        "stored_essays": query(["re"], f"select redacao_id, aluno_id, cast(data_escrita as date) as dia, tema, {', '.join(f'competencia{k}' for k in range(1, 6))}, nota_total, {BAND} as status, cast(fraca as int) as competencia_mais_fraca, 'A competência ' || fraca || ' foi a mais fraca.' as diagnostico, 'Treinar mais a competência ' || fraca || '.' as recomendacao from re"),
        "band_labels": query(["re"], f"select redacao_id, {BAND} as status, {by_band(names)} as rotulo, {by_band(spans)} as faixa from re"),
        "essay_status_map": query(["re"], f"select aluno_id, mes, string_agg(status || ':' || n, ',' order by status) as distribuicao from (select aluno_id, mes, {BAND} as status, count(*) as n from re group by 1, 2, 3) d group by 1, 2"),
        "essay_evolution": query(["re"], "select aluno_id, mes, string_agg(concat_ws(':', dia, redacao_id, nota_total), ',' order by dia, redacao_id, nota_total) as evolucao from re group by 1, 2"),
        "closed_month": query(["ativ"], "select * exclude (dim) from resumo where mes = date '2000-05-01'", months("aluno_id, ")),
        "corr_first_pairs": query(["ss", "sb"], f"select mes, count(*) as pares, case when count(*) >= 3 and var_pop(x) > 1e-15 and var_pop(y) > 1e-15 then {r('covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y))', 3)} end as correlacao from ({pairs}) t where k <= 30 group by mes"),
    }
    three = {"foco_ipr": "corr_focus_ipr", "sono_acerto": "corr_sleep_hits", "ansiedade_erro": "corr_anxiety_errors"}
    out["correlations"] = "select *, coalesce(abs(correlacao) >= 0.5, false) as forte from (" + " union all ".join(f"select *, '{k}' as correlacao_de from ({out[n]}) c" for k, n in three.items()) + ") r"
    return out
