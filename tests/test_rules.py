"""Each rule of advice by hand: what must hold, and how the text that follows begins or ends. Nothing here is taken from the library's own tables of texts."""

import pytest
from pyspark.sql import functions as F
from studyperf.operators import advice, monthly

BOARD = "ipr_medio double, percentual_medio double, horas double, questoes long, tendencia string, status_horas string, status_questoes string, assuntos_criticos string"
STEADY = {"ipr_medio": 0.72, "percentual_medio": 80.5, "horas": 22.0, "questoes": 350, "tendencia": "ESTÁVEL", "status_horas": "DENTRO", "status_questoes": "DENTRO", "assuntos_criticos": ""}
TRANSITION = "Eficiência em 72.0% — zona de transição. Você acerta 80.5% das questões"

#: The period, what differs from STEADY, and the texts that must be given, in order.
BOARDS = {
    "transition": ("semana", {}, [TRANSITION]),
    "critical": ("semana", {"ipr_medio": 0.5999}, ["IPR crítico em 60.0%: você está consolidando erros. Com 80.5% de acerto e 60.0% de eficiência real", "Refaça as últimas 30 questões erradas"]),
    "critical, too many hours": ("semana", {"ipr_medio": 0.41, "horas": 25.26, "status_horas": "ACIMA"}, ["IPR crítico em 41.0%", "Refaça as últimas 30", "Você está 3.3h acima da meta de horas (22h) e o IPR está em 41.0%", "Horas 3.3h acima da meta (22h). Excesso"]),
    "below the line": ("semana", {"ipr_medio": 0.6}, ["Desempenho em 60.0% de eficiência — abaixo do limiar de aprovação (70%). Com 80.5% de acerto bruto", "Reserve 10 minutos no início de cada sessão"]),
    "below the line, falling": ("semana", {"ipr_medio": 0.6999, "tendencia": "DECLÍNIO"}, ["Desempenho em 70.0%", "Reserve 10 minutos", "IPR em queda e abaixo de 70% — sinal de alerta", "Queda de desempenho detectada em relação ao período anterior"]),
    "transition, rising": ("semana", {"ipr_medio": 0.7, "tendencia": "ASCENDENTE"}, ["Eficiência em 70.0%", "Tendência positiva: você está crescendo", "Tendência positiva em relação ao período anterior — seu plano"]),
    "transition, few questions": ("mes", {"questoes": 1000, "status_questoes": "ABAIXO"}, [TRANSITION, "Com IPR nessa faixa e 400 questões abaixo da meta (1400)", "Déficit de 400 questões no período (meta: 1400)"]),
    "good": ("semana", {"ipr_medio": 0.75, "status_questoes": "ACIMA"}, ["Bom desempenho: 75.0% de eficiência com 80.5% de acerto", "Volume acima da meta (350 questões) — atenção"]),
    "good, few hours": ("semana", {"ipr_medio": 0.8, "horas": 20.04, "status_horas": "ABAIXO"}, ["Bom desempenho: 80.0%", "Qualidade alta, mas 2.0h abaixo da meta de 22h", "Faltam 2.0h para atingir a meta semanal de 22h"]),
    "high": ("ano", {"ipr_medio": 0.85, "status_questoes": "ACIMA"}, ["Alto desempenho: 85.0% de eficiência", "Priorize questões de provas anteriores", "Volume acima da meta (16800 questões)"]),
    "high, falling": ("semana", {"ipr_medio": 0.9, "tendencia": "DECLÍNIO"}, ["Alto desempenho: 90.0%", "Priorize questões", "Atenção: IPR alto (90.0%) mas tendência em queda", "Queda de desempenho detectada"]),
    "one topic": ("semana", {"assuntos_criticos": "7"}, [TRANSITION, "1 assunto(s) com IPR abaixo de 70% no período"]),
    "three topics": ("semana", {"assuntos_criticos": "7,9,12"}, [TRANSITION, "3 assunto(s) com IPR abaixo", "3 pontos críticos simultâneos indicam base teórica fragmentada"]),
    "topics of a good one": ("semana", {"ipr_medio": 0.76, "assuntos_criticos": "7,9", "status_questoes": "ACIMA"}, ["Bom desempenho", "2 assunto(s)", "IPR geral ok (76.0%), mas há assuntos específicos críticos", "Volume acima"]),
    "hours of a month": ("mes", {"horas": 80.0, "status_horas": "ABAIXO"}, [TRANSITION, "Déficit de 8.0h no mês (meta: 88h)"]),
    "hours of a year": ("ano", {"horas": 1000.0, "status_horas": "ABAIXO"}, [TRANSITION, "Déficit de 56.0h no período (meta: 1056h)"]),
    "much and badly": ("semana", {"ipr_medio": 0.65, "status_questoes": "ACIMA"}, ["Desempenho em 65.0%", "Reserve", "Volume acima", "Combinação crítica: IPR em 65.0% (abaixo do limiar) e volume acima da meta"]),
    "falling, too many hours": ("semana", {"horas": 30.0, "status_horas": "ACIMA", "tendencia": "DECLÍNIO"}, [TRANSITION, "Queda de desempenho detectada", "Horas 8.0h acima", "Queda de desempenho com horas acima da meta (22h) — padrão clássico"]),
    "all in line": ("semana", {"ipr_medio": 0.8}, ["Bom desempenho", "Todos os indicadores alinhados"]),
    "all in line but falling": ("semana", {"ipr_medio": 0.8, "tendencia": "DECLÍNIO"}, ["Bom desempenho", "Queda de desempenho detectada"]),
}


def test_dashboard_rules(spark):
    for period in ("semana", "mes", "ano"):
        cases = {n: {**STEADY, **x} for n, (p, x, _) in BOARDS.items() if p == period}
        df = spark.createDataFrame([(n, *(c[k.split()[0]] for k in BOARD.split(", "))) for n, c in cases.items()], "caso string, " + BOARD)
        for row in advice.advised(df, period).collect():
            want = BOARDS[row["caso"]][2]
            assert len(row["recomendacoes"]) == len(want) and all(got.startswith(x) for got, x in zip(row["recomendacoes"], want)), (row["caso"], row["recomendacoes"])


MONTH = "ipr double, ipr_pct string, score double, n_criticos int, criticos string, subinvestidas string, distracao double, projetadas double, necessarias double, redacoes long, nota_media double, fraca int"
GOOD = {"ipr": 75.0, "ipr_pct": "75.0", "score": 80.0, "n_criticos": 0, "criticos": None, "subinvestidas": None, "distracao": 40.0, "projetadas": 88.0, "necessarias": 0.0, "redacoes": 2, "nota_media": 600.0, "fraca": 3}
#: What differs from GOOD, and category, priority, message (its beginning) and action (a part) of what must be given.
MONTHS = {
    "nothing to say": ({}, [("GERAL", "BAIXA", "Todos os indicadores dentro do esperado.", "eleve progressivamente a dificuldade")]),
    "critical": ({"ipr": 59.99, "ipr_pct": "60.0"}, [("DESEMPENHO", "CRÍTICA", "IPR mensal de 60.0% — abaixo do limiar mínimo.", "Pare de avançar conteúdo")]),
    "below the line": ({"ipr": 60.0, "ipr_pct": "60.0"}, [("DESEMPENHO", "ALTA", "IPR mensal de 60.0% — abaixo do limiar de aprovação.", "3 assuntos com maior taxa de erro")]),
    "at the line": ({"ipr": 70.0, "ipr_pct": "70.0"}, [("GERAL", "BAIXA", "Todos", "")]),
    "high": ({"ipr": 85.0, "ipr_pct": "85.0"}, [("DESEMPENHO", "BAIXA", "IPR mensal excelente (85.0%). Foco agora em velocidade", "cronômetro abaixo do tempo oficial")]),
    "unsteady": ({"score": 49.9}, [("CONSISTÊNCIA", "ALTA", "Score de consistência baixo (49.9%).", "horário fixo diário")]),
    "topics": ({"n_criticos": 4, "criticos": "a, b, c"}, [("ASSUNTOS_CRÍTICOS", "ALTA", "4 assunto(s) com IPR abaixo de 70%: a, b, c.", "até o IPR superar 75%")]),
    "neglected": ({"subinvestidas": "M1, M2"}, [("BALANCEAMENTO", "MÉDIA", "Matérias com alto peso na prova recebendo pouca atenção: M1, M2.", "Redistribua o tempo")]),
    "careless": ({"distracao": 40.1}, [("QUALIDADE", "MÉDIA", "40.1% dos erros são por distração/pressa.", "verificação dupla")]),
    "few hours": ({"projetadas": 74.7, "necessarias": 1.25}, [("VOLUME", "MÉDIA", "Projeção de horas (74.7h) abaixo da meta (88h).", "São necessárias 1.25h/dia adicionais")]),
    "hours just enough": ({"projetadas": 74.8}, [("GERAL", "BAIXA", "Todos", "")]),
    "no essay": ({"redacoes": 0, "nota_media": None, "fraca": None}, [("REDAÇÃO", "MÉDIA", "Nenhuma redação registrada no mês.", "pelo menos 2 redações por mês")]),
    "weak essays": ({"nota_media": 599.9}, [("REDAÇÃO", "ALTA", "Nota média das redações: 599.9. Abaixo do limiar", "Foque na competência 3")]),
    "all at once": (
        {"ipr": 10.0, "ipr_pct": "10.0", "score": 1.0, "n_criticos": 1, "criticos": "a", "subinvestidas": "M", "distracao": 99.0, "projetadas": 1.0, "necessarias": 9.0, "redacoes": 0},
        [("DESEMPENHO", "CRÍTICA", "IPR", ""), ("CONSISTÊNCIA", "ALTA", "Score", ""), ("ASSUNTOS_CRÍTICOS", "ALTA", "1 assunto(s)", ""), ("BALANCEAMENTO", "MÉDIA", "Mat", ""), ("QUALIDADE", "MÉDIA", "99.0%", ""), ("VOLUME", "MÉDIA", "Proj", ""), ("REDAÇÃO", "MÉDIA", "Nen", "")],
    ),
}


def test_month_rules(spark):
    cases = {n: {**GOOD, **x} for n, (x, _) in MONTHS.items()}
    df = spark.createDataFrame([(n, *(c[k.split()[0]] for k in MONTH.split(", "))) for n, c in cases.items()], "caso string, " + MONTH)
    for row in df.select("caso", monthly.month_texts().alias("r")).collect():
        want = MONTHS[row["caso"]][1]
        assert [(r["categoria"], r["prioridade"]) for r in row["r"]] == [x[:2] for x in want], row["caso"]
        assert all(r["mensagem"].startswith(x[2]) and x[3] in r["acao_sugerida"] for r, x in zip(row["r"], want)), row["caso"]


@pytest.mark.parametrize(("competency", "note", "begins"), [(1, 80, "A redação apresenta muitos desvios graves"), (1, 81, "Há desvios ocasionais"), (2, 141, "O tema foi bem compreendido"), (3, 0, "A argumentação é fraca"), (4, 140, "A progressão textual ocorre"), (5, 200, "A proposta de intervenção é adequada")])
def test_essay_rules(spark, competency, note, begins):
    essay = {f"competencia{k}": note if k == competency else 100 for k in range(1, 6)}
    df = spark.createDataFrame([(1, *essay.values())], "redacao_id int, " + ", ".join(f"{c} int" for c in essay))
    row = advice.essay_advice({"redacao": df}).where(F.col("competencia") == competency).first()
    assert row["nota"] == note and row["diagnostico"].startswith(begins)
