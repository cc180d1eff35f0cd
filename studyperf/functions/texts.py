"""Advice and diagnosis texts, each with the condition under which it is given.

Conditions are SQL over named columns, in a form that Spark and DuckDB read alike. `{name}` in a text stands for a column of that name, given as text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The texts of a dashboard's advice, in the order in which they are given.
DASHBOARD_ADVICE = (
    ("ipr < 0.60", "IPR crítico em {ipr_pct}%: você está consolidando erros. Com {acerto}% de acerto e {ipr_pct}% de eficiência real, continuar aumentando volume só aprofunda os padrões errados. Pare questões por 2 dias e revise a teoria dos assuntos com mais erros."),
    ("ipr < 0.60", "Refaça as últimas 30 questões erradas sem ver o gabarito antes de responder: o esforço de recuperação ativa (retrieval practice) é o que gera aprendizado real. Releitura passiva não funciona."),
    ("ipr < 0.60 and status_horas = 'ACIMA'", "Você está {sobra_h}h acima da meta de horas ({meta_h}h) e o IPR está em {ipr_pct}% — volume sem qualidade está atrapalhando. Corte a carga em 30% agora."),
    ("ipr >= 0.60 and ipr < 0.70", "Desempenho em {ipr_pct}% de eficiência — abaixo do limiar de aprovação (70%). Com {acerto}% de acerto bruto, o gargalo está na velocidade ou em erros por distração/pressa. Identifique os 2-3 assuntos com mais erros e estude-os em blocos concentrados antes de avançar."),
    ("ipr >= 0.60 and ipr < 0.70", "Reserve 10 minutos no início de cada sessão para revisar os erros do dia anterior: isso ativa reconsolidação de memória e reduz reincidência. Sem esse ciclo, você vai repetir os mesmos erros indefinidamente."),
    ("ipr >= 0.60 and ipr < 0.70 and tendencia = 'DECLÍNIO'", "IPR em queda e abaixo de 70% — sinal de alerta. Interrompa avanço de conteúdo novo por 3 dias e dedique esse tempo exclusivamente a revisão dos erros recentes. Avançar agora vai aprofundar as lacunas."),
    ("ipr >= 0.70 and ipr < 0.75", "Eficiência em {ipr_pct}% — zona de transição. Você acerta {acerto}% das questões, mas ainda há instabilidade entre assuntos. Use interleaving: alterne 2-3 assuntos dentro do mesmo bloco em vez de estudar um único tema por sessão. Isso prepara o cérebro para o formato real da prova."),
    ("ipr >= 0.70 and ipr < 0.75 and tendencia = 'ASCENDENTE'", "Tendência positiva: você está crescendo. Eleve levemente a dificuldade das questões — você está pronto para sair da zona de transição. Não mude o método, apenas aumente o nível."),
    ("ipr >= 0.70 and ipr < 0.75 and status_questoes = 'ABAIXO'", "Com IPR nessa faixa e {falta_q} questões abaixo da meta ({meta_q}), o desenvolvimento está lento. Adicione um bloco extra diário de 20-25 questões nos temas mais cobrados."),
    ("ipr >= 0.75 and ipr < 0.85", "Bom desempenho: {ipr_pct}% de eficiência com {acerto}% de acerto. Para evitar platô, aumente progressivamente a dificuldade — questões fáceis não geram crescimento real. O cérebro só evolui sob desafio calibrado."),
    ("ipr >= 0.75 and ipr < 0.85 and status_horas = 'ABAIXO'", "Qualidade alta, mas {falta_h}h abaixo da meta de {meta_h}h. Você tem o método — agora precisa de volume. Adicione sessões de 45-60 min nos intervalos do dia para fechar esse déficit."),
    ("ipr >= 0.85", "Alto desempenho: {ipr_pct}% de eficiência. O diferencial agora é velocidade sob pressão. Treine com limite de tempo 20% abaixo do real para criar margem de segurança na prova."),
    ("ipr >= 0.85", "Priorize questões de provas anteriores da EsPCEx: reconhecer o estilo de elaboração reduz carga cognitiva no dia da prova e libera atenção para questões mais difíceis."),
    ("ipr >= 0.85 and tendencia = 'DECLÍNIO'", "Atenção: IPR alto ({ipr_pct}%) mas tendência em queda. Isso quase sempre indica fadiga acumulada. Faça 1-2 dias de carga reduzida agora antes que o rendimento caia de forma mais acentuada."),
    ("n_criticos > 0", "{n_criticos} assunto(s) com IPR abaixo de 70% no período — lacuna confirmada, não acaso. Resolva ao menos 15 questões específicas desses tópicos por dia até o IPR superar 75%. Não avance nesses assuntos sem atingir esse limiar."),
    ("n_criticos >= 3", "{n_criticos} pontos críticos simultâneos indicam base teórica fragmentada. Reorganize o plano: dedique 1 semana inteira a teoria direcionada antes de retomar volume nesses temas. Tentar cobrir todos ao mesmo tempo vai aprofundar as lacunas."),
    ("n_criticos > 0 and ipr >= 0.75", "IPR geral ok ({ipr_pct}%), mas há assuntos específicos críticos puxando para baixo. Esse é exatamente o tipo de lacuna que elimina candidatos avançados na reta final. Trate com prioridade máxima."),
    ("tendencia = 'DECLÍNIO'", "Queda de desempenho detectada em relação ao período anterior. Antes de estudar mais, estude melhor: fadiga cognitiva acumulada derruba rendimento mesmo com tempo alto. Reduza volume por 2-3 dias, priorize sono e faça revisão em vez de conteúdo novo."),
    ("tendencia = 'ASCENDENTE'", "Tendência positiva em relação ao período anterior — seu plano atual está funcionando. Não mude o método agora. Eleve gradualmente a carga. Mudanças bruscas em fases de crescimento interrompem o ciclo de consolidação."),
    ("status_horas = 'ABAIXO' and periodo = 'semana'", "Faltam {falta_h}h para atingir a meta semanal de {meta_h}h. Distribua em blocos de 90 minutos com pausas de 15 min: esse ciclo respeita os picos naturais de concentração e maximiza retenção por hora estudada."),
    ("status_horas = 'ABAIXO' and periodo = 'mes'", "Déficit de {falta_h}h no mês (meta: {meta_h}h). Identifique quais dias da semana estão com menor carga e adicione pelo menos uma sessão extra nesses dias."),
    ("status_horas = 'ABAIXO' and periodo not in ('semana', 'mes')", "Déficit de {falta_h}h no período (meta: {meta_h}h). Pequenos blocos diários de 45 min acumulam muito: 5 dias por semana × 45 min = mais de 3h semanais extras sem reorganizar a rotina."),
    ("status_horas = 'ACIMA'", "Horas {sobra_h}h acima da meta ({meta_h}h). Excesso sem qualidade equivalente causa fadiga de decisão e consolidação deficiente durante o sono. Monitore: se o IPR não acompanhou o volume, reduza agora."),
    ("status_questoes = 'ABAIXO'", "Déficit de {falta_q} questões no período (meta: {meta_q}). Volume mínimo importa para criar familiaridade com padrões de prova. Inclua pelo menos um bloco extra diário de 20-30 questões nos assuntos mais cobrados."),
    ("status_questoes = 'ACIMA'", "Volume acima da meta ({meta_q} questões) — atenção: fazer muitas questões sem analisar os erros é a principal causa de estagnação em candidatos avançados. Reserve ao menos 30% do tempo de questões para revisão e análise de cada erro."),
    ("ipr < 0.70 and status_questoes = 'ACIMA'", "Combinação crítica: IPR em {ipr_pct}% (abaixo do limiar) e volume acima da meta. Você está praticando muito e aprendendo pouco. Reduza o volume pela metade e invista o tempo restante em análise profunda de cada erro."),
    ("tendencia = 'DECLÍNIO' and status_horas = 'ACIMA'", "Queda de desempenho com horas acima da meta ({meta_h}h) — padrão clássico de fadiga cognitiva. Tire um dia de descanso completo e retome com volume 20% menor. Descanso não é perda de tempo: é quando o cérebro consolida o que aprendeu."),
    ("ipr >= 0.75 and status_horas = 'DENTRO' and status_questoes = 'DENTRO' and tendencia <> 'DECLÍNIO'", "Todos os indicadores alinhados: IPR, volume e tendência estão dentro ou acima do esperado. Agora o objetivo é proteger essa consistência e elevar progressivamente a dificuldade das questões."),
)
DASHBOARD_FALLBACK = "Indicadores dentro do esperado. Mantenha a consistência — na reta final, regularidade supera qualquer pico isolado de esforço."

# A month's advice. Condition, category, priority, message, action; the last is given where no other is.
MONTH_ADVICE = (
    ("ipr < 60", "DESEMPENHO", "CRÍTICA", "IPR mensal de {ipr_pct}% — abaixo do limiar mínimo. Volume sem qualidade está consolidando erros.", "Pare de avançar conteúdo. Dedique 1 semana a revisão profunda dos temas com mais erros antes de retomar o ciclo normal."),
    ("ipr >= 60 and ipr < 70", "DESEMPENHO", "ALTA", "IPR mensal de {ipr_pct}% — abaixo do limiar de aprovação.", "Identifique os 3 assuntos com maior taxa de erro e reserve blocos exclusivos para revisão estruturada nesses temas."),
    ("ipr >= 85", "DESEMPENHO", "BAIXA", "IPR mensal excelente ({ipr_pct}%). Foco agora em velocidade e pressão.", "Simule condições reais de prova com cronômetro abaixo do tempo oficial. Introduza questões de provas anteriores da EsPCEx."),
    ("score < 50", "CONSISTÊNCIA", "ALTA", "Score de consistência baixo ({score}%). Irregularidade prejudica consolidação de memória de longo prazo.", "Estabeleça um horário fixo diário de estudo — mesmo que curto. 30 min diários superam 4 horas uma vez por semana em termos de retenção."),
    ("n_criticos > 0", "ASSUNTOS_CRÍTICOS", "ALTA", "{n_criticos} assunto(s) com IPR abaixo de 70%: {criticos}.", "Resolva questões específicas desses tópicos diariamente até o IPR superar 75%. Priorize no próximo ciclo antes de qualquer conteúdo novo."),
    ("subinvestidas is not null", "BALANCEAMENTO", "MÉDIA", "Matérias com alto peso na prova recebendo pouca atenção: {subinvestidas}.", "Redistribua o tempo de estudo priorizando essas matérias no próximo mês. Use o peso da prova como guia de alocação."),
    ("distracao > 40", "QUALIDADE", "MÉDIA", "{distracao}% dos erros são por distração/pressa. Erro técnico, não de conteúdo.", "Adote estratégia de verificação dupla nas questões. Reduza velocidade e priorize leitura completa do enunciado antes de marcar."),
    ("projetadas < 74.8", "VOLUME", "MÉDIA", "Projeção de horas ({projetadas}h) abaixo da meta (88h).", "São necessárias {necessarias}h/dia adicionais para atingir a meta. Adicione sessões curtas nos períodos livres."),
    ("redacoes = 0", "REDAÇÃO", "MÉDIA", "Nenhuma redação registrada no mês.", "Produza pelo menos 2 redações por mês para manter desenvolvimento e monitorar evolução das competências."),
    ("redacoes > 0 and nota_media < 600", "REDAÇÃO", "ALTA", "Nota média das redações: {nota_media}. Abaixo do limiar competitivo (600).", "Foque na competência {fraca} — a mais fraca do mês. Reserve 30 min semanais para exercícios específicos dessa competência."),
)
MONTH_FALLBACK = ("GERAL", "BAIXA", "Todos os indicadores dentro do esperado.", "Mantenha a consistência e eleve progressivamente a dificuldade das questões.")

# For competencies 1 to 5, texts for scores to 80, to 140 and above; and the competencies' names.
DIAGNOSES = (
    ("A redação apresenta muitos desvios graves da norma culta, comprometendo a clareza e a formalidade do texto.", "Há desvios ocasionais da norma culta que prejudicam parcialmente a qualidade linguística.", "A norma culta está bem aplicada, com poucos desvios pontuais."),
    ("A redação demonstra compreensão insuficiente da proposta temática.", "A abordagem do tema está parcialmente adequada, mas ainda superficial.", "O tema foi bem compreendido, embora possa ser aprofundado."),
    ("A argumentação é fraca ou pouco estruturada, com ideias pouco desenvolvidas.", "Os argumentos existem, mas ainda carecem de aprofundamento e exemplificação.", "A argumentação é consistente, mas pode ganhar maior densidade analítica."),
    ("O texto apresenta problemas significativos de coesão e organização das ideias.", "A progressão textual ocorre, mas com limitações no uso de conectivos.", "A coesão textual é adequada, com pequenas oportunidades de melhoria."),
    ("A proposta de intervenção é incompleta ou pouco clara.", "A intervenção é válida, mas ainda carece de detalhamento.", "A proposta de intervenção é adequada, podendo apenas ganhar maior especificidade."),
)
EXERCISES = (
    ("Estude gramática básica com foco em concordância, regência e pontuação.", "Revise regras de pontuação e concordância para reduzir pequenos desvios.", "Faça revisões finais focando em refinamento da norma culta."),
    ("Treine interpretação de temas e pratique identificar o problema central da proposta.", "Antes de escrever, destaque palavras-chave do tema e delimite o problema da redação.", "Aprofunde a abordagem temática com recortes mais específicos."),
    ("Treine construção de argumentos claros usando causa, consequência e exemplificação.", "Utilize repertório sociocultural e desenvolva melhor os exemplos nos parágrafos.", "Refine a densidade argumentativa com repertórios mais sofisticados."),
    ("Estude conectivos básicos e pratique a ligação entre frases e parágrafos.", "Amplie o uso de conectivos variados para melhorar a progressão textual.", "Aprimore a fluidez textual variando mecanismos de coesão."),
    ("Treine a estrutura completa da intervenção: agente, ação, meio, modo e finalidade.", "Detalhe melhor os elementos da intervenção para torná-la mais concreta.", "Aprimore a viabilidade e detalhamento da proposta de intervenção."),
)
#: The two texts stored with an essay; %d is its weakest competency.
STORED_NOTES = {"diagnostico": "A competência %d foi a mais fraca.", "recomendacao": "Treinar mais a competência %d."}
COMPETENCY_NAMES = ("Domínio da norma culta da língua portuguesa", "Compreensão da proposta de redação", "Seleção e organização de argumentos", "Conhecimento dos mecanismos linguísticos", "Proposta de intervenção")


def filled(text: str) -> Column:
    """A text with the columns that it names in their places."""
    parts = re.split(r"\{(\w+)\}", text)
    return F.concat(*(F.col(p).cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts) if p))


def by_score(texts: tuple[tuple[str, str, str], ...], competency: Column, score: Column) -> Column:
    """The text for a competency and its score; empty for other competencies."""
    band = F.when(score <= 80, 0).when(score <= 140, 1).otherwise(2)
    every = F.array(*(F.lit(t) for row in texts for t in row))
    return F.when(competency.between(1, len(texts)), F.get(every, (competency - 1) * 3 + band)).otherwise("")


def competency_name(competency: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, COMPETENCY_NAMES)), competency - 1), F.concat(F.lit("C"), competency.cast("string")))


def hours_text(hours: Column) -> Column:
    """`Xh Ymin`, `Xh` without minutes; halves of a minute go up."""
    whole = F.floor(hours)
    rest = F.floor((hours - whole).cast("decimal(28,12)") * 60 + F.lit(0.5).cast("decimal(2,1)")).cast("int")
    return F.concat(whole.cast("string"), F.lit("h"), F.when(rest == 0, "").otherwise(F.concat(F.lit(" "), rest.cast("string"), F.lit("min"))))


#: Fixed value: where a joined text is parted.
PARTED = r"\r?\n|(?:^|\s)[•\-▸·]\s+"


def points(text: Column) -> Column:
    """A joined text's points: parted at line ends and bullets, trimmed, without empty ones. Null: none."""
    blank = r"^\s+|\s+$"
    trimmed = F.transform(F.split(F.regexp_replace(text, blank, ""), PARTED), lambda p: F.regexp_replace(p, blank, ""))
    return F.coalesce(F.filter(trimmed, lambda p: p != ""), F.array().cast("array<string>"))


def month_label(month: Column | str) -> Column:
    return F.date_format(month, "MMMM/yyyy")
