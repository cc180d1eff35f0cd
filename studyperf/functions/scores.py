"""Scores and classes as column expressions.

Rounding: halves go up, on the value's first twelve decimals; where the value is a tie, this may differ by one unit from rounding to even on binary fractions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds a question at which speed counts fully, and not at all.
FAST, SLOW = 120.0, 300.0
CARELESS = ("DISTRACAO", "PRESSA")
CONCEPTUAL = ("CONCEITO", "CALCULO")
#: Hours and questions to reach, by period.
GOALS = {"semana": (22, 350), "mes": (88, 1400)}
YEAR_GOAL = (1056, 16800)
#: Exclusive upper totals of an essay's bands; beyond the last: excelente.
ESSAY_BANDS = ((400, "critica"), (600, "fraca"), (700, "regular"), (800, "boa"), (900, "muito_boa"))
WEEKDAYS = ("Segunda", "Terça", "Quarta", "Quinta", "Sexta", "Sábado", "Domingo")
COMPETENCIES = tuple(f"competencia{k}" for k in range(1, 6))


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rounded(x: Column, digits: int) -> Column:
    return F.round(x.cast("decimal(28,12)"), digits).cast("double")


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(col(a).cast("double"), col(b).cast("double")), F.lit(0.0))


def pct(a: Column | str, b: Column | str, digits: int = 2) -> Column:
    return rounded(ratio(a, b) * 100, digits)


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def normalised(x: Column | str, least: Column | str, most: Column | str) -> Column:
    """The place of x between two ends; 0 where they are equal."""
    return ratio(col(x) - col(least), col(most) - col(least))


def speed(seconds: Column | str, questions: Column | str) -> Column:
    return clamp((SLOW - ratio(seconds, questions)) / (SLOW - FAST))


def block_ipr(hits="total_acertos", questions="total_questoes", seconds="tempo_total_segundos", difficulty="dificuldade", careless="erros_criticos") -> Column:
    """0 to 1, four decimals, as a decimal so that sums don't depend on their order."""
    score = ratio(hits, questions) * 0.6 + speed(seconds, questions) * 0.2 + col(difficulty) / 5 * 0.2 - F.coalesce(col(careless), F.lit(0)) * 0.01
    return F.when(col(questions) <= 0, 0).otherwise(rounded(clamp(score), 4)).cast("decimal(6,4)")


def mock_ipr(hits="total_acertos", questions="total_questoes", seconds="tempo_total_segundos", anxiety="nivel_ansiedade", fatigue="nivel_fadiga", sleep="qualidade_sono") -> Column:
    zero = lambda c: F.coalesce(col(c), F.lit(0))
    score = ratio(hits, questions) * 0.7 + speed(seconds, questions) * 0.3 - (zero(anxiety) + zero(fatigue) - zero(sleep)) * 0.01
    return F.when(col(questions) <= 0, 0).otherwise(rounded(clamp(score), 4)).cast("decimal(6,4)")


def mean(total: Column | str, n: Column | str, digits: int) -> Column:
    """total / n, null without rows."""
    return rounded(F.try_divide(col(total).cast("double"), col(n).cast("double")), digits)


def blend(blocks: Column, mocks: Column, digits: int = 4) -> Column:
    """Of mean block and mock scores; mocks count for three tenths where there are any above 0."""
    blocks, mocks = F.coalesce(blocks, F.lit(0.0)), F.coalesce(mocks, F.lit(0.0))
    return rounded(F.when(mocks > 0, blocks * 0.7 + mocks * 0.3).otherwise(blocks), digits)


def trend(now: Column, before: Column) -> Column:
    change = F.try_divide(now - before, before)
    return F.when(before == 0, "ESTÁVEL").when(change > 0.05, "ASCENDENTE").when(change < -0.05, "DECLÍNIO").otherwise("ESTÁVEL")


def goal_status(value: Column, goal: float) -> Column:
    return F.when(value < goal, "ABAIXO").when(value > goal, "ACIMA").otherwise("DENTRO")


def mission_status(ipr: Column, hours: Column, questions: Column, direction: Column) -> Column:
    points = (
        F.when(ipr >= 0.75, 3).when(ipr >= 0.70, 2).when(ipr >= 0.60, 1).otherwise(0)
        + F.when(hours != "ABAIXO", 2).otherwise(0)
        + F.when(questions != "ABAIXO", 2).otherwise(0)
        + F.when(direction == "ASCENDENTE", 2).when(direction == "ESTÁVEL", 1).otherwise(0)
    )
    return F.when((ipr >= 0.70) & (points >= 6), "CUMPRIDA").when(points >= 5, "PARCIAL").otherwise("INSUFICIENTE")


def graded(x: Column, names: tuple[str, str, str, str], cuts: tuple[float, float, float] = (0.60, 0.70, 0.80)) -> Column:
    return F.when(x < cuts[0], names[0]).when(x < cuts[1], names[1]).when(x < cuts[2], names[2]).otherwise(names[3])


def topic_status(ipr: Column) -> Column:
    return graded(ipr, ("CRÍTICO", "FRACO", "REGULAR", "BOM"))


def subject_status(ipr: Column) -> Column:
    return graded(ipr, ("CRÍTICA", "FRACA", "REGULAR", "BOA"))


def consistency_class(score: Column) -> Column:
    return graded(score, ("IRREGULAR", "REGULAR", "BOA", "EXCELENTE"), (50, 70, 85))


def weight_balance(share: Column, weight: Column) -> Column:
    r = F.try_divide(share, weight * 10)
    return F.when(weight <= 0, "SEM_PESO_DEFINIDO").when(r < 0.7, "SUBINVESTIDA").when(r > 1.4, "SUPERINVESTIDA").otherwise("EQUILIBRADA")


def essay_total() -> Column:
    return sum((F.col(c) for c in COMPETENCIES[1:]), F.col(COMPETENCIES[0]))


def weakest_competency() -> Column:
    all_ = F.array(*COMPETENCIES)
    return F.array_position(all_, F.array_min(all_)).cast("int")


def essay_band(total: Column) -> Column:
    out = F
    for most, name in ESSAY_BANDS:
        out = out.when(total < most, name)
    return out.otherwise("excelente")


#: Stored band, shown name, shown range of scores.
BAND_LABELS = (
    ("critica", "Crítica", "< 400"),
    ("fraca", "Fraca", "400–599"),
    ("regular", "Regular", "600–699"),
    ("boa", "Boa", "700–799"),
    ("muito_boa", "Muito Boa", "800–899"),
    ("excelente", "Excelente", "≥ 900"),
)


def band_label(band: Column) -> tuple[Column, Column]:
    """The name and the range shown for a stored band, read without case and outer blanks; a dash and nothing for any other."""
    key = F.lower(F.trim(band))
    names = ranges = F
    for stored, name, span in BAND_LABELS:
        names, ranges = names.when(key == stored, name), ranges.when(key == stored, span)
    return names.otherwise("—"), ranges.otherwise("")


def essay_level(average: Column) -> Column:
    return F.when(average >= 900, "Elite").when(average >= 800, "Avançado").when(average >= 600, "Intermediário").when(average >= 400, "Básico").otherwise("Iniciante")


def variation(now: Column, before: Column) -> tuple[Column, Column]:
    return rounded(now - before, 2), F.when(before == 0, 0.0).otherwise(rounded(F.try_divide(now - before, before) * 100, 1))


def arrow(change: Column) -> Column:
    text = F.concat(change.cast("decimal(20,1)").cast("string"), F.lit("%"))
    return F.when(change > 5, F.concat(F.lit("↑ +"), text)).when(change < -5, F.concat(F.lit("↓ "), text)).otherwise(F.concat(F.lit("→ "), text))


def weekday_name(day: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.weekday(day) + 1)
