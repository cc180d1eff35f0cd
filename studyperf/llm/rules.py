"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule is a name and a condition on a text's measures. On a sample each rule's cost (seconds a row, its measures included, an empty job's time taken off) and selectivity (share of rows it rejects) are estimated; the
rules then stand in a CASE expression in the order of rejections per cost. In `selected` the measures stand inside the CASE, so that a row which an early rule rejects never computes what only later rules need. `judged` also returns all
measures of all rows, so there the order saves nothing. The order never changes which rows are kept, only which rule is named as the reason. Ties in the order go by the rules' names; without rows or rejections the order means nothing.

Null and empty texts have zeros for all measures; long texts are read whole. Five-word windows are compared by 64-bit hashes within one text. Repeated rows are judged alike; columns of the input stay unless they are named like a measure. An empty table gives an empty result.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, stored, whole_text

WINDOW = 5
SAMPLE = 2000
SYMBOLS = r"[^#*$%&|<>]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def repeat_words(w: Column, window: int = WINDOW) -> Column:
    """The number of words in windows that occur twice or more."""

    def covered(places: Column) -> Column:
        overlaps = F.transform(places, lambda p, i: F.greatest(F.lit(0), window - (p - F.coalesce(F.get(places, i - 1), p - window))))
        return window * F.size(places) - F.aggregate(overlaps, F.lit(0), lambda a, x: a + x)

    def places(ordered: Column) -> Column:
        same = lambda x, i, d: F.coalesce(F.get(ordered, i + d)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(ordered, lambda x, i: same(x, i, -1) | same(x, i, 1)), lambda x: x["i"]))

    def of(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(ordered, lambda o: let(places(o), covered)))

    hashes = let(w, lambda a: F.transform(F.sequence(F.lit(0), F.size(a) - window), lambda i: F.xxhash64(*(F.get(a, i + k) for k in range(window)))))
    return F.when(F.size(w) < window + 1, 0).otherwise(let(hashes, of)).cast("long")


def _inline(text: Column) -> dict[str, Column]:
    """The measures of a text, each as an expression of its own."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return _measures(t, words(t), lines)


def _measures(t: Column, w: Column, lines: Column) -> dict[str, Column]:
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(t, SYMBOLS, "")).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeat_words(w),
        "n_upper": F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")),
        "n_letters": F.length(F.regexp_replace(t, r"[^\p{L}]+", "")),
    }


#: The measures that judged() returns.
RETURNED = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """fails: from the measures by name to the condition under which a text is rejected."""

    name: str
    fails: Callable[[dict[str, Column]], Column]


#: The first two are the base; the others leave room above what ordinary prose has.
def default_rules() -> list[Rule]:
    return [
        Rule("few_words", lambda m: m["n_words"] < 10),
        Rule("repeats", lambda m: 100 * m["n_repeat_words"] > 20 * m["n_words"]),
        Rule("symbols", lambda m: 10 * m["n_symbols"] > 3 * m["n_words"]),
        Rule("same_lines", lambda m: 10 * m["n_dup_lines"] > 3 * m["n_lines"]),
        Rule("long_words", lambda m: m["word_chars"] > 20 * m["n_words"]),
        Rule("capitals", lambda m: 2 * m["n_upper"] > m["n_letters"]),
    ]


def estimated(sample: DataFrame, rules: list[Rule]) -> list[tuple[Rule, float, float]]:
    """The rules with their seconds a row and rejected share. sample is small and stored; each job runs twice, and the faster run counts."""
    rows = sample.count()

    def timed(condition: Column) -> tuple[float, int]:
        best = float("inf")
        for _ in range(2):
            began = time.perf_counter()
            rejected = sample.agg(F.sum(condition.cast("long")).alias("n")).first()["n"] or 0
            best = min(best, time.perf_counter() - began)
        return best, rejected

    empty, _ = timed(F.col("text").isNull())
    out = []
    for rule in rules if rows else ():
        seconds, rejected = timed(rule.fails(_inline(F.col("text"))))
        out.append((rule, max(seconds - empty, 1e-4) / rows, rejected / rows))
    return out or [(rule, 0.0, 0.0) for rule in rules]


def by_worth(estimates: list[tuple[Rule, float, float]]) -> list[Rule]:
    """The rules by rejections per cost."""
    return [rule for rule, seconds, share in sorted(estimates, key=lambda x: (-x[2] / max(x[1], 1e-12), x[0].name))]


def ordered(docs: DataFrame, rules: list[Rule] | None = None, sample: int = SAMPLE) -> list[Rule]:
    """The rules in the order of the cascade for docs, from about `sample` of their rows."""
    share = min(1.0, sample / max(docs.count(), 1))
    few = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < share * 1_000_000).select("text")  # by id too: copies are sampled apart
    return by_worth(estimated(stored(few, "rules-sample"), rules or default_rules()))


def cascade(rules: list[Rule], measures: dict[str, Column]) -> Column:
    """The name of the first rule that rejects, or null."""
    out = F
    for rule in rules:
        out = out.when(rule.fails(measures), rule.name)
    return out


def judged(docs: DataFrame, rules: list[Rule] | None = None, sample: int = SAMPLE) -> DataFrame:
    """docs with the measures, base_failed, kept and failed_rule (null if kept)."""
    t, w, lines = F.col("__text"), F.col("__words"), F.col("__lines")
    prepared = docs.withColumn("__text", whole_text()).withColumn("__words", words(t)).withColumn("__lines", F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    own = _measures(t, w, lines)
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (
        prepared.withColumns({name: own[name] for name in RETURNED})
        .withColumn("base_failed", base)
        .withColumn("failed_rule", cascade(ordered(docs, rules, sample), {name: F.col(name) if name in RETURNED else own[name] for name in own}))
        .withColumn("kept", F.col("failed_rule").isNull())
        .drop("__text", "__words", "__lines")
    )


def selected(docs: DataFrame, rules: list[Rule] | None = None, sample: int = SAMPLE) -> DataFrame:
    """The documents that all rules let pass, with their own columns. A row computes no more than the rules up to the first that rejects it need."""
    return docs.where(cascade(ordered(docs, rules, sample), _inline(F.col("text"))).isNull())
