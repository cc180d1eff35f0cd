"""Secret scans in DataFrame functions only: three patterns, and a battery of randomness tests on long tokens.

The null hypothesis of the battery is ordinary text: words of letters, run together or parted by `+/_-`, in small letters, capitals or with initial capitals, and numbers among them. A token's encoding is inferred from its alphabet: digits,
hexadecimal, base 32, base 36, base 62 or base 64. It says which tests apply and on which symbols. Each gives a normal score whose mean and spread under the null are set on the safe side of what prose shows:

- chi-squared for trend: the letters of the alphabet, pooled in three cells from common to rare, against uniform ones; prose keeps to the common cell (not for hexadecimal, whose letters are another alphabet than prose's);
- runs: how often vowels and consonants take turns; prose alternates more than chance does (not for hexadecimal);
- serial correlation: how often a character's class (small letter, capital, digit) differs from the one before; initial capitals count as small letters. Prose keeps its class.

A fourth score sums those that apply (Stouffer). A token's p-value is four times the least of the four (Bonferroni), which holds whatever their dependence. Tokens of like length form a stratum; within each the Benjamini-Hochberg rule bounds the
share of false discoveries, so that short tokens, which say less, don't weaken the test of long ones. Tests hold p-values of generated prose in seven styles against uniform ones. Numbers alone are ordinary, so random digits are not found; with
fewer than 12 symbols to test, a test says nothing.

Null texts have no spans. Spans count code points, the end exclusive. Texts are scanned whole; a text's cost grows with its length and, but for a logarithm, its matches. Repeated rows are scanned alike; ties in start go by kind; an empty table
gives an empty result; columns of the input may have any names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, whole_text
from .rules import let

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run that is long enough; shorter runs would fail and hide no later match, for a later one in the same run is shorter still.
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
TOKEN = r"[A-Za-z0-9+/_-]{20,}+"
KINDS = ("assign", "access", "hex", "random")
SPAN = "array<struct<start:int,kind:int,end:int>>"
FOUND = "struct<start:int,kind:int,end:int,text:string>"
RATE = 0.01
#: Of ordinary text, on the safe side: how often the class of characters changes (0.07 where a third of the words are numbers, 0.09 where half are); how often vowels and consonants take turns; by how much spreads exceed independent ones.
CHANGE, TURNS, SPREAD = 0.14, 0.53, 1.15
#: Cells of letters, from common ones (0) to rare ones (2) in languages of Latin script; mean and variance of a letter's cell in ordinary text (a uniform one has mean 1.04).
COMMON, MIDDLE, RARE = "aeinorst", "cdfghlmpu", "bjkqvwxyz"
CELL, CELL_VARIANCE = 0.5, 0.45
#: Symbols that a test needs.
LEAST = 12
#: How the mark of byte order looks in UTF-32, where each code point has four bytes.
ORDER = b"\0\0\xfe\xff"


def running(x: Column, join: Callable[[Column, Column], Column], back: bool = True) -> Column:
    """At each place the join of all elements up to it (with back) or from it on, by doubling: n log n steps in all. join meets null beyond the ends."""
    far = lambda k: F.call_function("shiftleft", F.lit(1 if back else -1), k)
    steps = F.filter(F.sequence(F.lit(0), F.lit(29)), lambda k: F.call_function("shiftleft", F.lit(1), k) < F.size(x))
    return F.aggregate(steps, x, lambda a, k: F.transform(a, lambda v, i: join(v, F.get(a, i - far(k)))))


def _found(text: Column, pattern: str, kind: int, good: Callable[[Column], Column] | None = None, group: int | None = None) -> Column:
    """The matches' places, from what lies between matches and the matches themselves; and their texts, or their group's."""

    def placed(between: Column, found: Column, chosen: Column) -> Column:
        ends = running(F.zip_with(F.slice(between, 1, F.size(found)), found, lambda b, m: F.length(b) + F.length(m)), lambda x, y: x + F.coalesce(y, F.lit(0)))
        spans = let(ends, lambda e: F.transform(found, lambda m, i: F.struct((F.get(e, i) - F.length(m)).alias("start"), F.lit(kind).alias("kind"), F.get(e, i).alias("end"), F.get(chosen, i).alias("text")).cast(FOUND)))
        return F.filter(spans, lambda s: good(s["text"])) if good else spans

    def found(m: Column) -> Column:
        chosen = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else m
        return let(F.split(text, pattern), lambda b: let(chosen, lambda c: placed(b, m, c)))

    return F.when(text.rlike(pattern), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), found)).otherwise(F.array().cast(f"array<{FOUND}>"))


def _spans(*args) -> Column:
    return F.transform(_found(*args), lambda s: F.struct(s["start"], s["kind"], s["end"]).cast("struct<start:int,kind:int,end:int>"))


def base_spans(text: Column) -> Column:
    return F.concat(
        _spans(text, ASSIGN, 0, lambda t: F.length(t) >= 6, 2),
        F.when(text.contains("AKIA"), _spans(text, ACCESS, 1)).otherwise(F.array().cast(SPAN)),
        _spans(text, HEX, 2),
    )


def _normal(z: Column) -> Column:
    """The normal distribution function, nearly (Page 1977)."""
    return 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), 1.5976 * z + 0.07056 * z * z * z))))


def battery(token: Column) -> Column:
    """The p-value of a token under the hypothesis that it is ordinary text."""
    pure = F.regexp_replace(F.regexp_replace(token, "(?<![A-Z])[A-Z](?=[a-z])", "a"), "[^A-Za-z0-9]", "")
    classes = F.translate(pure, "ABCDEFGHIJKLMNOPQRSTUVWXYZbcdefghijklmnopqrstuvwxyz123456789", "A" * 26 + "a" * 25 + "0" * 9)
    letters = F.lower(F.regexp_replace(token, "[^A-Za-z]", ""))
    turning = F.translate(letters, "eiouycdfghjklmnpqrstvwxz", "a" * 5 + "b" * 19)
    runs = lambda x: F.length(F.regexp_replace(x, r"(.)\1*", "r")) - 1.0
    encoding = F.when(token.rlike("^[0-9]+$"), "digits").when(token.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), "base 16").when(token.rlike("^[A-Z2-7]+$"), "base 32").when(token.rlike("^(?:[0-9a-z]+|[0-9A-Z]+)$"), "base 36")
    encoding = encoding.when(token.rlike("^[0-9A-Za-z]+$"), "base 62").otherwise("base 64")

    def scores(n: Column, size: Column, kind: Column) -> Column:
        cells = F.length(F.translate(letters, COMMON, "")) + F.length(F.translate(letters, COMMON + MIDDLE, ""))
        trend = (cells - size * CELL) / (SPREAD * F.sqrt(size * CELL_VARIANCE))
        turns = ((size - 1) * TURNS - runs(turning)) / (SPREAD * F.sqrt((size - 1) * TURNS * (1 - TURNS)))
        changes = (runs(classes) - (n - 1) * CHANGE) / (SPREAD * F.sqrt((n - 1) * CHANGE * (1 - CHANGE)))
        prose, serial = ~kind.isin("digits", "base 16") & (size >= LEAST), (kind != "digits") & (n >= LEAST)
        none = F.lit(-9.0)
        together = F.when(prose & serial, (trend + turns + changes) / (SPREAD * F.sqrt(F.lit(3.0))))
        return F.greatest(F.when(prose, F.greatest(trend, turns)).otherwise(none), F.when(serial, changes).otherwise(none), together)

    measures = F.struct(F.length(pure).cast("double").alias("n"), F.length(letters).cast("double").alias("size"), encoding.alias("kind"))
    return F.least(F.lit(1.0), 4 * (1 - _normal(let(measures, lambda x: scores(x["n"], x["size"], x["kind"])))))


def _apart(base: Column, tokens: Column) -> Column:
    """The tokens that no base span touches: none before them reaches into them, and the next one begins beyond them."""

    def free(both: Column) -> Column:
        reach = running(F.transform(both, lambda m: F.when(m["kind"] < 3, m["end"])), F.greatest)
        later = running(F.transform(both, lambda m: F.when(m["kind"] < 3, m["start"])), F.least, back=False)
        alone = lambda m, r, n: (m["kind"] == 3) & (F.coalesce(r, F.lit(0)) <= m["start"]) & F.coalesce(n >= m["end"], F.lit(True))
        return let(reach, lambda r: let(later, lambda n: F.filter(both, lambda m, i: alone(m, F.get(r, i), F.get(n, i)))))

    def among(t: Column) -> Column:
        own = F.transform(base, lambda b: F.struct(b["start"], b["kind"], b["end"], F.lit(None).cast("string").alias("text")).cast(FOUND))
        return F.when((F.size(base) == 0) | (F.size(t) == 0), t).otherwise(let(F.sort_array(F.concat(own, t)), free))

    return let(tokens, among)


def scanned(docs: DataFrame, column: str = "text") -> DataFrame:
    """docs with __base (spans) and __more (spans of candidate tokens outside these, each with its p-value)."""
    text = whole_text(column)
    rated = F.transform(_apart(F.col("__base"), _found(text, TOKEN, 3)), lambda t: F.struct(t["start"], t["kind"], t["end"], battery(t["text"]).alias("p")))
    return docs.withColumn("__base", base_spans(text)).withColumn("__more", rated)


def _stratum(span: Column) -> Column:
    return F.floor(F.log2((span["end"] - span["start"]).cast("double"))).cast("int")


def _grade(span: Column) -> Column:
    """Tenths of powers of ten; the p-value's upper end, so that none passes for smaller than it is."""
    return F.least(F.lit(3000), F.floor(-10 * F.log10(F.greatest(span["p"], F.lit(1e-300))))).cast("int")


def cutoffs(found: DataFrame, rate: float = RATE) -> dict[int, int]:
    """For each stratum of lengths, the least grade that counts as a discovery. The table of grades has a bounded size."""
    spans = found.select(F.explode("__more").alias("s")).groupBy(_stratum(F.col("s")).alias("stratum"), _grade(F.col("s")).alias("grade")).count()
    by: dict[int, dict[int, int]] = {}
    for stratum, grade, n in spans.collect():
        by.setdefault(stratum, {})[grade] = n
    cuts = {}
    for stratum, grades in by.items():
        tested, passed = sum(grades.values()), 0
        for grade in sorted(grades, reverse=True):
            passed += grades[grade]
            if 10 ** (-grade / 10) <= rate * passed / tested:
                cuts[stratum] = grade
    return cuts


def all_spans(cuts: dict[int, int]) -> Column:
    """Base spans and discoveries, by start and kind."""
    passes = lambda s: F.coalesce(F.create_map(*(F.lit(x) for kv in cuts.items() for x in kv))[_stratum(s)] <= _grade(s), F.lit(False)) if cuts else F.lit(False)
    more = F.transform(F.filter("__more", passes), lambda s: F.struct(s["start"], s["kind"], s["end"]))
    return F.sort_array(F.concat("__base", more))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"], s["end"])), ",")


def scan(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base (the base spans, joined) and spans (all)."""
    found = stored(scanned(docs.select("doc_id", "text")).drop("text"), "secrets")
    count = lambda k: F.size(F.filter("__all", lambda s: s["kind"] == k)).cast("long")
    return (
        found.withColumn("__all", all_spans(cutoffs(found, rate)))
        .select("doc_id", *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)), joined(F.sort_array("__base")).alias("base"), joined(F.col("__all")).alias("spans"))
    )


def masked(docs: DataFrame, rate: float = RATE, mask: str = "[SECRET]") -> DataFrame:
    """docs, each secret in its text replaced; n_chars follows, where docs has it. Texts without secrets stay as they are. Each text is scanned once: what was found is stored beside the documents."""
    found = stored(scanned(docs.select(F.struct("*").alias("row")), "row.text"), "scanned")  # in a struct, no column's name meets ours
    text = F.col("row.text")

    def kept(spans: Column, raw: Column) -> Column:
        part = lambda at, n: F.decode(F.concat(F.lit(ORDER), F.substring(raw, 4 * at + 1, 4 * n)), "UTF-32")  # noqa: E731  found at once, as each code point has four bytes
        # apart: overlapping spans are one secret
        parts = lambda past: F.transform(spans, lambda s, i: let(F.coalesce(F.get(past, i - 1), F.lit(0)), lambda at: F.when(s["start"] >= at, F.concat(part(at, s["start"] - at), F.lit(mask))).otherwise(F.lit(""))))
        last = F.array_max(F.transform(spans, lambda x: x["end"]))
        return F.concat(F.array_join(let(running(F.transform(spans, lambda x: x["end"]), F.greatest), parts), ""), let(last, lambda at: part(at, F.length(text) - at)))

    new = let(F.col("__all"), lambda spans: let(F.encode(text, "UTF-32"), lambda raw: kept(spans, raw)))
    out = found.withColumn("__all", all_spans(cutoffs(found, rate))).withColumn("__new", F.when(F.size("__all") > 0, new))
    cells = {"text": F.coalesce("__new", text)}
    if "n_chars" in docs.columns:
        cells["n_chars"] = F.coalesce(F.length("__new").cast(docs.schema["n_chars"].dataType), F.col("row")["n_chars"])
    return out.select(*(cells.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
