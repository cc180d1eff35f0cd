"""Spelling variants: words one edit (a code point inserted, deleted or replaced) from each other, and the more frequent form of each.

A word's form is the near word of largest n, if that n is at least RATIO times its own; roots follow forms to the last. Near words are found in sorted lists, one for each half word: two words one edit apart share their first or their
last half, so each word goes into the lists of its halves, with what it has besides. A list is scanned for all its words at once, depth by depth: the rows of the edit matrix, banded to three cells, are kept for each range of words with
one prefix, which the longest common prefixes of neighbours delimit, and a range whose prefix exceeds one edit is left. Each pair is looked for once, from the earlier word on.

A half that more than GROUP words share is dealt again by halves of what they have besides, until lists are short or what is left has one code point or two (then the alphabet bounds them), so no task holds a long list and no pair is lost.

Words are the runs of letters of whole texts, A-Z lower-cased, of at least LEAST code points and TWICE occurrences. For each run of a document the crc32 of `<doc_id>:<run>` decides whether, and where, one code point is left out of it (see
`vocabulary`). Null texts have no words; a null id counts as an empty one. Repeated rows count each time; ties go to the smaller word in code-point order. Very long words are compared whole. Columns other than doc_id and text are
ignored. A table without words gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, whole_text

LETTERS = r"([A-Za-zÀ-ÿ]+)"
LEAST, TWICE, RATIO, EVERY = 7, 2, 10, 31
#: Words of a list, words that are asked at once, and the depth from which what is left is compared directly.
GROUP, ASKED, DEEP = 512, 4096, 64


def vocabulary(docs: DataFrame, least: int = LEAST, twice: int = TWICE, every: int = EVERY) -> DataFrame:
    """word and n, its occurrences in all texts. Where `every` divides a run's hash h, the run's code point h % length is left out."""
    low = F.translate(whole_text(), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    id_ = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    runs = docs.select(id_.alias("id"), F.explode(F.regexp_extract_all(low, F.lit(LETTERS), F.lit(1))).alias("run")).where(F.length("run") >= least)
    hashed = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % every == 0, cut).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= twice)


def _halves(key: Column, c: Column, rest: Column) -> Column:
    """The lists of words with `c` or c + 1 code points left: by the first half of c, and by the last."""
    half = (c / 2).cast("int")
    last = c - half
    ahead = F.length(rest) - last
    first = F.struct(F.concat(key, F.lit("|0:"), F.substring(rest, F.lit(1), half)).alias("key"), last.alias("c"), F.substring(rest, half + 1, F.length(rest)).alias("rest"))
    second = F.struct(F.concat(key, F.lit("|1:"), F.substring(rest, ahead + 1, last)).alias("key"), half.alias("c"), F.substring(rest, F.lit(1), ahead).alias("rest"))
    return F.array(first, second)


def _layout(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All code points with -1 before and twice after each word, where each word starts, and their lengths."""
    sizes = np.array([len(w) for w in words], np.int64)
    start = np.cumsum(sizes + 3) - sizes - 2
    flat = np.full(int(sizes.sum()) + 3 * len(words), -1, np.int32)
    inside = np.repeat(start - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    flat[inside] = np.frombuffer("".join(words).encode("utf-32-le"), np.int32)
    return flat, start, sizes


def _common(flat: np.ndarray, start: np.ndarray, sizes: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The common prefix of each word with the one before, up to DEEP; -1 at the start of a list."""
    out = np.where(np.diff(group, prepend=group[:1] - 1) == 0, 0, -1)
    alive = np.flatnonzero(out == 0)
    for d in range(DEEP):
        alive = alive[(sizes[alive] > d) & (sizes[alive - 1] > d)]
        alive = alive[flat[start[alive] + d] == flat[start[alive - 1] + d]]
        if not len(alive):
            break
        out[alive] = d + 1
    return out


def one_edit(a: str, b: str) -> bool:
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return a != b and (a[low + 1 :] == b[low + 1 :] or a[low:] == b[low + 1 :] or a[low + 1 :] == b[low:])


def near_pairs(words: list[str], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places i < j of the words of one list that are one edit apart. words are distinct in each list and sorted in it; group numbers the lists in order."""
    flat, start, sizes = _layout(words)
    common = _common(flat, start, sizes, group)
    end, found = np.searchsorted(group, group, "right"), [(np.empty(0, np.int64),) * 2]
    begins = {d: np.flatnonzero(common <= d) for d in range(min(int(common.max(initial=0)), DEEP) + 1)}
    most = max(begins)
    for at in range(0, len(words), ASKED):
        q = np.arange(at, min(at + ASKED, len(words)))
        low, high = q + 1, end[q]
        rows = np.tile(np.array([2, 0, 1], np.int8)[:, None], len(q))  # of j = d - 1, d and d + 1 code points of the word asked
        for d in range(DEEP + 1):
            # the word that ends here is the first of its range
            off = sizes[q] - d
            ends = (low < high) & (sizes[np.minimum(low, len(words) - 1)] == d)
            hit = np.flatnonzero(ends & (np.abs(off) <= 1))
            hit = hit[rows[off[hit] + 1, hit] <= 1]
            found.append((q[hit], low[hit]))
            low = low + ends
            some = low < high
            q, low, high, rows = q[some], low[some], high[some], rows[:, some]
            if not len(q) or d == DEEP:
                break
            # each range parts where a common prefix is no longer than d
            edge = begins[min(d, most)]
            a, z = np.searchsorted(edge, low, "right"), np.searchsorted(edge, high, "left")
            parts = z - a + 1
            of = np.repeat(np.arange(len(q)), parts)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
            place = np.repeat(a, parts) + nth
            first = np.where(nth == 0, low[of], edge[np.maximum(place - 1, 0)])
            last = np.where(nth == parts[of] - 1, high[of], edge[np.minimum(place, len(edge) - 1)])
            q = q[of]
            char, own = flat[start[first] + d], start[q]
            theirs = sizes[q] + 1
            r0, r1, r2 = rows[:, of]
            n0 = np.minimum(r0 + (flat[own + np.minimum(d - 1, theirs)] != char), r1 + 1)
            n1 = np.minimum(np.minimum(r1 + (flat[own + np.minimum(d, theirs)] != char), r2 + 1), n0 + 1)
            n2 = np.minimum(r2 + (flat[own + np.minimum(d + 1, theirs)] != char), n1 + 1)
            alive = np.minimum(np.minimum(n0, n1), n2) <= 1
            q, low, high = q[alive], first[alive], last[alive]
            rows = np.minimum(np.stack([n0[alive], n1[alive], n2[alive]]), 2).astype(np.int8)
        for i, a, z in zip(q, low, high):
            near = [j for j in range(a, z) if one_edit(words[i], words[j])]
            found.append((np.full(len(near), i), np.array(near, np.int64)))
    return tuple(np.concatenate(x) for x in zip(*found))


def _scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of words of one key; rows come sorted by key and rest. A list that a batch cuts is carried over."""

    def pairs(rows: pd.DataFrame) -> pd.DataFrame:
        key, rest = rows["key"].to_numpy(), rows["rest"].tolist()
        i, j = near_pairs(rest, np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])))
        # two words that both have one code point more than c meet among the words of their own length
        longer = rows["rest"].str.len().to_numpy() > rows["c"].to_numpy()
        once = ~(longer[i] & longer[j])
        a, b = rows.iloc[i[once]], rows.iloc[j[once]]
        return pd.DataFrame({"a": a["word"].to_numpy(), "n_a": a["n"].to_numpy(), "b": b["word"].to_numpy(), "n_b": b["n"].to_numpy()})

    held = None
    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        whole = int((rows["key"].to_numpy() != rows["key"].iloc[-1]).sum()) if len(rows) else 0
        if whole:
            yield pairs(rows.iloc[:whole])
        held = rows.iloc[whole:].reset_index(drop=True)
    if held is not None and len(held) > 1:
        yield pairs(held)


def near_words(words: DataFrame) -> DataFrame:
    """a, n_a, b, n_b: each pair of words (word, n) one edit apart, once."""
    size = F.length("word")
    lists = F.concat(*(_halves(c.cast("string"), c, F.col("word")) for c in (size - 1, size)))
    rows, found = words.select("word", "n", F.explode(lists).alias("x")).select("word", "n", "x.*"), []
    while True:
        counted = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
        rows = stored(rows.join(counted, "key"), "lists")
        short = (F.col("size") <= GROUP) | (F.col("c") <= 1)
        sorted_ = rows.where(short).drop("size").repartition("key").sortWithinPartitions("key", "rest")
        found.append(sorted_.mapInPandas(_scanned, "a string, n_a long, b string, n_b long"))
        rows = rows.where(~short)
        if rows.isEmpty():
            break
        rows = rows.select("word", "n", F.explode(_halves(F.col("key"), F.col("c"), F.col("rest"))).alias("x")).select("word", "n", "x.*")
    # a pair whose words share both halves was found twice
    pairs = reduce(DataFrame.union, found).select(F.least("a", "b").alias("a"), F.when(F.col("a") < F.col("b"), F.col("n_a")).otherwise(F.col("n_b")).alias("n_a"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("n_b")).otherwise(F.col("n_a")).alias("n_b"))
    return pairs.distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word and root of the rows (word, form). n grows tenfold with each step, so paths are short; each round doubles what has been followed."""
    out = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = out.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = stored(out.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        out = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return out


def grouped(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, form, root, n_near and form_n of each word (word, n)."""
    pairs = near_words(words)
    end = lambda word, other, m: F.struct(F.col(word).alias("word"), F.col(other).alias("other"), F.col(m).alias("m"))
    both = pairs.select(F.inline(F.array(end("a", "b", "n_b"), end("b", "a", "n_a"))))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("x"))
    held = F.when(-F.col("x.m") >= ratio * F.col("n"), F.col("x"))
    named = stored(words.join(best, "word", "left").select("word", "n", held["other"].alias("form"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), (-held["m"]).alias("form_n")), "forms")
    return named.join(roots(named.where("form is not null")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame) -> DataFrame:
    return grouped(stored(vocabulary(docs), "vocabulary"))
