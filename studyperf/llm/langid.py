"""Language identification by prediction by partial matching (PPM).

For each language a context tree counts which byte follows which contexts of up to ORDER bytes. A text's code length under a language is
the sum over its bytes of -log2 p, where p comes from the longest context seen in that language, with an escape to the next
shorter one for each order in which the byte was not seen (method C: with n counts of d distinct bytes, a byte seen c times has
c / (n + d), the escape d / (n + d)), and from 1 / 256 below order 0. The counts are frozen after training, so each context and byte has one fixed cost and a text's code length is exact.

Training takes a sample of at most about SAMPLE documents a language, chosen by a hash of their ids; its counts are summed by Spark. A document is
scored where it is. `und`: null text, or a text without letters. Null and repeated ids matter to nothing but the choice of the sample. With no training documents every language is `und`. Long texts are scored whole, in chunks; languages that fit alike: the first by name. Repeated rows are scored alike, and count as often in training; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_ids, identified, small_batches

ORDER = 3
SAMPLE = 3000
CHUNK = 1 << 20
LETTER = regex.compile(r"\p{L}")


def _grams(data: bytes, order: int) -> np.ndarray:
    """For each byte: it in the low byte, the bytes before it above, as an unsigned integer; byte i has no more than i before it."""
    x = np.frombuffer(data, np.uint8).astype(np.uint64)
    out = x.copy()
    for k in range(1, order + 1):
        out[k:] |= x[:-k] << np.uint64(8 * k)
    return out


def sampled(docs: DataFrame, by: str, most: int, key: str = "doc_id") -> DataFrame:
    """About `most` rows of each value of `by`, chosen by a hash of the key: the same ones on every run and in every layout."""
    shares = {r[0]: min(1.0, most / r[1]) for r in docs.groupBy(by).count().collect() if r[0] is not None}
    if not shares:
        return docs.limit(0)
    share = F.create_map(*(x for k, v in shares.items() for x in (F.lit(k), F.lit(v))))[F.col(by)]
    return docs.where(F.col(by).isNotNull() & (F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1_000_000)) < share * 1_000_000))


def gram_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, length (of the context), gram and n, summed over all documents given."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, group in batch.groupby("lang"):
                for length in range(order + 1):
                    mask = np.uint64((1 << 8 * (length + 1)) - 1)
                    parts = [_grams(t.encode(), length)[length:] & mask for t in group["text"] if t and len(t.encode()) > length]
                    if parts:
                        grams, n = np.unique(np.concatenate(parts), return_counts=True)
                        yield pd.DataFrame({"lang": lang, "length": length, "gram": grams.astype(np.int64), "n": n})

    return docs.select("lang", "text").mapInPandas(counted, "lang string, length int, gram long, n long").groupBy("lang", "length", "gram").agg(F.sum("n").alias("n"))


class ContextTrees:
    """All languages' frozen costs: a state for each context seen in any of them, a cost for each state, byte and language."""

    def __init__(self, counts: pd.DataFrame, order: int = ORDER):
        self.order, self.langs = order, sorted(counts["lang"].unique())
        seen = np.unique(counts["gram"].to_numpy(np.int64)[counts["length"].to_numpy() == 0])
        #: Bytes unseen in training all behave alike, as one more symbol.
        self.symbol = np.full(256, len(seen), np.int64)
        self.symbol[seen] = np.arange(len(seen))
        size = self.size = len(seen) + 1
        longest = np.zeros(1, np.int64)
        #: In the order of their lengths: state of the context of that length, by its symbols; the empty one is state 0.
        self.state = [longest]
        costs = np.full((1, size, len(self.langs)), 8.0, np.float32)
        below = costs
        rows = [None] * (order + 1)
        total = 1
        for length in range(order + 1):
            own = counts[counts["length"] == length]
            gram = own["gram"].to_numpy(np.int64)
            context = np.zeros(len(gram), np.int64)
            for k in range(length, 0, -1):
                context = context * size + self.symbol[gram >> 8 * k & 255]
            if length:
                keys = np.unique(context)
                # a context never seen counts as its longest seen suffix
                table = np.tile(self.state[length - 1], size) if size**length <= 1 << 25 else None
                if table is None:
                    raise ValueError("too many distinct bytes for this order")
                shorter = self.state[length - 1][keys % size ** (length - 1)]
                table[keys] = total + np.arange(len(keys))
                self.state.append(table)
                total += len(keys)
                at, below = np.searchsorted(keys, context), self.costs[shorter]
            else:
                at, keys = context, np.zeros(1, np.int64)
            n = np.zeros((len(keys), size, len(self.langs)), np.float32)
            lang = np.searchsorted(self.langs, own["lang"].to_numpy())
            n[at, self.symbol[gram & 255], lang] = own["n"].to_numpy()
            distinct, sums = (n > 0).sum(1, keepdims=True), n.sum(1, keepdims=True)
            with np.errstate(divide="ignore", invalid="ignore"):
                known = -np.log2(n / (sums + distinct))
                escape = np.where(sums > 0, -np.log2(distinct / (sums + distinct)), 0)
            made = np.where(n > 0, known, below + escape).astype(np.float32)
            self.costs = made if not length else np.concatenate([self.costs, made])

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language."""
        out = np.zeros((len(texts), len(self.langs)))
        held: list[tuple[int, bytes]] = []
        size = 0
        for i, text in enumerate(texts):
            for at in range(0, len(text), CHUNK):
                head = max(0, at - self.order)  # a later piece begins with its context
                held.append((i, text[head : at + CHUNK], at - head))
                size += len(held[-1][1])
                if size >= CHUNK:
                    self._add(out, held)
                    held, size = [], 0
        self._add(out, held)
        return out

    def _add(self, out: np.ndarray, held: list[tuple]) -> None:
        if not held:
            return
        x = self.symbol[np.frombuffer(b"".join(piece for _, piece, _ in held), np.uint8)]
        starts = np.cumsum([0, *(len(piece) for _, piece, _ in held)])
        state = np.zeros(len(x), np.int64)
        context = np.zeros(len(x), np.int64)
        since = np.arange(len(x)) - np.repeat(starts[:-1], np.diff(starts))
        for k in range(1, self.order + 1):
            context[k:] += x[:-k] * self.size ** (k - 1)
            have = since >= k if k < self.order else slice(None)
            if k < self.order:
                short = np.flatnonzero(since == k)
                state[short] = self.state[k][context[short]]
            else:
                full = np.flatnonzero(since >= k)
                state[full] = self.state[k][context[full]]
        each = self.costs.reshape(-1, len(self.langs))[state * self.size + x]
        head = np.array([h for _, _, h in held])
        for at in np.flatnonzero(head):
            each[starts[at] : starts[at] + head[at]] = 0
        np.add.at(out, [i for i, _, _ in held], np.add.reduceat(each, starts[:-1], axis=0, dtype=np.float64))


def train(docs: DataFrame, order: int = ORDER, sample: int = SAMPLE) -> ContextTrees | None:
    """The trees of the languages in docs (lang, text, doc_id); None without any text."""
    counts = gram_counts(sampled(docs, "lang", sample), order).toPandas()  # bounded by languages times contexts of a few bytes
    return ContextTrees(counts, order) if len(counts) else None


def identify(docs: DataFrame, trees: ContextTrees | None) -> DataFrame:
    """doc_id, lang_pred, score (the language's share of the probability, all languages alike beforehand) and bits_per_byte."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees = shared.value
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            known = np.array([trees is not None and LETTER.search(t) is not None for t in texts], bool)
            lang, score, bits = np.full(len(texts), "und", object), np.zeros(len(texts)), np.zeros(len(texts))
            if known.any():
                data = [t.encode() for t, k in zip(texts, known) if k]
                lengths = trees.lengths(data)
                best = lengths.argmin(1)
                least = lengths[np.arange(len(data)), best]
                lang[known] = np.array(trees.langs, object)[best]
                score[known] = 1 / np.exp2(np.maximum(least[:, None] - lengths, -1000)).sum(1)
                bits[known] = least / [len(d) for d in data]
            yield pd.DataFrame({"doc_id": doc_ids(batch), "lang_pred": lang, "score": score, "bits_per_byte": bits})

    return identified(docs, "text").mapInPandas(scored, "doc_id long, lang_pred string, score double, bits_per_byte double")
