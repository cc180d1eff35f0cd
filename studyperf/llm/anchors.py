"""Finding what recurs in a corpus without moving the corpus: window minimisers as anchors.

Each window of a fixed number of units (words, bytes) has an anchor: the least hash of the grams within it, at the first place in the window that has it. Equal windows have equal anchors at equal places. A window also has a key: the
hash of the longer gram that begins with the anchor, or ends with it if the anchor lies in the window's right half; so it lies within the window too, and equal windows have equal keys. A maximal run of windows with one place of their anchor is a stretch.

Hashes only choose candidates. What goes is decided by the caller's method on the texts themselves:

1. `recurring` counts the keys (packed, by slices of their range) and keeps those that occur twice or more in a bitmap of a bounded size. With ever more of them the bitmap gets denser and lets more pass that don't recur;
   no recurring one is ever missed.
2. `whole_pieces` scans the documents again and sends stretches whose keys are in the bitmap, as pieces of text, to where pieces with the same text meet. The method finds what occurs several times; all but the first go.
   Each worker does this with its own pieces first, so a text goes out once for many documents that share it. What stays is cut up by keys.
3. `several` looks for keys that still have several different pieces, as at a passage's ends, by a second bitmap, and `windows_apart` lets the method find the single windows that these share. Pieces of keys with very many of them are
   dealt out window by window.

Pieces travel in compressed packs: one for each worker's portion and slice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import identified, small_batches, stored, whole_text

#: The bitmap has at most 2 ** MOST_BITS bits (64 MB).
LEAST_BITS, MOST_BITS = 23, 29
#: Units that are scanned at once; longer documents are scanned in parts that overlap by a window less one.
CHUNK = 1 << 16
#: Keys that a worker gathers before it sends them on; bytes of pieces that it gathers before it compares them and sends them on; bytes that the method gets at once.
FLUSH, HELD, BYTES = 1 << 19, 4 << 20, 1 << 20
#: Bytes of flags, unpacked, that a worker deals out at once.
SPANS = 16 << 20
#: Bytes of all documents' texts for each slice that pieces are dealt to.
SLICE = 2 << 20
#: Keys with more different pieces than this are crowded: their windows are dealt out one by one.
CROWD = 1000
#: Up to so many crowded keys are broadcast (8 bytes each).
MOST_CROWDS = 1 << 20
#: Low bits of a gram's hash that give way to its place.
PLACE = np.uint64((1 << 20) - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(29))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


#: For pieces of text (their groups, of which equal ones have the same; windows; texts): where passages that occur several times are, as found by the method: arrays of piece, first window in it, number of windows, and the passage's number.
#: With `windows` single windows count as passages too, else whole pieces alone need to.
Locate = Callable[[np.ndarray, np.ndarray, list[bytes], bool], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Kind:
    """How texts become units: the window and the gram in units, the functions that split a text, hash the units of many joined texts and join units; and the method."""

    window: int
    gram: int
    split: Callable[[bytes], object]
    units: Callable[[list], np.ndarray]
    join: Callable[[object], bytes]
    locate: Locate
    #: Whether a recurrence within one document counts.
    within: bool


BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, modulo 2 ** 64."""
    if len(_powers[0]) <= n:
        with np.errstate(over="ignore"):
            for k, b in enumerate((BASE, INVERSE)):
                _powers[k] = np.cumprod(np.append(np.uint64(1), np.full(n + n // 4, b, np.uint64)), dtype=np.uint64)
    return _powers[0], _powers[1]


class Prefixes:
    """Polynomial hashes of all prefixes of a row of units, from which any range's hash comes in one step."""

    def __init__(self, units: np.ndarray):
        self.sums = np.zeros(len(units) + 1, np.uint64)
        up, self.down = powers(len(units))
        with np.errstate(over="ignore"):
            np.cumsum(units * up[: len(units)], out=self.sums[1:])

    def of(self, start: np.ndarray, size) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[start + size] - self.sums[start]) * self.down[start]

    def grams(self, size: int) -> np.ndarray:
        """Hashes of all grams of a size."""
        with np.errstate(over="ignore"):
            return mixed((self.sums[size:] - self.sums[:-size]) * self.down[: len(self.sums) - size])


def runs(kind: Kind, parts: list) -> tuple[np.ndarray, ...]:
    """Of joined parts of documents: maximal runs of windows with one place of their anchor and one key. Of each the part, first window (in the part), number of windows, anchor, its place, key."""
    lengths = np.array([len(p) for p in parts])
    ends = np.cumsum(lengths)
    starts, total = ends - lengths, int(lengths.sum())
    none = np.zeros(0, np.int64)
    first = none
    if total >= kind.window:
        first = np.flatnonzero((np.repeat(ends, lengths) - np.arange(total))[: total - kind.window + 1] >= kind.window)
    if not len(first):
        return none, none, none, none.astype(np.uint64), none, none.astype(np.uint64)
    prefixes = Prefixes(kind.units(parts))
    grams = prefixes.grams(kind.gram)
    least = sliding_min((grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64), kind.window - kind.gram + 1)[first]
    place = (least & PLACE).astype(np.int64)
    slack = kind.window - kind.gram
    half = slack // 2
    left = place - first >= half
    new = np.ones(len(first), bool)
    new[1:] = (least[1:] != least[:-1]) | (left[1:] != left[:-1]) | (first[1:] != first[:-1] + 1)
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(first)))
    begin, place, left = first[at], place[at], left[at]
    key = prefixes.of(np.where(left, place - half, place), np.where(left, kind.gram + half, kind.gram + slack - half + 1))
    part = np.searchsorted(ends, begin, "right")
    # least hashes crowd at the low end; mixed again, they spread evenly over slices and bitmaps
    return part, begin - starts[part], n, mixed(least[at] >> np.uint64(20)), place, mixed(key + left)


def encoded(text: str | None) -> bytes:
    return (text or "").encode()


def pieces(kind: Kind, texts: Iterator[bytes]) -> Iterator[tuple[list, list[tuple[int, int]]]]:
    """Splits texts and yields parts of about CHUNK units together, with each part's text number and offset."""
    held, where, size = [], [], 0
    for i, text in enumerate(texts):
        units = kind.split(text)
        for at in range(0, max(1, len(units) - kind.window + 1), CHUNK):
            part = units[at : at + CHUNK + kind.window - 1]
            held.append(part)
            where.append((i, at))
            size += len(part)
            if size >= CHUNK:
                yield held, where
                held, where, size = [], [], 0
    if held:
        yield held, where


def slices_of(spark: SparkSession) -> int:
    """Into how many slices hashes are dealt: a power of two, with the cluster's number of partitions."""
    return 1 << max(6, (2 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())


def _packed(slices: int, keys: np.ndarray, repeated: np.ndarray) -> pd.DataFrame:
    """Sorted distinct keys, in slices of their range, 32 bits each; repeated: those that already recur."""
    bits = slices.bit_length() - 1

    def cut(x: np.ndarray) -> list[bytes]:
        edges = np.searchsorted(x >> np.uint64(64 - bits), np.arange(slices + 1))
        low = ((x >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype("<u4")
        return [low[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])]

    out = pd.DataFrame({"slice": np.arange(slices), "once": cut(keys), "again": cut(repeated)})
    return out[out["once"].str.len() > 0]


KEYS = "slice int, once binary, again binary"


def bitmap(keys: DataFrame, slices: int) -> tuple[int, bytes]:
    """The number of bits and the bitmap, by the hash's upper bits, of the keys (columns KEYS) that occur twice or more."""

    def met(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        values, n = np.unique(np.frombuffer(b"".join(group["once"]), "<u4"), return_counts=True)
        out = np.union1d(values[n > 1], np.frombuffer(b"".join(group["again"]), "<u4")).astype("<u4")
        return pd.DataFrame({"slice": [key[0]], "n": [len(out)], "found": [out.tobytes()]})

    found = stored(keys.groupBy("slice").applyInPandas(met, "slice int, n long, found binary"), "anchors")
    total = found.agg(F.sum("n")).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * total).bit_length()))
    own = bits - (slices.bit_length() - 1)

    def mapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            maps = []
            for data in batch["found"]:
                flags = np.zeros(1 << own, bool)
                flags[np.frombuffer(data, "<u4") >> np.uint32(32 - own)] = True
                maps.append(np.packbits(flags, bitorder="little").tobytes())
            yield pd.DataFrame({"slice": batch["slice"], "bits": maps})

    whole, width = np.zeros(1 << bits - 3, np.uint8), 1 << own - 3
    for row in found.select("slice", "found").mapInPandas(mapped, "slice int, bits binary").toLocalIterator():  # together as large as the bitmap
        whole[row["slice"] * width : (row["slice"] + 1) * width] = np.frombuffer(row["bits"], np.uint8)
    return bits, whole.tobytes()


def recurring(docs: DataFrame, kind: Kind) -> tuple[int, bytes]:
    """The bitmap of the keys that recur: in several documents, or within one where that counts."""
    slices = slices_of(docs.sparkSession)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, size = [], 0

        def flush() -> pd.DataFrame:
            values, n = np.unique(np.concatenate(keys), return_counts=True)
            return _packed(slices, values, values[n > 1])

        for batch in batches:
            for parts, where in pieces(kind, map(encoded, batch["text"])):
                part, *_, key = runs(kind, parts)
                if not kind.within:  # once for each document
                    doc = np.array([i for i, _ in where])[part]
                    order = np.lexsort((doc, key))
                    key, doc = key[order], doc[order]
                    new = np.ones(len(key), bool)
                    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
                    key = key[new]
                keys.append(key)
                size += len(key)
                if size >= FLUSH:
                    yield flush()
                    keys, size = [], 0
        if keys:
            yield flush()

    return bitmap(docs.select("text").mapInPandas(counted, KEYS), slices)


def marked(bits: int, bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = (values >> np.uint64(64 - bits)).astype(np.int64)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


#: n windows from start of a document that are to go.
FLAG = np.dtype([("doc", "<i8"), ("start", "<i4"), ("n", "<i4")])
PACK = 1 << 14
#: A pack of pieces (a text, with its document, place and number of windows) for a slice, or one of flags.
PACKS = "slice int, pieces binary, flags binary"
#: A piece under the key of all its windows.
KEYED = "key long, doc long, start int, n int, data binary"


def squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(4, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unsqueezed(data: bytes) -> bytes:
    return pa.decompress(data[4:], decompressed_size=int.from_bytes(data[:4], "little"), codec="zstd", asbytes=True)


@dataclass
class Pieces:
    doc: np.ndarray
    start: np.ndarray
    n: np.ndarray
    data: list[bytes]

    @staticmethod
    def joined(parts: list[Pieces]) -> Pieces:
        if not parts:
            return Pieces(*(np.zeros(0, np.int64),) * 3, [])
        return Pieces(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("doc", "start", "n")), [x for p in parts for x in p.data])

    def take(self, rows: np.ndarray) -> Pieces:
        return Pieces(self.doc[rows], self.start[rows], self.n[rows], [self.data[k] for k in rows.tolist()])

    def packed(self) -> bytes:
        size = np.fromiter(map(len, self.data), np.int64, len(self.data))
        return squeezed(b"".join([len(size).to_bytes(4, "little"), self.doc.astype("<i8").tobytes(), self.start.astype("<i4").tobytes(), self.n.astype("<i4").tobytes(), size.astype("<i4").tobytes(), *self.data]))

    @staticmethod
    def unpacked(packs: list[bytes]) -> Pieces:
        out = []
        for pack in packs:
            raw = unsqueezed(pack)
            count = int.from_bytes(raw[:4], "little")
            doc = np.frombuffer(raw, "<i8", count, 4)
            start, n, size = (np.frombuffer(raw, "<i4", count, 4 + (8 + 4 * k) * count).astype(np.int64) for k in range(3))
            ends = (4 + 20 * count + np.cumsum(size)).tolist()
            out.append(Pieces(doc, start, n, [raw[a:b] for a, b in zip([4 + 20 * count, *ends], ends)]))
        return Pieces.joined(out)


def later(within: bool, key: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which rows have an earlier one with the same key."""
    order = np.lexsort((start, doc, key))
    k, d, s = key[order], doc[order], start[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
    out = np.zeros(len(k), bool)
    if len(k):
        out[order] = (d > d[head]) | (within & (d == d[head]) & (s > s[head]))
    return out


def unions(doc: np.ndarray, first: np.ndarray, past: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of ranges in documents: their unions, in order; ranges that touch become one."""
    order = np.lexsort((first, doc))
    doc, first, past = doc[order], first[order].astype(np.int64), past[order].astype(np.int64)
    if not len(doc):
        return doc, first, past
    far = 1 << 33
    group = (np.cumsum(np.append(True, doc[1:] != doc[:-1])) - 1) * far
    reach = np.maximum.accumulate(past + group) - group
    at = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (first[1:] > reach[:-1])))
    return doc[at], first[at], np.maximum.reduceat(past, at)


def flags(doc: np.ndarray, start: np.ndarray, n) -> list[bytes]:
    """Windows that are to go, packed by PACK; neighbours together."""
    doc, first, past = unions(doc, start, start + n)
    out = np.zeros(len(doc), FLAG)
    out["doc"], out["start"], out["n"] = doc, first, past - first
    return [squeezed(out[k : k + PACK].tobytes()) for k in range(0, len(out), PACK)]


def flagged(packs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(unsqueezed, packs)), FLAG)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and doc, which tells documents apart and orders them: the id; but for rows without one, and for rows that share an id with a row of another text (of these the one with the least hash keeps it),
    a number above all ids, made from id and text. So equal rows are one document, and others never are."""
    text = F.xxhash64(whole_text())
    seen = stored(docs.groupBy("doc_id").agg(F.min(text).alias("low"), F.max(text).alias("high")), "ids")
    top, odd = seen.agg(F.max("doc_id"), F.bool_or(F.expr("doc_id is null or low <> high"))).first()
    if not odd:
        return docs.select("doc_id", "text", F.col("doc_id").alias("doc"))
    base = min(max(1 << 62, (top or 0) + 1), (1 << 63) - 2)
    own = F.lit(base) + F.pmod(F.xxhash64("doc_id", text), F.lit((1 << 63) - 1 - base))
    clash = seen.where("doc_id is not null and low <> high").select("doc_id", "low")
    return docs.join(clash, "doc_id", "left").select("doc_id", "text", F.when(F.col("doc_id").isNull() | (text != F.col("low")), own).otherwise(F.col("doc_id")).alias("doc"))


def _portions(group: np.ndarray, data: list[bytes]) -> Iterator[np.ndarray]:
    """Rows in the order of their groups, about BYTES at a time; a group's stay together."""
    order = np.argsort(group, kind="stable")
    size = np.cumsum(np.fromiter(map(len, data), np.int64, len(data))[order])
    heads = np.flatnonzero(np.append(True, group[order][1:] != group[order][:-1]))
    portion = size[heads] // BYTES
    yield from np.split(order, heads[np.flatnonzero(portion[1:] != portion[:-1]) + 1])


def standing(p: Pieces, group: np.ndarray) -> np.ndarray:
    """For each piece the one that stands for it: the first of its document with its text. So a text of one repeated byte has one piece to compare, not one for each window. Equal texts have equal groups."""
    order = np.lexsort((group, p.doc))
    same = (group[order][1:] == group[order][:-1]) & (p.doc[order][1:] == p.doc[order][:-1])
    out, first = np.arange(len(p.data)), {}
    for k in np.sort(order[np.append(same, False)[: len(order)] | np.append(False, same)[: len(order)]]).tolist():
        out[k] = first.setdefault((int(p.doc[k]), p.data[k]), k)
    return out


def resolved(kind: Kind, p: Pieces, keys: np.ndarray | None = None) -> tuple[list[bytes], np.ndarray]:
    """Flags of what stands earlier in the pieces p, by the kind's method; and which pieces are not flagged as a whole. With keys single windows are compared, of pieces with equal keys; else whole pieces."""
    group = np.fromiter(map(xxhash.xxh32_intdigest, p.data), np.int64, len(p.data)) if keys is None else keys
    stays, packs = np.ones(len(p.data), bool), []
    stands = np.arange(len(p.data)) if kind.within else standing(p, group)
    own = np.flatnonzero(stands == np.arange(len(stands)))
    members, number = np.argsort(stands, kind="stable"), np.bincount(stands, minlength=len(stands))
    begin = np.cumsum(number) - number
    for rows in _portions(group[own], [p.data[k] for k in own.tolist()]) if len(own) else ():
        rows = own[rows]
        piece, at, size, passage = kind.locate(group[rows], p.n[rows], [p.data[k] for k in rows.tolist()], keys is not None)
        piece = rows[piece]
        gone = np.flatnonzero(later(kind.within, passage, p.doc[piece], p.start[piece] + at))
        # what goes of a piece goes of all that it stands for
        n = number[piece[gone]]
        gone, inside = np.repeat(gone, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        piece, at, size = members[begin[piece[gone]] + inside], at[gone], size[gone]
        stays[piece[size == p.n[piece]]] = False
        packs += flags(p.doc[piece], p.start[piece] + at, size)
    return packs, stays


def _sent(kind: Kind, parts: Iterator[Pieces], slices: int) -> Iterator[pd.DataFrame]:
    """What a worker sends on of its pieces, a portion at a time: those that stay, to the slices of their texts, and flags, anywhere."""

    def send(held: list[Pieces]) -> pd.DataFrame:
        p = Pieces.joined(held)
        packs, stays = resolved(kind, p)
        rows = np.flatnonzero(stays)
        to = np.fromiter((xxhash.xxh64_intdigest(p.data[k]) % slices for k in rows.tolist()), np.int64, len(rows))
        order = np.argsort(to, kind="stable")
        rows, to = rows[order], to[order]
        at = np.flatnonzero(np.append(True, to[1:] != to[:-1])[: len(to)])
        own = [p.take(x).packed() for x in np.split(rows, at[1:])] if len(rows) else []
        return pd.DataFrame({"slice": [*to[at].tolist(), *(np.arange(len(packs)) * 7 % slices).tolist()], "pieces": own + [b""] * len(packs), "flags": [b""] * len(own) + packs})

    held, size = [], 0
    for part in parts:
        held.append(part)
        size += sum(map(len, part.data))
        if size >= HELD:
            yield send(held)
            held, size = [], 0
    if held:
        yield send(held)


def _met(kind: Kind):
    """Resolves the pieces of a slice, and hands on those that stay."""

    def met(group: pd.DataFrame) -> pd.DataFrame:
        p = Pieces.unpacked([x for x in group["pieces"] if x])
        packs, stays = resolved(kind, p)
        packs += [x for x in group["flags"] if x]
        return pd.DataFrame({"slice": 0, "pieces": [p.take(np.flatnonzero(stays)).packed()] + [b""] * len(packs), "flags": [b""] + packs})

    return met


def whole_pieces(docs: DataFrame, kind: Kind, known: tuple[int, bytes], slices: int) -> DataFrame:
    """PACKS of the pieces that stay, and of the flags of what stands earlier."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[Pieces]:
        bits, own = shared.value[0], np.frombuffer(shared.value[1], np.uint8)
        for batch in batches:
            ids = batch["doc"].to_numpy("int64")
            for parts, where in pieces(kind, map(encoded, batch["text"])):
                part, first, n, _, place, key = runs(kind, parts)
                take = marked(bits, own, key)
                part, first, n, place = part[take], first[take], n[take], place[take]
                if not len(part):
                    continue
                # neighbouring runs are one piece if their anchor has the same place: then no window stands twice in a piece
                new = np.ones(len(part), bool)
                new[1:] = (place[1:] != place[:-1]) | (first[1:] != first[:-1] + n[:-1])
                at = np.flatnonzero(new)
                part, first, n = part[at], first[at], np.add.reduceat(n, at)
                text, offset = np.array(where).T
                yield Pieces(ids[text[part]], offset[part] + first, n, [kind.join(parts[p][f : f + m + kind.window - 1]) for p, f, m in zip(part.tolist(), first.tolist(), n.tolist())])

    rows = docs.select("doc", "text").mapInPandas(lambda batches: _sent(kind, cut(batches), slices), PACKS)
    return stored(rows.groupBy("slice").applyInPandas(_met(kind), PACKS), "pieces")


def cut_up(kind: Kind, p: Pieces) -> tuple[np.ndarray, Pieces]:
    """Pieces cut up by the keys of their windows, and these keys; each window stands in one of them."""
    parts = list(map(kind.split, p.data))
    part, first, n, _, _, key = runs(kind, parts)
    return key, Pieces(p.doc[part], p.start[part] + first, n, [kind.join(parts[k][f : f + m + kind.window - 1]) for k, f, m in zip(part.tolist(), first.tolist(), n.tolist())])


def _cut_packs(kind: Kind, batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, Pieces]]:
    for batch in batches:
        for pack in batch["pieces"]:
            p = Pieces.unpacked([pack])
            for rows in _portions(np.arange(len(p.data)), p.data) if p.data else ():
                yield cut_up(kind, p.take(rows))


def several(found: DataFrame, kind: Kind) -> DataFrame:
    """The pieces (KEYED) of keys that have several."""
    slices = slices_of(found.sparkSession)
    own = found.where(F.length("pieces") > 0).select("pieces")

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for key, _ in _cut_packs(kind, batches):
            values, n = np.unique(key, return_counts=True)
            yield _packed(slices, values, values[n > 1])

    shared = found.sparkSession.sparkContext.broadcast(bitmap(own.mapInPandas(counted, KEYS), slices))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits, known = shared.value[0], np.frombuffer(shared.value[1], np.uint8)
        for key, p in _cut_packs(kind, batches):
            rows = np.flatnonzero(marked(bits, known, key))
            p = p.take(rows)
            yield pd.DataFrame({"key": key[rows].view(np.int64), "doc": p.doc, "start": p.start, "n": p.n, "data": p.data})

    return stored(own.mapInPandas(cut, KEYED), "several")


def dealt_out(own: DataFrame, kind: Kind, slices: int) -> tuple[DataFrame, DataFrame]:
    """The pieces, by slices of their keys; and the windows (PACKS) of crowded keys, each a piece, by slices of their texts: equal ones still meet, but no slice gets all of a key's."""
    crowds = stored(own.groupBy("key").agg(F.count("*").alias("times")).where(F.col("times") > CROWD).select("key"), "crowds")
    if crowds.count() <= MOST_CROWDS:
        crowds = F.broadcast(crowds)
    few = own.join(crowds, "key", "left_anti").withColumn("slice", F.pmod(F.xxhash64("key"), F.lit(slices)).cast("int"))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[Pieces]:
        for batch in batches:
            n = batch["n"].to_numpy(np.int64)
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            data = [kind.join(units[k : k + kind.window]) for text, m in zip(batch["data"], n.tolist()) for units in [kind.split(text)] for k in range(m)]
            yield Pieces(np.repeat(batch["doc"].to_numpy(np.int64), n), np.repeat(batch["start"].to_numpy(np.int64), n) + step, np.ones(len(data), np.int64), data)

    return few, own.join(crowds, "key", "left_semi").select("doc", "start", "n", "data").mapInPandas(lambda batches: _sent(kind, split(batches), slices), PACKS)


def windows_apart(own: DataFrame, kind: Kind, slices: int) -> DataFrame:
    """Flags of single windows that pieces of one key share."""

    def shared(group: pd.DataFrame) -> pd.DataFrame:
        p = Pieces(*(group[c].to_numpy(np.int64) for c in ("doc", "start", "n")), group["data"].tolist())
        return pd.DataFrame({"flags": resolved(kind, p, group["key"].to_numpy(np.int64))[0]})

    few, many = dealt_out(own, kind, slices)
    return few.groupBy("slice").applyInPandas(shared, "flags binary").union(many.groupBy("slice").applyInPandas(_met(kind), PACKS).select("flags"))


def spans(found: DataFrame, kind: Kind) -> DataFrame:
    """doc and spans: for each document what is covered, packed as first and past units. Flags go in packs to the slices of their documents, so their number does not grow with how many workers tell of a document."""
    slices = 4 * slices_of(found.sparkSession)
    shift = np.uint64(64 - (slices.bit_length() - 1))

    def deal(held: list[bytes]) -> pd.DataFrame:
        x = flagged(held)
        doc, first, past = unions(x["doc"], x["start"], x["start"].astype(np.int64) + x["n"])
        to = (mixed(doc.astype(np.int64).view(np.uint64)) >> shift).astype(np.int64)
        order = np.argsort(to, kind="stable")
        out, to = np.zeros(len(doc), FLAG), to[order]
        out["doc"], out["start"], out["n"] = doc[order], first[order], (past - first)[order]
        heads = np.flatnonzero(np.append(True, to[1:] != to[:-1])[: len(to)])
        return pd.DataFrame({"slice": to[heads], "flags": [squeezed(part.tobytes()) for part in np.split(out, heads[1:])]})

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            for pack in batch["flags"]:
                held.append(pack)
                size += int.from_bytes(pack[:4], "little")
                if size >= SPANS:
                    yield deal(held)
                    held, size = [], 0
        if held:
            yield deal(held)

    def united(group: pd.DataFrame) -> pd.DataFrame:
        x = flagged(group["flags"].tolist())
        doc, first, past = unions(x["doc"], x["start"], x["start"].astype(np.int64) + x["n"] + kind.window - 1)
        docs, heads = np.unique(doc, return_index=True)
        pairs, edges = np.stack([first, past], 1).astype("<i4"), np.append(heads, len(doc))
        return pd.DataFrame({"doc": docs, "spans": [[pairs[a:b].tobytes()] for a, b in zip(edges[:-1], edges[1:])]})

    return found.select("flags").mapInPandas(dealt, "slice int, flags binary").groupBy("slice").applyInPandas(united, "doc long, spans array<binary>")


def merged(packs: list[bytes] | None) -> np.ndarray:
    """The pairs of first and past, in order and apart from each other."""
    x = np.frombuffer(b"".join(packs), "<i4").reshape(-1, 2).astype(np.int64) if packs is not None and len(packs) else np.zeros((0, 2), np.int64)
    if len(x) < 2:
        return x
    x = x[np.argsort(x[:, 0], kind="stable")]
    reach = np.maximum.accumulate(x[:, 1])
    at = np.flatnonzero(np.append(True, x[1:, 0] > reach[:-1]))
    return np.stack([x[at, 0], np.maximum.reduceat(x[:, 1], at)], 1)


def slices_for(docs: DataFrame) -> int:
    """Into how many slices pieces are dealt: by the bytes of all texts, so that a slice's size doesn't grow with them."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // SLICE))


def covered(docs: DataFrame, kind: Kind) -> DataFrame:
    """doc_id (0 where unnamed), unnamed, text and spans: packs of what of each document also stands earlier (null: nothing)."""
    small_batches(docs.sparkSession)
    docs = keyed(docs.select("doc_id", "text"))
    slices = slices_for(docs)
    whole = whole_pieces(docs, kind, recurring(docs, kind), slices)
    apart = windows_apart(several(whole, kind), kind, slices)
    found = spans(whole.select("flags").union(apart).where(F.length("flags") > 0), kind)
    return identified(docs.join(stored(found, "spans"), "doc", "left"), "text", "spans")
