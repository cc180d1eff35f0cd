"""Null, large and shared ids, and passages that many documents share, for op8_phrases and op9_suffixes."""

import dataclasses
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from studyperf.llm import anchors, phrases, suffixes

SHARED = " ".join(f"passage{k}" for k in range(40))
CLEAN = " ".join(f"clean{k}" for k in range(60))
LARGE = 2**53 + 1


@pytest.mark.parametrize("operator", [phrases, suffixes])
def test_ids_null_large_or_shared(spark, operator):
    other, third = "other " + CLEAN.replace("clean", "other"), CLEAN.replace("clean", "third")
    rows = [(None, SHARED), (5, f"first {SHARED}"), (LARGE, f"then {SHARED}"), (LARGE + 1, CLEAN), (None, other), (9, third), (9, f"{SHARED} last"), (9, third)]
    kept = {}
    for r in operator.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect():
        kept.setdefault(r["doc_id"], []).append(bytes(r["kept"]).decode().strip() if operator is suffixes else r["kept"])
    assert set(kept) == {5, 9, LARGE, LARGE + 1, None}
    assert kept[5] == [f"first {SHARED}"] and kept[LARGE] == ["then"] and kept[LARGE + 1] == [CLEAN]
    assert sorted(kept[None]) == sorted(["", other])
    assert kept[9].count(third) == 2 and all("passage20" not in t for t in kept[9])


def crowd_of(spark, n):
    rows = [(k, f"{' '.join(f'a{k}x{i}' for i in range(30))} {SHARED} {' '.join(f'b{k}x{i}' for i in range(30))}") for k in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


@pytest.mark.parametrize("operator", [phrases, suffixes])
def test_no_group_holds_a_crowded_anchor(spark, monkeypatch, operator):
    docs = anchors.keyed(crowd_of(spark, 300))

    def largest(crowd):  # the largest group's share of all windows that are compared one by one
        monkeypatch.setattr(anchors, "CROWD", crowd)
        whole = anchors.whole_pieces(docs, operator.KIND, anchors.recurring(docs, operator.KIND), 64)
        few, many = anchors.dealt_out(anchors.several(whole, operator.KIND), operator.KIND, 64)
        sizes = [r["n"] for r in few.groupBy("slice").agg(F.sum("n").alias("n")).collect()]
        for packs in many.groupBy("slice").agg(F.collect_list("pieces").alias("x")).collect():
            sizes.append(int(anchors.Pieces.unpacked([bytes(x) for x in packs["x"] if x]).n.sum()))
        return max(sizes) / sum(sizes)

    assert largest(20) < 0.1 < largest(10**6)


@pytest.mark.parametrize("operator", [phrases, suffixes])
def test_crowded_anchors_change_nothing(spark, monkeypatch, operator):
    docs = crowd_of(spark, 60)
    before = sorted(operator.digest(docs).collect())
    monkeypatch.setattr(anchors, "CROWD", 2)
    assert sorted(operator.digest(docs).collect()) == before and sum(r["n_removed"] > 0 for r in before) == 59


def some_texts():
    """Copies, copies with edits, a shared passage, and texts that repeat themselves, also at once."""
    r = random.Random(5)
    prose = [" ".join(f"w{r.randrange(40)}" for _ in range(60)) for _ in range(4)]
    edited = [t.replace("w1 ", "edit ").replace("w7", "é") for t in prose]
    texts = prose + edited + prose[:2] + [f"{prose[0]} {SHARED} {prose[1]}", f"x {SHARED}", "a " * 90, "ab cd ef " * 30 + "end", prose[2] + " " + prose[2]]
    return texts + [prose[3][: len(prose[3]) // 2]] + [None, "", "short"]


def brute(operator, texts):
    words = operator is phrases
    size, seen, out = operator.WINDOW, set(), {}
    for doc, text in enumerate(texts):
        units, gone, new = (text or "").encode().split() if words else (text or "").encode(), set(), set()
        for s in range(len(units) - size + 1):
            window = tuple(units[s : s + size])
            if window in seen or words and window in new:
                gone.update(range(s, s + size))
            new.add(window)
        seen |= new
        kept = [u for k, u in enumerate(units) if k not in gone]
        out[doc] = len(gone), b" ".join(kept).decode() if words else bytes(kept)
    return out


def removed(operator, docs):
    return {r["doc_id"]: (r["n_removed"], r["kept"] if operator is phrases else bytes(r["kept"])) for r in operator.deduplicated(docs).collect()}


@pytest.mark.parametrize("operator", [phrases, suffixes])
@pytest.mark.parametrize("partitions", [1, 6])
def test_equals_brute_force(spark, operator, partitions):
    docs = spark.createDataFrame(list(enumerate(some_texts())), "doc_id long, text string").repartition(partitions)
    assert removed(operator, docs) == brute(operator, some_texts())


@pytest.mark.parametrize("operator", [phrases, suffixes])
def test_hashes_that_all_collide_change_nothing(spark, operator, monkeypatch):
    """All units hash alike, so all anchors, keys and prefixes of one length do."""
    units = (lambda parts: np.zeros(sum(map(len, parts)), np.uint64)) if operator is phrases else (lambda parts: np.zeros(len(b"".join(parts)), np.uint64))
    monkeypatch.setattr(suffixes, "_BYTES", np.zeros(256, np.uint64))
    monkeypatch.setattr(operator, "KIND", dataclasses.replace(operator.KIND, units=units))
    docs = spark.createDataFrame(list(enumerate(some_texts())), "doc_id long, text string").repartition(3)
    assert removed(operator, docs) == brute(operator, some_texts())


@pytest.mark.parametrize("operator", [phrases, suffixes])
@pytest.mark.parametrize("partitions", [1, 6])
def test_without_the_method_nothing_goes(spark, operator, partitions, monkeypatch):
    """What goes is what the automaton, or the suffix sort, finds."""
    monkeypatch.setattr(operator, "KIND", dataclasses.replace(operator.KIND, locate=lambda *a: tuple(np.zeros((4, 0), np.int64))))
    docs = spark.createDataFrame(list(enumerate(some_texts())), "doc_id long, text string").repartition(partitions)
    assert {n for n, _ in removed(operator, docs).values()} == {0}


def test_slices_follow_the_bytes(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "x" * 5000), (2, None)], "doc_id long, text string")
    monkeypatch.setattr(anchors, "SLICE", 100)
    assert anchors.slices_for(docs) == 50


@pytest.mark.parametrize("operator", [phrases, suffixes])
def test_small_portions_change_nothing(operator, monkeypatch):
    """In this process: all runs of windows as pieces, once at once and once in small parts."""

    def gone():
        keys, rows = [], []
        for parts, where in anchors.pieces(operator.KIND, ((t or "").encode() for t in some_texts())):
            for part, first, n, *_, key in zip(*anchors.runs(operator.KIND, parts)):
                doc, offset = where[part]
                keys.append(key.view(np.int64))
                rows.append((doc, offset + first, n, operator.KIND.join(parts[part][first : first + n + operator.WINDOW - 1])))
        doc, start, n, data = zip(*rows)
        pieces = anchors.Pieces.unpacked([anchors.Pieces(np.array(doc), np.array(start), np.array(n), list(data)).packed()])
        found = anchors.flagged(anchors.resolved(operator.KIND, pieces, np.array(keys))[0])
        return {(d, s + k) for d, s, n in found.tolist() for k in range(n)}

    whole = gone()
    for name, value in (("CHUNK", 64), ("BYTES", 500)):
        monkeypatch.setattr(anchors, name, value)
    monkeypatch.setattr(phrases, "SHARD", 2)
    assert gone() == whole and len(whole) > 100


@pytest.mark.parametrize("operator", [phrases, suffixes])
def test_no_documents_and_clashing_columns(spark, operator):
    docs = spark.createDataFrame([(1, SHARED), (2, SHARED)], "doc_id long, text string")
    wide = docs.selectExpr("*", *(f"'clash' as {c}" for c in ("doc", "spans", "slice", "anchor", "start", "n", "data", "flags", "kept", "unnamed")))
    assert removed(operator, wide) == removed(operator, docs)
    assert operator.digest(wide.limit(0)).count() == 0


def test_texts_that_repeat_themselves(spark):
    texts = ["a" * 150_000, "b" + "a" * 200_000 + "c" + "xyz" * 9_000, "xyz" * 30_000 + "a" * 49, "q" * 60 + "xyz" * 20 + "q" * 60, None, "q" * 70_000]
    seen, wanted = set(), {}
    for k, text in enumerate(texts):
        data = (text or "").encode()
        windows = [data[i : i + 50] for i in range(len(data) - 49)]
        gone = np.zeros(len(data), bool)
        for i, w in enumerate(windows):
            if w in seen:
                gone[i : i + 50] = True
        seen.update(windows)
        wanted[k] = bytes(np.frombuffer(data, np.uint8)[~gone])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: bytes(r["kept"]) for r in suffixes.deduplicated(docs).collect()} == wanted


def test_spans_of_many_packs_are_one_row_a_document(spark):
    """However many packs tell of a document, it has one row, and what is dealt out is packs, not a row for each document and pack."""
    doc = np.arange(500)
    packs = [p for k in range(40) for p in anchors.flags(doc, np.full(500, 3 * k), np.full(500, 2))]
    found = spark.createDataFrame([(bytearray(p),) for p in packs], "flags binary").repartition(20)
    rows = anchors.spans(found, suffixes.KIND).collect()
    assert sorted(r["doc"] for r in rows) == doc.tolist()
    assert all(anchors.merged(r["spans"]).tolist() == [[0, 3 * 39 + 2 + suffixes.WINDOW - 1]] for r in rows)
    dealt = anchors.spans(found, suffixes.KIND)._jdf.queryExecution().optimizedPlan().toString()
    assert "dealt(flags" in dealt and "collect_list" not in dealt


def test_words_have_one_hash_wherever_they_stand():
    """Also long ones, which stand by a digest."""
    long = b"a" * 1_000_000
    words = [b"x", b"xx", b"xy", b"\x00", b"\x00\x00", b"a" * 64, b"a" * 65, long]
    own = phrases._units([words]).tolist()
    assert len(set(own)) == len(words)
    assert phrases._units([[w] for w in reversed(words)]).tolist() == own[::-1]
    assert [phrases._units([[w]]).tolist()[0] for w in words] == own and len(phrases._units([[], []])) == 0
