"""Cascade, ordinal regression, context trees and resharding against plain versions."""

import math
import random
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F
from studyperf.llm import common, langid, nearcopies, quality, reshard, rules, simhash


def rule(name, fails):
    return rules.Rule(name, fails)


def test_cascade_goes_by_rejections_per_cost(spark):
    docs = spark.createDataFrame([(k, ("plain words " * 400) + ("#" if k % 2 else "")) for k in range(400)], "doc_id long, text string")
    cheap, dear, idle = rule("cheap", lambda m: m["n_symbols"] > 0), rule("dear", lambda m: (m["n_repeat_words"] > 10**6) | (m["n_symbols"] > 0)), rule("idle", lambda m: m["n_words"] < 1)
    assert [r.name for r in rules.ordered(docs, [idle, dear, cheap])] == ["cheap", "dear", "idle"]
    assert [r.name for r in rules.by_worth([(cheap, 2.0, 0.2), (dear, 1.0, 0.2), (idle, 1e-9, 0.0)])] == ["dear", "cheap", "idle"]
    assert [r.name for r in rules.ordered(docs.limit(0), [idle, cheap])] == ["cheap", "idle"]


def test_later_rules_are_not_computed_for_rejected_rows(spark):
    docs = spark.createDataFrame([(1, "few"), (2, "words " * 12)], "doc_id long, text string")
    bad = rule("bad", lambda m: F.when(m["n_words"] == 1, F.raise_error("computed")).otherwise(F.lit(False)))
    first = rule("few", lambda m: m["n_words"] < 10)
    found = docs.where(rules.cascade([first, bad], rules._inline(F.col("text"))).isNull())
    assert [r["doc_id"] for r in found.collect()] == [2]
    with pytest.raises(Exception, match="computed"):
        docs.where(rules.cascade([bad, first], rules._inline(F.col("text"))).isNull()).collect()


def test_any_order_and_the_filter_keep_the_same_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    judged = {r["doc_id"] for r in rules.judged(docs).where("kept").collect()}
    selected = rules.selected(docs, list(reversed(rules.default_rules())))
    assert {r["doc_id"] for r in selected.collect()} == judged and selected.columns == docs.columns


def test_rules_on_any_measure(spark):
    docs = spark.createDataFrame([(1, "A B"), (2, None)], "doc_id long, text string")
    own = [rule("mine", lambda m: m["n_repeat_words"] + m["n_upper"] > 1)]
    assert {r["doc_id"]: r["failed_rule"] for r in rules.judged(docs, own).collect()} == {1: "mine", 2: None}
    assert rules.judged(docs.limit(0)).count() == rules.selected(docs.limit(0)).count() == 0


def test_ordinal_fit_beats_a_plain_descent():
    r = np.random.default_rng(4)
    truth = r.normal(size=30)
    bins = [r.choice(30, 6, replace=False) for _ in range(300)]
    values = [np.ones(6, np.float32) for _ in bins]
    grades = np.array([int(s > -1) + int(s > 1) for s in (truth[b].sum() + r.logistic() for b in bins)])
    share = 1 / np.maximum(np.bincount(grades, minlength=3) / len(grades), 0.1)
    weight = share[grades] / share[grades].sum()
    x = np.zeros((300, 30))
    for i, b in enumerate(bins):
        x[i, b] = 1

    def loss(w, t, penalty=6e-4):
        p = 1 / (1 + np.exp(t[None, :] - (x @ w)[:, None]))
        own = (np.hstack([np.ones((300, 1)), p]) - np.hstack([p, np.zeros((300, 1))]))[np.arange(300), grades]
        return -(weight * np.log(own)).sum() + penalty * np.abs(w).sum()

    model = quality.fit(bins, values, grades)
    w, t = model.weights[np.arange(30)].astype(float), model.thresholds
    assert t[0] <= t[1] and np.argsort(model.tails(x @ w)[:, 1]).tolist() == np.argsort(x @ w).tolist()
    a, b = np.zeros(30), np.array([-1.0, 1.0])
    for _ in range(600):  # plain descent by differences
        base, slope = loss(a, b), np.zeros(32)
        for k in range(32):
            step = np.zeros(32)
            step[k] = 1e-5
            slope[k] = (loss(a + step[:30], b + step[30:]) - base) / 1e-5
        a, b = a - slope[:30], b - slope[30:]
    assert loss(w, t) <= loss(a, b) + 1e-3


@pytest.mark.parametrize("present", [[0], [0, 1], [2], [1, 2]])
def test_scale_stays_when_grades_are_absent(spark, present):
    docs = spark.createDataFrame([(k, f"text of {['alpha', 'bravo', 'cargo'][present[k % len(present)]]} number{k}", present[k % len(present)]) for k in range(40)], "doc_id long, text string, grade int")
    model = quality.train(docs, docs.select("doc_id", "grade"))
    found = quality.score(docs, model).select("grade", "quality_verdict.*").collect()
    assert len(model.thresholds) == 2 and {r["grade"] for r in found if r["kept"]} == {2} & set(present)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "word " * 100_000)], "doc_id long, text string")
    assert quality.score(odd, model).count() == 4 and quality.score(odd.limit(0), model).count() == 0


def code_length(texts, text, order):
    """PPM, method C, by dictionaries."""
    counts = Counter()
    for t in texts:
        for k in range(order + 1):
            counts.update((t[i - k : i], t[i]) for i in range(k, len(t)))
    seen = {}
    for (context, byte), n in counts.items():
        seen.setdefault(context, Counter())[byte] = n
    bits = 0.0
    for i, byte in enumerate(text):
        for k in range(min(order, i), -1, -1):
            own = seen.get(text[i - k : i])
            if own is None:
                continue
            total = sum(own.values()) + len(own)
            if byte in own:
                bits -= math.log2(own[byte] / total)
                break
            bits -= math.log2(len(own) / total)
        else:
            bits += 8
    return bits


def test_code_lengths_equal_plain_ppm(spark):
    r = random.Random(6)
    texts = {lang: ["".join(r.choices(letters, k=80)) for _ in range(5)] for lang, letters in (("aa", "abcde é"), ("bb", "cdefgh "))}
    rows = [(k, t, lang) for lang, own in texts.items() for k, t in enumerate(own)]
    trees = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    for text in ("abc de", "h", "zzabczz é", texts["bb"][0] * 3):
        want = [code_length([t.encode() for t in texts[lang]], text.encode(), langid.ORDER) for lang in ("aa", "bb")]
        assert np.allclose(trees.lengths([text.encode()])[0], want, rtol=1e-5)
    one = langid.train(spark.createDataFrame([(1, "abc", "aa"), (2, None, "bb"), (3, "", "cc")], "doc_id long, text string, lang string"))
    odd = spark.createDataFrame([(2**53 + 1, "abc" * 50_000), (None, "cab"), (3, None), (3, "12")], "doc_id long, text string").coalesce(1)
    found = sorted((r["doc_id"] or 0, r["lang_pred"], r["score"]) for r in langid.identify(odd, one).collect())
    assert found == [(0, "aa", 1.0), (3, "und", 0.0), (3, "und", 0.0), (2**53 + 1, "aa", 1.0)]


def test_flow_is_cheapest_on_small_networks():
    r = random.Random(8)
    for _ in range(12):
        blocks = {(old, size): (n := r.randrange(1, 4), n * 10 * (size + 1)) for old in range(2) for size in range(2)}
        rows, shards = sum(n for n, _ in blocks.values()), 2
        least, extra = divmod(rows, shards)
        costs = [(old, total // n) for (old, _), (n, total) in blocks.items() for _ in range(n)]
        best = min(sum(c for (old, c), new in zip(costs, to) if old != new) for to in product(range(shards), repeat=rows) if sorted(Counter(to)[k] for k in range(shards)) == sorted([least + (k < extra) for k in range(shards)]))
        found = sum(n * blocks[old, size][1] // blocks[old, size][0] for old, size, new, n in reshard.transfers(blocks, shards) if old != new)
        assert found == best


def test_the_smallest_rows_move(spark):
    sizes = [5, 9, 9, 9, 12, 100, 100, 103, 104, 300, 9, 9]
    docs = spark.createDataFrame([(k, "x" * n) for k, n in enumerate(sizes)], "doc_id long, text string")
    out = reshard.reshard(docs, F.lit(0), 3).collect()
    moved = sorted(r["size"] - 1 for r in out if r["shard"])
    assert moved == sorted(sizes)[:8] and sorted(r["slot"] for r in out if r["shard"] == 1) == [0, 1, 2, 3]


@pytest.mark.parametrize("operator", [simhash, nearcopies])
def test_one_row_of_each_component_stays(spark, operator):
    text, other = "one calm line of prose that says a few plain things and goes on", "quite another text about nothing that is in the first of them all"
    rows = [(1, text, "a"), (1, other, "b"), (2, text, "c"), (None, text, "d"), (None, "only rows without an id have this text of some words", "e"), (None, "only rows without an id have this text of some words", "f"), (3, other, "g"), (1, text, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, low string").repartition(3)
    kept = operator.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"][:4]) for r in kept.collect()) == [(0, "only"), (1, "one "), (1, "quit")]


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
