"""The pipeline's near-copy rule against brute force, on planted near copies."""

import random

import corpus_pipeline
from pyspark.sql import functions as F
from studyperf.llm import nearcopies, simhash

RANDOM = random.Random(7)


def words(n):
    return [f"w{RANDOM.randrange(5000)}" for _ in range(n)]


def edited(text, edits):
    text = list(text)
    for _ in range(edits):
        text[RANDOM.randrange(len(text))] = f"e{RANDOM.randrange(5000)}"
    return text


def planted():
    texts = []
    for n in (12, 40, 60, 200):
        for _ in range(6):
            own = words(n)
            texts += [own] + [edited(own, k) for k in (1, 1, n // 40, n // 25)]
            step = own
            for _ in range(4):  # chains: each is near the one before
                texts.append(step := edited(step, 1))
    common = words(120)  # one passage in many texts that are else different, with near copies among them
    for _ in range(40):
        own = common + words(30)
        texts += [own, edited(own, 1)]
    RANDOM.shuffle(texts)
    return [" ".join(t) for t in texts] + [None, "", " \n", "one", "ONE "]


def brute(texts):
    sets, root = [nearcopies.shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return dict(enumerate(root))


def test_stage_drops_near_copies(spark):
    texts = planted()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    wanted = brute(texts)
    assert {r["doc_id"]: r["component_id"] for r in nearcopies.near_copies(docs).collect()} == wanted
    kept = dict(corpus_pipeline.STAGES)["SimHash near-dedup"](spark, docs, "")
    assert {r["doc_id"] for r in kept.collect()} == set(wanted.values())


def test_large_groups_are_searched_again(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "GROUP", 2)
    texts = planted()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert {r["doc_id"]: r["component_id"] for r in nearcopies.near_copies(docs).collect()} == brute(texts)


def test_groups_are_dealt_again_only_where_pairs_are_many(spark, monkeypatch):
    """Groups of more than 16 texts whose pairs are few: no finer keys are made, and no link is lost."""
    monkeypatch.setattr(nearcopies, "_bridges", lambda met: 1 / 0)
    texts = planted()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert {r["doc_id"]: r["component_id"] for r in nearcopies.near_copies(docs).collect()} == brute(texts)


def test_a_large_component_meets_only_the_others(spark):
    """Of a key with 300 nodes of one root and two others these two meet all, so the pairs don't grow with its square."""
    rows = spark.createDataFrame([("k", n, 0) for n in range(300)] + [("k", 300, 300), ("k", 301, 301), ("same", 1, 0), ("same", 2, 0)], "key string, node long, root long")
    divided = nearcopies._divided(rows)
    assert {tuple(r) for r in divided.select("key", "main", "pairs").collect()} == {("k", 0, 302 * 2)}
    finer = spark.createDataFrame([(n, [n % 2] * (nearcopies.BITS // 64)) for n in range(302)], "node long, sketch array<long>")
    pairs = {tuple(r) for r in nearcopies._across(rows, finer).collect()}
    assert pairs == {(n, 300) for n in range(300)} | {(n, 301) for n in range(302 - 1)}


def test_no_documents(spark):
    assert nearcopies.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_large_group_of_unlike_texts_makes_few_pairs(spark):
    """Texts of one key that are alike by a half aren't all held against each other; those alike by 0.8 are."""
    common = [f"comum{k}" for k in range(100)]
    texts = [" ".join(common + [f"x{n}y{k}" for k in range(50)]) for n in range(60)] + [" ".join(common + [f"x7y{k}" for k in range(40)] + ["fim"])]
    rows = spark.createDataFrame([("k", n, n, t) for n, t in enumerate(texts)], "key string, node long, root long, text string")
    assert nearcopies.similarity(nearcopies.shingles(texts[7]), nearcopies.shingles(texts[60])) >= 0.8
    finer = rows.select("node", F.pandas_udf(nearcopies._finer, "struct<keys:array<long>,sketch:array<long>>")("text").alias("x")).select("node", "x.*")
    assert [tuple(r) for r in nearcopies._across(rows.drop("text"), finer).collect()] == [(7, 60)]


def test_a_pair_that_shares_many_keys_is_joined_once(spark):
    """What comes out of the join needs no deduplication."""
    text = " ".join(f"p{k}" for k in range(100))
    texts = [(1, text), (2, text + " fim")]
    rows = spark.createDataFrame([(key, n, n) for key in range(40) for n, _ in texts], "key long, node long, root long")
    finer = spark.createDataFrame(texts, "node long, text string").select("node", F.pandas_udf(nearcopies._finer, "struct<keys:array<long>,sketch:array<long>>")("text").alias("x")).select("node", "x.*")
    pairs = nearcopies._across(rows, finer)
    assert "Aggregate" not in pairs._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[0]
    assert [tuple(r) for r in pairs.collect()] == [(1, 2)]


def test_kept_rows_shuffle_their_texts_once(spark):
    """The texts go to the join, and no further to leave repeated rows out; ids that are null or 0 are two ids."""
    marked = spark.createDataFrame([(1, "a", 7), (1, "a", 7), (2, "b", 7), (None, "c", 8), (0, "c", 8), (None, "d", 9), (None, "d", 9)], "doc_id long, text string, __key long")
    rooted = spark.createDataFrame([(7, 1, 7), (8, 0, 8), (9, None, 9)], "key long, low long, root long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = simhash.one_of_each(marked, rooted).select("doc_id", "text")
        assert kept._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 3
        assert sorted(map(str, map(tuple, kept.collect()))) == ["(0, 'c')", "(1, 'a')", "(None, 'd')"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
