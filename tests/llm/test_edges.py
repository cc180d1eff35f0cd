"""Nulls in any column, clashing names and repeated rows; queries with SQL against it."""

import public_tokenizers
import pytest
from oracle import compare
from pyspark.sql import functions as F
from studyperf.llm import bpe, decontaminate, langid, phrases, quality, queries, reshard, rules, secrets, simhash, suffixes

TEXT = "one calm line of prose that says a few plain things and then goes on for some more words until it ends at last here"
CLASH = ("fp", "variant", "mask", "root", "node", "kept", "n", "class", "cell", "rank", "shard", "slot", "grade", "ids", "spans", "base", "key", "k", "component_id")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, TEXT, "en"), (1, TEXT, "en"), (None, TEXT, "en"), (None, None, None), (2, None, None), (3, "", None), (4, TEXT + " and more", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"source": F.lit(None).cast("string"), "n_chars": F.lit(None).cast("int")})
    return df.withColumns({c: F.lit("clash") for c in CLASH})


def ids(df):
    return sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in df.select("doc_id").collect())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(spark, "/root/testdata/sf0.001", queries.QUERIES[name], queries.ORACLES[name]) == ""


def test_one_row_for_each_document(spark, odd):
    ranks = bpe.read_ranks(spark, public_tokenizers.path(queries.TOKENIZER))
    for found in (
        bpe.encode_documents(odd, ranks, public_tokenizers.PATTERN),
        quality.score(odd, None),
        reshard.reshard(odd, F.lit(None), 4),
        rules.judged(odd),
        simhash.near_duplicates(odd),
        secrets.scan(odd),
        langid.identify(odd, None),
    ):
        assert ids(found) == ids(odd)


@pytest.mark.parametrize("operator", [phrases, suffixes])
def test_substrings_take_null_ids(odd, operator):
    assert operator.digest(odd).count() >= 4


def test_stages_keep_columns(spark, odd):
    items = spark.createDataFrame([(None, TEXT), (1, None)], "item_id long, text string")
    for out in (quality.select(odd, None), simhash.deduplicated(odd), decontaminate.clean(odd, items), secrets.masked(odd)):
        assert out.columns == odd.columns and out.count() >= 1
    assert simhash.deduplicated(odd.where("doc_id = 1")).count() == 1


def test_labels_with_nulls(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, None, None), (None, 1, 0), (3, 0, None), (4, 1, None)], "doc_id long, quality int, toxic int")
    assert {r["doc_id"]: r["grade"] for r in quality.graded(labels).collect()} == {1: 0, 3: 1, 4: 2}
