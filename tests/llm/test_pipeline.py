"""The whole pipeline on real rows and awkward ones, each stage against a plain version of it."""

import re
from itertools import combinations

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from studyperf.llm import bpe, nearcopies, oracles, quality
from studyperf.llm.queries import TOKENIZER

SMALL = "/root/testdata/sf0.001"
BASE = re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{6,}|AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path, names = str(tmp_path_factory.mktemp("corpus")), ("doc_id", "text", "lang", "source", "n_chars")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    good, one, two = (r["text"] for r in docs.join(spark.read.parquet(f"{SMALL}/labels.parquet").where("quality = 1 and toxic = 0"), "doc_id").where("length(text) between 600 and 3000 and lang = 'en'").orderBy("doc_id").limit(3).collect())
    mixed = one[: len(one) // 2] + " password = hunter2hunter2 " + two[len(two) // 2 :]
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy(F.desc(F.length("text"))).first()["text"]
    new = f"{good} and then a few words of its own to part it from the others, said once and never again in all of this corpus "
    odd = [
        (None, None, None, None, None), (90001, None, "en", None, None), (90002, "", None, "x", 0), (90003, " \n\t", "en", "x", 3), (None, "short and odd", None, None, 13),
        (90004, good, "en", "x", len(good)), (90005, good, "en", "x", len(good)), (90005, good, "en", "x", len(good)),
        (90006, f"{new} {item} {new}", "en", "x", None), (90007, mixed, "en", "x", None), (90008, " ".join(f"{good} number{k}" for k in range(200)), "en", "x", None),
    ]
    docs.select(*names).unionByName(spark.createDataFrame(odd, docs.select(*names).schema)).withColumns({"kept": F.lit("clash"), "key": F.lit(1), "grade": F.lit("clash")}).write.parquet(f"{path}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    labels.unionByName(spark.createDataFrame([(None, 1, 0), (90004, None, None)], labels.schema)).write.parquet(f"{path}/labels.parquet")
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    items.unionByName(spark.createDataFrame([(None, None), (None, "")], items.schema)).write.parquet(f"{path}/benchmark.parquet")
    return path


def key(r):
    return r["doc_id"] is None, r["doc_id"] or 0, r["text"] or ""


def rows(df):
    return sorted(df.collect(), key=key)


def deduplicated(docs):
    """One row of each component of texts: of its least id, ids before nulls."""
    texts = {t: nearcopies.shingles(t) for t in {r["text"] for r in docs}}
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for a, b in combinations(texts, 2):
        if nearcopies.similarity(texts[a], texts[b]) >= 0.8:
            root[find(a)] = find(b)
    least = {}
    for r in docs:
        at = find(r["text"])
        least[at] = min(least.get(at, (True, 0)), key(r)[:2])
    return sorted(least.values())


def contaminated(docs, folder):
    con = duckdb.connect()
    con.execute(f"create view benchmark as select * from '{folder}/benchmark.parquet/*.parquet'")
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [(k, r["text"]) for k, r in enumerate(docs)])
    return {r[0] for r in con.execute(f"select distinct doc_id from ({oracles.DECONTAMINATE_SQL}) x").fetchall()}


def test_each_stage_equals_its_plain_version(spark, folder):
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.stored(stage(spark, docs, folder), "stage")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.dtypes == before.dtypes
        kept[name] = rows(docs) if name != "byte-level BPE" else docs.collect()
    whole = rows(spark.read.parquet(f"{folder}/documents.parquet"))

    model = quality.train(spark.read.parquet(f"{folder}/documents.parquet"), quality.graded(spark.read.parquet(f"{folder}/labels.parquet")))
    features = quality.Features()
    good = lambda text: model.tails(np.array([sum(model.weights[b].astype(float) * v for b, v in zip(*features.of(text or "")))]))[0, 1]
    graded = [r for r in whole if good(r["text"]) >= 0.5]
    assert 0 < len(graded) < len(whole) and kept["quality classifier"] == graded

    alone = kept["SimHash near-dedup"]
    assert [key(r)[:2] for r in alone] == deduplicated(graded) and {key(r) for r in alone} <= {key(r) for r in graded}

    gone = contaminated(alone, folder)
    clean = kept["benchmark decontamination"]
    assert gone and clean == [r for k, r in enumerate(alone) if k not in gone] and all(r["doc_id"] != 90006 for r in clean)

    masked = kept["secret scans"]
    assert sorted(str(r["doc_id"]) for r in masked) == sorted(str(r["doc_id"]) for r in clean)
    assert any(BASE.search(r["text"] or "") for r in clean) and not any(BASE.search(r["text"] or "") for r in masked)
    plain = {key(r) for r in clean if not re.search(r"[A-Za-z0-9+/_-]{20,}", r["text"] or "") and not BASE.search(r["text"] or "")}
    assert plain <= {key(r) for r in masked}  # texts without a long token stay as they are

    ranks = bpe.read_ranks(spark, public_tokenizers.path(TOKENIZER))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    given = sorted((str(r["doc_id"]), list(r["ids"])) for r in kept["byte-level BPE"])
    assert given == sorted((str(r["doc_id"]), enc.encode_ordinary(r["text"] or "")) for r in masked)


def test_no_documents(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
