"""Base spans against plain regular expressions, the battery's p-values on prose, false discoveries, masking."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F
from studyperf.llm import queries, secrets

FOLDER = "/root/testdata/sf0.001"
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ALPHABETS = {
    "base 64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "base 62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base 36": "abcdefghijklmnopqrstuvwxyz0123456789", "base 32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base 16": "0123456789ABCDEF",
}


def base(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(spans)


def joined(spans):
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def test_query_equals_plain_patterns(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    found = queries.op7_secrets(spark, FOLDER).collect()
    assert len(found) == len(texts)
    for r in found:
        spans = base(texts[r["doc_id"]])
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == n for _, k, _ in spans) for n in range(3))
        assert r["base_sha256"] == hashlib.sha256(joined(spans).encode()).hexdigest()
        assert ",".join(x for x in r["spans"].split(",") if not x.startswith("random")) == joined(spans)


def test_awkward_spans(spark):
    texts = [
        None, "", "token=abc token=abcdef", "é😀 PASSWORD : \"xyz_123.\" AKIA" + "A" * 15, "AKIAAKIA" + "B" * 20, "0" * 24 + "g" + "f" * 23, "secret='deadbeefdeadbeefdeadbeef01'", "api_key=a api-key=bbbbbb apikey=bbbbbb",
        "x " * 20_000 + "token: " + "q" * 40_000, "tokentoken==abcdef", "passwd=AKIA" + "C" * 30, "password=secret=abcdefgh",
    ]
    rows = {r["k"]: r["base"] for r in secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).withColumnRenamed("doc_id", "k").collect()}
    assert rows == {k: joined(base(t)) for k, t in enumerate(texts)}


@pytest.fixture(scope="module")
def tokens(spark):
    """Words of documents as tokens in seven styles, and random ones."""
    r = random.Random(11)
    words = [w for row in spark.read.parquet(f"{FOLDER}/documents.parquet").where("lang is not null and text is not null").collect() for w in set(re.findall("[a-z]{2,14}", row["text"].lower()))]
    styles = {"": str, "_": str, "-": str, "/": str, "camel": str.capitalize, "UPPER": str.upper, "numbers": str}
    rows = []
    for style, form in styles.items():
        for _ in range(700):
            token, least = "", r.choice([20, 24, 32, 48, 64])
            while len(token) < least:
                part = str(r.randrange(3000)) if style == "numbers" and r.random() < 0.3 else form(r.choice(words))
                token += (("_" if len(style) > 1 and style != "camel" else "" if style == "camel" else style) if token else "") + part
            rows.append((f"prose {style}", token))
    for name, alphabet in ALPHABETS.items():
        rows += [(name, "".join(r.choices(alphabet, k=r.choice([32, 48, 64])))) for _ in range(100)]
    return rows


def test_values_of_prose_are_never_too_small(spark, tokens):
    rated = spark.createDataFrame(tokens, "style string, token string").repartition(8).withColumn("p", secrets.battery(F.col("token")))
    for row in rated.groupBy("style").agg(*(F.avg((F.col("p") <= x).cast("int")).alias(str(x)) for x in (0.2, 0.05, 0.01, 0.001))).collect():
        if row["style"].startswith("prose"):
            assert all(row[str(x)] <= x + 3 * (x / 700) ** 0.5 for x in (0.2, 0.05, 0.01, 0.001)), row
        else:
            assert row["0.05"] > 0.8, row


def test_share_of_false_discoveries(spark, tokens):
    docs = spark.createDataFrame([(k, f"see {t} here") for k, (_, t) in enumerate(tokens)], "doc_id long, text string").repartition(8)
    found = {r["doc_id"] for r in secrets.scan(docs).where("n_random > 0").collect()}
    wrong = sum(tokens[k][0].startswith("prose") for k in found)
    assert len(found) >= 150 and wrong <= 2 * secrets.RATE * len(found) + 2


def test_masking(spark):
    rows = [(1, "a password=hunter22 b deadbeefdeadbeefdeadbeef00", 5, "x"), (2, "secret=deadbeefdeadbeefdeadbeef01 end", 5, "x"), (3, None, None, "x"), (None, "plain", 5, "x"), (1, "a password=hunter22 b deadbeefdeadbeefdeadbeef00", 5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, spans string")
    out = secrets.masked(docs)
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"] or 0), r["text"], r["n_chars"]) for r in out.collect() if r["text"] is not None)
    assert got == [(0, "plain", 5), (1, "a [SECRET] b [SECRET]", 21), (1, "a [SECRET] b [SECRET]", 21), (2, "[SECRET] end", 12)]
    assert out.count() == 5 and secrets.masked(docs.limit(0)).count() == 0


def plain_battery(token):
    """The battery, written out symbol by symbol."""
    if token.isdigit():
        return 1.0
    squeezed = re.sub("(?<![A-Z])[A-Z](?=[a-z])", "a", token)
    kinds = ["A" if c.isupper() else "0" if c.isdigit() else "a" for c in squeezed if c.isalnum()]
    letters = [c for c in token.lower() if c.isalpha()]
    turns = [c in "aeiouy" for c in letters]
    changed = lambda x: sum(a != b for a, b in zip(x, x[1:]))
    score = lambda x, n, mean, variance: (x - n * mean) / (secrets.SPREAD * math.sqrt(n * variance))
    cell = {c: k for k, cells in enumerate(("aeinorst", "cdfghlmpu", "bjkqvwxyz")) for c in cells}
    z = [-9.0]
    if len(kinds) >= 12:
        z.append(score(changed(kinds), len(kinds) - 1, 0.14, 0.14 * 0.86))
    if len(letters) >= 12 and not re.fullmatch("[0-9a-f]+|[0-9A-F]+", token):
        own = [score(sum(cell[c] for c in letters), len(letters), 0.5, 0.45), -score(changed(turns), len(letters) - 1, 0.53, 0.53 * 0.47)]
        z += own + ([(own[0] + own[1] + z[1]) / (secrets.SPREAD * math.sqrt(3))] if len(kinds) >= 12 else [])
    best = max(z)
    return min(1.0, 4 * (1 - 1 / (1 + math.exp(-max(-700, min(700, 1.5976 * best + 0.07056 * best**3))))))


def test_battery_equals_a_plain_one(spark, tokens):
    r = random.Random(5)
    more = ["0" * 25, "ABCDEF" * 4, "a" * 20, "+/_-" * 6, "A1" * 15, "abc-" * 9, "Ab" * 12, *("".join(r.choices("Aab1+e_", k=r.randrange(20, 60))) for _ in range(200))]
    rows = spark.createDataFrame([(t,) for t in [*(t for _, t in tokens[::7]), *more]], "token string").select("token", secrets.battery(F.col("token")).alias("p")).collect()
    assert all(abs(x["p"] - plain_battery(x["token"])) < 1e-9 for x in rows)


@pytest.mark.parametrize("name", sorted(ALPHABETS))
def test_random_tokens_are_found(spark, name):
    r = random.Random(3)
    planted = [(-k - 1, f"the key {''.join(r.choices(ALPHABETS[name], k=n))} stays here") for k in range(60) for n in [(32, 48, 64)[k % 3]]]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    found = secrets.scan(docs.unionByName(spark.createDataFrame(planted, "doc_id long, text string"))).where("n_random > 0").select("doc_id").collect()
    assert sum(x["doc_id"] < 0 for x in found) >= 0.9 * len(planted)
    assert sum(x["doc_id"] >= 0 for x in found) <= 0.005 * docs.count()


def test_many_matches_in_one_text(spark):
    r = random.Random(9)
    text = "é ".join("".join(r.choices("0123456789abcdef", k=24)) if k % 3 else "token=abcdef" + "x" * (k % 17) + " Some_words_in_a_row_here" for k in range(64_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = base(text)
    row = secrets.scan(docs).first()
    assert row["base"] == joined(spans)
    pieces, at = [], 0
    for start, end in (map(int, x.split(":")[1:]) for x in row["spans"].split(",")):
        if start >= at:
            pieces += [text[at:start], "[SECRET]"]
        at = max(at, end)
    assert secrets.masked(docs).first()["text"] == "".join([*pieces, text[at:]])


def test_masking_keeps_odd_characters_and_names(spark):
    text = "\ufeff😀 password=hunter22\ufeff é token=😀 secret=abcdefgh"
    docs = spark.createDataFrame([(1, text, "a", "b", "c", "d", "e")], "doc_id long, text string, __base string, __more string, __all string, __new string, row string")
    out = secrets.masked(docs)
    assert out.columns == docs.columns
    assert tuple(out.first()) == (1, "\ufeff😀 [SECRET]\ufeff é token=😀 [SECRET]", "a", "b", "c", "d", "e")


def test_tokens_touched_by_other_spans_are_left_out(spark):
    r = random.Random(21)
    words = ["".join(r.choices(ALPHABETS["base 64"], k=r.randrange(10, 50))) for _ in range(60)] + ["deadbeef" * 4, "token=", "AKIA" + "Q" * 20, " ", "=", "é", "secret:"] * 12
    texts = ["".join(r.choices(words, k=30)) for _ in range(40)]
    rows = secrets.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for row in rows:
        spans = base(texts[row["doc_id"]])
        wanted = [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}", texts[row["doc_id"]]) if not any(a < m.end() and m.start() < b for a, _, b in spans)]
        assert [(s["start"], s["end"]) for s in row["__more"]] == wanted
