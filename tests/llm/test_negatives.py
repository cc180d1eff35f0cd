"""Hard negatives against brute force, and the residue arithmetic against whole numbers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from studyperf.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<float>, anchor string, cell int, score string"


def wanted(rows, positives=5, k=5):
    own = [(i, g, [math.floor(256 * np.float32(x).astype(float)) for x in v]) for i, g, v, *_ in rows if None not in (i, g, v) and all(x is not None and math.isfinite(x) for x in v)]
    own = [r for r in own if sum(x * x for x in r[2]) < 2**54]
    out = []
    for i, g, v in own:
        if i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, h) for j, h, w in own if j != i)
        for s, p, _ in [x for x in scored if x[2] == g][:positives]:
            near = [(n, j) for n, j, h in scored if h != g and -80 * s <= -100 * n <= -100 * s][:k]
            out += [(i, p, r + 1, j, -s, -n) for r, (n, j) in enumerate(near)]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = negatives.mined(df, F.col("vec_id"), F.col("label"), F.col("embedding"), F.col("vec_id") % 100 == 0, **more)
    return sorted(tuple(r) for r in out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def odd_rows():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 9))
    rows = [(i, int(i % 3), [float(x) for x in base[i % 12] + rng.normal(size=9) * (i % 5) / 8], "clash", 1, "clash") for i in range(400)]
    rows += [(1000 + i, i % 2, [0.5] * 9, None, None, None) for i in range(30)]  # equal vectors, tied scores
    rows += [(100, 0, rows[100][2]), (100, 2, [x / 2 for x in rows[100][2]]), (101, 0, rows[101][2])]  # repeated ids
    rows += [(None, 1, [1.0] * 9), (2000, None, [1.0] * 9), (2100, 1, None), (2200, 1, [1.0, None]), (2300, 1, [float("nan")] * 9), (2400, 1, [float("inf")] * 9), (2500, 0, []), (2501, 0, [1.0]), (2502, 1, [2.0] * 12), (2600, 1, [1e30] * 9)]
    return [r if len(r) == 6 else (*r, None, None, None) for r in rows]


def test_equals_brute_force(spark):
    rows = odd_rows()
    got = mined(spark, rows)
    assert len(got) > 40 and got == wanted(rows)


def test_many_blocks_of_anchors_and_rows(spark, monkeypatch):
    for name, value in (("ANCHORS", 2), ("ROWS", 40), ("TILE", 16)):
        monkeypatch.setattr(negatives, name, value)
    rows = odd_rows()
    assert mined(spark, rows) == wanted(rows)


def test_no_rows_no_anchors_no_positives(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, 0, [1.0], None, None, None)]) == []
    assert mined(spark, [(100, 0, [1.0], None, None, None), (1, 1, [1.0], None, None, None)]) == []


@pytest.mark.parametrize(("dims", "most"), [(3, 5), (64, 300), (900, 300), (70, 1 << 20), (1000, 1 << 21)])
def test_products_are_exact(dims, most):
    rng = np.random.default_rng(dims)
    a, b = rng.integers(-most, most + 1, (7, dims)), rng.integers(-most, most + 1, (5, dims))
    a[0], b[0] = most, -most
    moduli = negatives.needed(negatives.longest(a) * negatives.longest(b) + 1)
    assert np.array_equal(negatives.product(negatives.residues(a, moduli), negatives.residues(b, moduli), moduli), a @ b.T)
    assert len(negatives.needed(10)) == 1 and len(negatives.needed(2.0**55)) == 7
