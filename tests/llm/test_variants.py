"""Spelling variants against brute force: the scan of sorted lists, the halves, the vocabulary, forms and roots."""

import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from studyperf.llm import variants

ENDS = {chr(c): chr(c + 32) for c in range(65, 91)}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = list(itertools.accumulate(range(1, len(b) + 1), lambda left, j, x=x, old=row: min(left + 1, old[j] + 1, old[j - 1] + (x != b[j - 1])), initial=i))
    return row[-1]


def wanted(docs):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(str.maketrans(ENDS))):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    form, out = {}, []
    near = {w: [v for v in words if v != w and abs(len(v) - len(w)) < 2 and edits(v, w) == 1] for w in words}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 10 * n else None
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out)


def rows(df):
    return sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect())


def random_words(n, letters, least, most, seed):
    rng = np.random.default_rng(seed)
    return sorted({"".join(rng.choice(list(letters), rng.integers(least, most + 1))) for _ in range(n)})


@pytest.mark.parametrize(("letters", "least", "most"), [("ab", 1, 7), ("abcdé", 3, 5), ("a", 1, 90), ("xy", 70, 75)])
def test_scan_of_lists_equals_all_pairs(letters, least, most, monkeypatch):
    monkeypatch.setattr(variants, "ASKED", 7)
    lists = [random_words(120, letters, least, most, s) for s in range(3)]
    words, group = [w for x in lists for w in x], np.repeat(range(3), [len(x) for x in lists])
    base = "long " * 40
    words, group = words + [base, base + "x", base[:-3] + base[-2:], base + "yy"], np.append(group, [3] * 4)
    order = sorted(range(len(words)), key=lambda k: (group[k], words[k]))
    words, group = [words[k] for k in order], group[order]
    i, j = variants.near_pairs(words, group)
    want = {(a, b) for a in range(len(words)) for b in range(a + 1, len(words)) if group[a] == group[b] and abs(len(words[a]) - len(words[b])) < 2 and edits(words[a], words[b]) == 1}
    assert len(i) == len(want) and set(zip(i.tolist(), j.tolist())) == want


def test_one_edit():
    for a, b in itertools.product(random_words(40, "ab", 1, 5, 1), repeat=2):
        assert variants.one_edit(a, b) == (edits(a, b) == 1)


@pytest.mark.parametrize("most", [4, 512])
def test_pairs_are_whole_whatever_the_lists(spark, monkeypatch, most):
    monkeypatch.setattr(variants, "GROUP", most)
    words = random_words(300, "ab", 7, 9, 2) + random_words(60, "abcdefg", 7, 8, 3)
    df = spark.createDataFrame([(w, k + 1) for k, w in enumerate(dict.fromkeys(words))], "word string, n long")
    n = {r["word"]: r["n"] for r in df.collect()}
    got = sorted(tuple(r) for r in variants.near_words(df).collect())
    assert got == sorted((a, n[a], b, n[b]) for a in n for b in n if a < b and edits(a, b) == 1)


def test_variants_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    base = random_words(50, "abcdefghilmnoprstuéß", 7, 11, 4)
    docs = [(k, " ".join(w.title() if k % 3 else w for w in rng.choice(base, 120)) + " ÀÉÎßñçä-naïveté123 " * 2) for k in range(60)]
    docs += [(None, " ".join(base)), (None, None), (7, ""), (8, "short words only"), (9, f"{'q' * 3000} {'q' * 3001} " * 2), (9, f"{'q' * 3000} " * 30)]
    df = spark.createDataFrame([(*d, "clash", 1, "clash") for d in docs], "doc_id long, text string, word string, n int, key string").repartition(5)
    got = rows(variants.variants(df))
    assert got == wanted(docs) and sum(r[1] is not None for r in got) > 10
    assert rows(variants.variants(df.limit(0))) == []


def test_roots_follow_forms(spark):
    words = ["abcdefg", "abcdefgh", "abcdefghi", "abcdefghij", "abcdefghijk"]
    df = spark.createDataFrame([(w, 2 * 10**k) for k, w in enumerate(words)] + [("zbcdefg", 20)], "word string, n long")
    got = {r[0]: r[1:] for r in rows(variants.grouped(df))}
    assert [got[w][1] for w in words] == [words[-1]] * 5 and got["abcdefg"][0] == "abcdefgh" and got["zbcdefg"] == (None, "zbcdefg", 20, 1, None)
