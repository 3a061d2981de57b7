"""Runs of words against a search for every period, and the defined cases."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import runs


def brute(words, exponent=4, least=6):
    """start, length, period of all runs: every stretch of equal words p apart whose smallest period is p."""
    n, out = len(words), set()
    for p in range(1, n // 2 + 1):
        s = 0
        while s + p < n:
            if words[s] != words[s + p]:
                s += 1
                continue
            e = s
            while e + p < n and words[e] == words[e + p]:
                e += 1
            length = e + p - s
            if length >= max(least, exponent * p) and not any(all(words[k] == words[k + q] for k in range(s, s + length - q)) for q in range(1, p)):
                out.add((s, length, p))
            s = e + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def rewritten(key, words):
    h, n = zlib.crc32(str(key).encode()), len(words)
    if key is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def digest(key, text):
    words = rewritten(key, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    found = brute(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(found), *told, hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(), hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest())


@pytest.mark.parametrize(("exponent", "least"), [(4, 6), (2, 2), (3, 1)])
def test_runs_of_random_words(exponent, least):
    rng = random.Random(exponent)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(0, 6)):
            words = [rng.randint(1, rng.choice([1, 2, 2, 3])) for _ in range(rng.choice([0, 1, 5, 6, 7, 20, 60]))]
            texts.append(np.array(rewritten(rng.randrange(1000), words), np.int64))
        for text, found in zip(texts, runs.runs_of(texts, exponent, least), strict=True):
            assert [tuple(r) for r in found.tolist()] == brute(text.tolist(), exponent, least)


def test_fibonacci_words():
    """Words with as many runs as can be."""
    a, b = [1], [1, 2]
    while len(b) < 300:
        a, b = b, b + a
    assert [tuple(r) for r in runs.runs_of([np.array(b)], 2, 2)[0].tolist()] == brute(b, 2, 2)


def test_next_smaller():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 17, 300):
        v = rng.permutation(n) + 1
        assert runs.next_smaller(v).tolist() == [next((j for j in range(i + 1, n) if v[j] < v[i]), n) for i in range(n)]


def test_suffixes_and_prefixes():
    rng = random.Random(2)
    texts = [[rng.randint(1, 2) for _ in range(rng.randint(1, 40))] + [0] for _ in range(5)]
    letters, text_of = np.concatenate([np.array(t) for t in texts]), np.repeat(range(5), [len(t) for t in texts])
    found = runs.CommonPrefixes(letters, text_of)
    at = 0
    for t in texts:
        n = len(t)
        assert np.argsort(found.rank[at : at + n]).tolist() == sorted(range(n), key=lambda i: t[i:])
        pairs = [(i, j) for i in range(n) for j in range(n) if i != j]
        want = [next(k for k in range(n) if t[i + k] != t[j + k]) for i, j in pairs]
        a, b = (np.array(x) + at for x in zip(*pairs, strict=True))
        assert found.of(a, b).tolist() == want
        at += n


def test_long_texts():
    """Three hundred thousand words, all equal, or without a run, or with a period of a tenth."""
    n = 300_000
    words = np.random.default_rng(3).integers(1, 1000, n)
    tenth = words[np.arange(n) % (n // 10)]
    one, none, ten = runs.runs_of([np.ones(n, np.int64), np.arange(1, n + 1), tenth])
    assert one.tolist() == [[0, n, 1]] and not len(none) and [0, n, n // 10] in ten.tolist()


DOCS = "doc_id long, text string, runs string, n_words int, best int, collapsed int"


def test_digests(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) for _ in range(300)] + [None, "", " \t\n\x0b ", "one", "a\x0ca\x0ba a\ra\na  a", "é é é é é é", "x " * 50]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a a a a a a a"), (7, "b b b b b b"), (7, "b b b b b b"), (-5, "q r " * 9)]
    docs = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], DOCS).repartition(3)
    got = sorted(((r[0], tuple(r)[1:]) for r in runs.run_digests(docs).collect()), key=str)
    assert got == sorted(((k, digest(k, t)) for k, t in rows), key=str)
    assert not runs.run_digests(docs.limit(0)).collect()


def test_operator(spark, monkeypatch):
    docs = spark.createDataFrame([("k", "w a b a b a b a b z"), (None, None)], "doc_id string, text string")
    got = {r["doc_id"]: r for r in runs.periodic_runs(docs).collect()}
    assert [tuple(r) for r in got["k"]["runs"]] == [(1, 8, 2)] and got["k"]["collapsed"] == "w a b z" and got["k"]["n_words"] == 10
    assert not got[None]["runs"] and got[None]["collapsed"] == "" and got[None]["n_words"] == 0
    assert [tuple(r) for r in runs.periodic_runs(docs.where("doc_id = 'k'"), exponent=5).first()["runs"]] == []
    long = spark.createDataFrame([(1, "v " + "a b " * 1_100_000)], "doc_id long, text string")  # above LONG: words one by one
    r = runs.periodic_runs(long).select("n_words", "runs", F.col("collapsed")).first()
    assert (r[0], [tuple(x) for x in r[1]], r[2]) == (2_200_001, [(1, 2_200_000, 2)], "v a b")
