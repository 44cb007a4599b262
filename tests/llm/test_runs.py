"""Word runs against a search over all periods, and the query's digests against the contract's words."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss.llm import runs


def by_periods(words, periods=4, least=6):
    """All runs, by walking the whole text once for each period."""
    found, n = {}, len(words)
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - s >= max(least, periods * q):
                found.setdefault((s, i + q - s), q)
            i += 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def repetitive(rng, n, letters):
    words = []
    while len(words) < n:
        unit = [rng.choice(letters) for _ in range(rng.randrange(1, 12))]
        words += (unit * rng.randrange(1, 8))[: rng.randrange(1, 60)] if rng.random() < 0.4 else unit[:1]
    return words[:n]


@pytest.mark.parametrize("periods, least", [(4, 6), (3, 5), (5, 5), (3, 9)])
def test_runs_agree_with_all_periods(periods, least):
    rng = random.Random(13)
    for _ in range(400):
        docs = [repetitive(rng, rng.randrange(90), "abcdefghij"[: rng.choice([1, 2, 3, 10])]) for _ in range(rng.randrange(1, 5))]
        assert runs.runs_of(docs, periods, least) == [by_periods(d, periods, least) for d in docs]


def test_mask_keeps_every_run():
    rng = random.Random(4)
    for _ in range(300):
        words = repetitive(rng, 80, "abc")
        ids = np.array([ord(w) for w in words])
        spans = runs.survivors(ids, np.zeros(len(ids), int), runs.overlap(4, 6), 6)
        assert all(any(a <= s and s + n <= b for a, b in spans) for s, n, _ in by_periods(words))
    distinct = np.arange(5000)
    assert runs.survivors(distinct, np.zeros(5000, int), 5, 6) == []


def test_colliding_hashes_cost_no_runs(monkeypatch):
    rng = random.Random(6)
    monkeypatch.setattr(runs, "PRIME", 7)
    for _ in range(100):
        words = repetitive(rng, 70, "abc")
        assert runs.runs_of([words], 4, 6) == [by_periods(words)]


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "a " * 6), (5, "a " * 6), (None, "x y " * 5), (6, "b\x0bb b\fb b\rb c"), (7, "long" * 10_000), (8, "u v w " * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_id", F.lit(1)).withColumn("runs", F.lit("x")).withColumn("collapsed", F.lit(0))
    got = sorted(((r["doc_id"] or 0, [tuple(x) for x in r["runs"]], r["collapsed"]) for r in runs.word_runs(docs).collect()), key=lambda r: r[0])
    assert got == [
        (0, [(0, 10, 2)], "x y"), (1, [], ""), (2, [], ""), (3, [], ""), (4, [], "a"), (5, [(0, 6, 1)], "a"), (5, [(0, 6, 1)], "a"),
        (6, [(0, 6, 1)], "b c"), (7, [], "long" * 10_000), (8, [(0, 120_000, 3)], "u v w"),
    ]
    assert runs.word_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        runs.word_runs(docs, periods=2)


def test_query_agrees_with_the_contract(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(repetitive(rng, rng.randrange(60), "abcdefghijklmnop"))) for i in range(300)] + [(310, None), (311, ""), (None, "a b")]
    got = {r["doc_id"]: tuple(r)[1:] for r in runs.run_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    planted = 0
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and n:
            planted += 1
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = by_periods(words)
        gone = {i for s, length, q in found for i in range(s + q, s + length)}
        best = max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else (None,) * 3
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want = (len(found), *best, 1000 * best[1] // best[2] if found else None, digest("".join(f"{s},{m},{q}\n" for s, m, q in found)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))
        assert got[doc_id] == want
    assert planted > 10
