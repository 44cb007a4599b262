"""Exact dedup, SimHash and components against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from gneiss.llm import simhash
from gneiss.llm.exact_dedup import drop_copies, exact_dedup
from gneiss.llm.shared import components, split_join
from gneiss.llm.simhash import GrayIndex, drop_near_copies, fingerprint, gray_rank, links, simhash_groups

DOCS = "doc_id long, text string, _lost string, keep_id int"


def roots(ids, pairs):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_exact_dedup_edge_cases(spark):
    rows = [(5, "a  b"), (3, "a\tb"), (9, None), (7, ""), (None, "a b"), (None, "only"), (2, " a b"), (4, " a b"), (4, " a b")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS)
    got = sorted(map(tuple, exact_dedup(docs).collect()), key=repr)
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]+", " ", t or ""), []).append(i)
    want = []
    for t, held in groups.items():
        keep = min((i for i in held if i is not None), default=None)
        want += [(i, keep, len(held), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in held]
    assert got == sorted(want, key=repr)
    kept = drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, -1, 2, 3, 4, 4, 7]
    assert exact_dedup(docs.limit(0)).count() == 0


def test_exact_dedup_separates_collisions(spark):
    docs = spark.createDataFrame([(1, "one"), (2, "two"), (3, "one"), (4, "three"), (5, "two")], "doc_id long, text string")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup(docs, key=lambda sha: F.substring(F.lit("same"), 1, 4)).collect()}
    assert got == {1: (1, 2), 3: (1, 2), 2: (2, 2), 5: (2, 2), 4: (4, 1)}


def test_split_join_deals_out_hot_keys(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"))
    got = split_join(rows, groups, "k", "n", 5000, F.col("id"))
    assert got.count() == 5000
    assert got.filter("k = 'hot' and n = 1667").count() == 1667
    assert got.filter("n is null").count() == 0


def test_components_match_union_find(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7)]
    frame = spark.createDataFrame(pairs, "a long, b long")
    want = roots({x for p in pairs for x in p if p[0] != p[1]}, [p for p in pairs if p[0] != p[1]])
    assert dict(map(tuple, components(frame).collect())) == want
    assert components(frame.limit(0)).count() == 0


def test_fingerprint_by_definition():
    def slow(text):
        words = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0
        return bits - (1 << 64) if bits >> 63 else bits

    rng = random.Random(1)
    texts = [None, "", " \t", "One", "ONE two", "É É é ß x y", "a b c " * 9] + [" ".join(rng.choice(["ab", "Cd", "ef", "gH"]) for _ in range(rng.randrange(40))) for _ in range(40)]
    for t in texts:
        assert fingerprint(t) == slow(t)
    simhash_chunk, simhash.CHUNK = simhash.CHUNK, 7
    try:
        assert [fingerprint(t) for t in texts] == [slow(t) for t in texts]
    finally:
        simhash.CHUNK = simhash_chunk


def near_codes(n, rng):
    codes = {0, (1 << 64) - 1}
    while len(codes) < n:
        code = rng.getrandbits(64)
        codes.add(code)
        for _ in range(rng.randrange(6)):
            for _ in range(rng.randrange(1, 5)):
                code ^= 1 << rng.randrange(64)
            codes.add(code)
    return sorted(codes)


def test_gray_rank_is_the_sequence():
    codes = np.arange(64, dtype=np.uint64)
    assert sorted(codes, key=lambda c: int(gray_rank(np.array([c]))[0])) == [int(i ^ (i >> 1)) for i in range(64)]


def test_gray_index_finds_every_group():
    rng = random.Random(5)
    codes = near_codes(900, rng)
    want = roots(range(len(codes)), [(i, j) for i in range(len(codes)) for j in range(i) if (codes[i] ^ codes[j]).bit_count() <= 3])
    got = GrayIndex(np.array(codes, np.uint64)).groups(3, queries=64)
    names = {}
    assert all(names.setdefault(int(g), w) == w for g, w in zip(got, (want[i] for i in range(len(codes)))))
    assert len(names) == len(set(want.values()))


def test_links_by_blocks_and_split_buckets(spark):
    rng = random.Random(6)
    codes = near_codes(700, rng) + [0xABCD << 48 | rng.getrandbits(20) for _ in range(120)]
    codes = sorted(set(codes))
    frame = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c, i) for i, c in enumerate(codes)], "fp long, node long")
    want = roots(range(len(codes)), [(i, j) for i in range(len(codes)) for j in range(i) if (codes[i] ^ codes[j]).bit_count() <= 3])
    for bucket, split in ((10_000, 1 << 16), (32, 1 << 16), (32, 40)):
        got = roots(range(len(codes)), map(tuple, links(frame, len(codes), 3, bucket, split).collect()))
        assert got == want


def test_simhash_groups_edge_cases(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(4, base), (2, base.replace("w200", "x")), (8, None), (6, " "), (None, base), (None, "alone here now"), (9, "Other Words Entirely"), (9, "Other Words Entirely")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS)
    got = sorted(((r[0], r[2]) for r in simhash_groups(docs).collect()), key=repr)
    near = (fingerprint(rows[0][1]) ^ fingerprint(rows[1][1])) & ((1 << 64) - 1)
    first = 2 if near.bit_count() <= 3 else 4
    assert got == sorted([(4, first), (2, 2), (8, 6), (6, 6), (None, first), (None, None), (9, 9), (9, 9)], key=repr)
    assert sorted(r["doc_id"] or -1 for r in drop_near_copies(docs).collect()) == sorted([-1, -1, 2, 6, 9, 9] + ([4] if first == 4 else []))
    assert simhash_groups(docs.limit(0)).count() == 0
