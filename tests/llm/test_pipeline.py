"""The pipeline's stages, one after the other, on a small corpus with known cases."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

import corpus_pipeline
from gneiss.llm import queries


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    text = lambda n=120: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(), "en", f"s{i % 4}", 0) for i in range(120)]
    toxic = [(200 + i, text(60) + " idiot loser", "en", "s0", 0) for i in range(30)]
    copies = [(300 + i, rows[i][1].replace(" ", "  "), "en", "s1", 0) for i in range(10)]
    base = text(3000)
    near = [(400, base, "en", "s2", 0), (401, base.replace(" w7 ", " other ", 1), "en", "s2", 0)]
    odd = [(500, None, None, None, None), (501, "", "en", "s3", 0)]
    docs = spark.createDataFrame(rows + toxic + copies + near + odd, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, 1) for i, *_ in toxic] + [(i, 1, 0) for i, *_ in rows], "doc_id long, quality int, toxic int")
    sf = str(tmp_path)
    docs.write.parquet(f"{sf}/documents.parquet")
    labels.write.parquet(f"{sf}/labels.parquet")
    at, seen = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, sf)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{sf}/out{k}")
        at = spark.read.parquet(f"{sf}/out{k}")
        seen[name] = [r["doc_id"] for r in at.collect()]
    assert sorted(seen["toxicity"]) == sorted([i for i, *_ in rows] + [300 + i for i in range(10)] + [400, 401, 500, 501])
    assert sorted(seen["exact_dedup"]) == sorted([i for i, *_ in rows] + [400, 401, 500])
    assert set(seen["simhash_dedup"]) >= {i for i, *_ in rows} | {400, 500} and 401 not in seen["simhash_dedup"]
    assert set(seen["source_mix"]) <= set(seen["simhash_dedup"])
    assert len(seen["packing"]) >= len(seen["source_mix"])


CLASHING = "_id long, _key string, row int, word string, size long, _copy int, fp long, mark int, bucket int, taken int"


def clashing(frame):
    """Extra columns whose names the operators use inside."""
    for c in CLASHING.split(", "):
        name, kind = c.split()
        frame = frame.withColumn(name, F.lit(1).cast(kind))
    return frame


def test_stages_keep_columns_that_clash_and_empty_tables(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(40)), "en", f"s{i % 3}", 0) for i in range(60)] + [(70, None, None, None, None), (None, "no id", None, None, None), (71, "", "en", "s1", 0)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    labels = spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(50)], "doc_id long, quality int, toxic int")
    for name, frame in (("full", docs), ("empty", docs.limit(0))):
        sf = f"{tmp_path}/{name}"
        frame.write.parquet(f"{sf}/documents.parquet")
        labels.write.parquet(f"{sf}/labels.parquet")
        at = spark.read.parquet(f"{sf}/documents.parquet")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, at, sf)
            if k < 4:
                assert out.columns == docs.columns
            out.write.parquet(f"{sf}/out{k}")
            at = spark.read.parquet(f"{sf}/out{k}")
        assert at.count() == 0 if name == "empty" else at.count() > 30
        assert corpus_pipeline.run(spark, sf).count() == at.count()


def slow_stages(rows):
    """Exact and near copies by brute force over (id, text): the ids that stay."""
    import xxhash

    seen, kept = {}, []
    for i, t in sorted(rows):
        text = re.sub("[\x20\x09-\x0d]+", " ", t or "")
        if seen.setdefault(text, i) == i:
            kept.append((i, t))
    prints = {}
    for i, t in kept:
        words = "".join(c.lower() if c.isascii() else c for c in t or "").split()
        shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        ones = [sum(xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for s in shingles) for b in range(64)]
        prints[i] = sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))
    up = {i: i for i in prints}
    find = lambda x: x if up[x] == x else find(up[x])
    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return [i for i, _ in kept], [i for i in prints if find(i) == i]


def test_dedup_stages_match_brute_force(spark):
    rng = random.Random(6)
    base = [" ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(200, 900))) for _ in range(15)]
    rows = []
    for i in range(90):
        words = base[i % 15].split()
        for _ in range(i // 15 % 4):
            words[rng.randrange(len(words))] = f"x{i}"
        rows.append((i, (" " if i % 2 else "  ").join(words)))
    docs = spark.createDataFrame(rows + [(100, None), (101, "")], "doc_id long, text string")
    exact, near = slow_stages(rows + [(100, None), (101, "")])
    once = corpus_pipeline.exact_dedup(spark, docs, "")
    assert sorted(r["doc_id"] for r in once.collect()) == exact and len(exact) < len(rows)
    assert sorted(r["doc_id"] for r in corpus_pipeline.simhash_dedup(spark, once, "").collect()) == near and len(near) < len(exact)


def test_queries_are_registered():
    names = sorted(queries.queries(), key=lambda n: int(n[2:].split("_")[0]))
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
