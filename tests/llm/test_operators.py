"""Operators without SQL against brute force, exact round trips and held-out accuracy, with their edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from gneiss.llm import html_text, language_model, licences, mixing, packing, toxicity
from gneiss.llm.chat import chat_windows, read_back
from gneiss.llm.embeddings import compare, embedding_groups, unit

EXTRA = "_id int, row int, c int"


def extra(frame):
    """Extra columns whose names operators use inside."""
    return frame.withColumn("_id", F.lit(1)).withColumn("row", F.lit(2)).withColumn("c", F.lit(3))


# op2


def test_language_model_counts_and_base(spark):
    rng = random.Random(2)
    words = ["the", "of", "ün", "Alpha", "beta", "gamma", "delta"] + [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(words[: 7 + i]) for _ in range(rng.randrange(60)))) for i in range(80)] + [(90, None), (91, ""), (None, "the of"), (5, "the the"), (92, "x" * 5000)]
    docs = extra(spark.createDataFrame(rows, "doc_id long, text string"))
    got = language_model.lm_scores(docs).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    count = Counter(w for i, t in rows if not held(i) for w in language_model.tokens(t))
    N, V = sum(count.values()), len(count)
    want = []
    for i, t in rows:
        found = language_model.tokens(t)
        want.append((-1 if i is None else i, held(i), len(found), sum(count[w] > 0 for w in found), N, round(sum(math.log10((count[w] + 0.5) / (N + 0.5 * (V + 1))) for w in found), 6)))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == sorted(want)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 and r["bits_per_byte"] > 0 for r in got)
    assert language_model.lm_scores(docs.limit(0)).count() == 0


def test_spellings_are_probabilities():
    """The bits of all continuations of a prefix add up to one, trained or not."""
    table = np.zeros(2 * language_model.STARTS[-1], np.uint32)
    language_model.add_counts(table, [b"banana", b"bandana", b"anna", b""] * 3)
    model = language_model.Speller(table)
    model.train([b"banane", b"nana"])
    total = 0.0
    for first in range(256):
        if first == 32:
            total += 2 ** model.log2([b""])[0]
            continue
        # a byte's share: all words that start with it; the closing space of one-byte words has probability p(first) * p(space | first)
        bits, share = language_model.Bits([bytes([first])]), 0.0
        for j in range(8):
            bit, partial, slots = bits.bit(j)
            x, sets = model.inputs(slots, j)
            logit = np.einsum("nk,nk->n", x, model.weights[sets])
            low, part = model.cells(logit)
            refined = model.map[partial, low] * (1 - part) + model.map[partial, low + 1] * part
            p = np.clip((language_model.squash(logit) + refined) / 2, 1e-6, 1 - 1e-6)
            share += math.log2(p[0] if bit[0] else 1 - p[0])
        total += 2**share
    assert abs(total - 1) < 1e-9
    assert model.log2([b"banana"])[0] > model.log2([b"xqzvkj"])[0] + 8


def test_language_model_charges_long_words_in_full(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    rows = [(i, " ".join(rng.choice(words) for _ in range(30))) for i in range(200) if i not in held]
    rows += [(i, "".join(rng.choice("0123456789abcdef") for _ in range(n))) for i, n in zip(held, (1000, 50_000))]
    got = {r["doc_id"]: r["bits_per_byte"] for r in language_model.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # random hexadecimal digits hold four bits each, in a long run as in a short one
    assert all(got[i] > 3.9 for i in held)


def test_language_model_mixer_is_trained_on_all_training_text(spark):
    words = [f"w{i}" for i in range(50)]
    rows = [(i, i % 5 == 1, " ".join(words[(i * j + j) % 50] for j in range(999))) for i in range(1000)]
    table = spark.createDataFrame(rows, "row long, held boolean, text string").repartition(4)
    model = language_model.WordMixer([b"", *map(str.encode, words)], [800] * 51, 1, 800_000)
    assert language_model.learn_words(table, model, 800_000).trained == 800_000
    lexicon = spark.createDataFrame([(f"word{i}".encode(), 1) for i in range(2000)], "word binary, c long")
    every = np.zeros(2 * language_model.STARTS[-1], np.uint32)
    language_model.add_counts(every, [f"word{i}".encode() for i in range(2000)])
    assert (language_model.Speller(every).seen == language_model.learn_speller(lexicon, 2000).seen).all()


def test_language_model_beats_base_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    row = language_model.lm_scores(docs).filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert row["s"] > 0.75 * row["b"]


def test_codes_and_mixed_bits_are_probabilities():
    """In any place of a text the probabilities of all symbols add up to one, trained or not."""
    words = [b"", b"a", b"b", b"c", b"dd"]
    model = language_model.WordMixer(words, [40, 30, 9, 9, 1], 5, 100)
    assert sorted(np.diff(model.start))[0] == 1 and len(model.start) == 7
    texts = [[b"a", b"b", b"a", b"b", b"zz", b""], [b"a", b"b", b"c", b""]] * 4
    table = np.zeros(2 * model.offsets[-1], np.uint32)
    model.add_counts(table, texts)
    model.table = table.reshape(-1, 2).astype(np.uint8)
    for _ in range(2):
        for prefix in ([], [b"a"], [b"a", b"b", b"a"], [b"zz", b"q"]):
            every = [prefix + [w] for w in [*words, b"other"]]
            got = model.log2(every + [prefix + [b"a"]], np.ones(len(every) + 1, bool)) - (model.log2([prefix], np.ones(1, bool))[0] if prefix else 0)
            assert abs((2 ** got[: len(every)]).sum() - 1) < 1e-4 and abs(got[-1] - got[1]) < 1e-6
        model.train(texts, np.ones(len(texts), bool))
    # a training token gives back what it gave: what stands once in training has no counts after two words
    table[:] = 0
    text = [[b"c", b"dd", b"a", b""]]
    model.add_counts(table, text)
    model.table = table.reshape(-1, 2).astype(np.uint8)
    assert not model.inputs(model.chunk(text), np.zeros(1, bool))[0][2].any() and model.inputs(model.chunk(text), np.ones(1, bool))[0][2].all()


def test_own_counts_and_contexts_by_brute_force():
    model = language_model.WordMixer([b"", b"a", b"b"], [5, 4, 3], 2, 50)
    rng = random.Random(3)
    texts = [[rng.choice([b"a", b"b", b"x", b"y"]) for _ in range(20)] + [b""] for _ in range(3)]
    c = model.chunk(texts)
    pairs = model.seen_before(c["text"][c["token"]], [c["node"].astype(np.uint16)], c["bit"])
    one = (c["one"] % np.uint64(5)).astype(np.uint16)[c["token"]]
    both, held = model.seen_before(c["text"][c["token"]], [c["node"].astype(np.uint16), one], c["bit"]), Counter()
    for i, k in enumerate(zip(c["text"][c["token"]], c["node"], one)):
        assert both[i] == held[k, 0] + 256 * held[k, 1]
        held[k, c["bit"][i]] += 1
    seen = Counter()
    for i, (t, n, b) in enumerate(zip(c["text"][c["token"]], c["node"], c["bit"])):
        assert pairs[i] == seen[t, n, 0] + 256 * seen[t, n, 1]
        seen[t, n, b] += 1
    # equal slots of the second context: equal node and equal two words before
    names = [w for t in texts for w in t]
    place = [i for t in texts for i in range(len(t))]
    two = [(names[i - 1] if place[i] else None, names[i - 2] if place[i] > 1 else None) for i in range(len(names))]
    key = {}
    for tok, n, slot in zip(c["token"], c["node"], c["slots"][2]):
        assert key.setdefault((two[tok], n), slot) == slot


def test_word_order_counts(spark):
    """Texts in the order of training texts score far above the same words shuffled: contexts that cross words decide."""
    rng = random.Random(12)
    after = {w: [rng.randrange(200) for _ in range(3)] for w in range(200)}

    def text():
        at, out = rng.randrange(200), []
        for _ in range(80):
            out.append(f"w{at}")
            at = rng.choice(after[at])
        return out

    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    rows, swapped = [], set()
    for i in range(800):
        words = text()
        if held(i) and i % 2:
            rng.shuffle(words)
            swapped.add(i)
        rows.append((i, " ".join(words)))
    got = language_model.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).filter("held_out").collect()
    mean = lambda of: sum(r["score"] for r in of) / len(of)
    plain, mixed = [r for r in got if r["doc_id"] not in swapped], [r for r in got if r["doc_id"] in swapped]
    assert mean(plain) > 0.7 * mean(mixed) and mean(plain) > 0.6 * sum(r["base_score"] for r in plain) / len(plain)


# op3


def links_of(rows, threshold=0.9):
    good = {i: np.array(v, float) / max(map(abs, v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    return [(a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] / (np.linalg.norm(good[a]) * np.linalg.norm(good[b])) >= threshold]


def test_embedding_groups_match_brute_force(spark):
    rng = np.random.default_rng(4)
    rows, base = [], rng.normal(size=(40, 8))
    for i in range(240):
        v = base[i % 40] + rng.normal(size=8) * 0.15 * (i % 5)
        rows.append((i, [float(np.float32(x)) for x in (v if i % 7 else base[i % 40] * 3)]))
    rows += [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] + [1.0] * 7), (1003, []), (1004, [1.0] * 7), (1005, [None] + [1.0] * 7), (1006, [float("inf")] + [1.0] * 7), (1007, rows[3][1]), (1008, [1e30 * x for x in rows[3][1]])]
    table = extra(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    pairs = links_of([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows])
    up = {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    n = Counter(x for p in pairs for x in p)
    want = sorted((i, n[i], find(i), find(i) == i) for i, _ in rows)
    for tile in (4096, 16):
        got = sorted(tuple(r) for r in embedding_groups(table, tile=tile, sample_rows=50).collect())
        assert got == want
    assert embedding_groups(table.limit(0)).count() == 0
    assert embedding_groups(table.filter("vec_id between 1000 and 1003")).filter("kept and n_links = 0").count() == 4


def test_embedding_groups_of_several_lengths(spark, monkeypatch):
    """Vectors of rarer lengths and of huge and tiny components link within their length."""
    from gneiss.llm import embeddings

    rng = np.random.default_rng(9)
    rows = [(i, list(map(float, rng.normal(size=8)))) for i in range(40)]
    rows += [(100 + k, [3e200 * x for x in (1.0, 2.0, 3.0 + k / 50)]) for k in range(3)] + [(200 + k, [1e-200, 2e-200 * (k + 1)]) for k in range(3)]
    rows += [(300 + k, [1.0 + k % 2]) for k in range(3)] + [(400 + k, [1.0] * 12 + [float(k % 4)]) for k in range(30)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    n = Counter(x for p in links_of(rows) for x in p)
    assert n[100] == 2 and n[300] == 2 and n[400] > 5
    for lengths in (16, 1):
        monkeypatch.setattr(embeddings, "LENGTHS", lengths)
        got = {r["vec_id"]: r["n_links"] for r in embedding_groups(table, tile=8, sample_rows=50).collect()}
        assert got == {i: n[i] for i, _ in rows}


def test_compare_stops_early_without_loss():
    rng = np.random.default_rng(1)
    x = unit(np.repeat(rng.normal(size=(150, 64)), 2, axis=0) + rng.normal(size=(300, 64)) * 0.02)
    order = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    got = {(int(i), int(j)) for i, j, c in compare(x @ order, x @ order, 0.9, True) for i, j in zip(i[c >= 0.9], j[c >= 0.9])}
    full = x @ x.T
    assert got == {(i, j) for i in range(300) for j in range(i + 1, 300) if full[i, j] >= 0.9} and got


# op4


def slow_targets(sizes, weights):
    total, target, free = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        left = total - sum(target[i] for i in range(len(sizes)) if i not in free)
        for i in free:
            target[i] = left * weights[i] / sum(weights[k] for k in free)
        over = {i for i in free if target[i] > 3 * sizes[i]}
        if not over:
            break
        for i in over:
            target[i] = 3.0 * sizes[i]
        free -= over
    return target


def test_targets(spark):
    rng = random.Random(8)
    for _ in range(6):
        sizes = [rng.choice([0, 1, 5, 1000, rng.randrange(10**6)]) for _ in range(rng.randrange(1, 9))]
        weights = [1.0 + i % 3 for i in range(len(sizes))]
        frame = mixing.shares(spark.createDataFrame([(i, s, w) for i, (s, w) in enumerate(zip(sizes, weights))], "i int, s long, w double"), sum(sizes))
        got = [r["target"] for r in frame.orderBy("i").collect()]
        assert all(abs(a - b) <= 1e-6 * max(1, b) for a, b in zip(got, slow_targets(sizes, weights)))
        assert abs(sum(got) - sum(sizes)) <= 1e-6 * max(1, sum(sizes))


def test_many_sources_are_ranked_and_mixed_alike(spark, monkeypatch):
    """Sorted parts and joins of many sources give what one part and broadcasts give."""
    rng = random.Random(17)
    rows = [(i, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(0, 40))), "s%d" % rng.randrange(90)) for i in range(600)] + [(700, "x y", None), (701, "z", "S")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted(map(tuple, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "PART", 7)
    monkeypatch.setattr(mixing, "SMALL", 3)
    got = sorted(map(tuple, mixing.mix(docs).collect()))
    assert [g[:3] for g in got] == [w[:3] for w in want] and all(abs(g[3] - w[3]) < 1e-6 for g, w in zip(got, want))
    by = {}
    for i, _, s in rows:
        by.setdefault(s, []).append(i)
    taken = {g[0]: g for g in got}
    for ids in by.values():
        assert abs(sum(taken[i][4] for i in ids) - taken[ids[0]][3]) <= max(2, 0.01 * taken[ids[0]][3])


def test_mix_reaches_targets_and_repeats(spark):
    rng = random.Random(9)
    rows = [(i, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(1, 80))), rng.choice(["a", "a", "a", "B", "é", None])) for i in range(400)]
    rows += [(500, None, "a"), (501, " \t", "empty"), (502, "one", "tiny"), (502, "one", "tiny"), (None, "no id here", "a")]
    docs = extra(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()), key=repr)
    source = {i: s for i, _, s in rows}
    for name in set(source.values()):
        mine = [r for r in got if source[r["doc_id"]] == name]
        size, target, taken = sum(r["size"] for r in mine), mine[0]["target"], sum(r["taken"] for r in mine)
        assert all(r["source_size"] == size and r["target"] == target for r in mine)
        assert abs(taken - target) <= max(2, 0.01 * target)
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in mine)
    order = sorted(set(source.values()), key=lambda s: (s is None, s or ""))
    sizes = [next(r["source_size"] for r in got if source[r["doc_id"]] == s) for s in order]
    want = dict(zip(order, slow_targets(sizes, [1 + i % 3 for i in range(len(order))])))
    assert all(abs(r["target"] - want[source[r["doc_id"]]]) < 1e-6 for r in got)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    copies = Counter(r["doc_id"] for r in mixed.collect())
    assert all(abs(copies[r["doc_id"]] - r["taken"] / r["size"]) <= 0.51 for r in got if r["size"] and r["doc_id"] not in (None, 502))
    assert mixing.mix(docs.limit(0)).count() == 0


# op5


def test_plan_places_every_item():
    rng = random.Random(1)
    cases = [{1: 5000}, {2048: 3, 1: 1}, {600: 7}, {1500: 10, 549: 10, 3: 5}, {512: 9}, {}, {x: 1 for x in range(1, 2049)}]
    cases += [dict(Counter(min(2048, max(1, int(rng.lognormvariate(m, s)))) for _ in range(n))) for m, s, n in ((6, 1.2, 4000), (3, 2, 3000), (7, 0.3, 500))]
    for histogram in cases:
        seqs, seen = {}, Counter()
        for length, first, items, copies, offset, sequence in sorted(packing.plan(dict(histogram))):
            assert first == seen[length]
            seen[length] += items
            for r in range(items):
                seqs.setdefault(sequence + r // copies, []).append((offset + r % copies * length, length))
        assert seen == Counter(histogram)
        for held in seqs.values():
            end = 0
            for offset, length in sorted(held):
                assert offset == end
                end += length
            assert end <= 2048
        total = sum(x * n for x, n in histogram.items())
        large = sum(n for x, n in histogram.items() if x > 1024)
        assert len(seqs) <= 1.1 * max(-(-total // 2048), large) + 3


def test_pack_cuts_and_hashes_ids(spark):
    encode = packing.public_encoder()
    long = " ".join(f"word{i} é" for i in range(3000))
    rows = [(3, "short text"), (1, None), (2, ""), (4, long), (5, "a <|endoftext|> b"), (6, "short text"), (6, "short text"), (None, "x"), (7, " " * 50 + "\n\n日本語 ½")]
    docs = extra(spark.createDataFrame(rows, "doc_id long, text string"))
    got = packing.pack(docs).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for i, t in rows:
        ids = np.array([*encode.full.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        mine = sorted(by[i], key=lambda r: r["piece"])
        if i == 6:
            assert len(mine) == 2 and mine[0]["ids_crc32"] == mine[1]["ids_crc32"]
            continue
        assert [r["start"] for r in mine] == [0, *np.cumsum([r["length"] for r in mine])[:-1]] and sum(r["length"] for r in mine) == len(ids)
        assert all(r["length"] == 2048 for r in mine[1:])
        assert all(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in mine)
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in got)
    for (s, o, n), (s2, o2, _) in zip(places, places[1:]):
        assert o2 == (o + n if s == s2 else 0)
    assert packing.pack(docs.limit(0)).count() == 0


def test_pieces_have_the_ids_of_whole_texts(spark):
    """Over all of sf0.1, over every character whose class the pattern is trusted with, and over special and strange texts."""
    encode = packing.public_encoder()
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").collect()]
    agreed = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and not encode.whole.search(chr(c))]
    assert len(agreed) > 30_000
    texts += ["".join(f"a{c}1{c}! {c}\n{c}" for c in agreed[at : at + 200]) for at in range(0, len(agreed), 200)]
    texts += ["a <|endoftext|> b", "<|endoftext|>", "\u0530\u20c0 x", " " * 5000 + "x", "x" * 20_000, "\U0001f600 ok", ""]
    whole = encode.full.encode_batch(texts, add_special_tokens=False)
    assert all(encode(t).tolist() == w.ids for t, w in zip(texts, whole))
    assert sum(encode.whole.search(t) is not None for t in texts[:10_000]) < 500


def test_packing_encodes_new_pieces_of_many_texts_at_once():
    """A call of the tokenizer for each text's few new pieces was most of the work; longest pieces are not kept."""
    encode = packing.Encoder(packing.public_encoder().full_path, packing.public_encoder().pattern)
    texts = [f"own{i} word, é{i}" for i in range(200)] + ["x" * 500, "a <|endoftext|> b", "", " \x1c\n  y"]
    calls, plain = [], encode.encoded
    encode.encoded = lambda t: calls.append(len(t)) or plain(t)
    got = encode.packed(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [encode.full.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(calls) == 2 and max(map(len, encode.ids)) <= packing.LONGEST


def test_packing_encodes_many_pieces_as_one_text():
    """A text of its own for each new piece took about half of the time of packing."""
    encode = packing.Encoder(packing.public_encoder().full_path, packing.public_encoder().pattern)
    text = " ".join(f"wörd{i}x, {i} ({i}) it's" for i in range(3000)) + "\n\n a \t b\x1c\x85c  'd''s \u3000e "
    calls, plain = [], encode.encoded
    encode.encoded = lambda t: calls.append(len(t)) or plain(t)
    assert encode(text).tolist() == encode.full.encode(text, add_special_tokens=False).ids
    assert sum(calls) < 20 and len(encode.ids) > 3000


def test_packing_keeps_frequent_pieces_and_no_more_than_its_limit(monkeypatch):
    """Kept pieces were all dropped when full; texts of another kind take their place."""
    monkeypatch.setattr(packing, "KEPT", 200)
    encode = packing.Encoder(packing.public_encoder().full_path, packing.public_encoder().pattern)
    new, plain = [], encode.of_pieces
    encode.of_pieces = lambda p: new.extend(p) or plain(p)
    word = lambda kind, i: kind + "".join("abcdefghij"[int(c)] for c in str(i))
    often = [word("often", i) for i in range(50)]
    for k in range(20):
        texts = [" ".join([*often, *(word("rare", 100 * k + j) for j in range(20))])]
        assert encode.packed(texts) == encode.encoded(texts)
        assert 60 < len(encode.ids) <= 200 and " oftenb" in encode.ids
    assert new.count(" oftenb") == 1
    other = [" ".join(word("neu", i) for i in range(120))]
    assert encode.packed(other) == encode.encoded(other) and " oftenb" not in encode.ids and " neub" in encode.ids



# op6


def test_chat_windows_round_trip(spark):
    rng = random.Random(3)
    marks = ["\\", "#", "### user: ", "</turn>\n", ":", "\\s", "\\l", "plain", "é\n", "\\c:", "<"]
    rows = []
    for conv in range(30):
        for turn in range(rng.randrange(1, 14)):
            role = "system" if turn == 0 and conv % 3 == 0 else rng.choice(["user", "assistant", None, "a: b"])
            rows.append((conv, turn, role, "".join(rng.choice(marks) + " " * rng.randrange(2) for _ in range(rng.randrange(30)))))
    rows += [(50, None, "assistant", None), (50, 0, "user", "x"), (50, 0, "user", "x"), (None, 1, "assistant", "lost"), (51, 0, "system", "rules " * 40), (51, 1, "assistant", "y " * 300)]
    rows += [(52, 0, "system", "rules " * 8)] + [(52, k, "user", "y " * (k % 9)) for k in range(1, 40)]
    table = extra(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    windows = chat_windows(table, budget=40, history=12)
    assert windows.filter("n_context > 0").count() > 10
    want = []
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        text = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in turns)
        loss = "".join(t or "" for _, _, r, t in turns if r == "assistant")
        want.append((conv, len(turns), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    got = read_back(windows).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    for r in windows.filter("conv_id = 52").collect():
        assert r["formatted"].startswith("### system: rules")
    assert read_back(chat_windows(table.limit(0))).count() == 0


def slow_windows(sizes, system, budget, history, section):
    """[(context turns, own turns)] by walking through the turns."""
    out, used, before = [], None, 0
    starts = [sum(sizes[:i]) for i in range(len(sizes))]
    for i, size in enumerate(sizes):
        if used is None or used + size > budget or starts[i] // section != before:
            rules = [0] if system and i else []
            kept = [j for j in range(len(rules), i) if starts[j] >= starts[i] - history and not (system and j == 0)]
            for context in (rules + kept, rules, []):
                if not i or sum(sizes[j] for j in context) + size <= budget:
                    break
            context = context if i else []
            out.append((context, []))
            used = sum(sizes[j] for j in context)
        out[-1][1].append(i)
        used, before = used + size, starts[i] // section
    return out


def test_chat_windows_keep_the_budget(spark, monkeypatch):
    """Windows against a plain walk, with turns, system turns and histories larger than the budget."""
    from gneiss.llm import chat

    monkeypatch.setattr(chat, "SECTION", 4)
    rng = random.Random(21)
    rows, talks = [], {}
    for conv in range(60):
        system = conv % 2 == 0
        words = [rng.choice([0, 1, 3, 9, 20, 37, 38, 39, 120]) if rng.random() < 0.8 else rng.randrange(60) for _ in range(rng.randrange(1, 40))]
        talks[conv] = system, [w + 2 for w in words]
        rows += [(conv, k, "system" if system and k == 0 else rng.choice(["user", "assistant"]), " ".join([f"t{k}"] * w)) for k, w in enumerate(words)]
    got = chat_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=40, history=15).collect()
    for conv, (system, sizes) in talks.items():
        mine = sorted((r for r in got if r["conv_id"] == conv), key=lambda r: r["window"])
        want = slow_windows(sizes, system, 40, 15, 160)
        assert [(r["n_context"], r["size"], r["formatted"].count("</turn>")) for r in mine] == [(len(c), sum(sizes[j] for j in c + o), len(c + o)) for c, o in want]
        assert all(r["size"] <= 40 or r["formatted"].count("</turn>") == 1 for r in mine)


def test_chat_runs_without_python(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    plan = read_back(chat_windows(table))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


# op7

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body class="post">
<header><h1>Site</h1></header><div id="cookie-notice">We use cookies</div><nav><ul><li>Menu<li>More</ul></nav>
<div class="ad">Buy</div><article><header><h1>Title &amp; more</h1></header><p>One&nbsp;<b>bold <i>x</i></b>
 two<br>three<p>Four &lt;5 &#233;<ul><li>a<li>b</ul><form><input><p>mail</p></form><aside>side</aside><div class="related-posts"><p>r</p></div>
<table><tr><td>c1<td>c2</table><!-- gone --><p class="lead">End<div hidden>h</div><section class="comments"><p>first!</p></section></article>
<div class="sidebar"><p>s</p></div><footer>&copy; x</footer></body></html>"""


def test_blocks_of_a_page():
    texts = lambda page: html_text.best(html_text.blocks(page)[0])
    assert texts(PAGE) == ["Title & more", "One bold x two three", "Four <5 é", "a", "b", "c1", "c2", "End"]
    assert texts("plain <b>text</b> a < b &amp; c") == ["plain text a < b & c"]
    assert html_text.blocks("") == ([], []) and html_text.blocks("<p")[0] == [("<p", 0, False)]
    assert texts('<p title="a>b" class=x>q</p><p "unclosed>r</p>') == ["q", "r"]
    # hidden inline parts leave their sentence whole; a block ends them
    assert texts('<p>one <span hidden>x <i>y</i></span>two</p>') == ["one two"]
    assert texts('<div>one <span class="ad">x<div>y</div></span>two</div>') == ["one", "y", "two"]
    # what tags set apart is read too, and marked
    assert [t for t, _, m in html_text.blocks(PAGE)[0] if m] == ["Site", "We use cookies", "Menu", "More", "Buy", "mail", "side", "r", "h", "first!", "s", "© x"]


def test_deep_pages_cost_no_more_than_their_length():
    import time

    for page in ("<div>x" * 40_000, "<div>" * 40_000 + "deep", "<div>x" * 20_000 + "</div>y" * 20_000):
        began = time.time()
        found, subtrees = html_text.blocks(page)
        assert len(subtrees) <= 40_000 and len(html_text.covered(len(found), subtrees, {h for h, _, _ in subtrees[:5]})) == len(found)
        assert time.time() - began < 5


def test_recurrence_alone_clears_pages_of_one_template(spark):
    rng = random.Random(5)
    words = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma"]) + str(rng.randrange(900)) for _ in range(n))
    rows, want = [], {}
    for i in range(200):
        story = [words(12) for _ in range(3)]
        host = "ab"[i % 2]
        page = f'<nav><ul><li>Start {host}</li><li>News</li></ul></nav><div class="ad">Buy {i % 3}</div><div>{"".join(f"<p>{t}</p>" for t in story)}</div><footer>© {host}</footer>'
        rows.append((i, f"https://{host}.example/{i}", f"<html><body>{page}</body></html>"))
        want[i] = "\n".join(story)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    alone = {r["page_id"]: r for r in html_text.main_text(pages, marks=False).collect()}
    assert all(alone[i]["text"] == want[i] and alone[i]["n_template"] == 4 and alone[i]["n_marked"] == 0 for i in want)
    neither = {r["page_id"]: r["text"] for r in html_text.main_text(pages, marks=False, least_pages=10**9).collect()}
    assert not any(neither[i] == want[i] for i in want)
    few = {r["page_id"]: r for r in html_text.main_text(pages.limit(6)).collect()}
    assert all(r["text"] == want[i] and r["n_template"] == 0 and r["n_marked"] == 4 for i, r in few.items())


def test_templates_of_a_host_go(spark):
    page = lambda i, host: f"<html><body><div><p>Welcome to the site of all sites</p></div><div><p>Story {i} tells of {i * 7}</p><p>Shared saying</p></div><div><span>Call us</span></div></body></html>"
    rows = [(i, f"https://h.example/{i}", page(i, "h")) for i in range(12)] + [(100 + i, f"http://few.example/{i}", page(i, "few")) for i in range(3)]
    # copies of one page are no template
    rows += [(200 + i, "https://copy.example/a", "<html><body><div><p>The same words each time</p></div></body></html>") for i in range(20)]
    article = lambda i: f"<article><p>Passage in all</p><p>own {i}</p><div>Share this<p>now</p></div></article>"
    rows += [(300 + i, f"https://art.example/{i}", article(i)) for i in range(12)] + [(400, None, None), (401, "x", ""), (None, "https://n", "<p>n</p>")]
    pages = extra(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.main_text(pages).collect()}
    assert len(got) == len(rows)
    # the shared paragraph lies outside an article, so nothing tells it from a template
    assert got[5][0] == "Story 5 tells of 35"
    assert got[101][0].startswith("Welcome") and got[205][0] == "The same words each time"
    assert got[303][0] == "Passage in all\nown 3"
    assert got[400] == ("", 0) and got[401] == ("", 0) and got[None] == ("n", 1)
    assert html_text.main_text(pages.limit(0)).count() == 0


def slow_text(pages):
    """Text of well-formed pages of known tags, templates counted by plain Python over trees: {id: text}."""
    import xml.etree.ElementTree as ET
    from collections import defaultdict

    shape = lambda e: (e.tag, (e.text or "").strip(), tuple(shape(c) for c in e))
    trees = {i: (url.split("/")[2], ET.fromstring(page)) for i, url, page in pages}
    group = {"div", "section", "ul"}

    def leaves(e, gone, rank):
        rank = 2 if e.tag == "article" else max(rank, 1 if e.tag == "main" else 0)
        if e.tag != "html" and (rank < 2 or e.tag in group) and e.tag not in ("body", "main", "article") and shape(e) in gone:
            return []
        return ([((e.text or "").strip(), rank)] if (e.text or "").strip() else []) + [x for c in e for x in leaves(c, gone, rank)]

    top = lambda found: "\n".join(t for t, r in found if r == max(x for _, x in found))
    seen, hosts = defaultdict(set), defaultdict(set)
    for host, tree in trees.values():
        article = top(leaves(tree, set(), 0))
        hosts[host].add(article)
        for e in tree.iter():
            seen[host, shape(e)].add(article)
    gone = lambda host: {s for (h, s), a in seen.items() if h == host and len(a) >= 8}
    return {i: top(leaves(tree, gone(host), 0)) for i, (host, tree) in trees.items()}


def site_pages():
    """Hosts with several page templates without article elements: menus of sections, author boxes, notices, and stories."""
    rng = random.Random(13)
    words = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rng.randrange(400)) for _ in range(n))
    boxes = {h: [f"<div><p>{words(8)}</p><ul><li>{words(2)}</li><li>{words(3)}</li></ul></div>" for _ in range(6)] for h in ("a", "b")}
    rows, want = [], {}
    for i in range(160):
        host, story = "ab"[i % 2], [words(rng.randrange(4, 20)) for _ in range(rng.randrange(1, 5))]
        box, foot = boxes[host][i % 3 * 2], boxes[host][i % 3 * 2 + 1]
        body = "".join(f"<p>{t}</p>" for t in story)
        inner = (f"{box}<div>{body}</div>{foot}", f"{box}<main>{body}</main>{foot}", f"<div><div>{box}</div><section>{body}{foot}</section></div>")[i % 5 % 3]
        rows.append((i, f"https://{host}.example/{i % 7}/{i}", f"<html><body>{inner}</body></html>"))
        want[i] = "\n".join(story)
    return rows, want


def test_templates_decide_pages_without_articles(spark):
    rows, want = site_pages()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.main_text(pages).collect()}
    assert got == slow_text(rows) == want
    # with template removal switched off most pages keep their boxes
    off = {r["page_id"]: r["text"] for r in html_text.main_text(pages, least_pages=10**9).collect()}
    assert sum(off[i] != want[i] for i in want) >= 0.6 * len(want)


# op9


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automata_agree_with_edit_distance():
    rng = random.Random(7)
    terms = ["scum", "loser", "pathetic", "disgusting", "vequ*"]
    lexicon = toxicity.Lexicon(terms)
    words = set(terms[:4])
    for t in terms[:4]:
        for _ in range(300):
            w = list(t)
            for _ in range(rng.randrange(1, 4)):
                at = rng.randrange(len(w))
                w[at : at + rng.randrange(2)] = rng.choice(["", "x", "e", "0"])
                w = w or ["s"]
            words.add("".join(w))
    for w in words:
        near = [edits(w, t) for t in terms[:4] if w and t[0] == w[0] and edits(w, t) <= (2 if len(t) >= 9 else 1 if len(t) >= 5 else 0)]
        if not w.startswith("vequ"):
            # a first letter is never edited, so a pair whose least edits all touch it may be missed
            assert lexicon.hit(w) in ({min(near)} if near else {-1}) or edits(w[1:], next(t for t in terms if t[0] == w[0])[1:]) > 1
    assert lexicon.hit("vequta") == 0 and lexicon.hit("veq") == -1


def test_stems_and_first_letters_take_edits():
    rng = random.Random(8)
    terms = ["scum", "loser", "disgusting", "vequ*", "idiot*", "morondal*"]
    lexicon = toxicity.Lexicon(terms, first=True)
    budget = {"scum": 0, "loser": 1, "disgusting": 2, "vequ*": 0, "idiot*": 1, "morondal*": 1}

    def nearest(w):
        found = []
        for t in terms:
            heads = [w[:n] for n in range(len(w) + 1)] if t.endswith("*") else [w]
            least = min(edits(h, t.rstrip("*")) for h in heads)
            found += [least] if least <= budget[t] else []
        return min(found, default=-1)

    words = {"xdiotic", "idjotic", "diotas", "iidiots", "0oser", "oser", "loserx", "veqa", "xequ", "scim", "idio", "morandaling", ""}
    for _ in range(1500):
        w = list(rng.choice(terms).rstrip("*") + rng.choice(["", "s", "ing"]))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(w))
            w[at : at + rng.randrange(2)] = rng.choice(["", "x", "e", "0"])
            w = w or ["s"]
        words.add("".join(w))
    assert all(lexicon.hit(w) == nearest(w) for w in words)
    assert [lexicon.hit(w) for w in ("xdiotic", "idjotic", "0oser", "veqa")] == [1, 1, 1, -1]


def test_toxicity_learns_and_scores(spark):
    rng = random.Random(5)
    plain = [f"wort{chr(97 + i % 26)}{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(plain) for _ in range(rng.randrange(5, 60))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["Loser!", "idiot", "vequ" + rng.choice(["ta", "mo", "zz"])]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(700, None), (701, ""), (702, "you lo5er and idi0t " + " ".join(plain[:10])), (None, "idiot loser"), (703, "fine words " * 20000)]
    labels += [(3, None), (999, 1)]
    docs = extra(spark.createDataFrame(rows, "doc_id long, text string"))
    marks = extra(spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, marks).collect()}
    assert len(got) == len(rows)
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] == (i in held) for i in range(600))
    assert all(got[i]["predicted"] == (i % 5 == 0) for i in held)
    assert [got[i]["predicted"] for i in (700, 701, 702, 703)] == [0, 0, 1, 0] and got[None]["predicted"] == 1
    kept = toxicity.drop_toxic(docs, marks)
    assert kept.columns == docs.columns and kept.filter("doc_id < 600").count() == 480
    assert toxicity.toxicity(docs.limit(0), marks).count() == 0
    assert {r["score"] for r in toxicity.toxicity(docs, marks.limit(0)).collect()} == {0.5}


def test_quotation_counts_less():
    lexicon = toxicity.Lexicon(["loser", "idiot"])
    direct, quoted = lexicon.features("you are a loser and that is all"), lexicon.features('he was "a loser" once again they')
    assert direct[1] > quoted[1] > 0 and quoted[2] > 0 and direct[2] == 0
    assert lexicon.features("nothing here") == [0.0] * toxicity.FEATURES == lexicon.features(None)


def test_edits_and_context_decide(spark):
    """On held-out rows misspelled terms are found by edits alone, and quotations stay clean by context alone."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").filter("length(text) < 3000")
    rows = docs.select("doc_id", "text", "toxic").collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    train = {r["text"]: r["toxic"] for r in rows if not held(r["doc_id"])}
    terms, ordinary, loose, w = toxicity.learn(spark.createDataFrame(list(train.items()), "text string, toxic int"))
    plain = toxicity.Lexicon(terms, first=True)

    def positives(texts, **how):
        lexicon = toxicity.Lexicon(terms, ordinary, loose, **how)
        x = np.array([lexicon.features(t) for t in texts])
        return int((1 / (1 + np.exp(-(x @ w[:-1] + w[-1]))) >= 0.7).sum())

    wrong = [m for r in rows if held(r["doc_id"]) and r["toxic"] and (m := toxicity.misspelled(r["text"], plain))]
    words = [t for t in terms if not t.endswith("*")]
    clean = [r["text"] for r in rows if held(r["doc_id"]) and not r["toxic"]][:600]
    quotes = [toxicity.quoting(t, words) for t in clean]
    assert positives(wrong, first=True) >= 0.8 * len(wrong) and positives(wrong, exact=True) <= 0.7 * len(wrong)
    assert positives(quotes, first=True) <= 0.01 * len(quotes) and positives(quotes, first=True, context=False) >= 0.1 * len(quotes)
    assert positives(clean, first=True) <= 0.005 * len(clean)


# op10

#: Statements as projects write them; none is a template, most are broken over lines.
NOTICES = {
    "gpl": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell",
    "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:\n\n1. Redistributions of source code must retain the above copyright\n   notice, this list of conditions and the following disclaimer.",
    "apache": "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "agpl": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as\npublished by the Free Software Foundation, either version 3 of the\nLicense, or (at your option) any later version.",
    "lgpl": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.",
    "cc-by-sa": "Figures in this chapter may be shared under CC BY-SA 4.0\nwherever their makers are named",
}
#: Licences of no family here, and prose that shares words with statements.
STRANGE = [
    "This program is made available under the Eclipse Public License v2.0",
    "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.",
    "The season's license to visit the general public house is free under the terms of the house",
    "Licensed under the EUPL version 1.2 by the public office of the general staff",
    "All rights reserved.",
]


def licence_corpus():
    rng = random.Random(6)
    filler = ["thon", "rean", "von", "der", "and", "public", "license", "under", "general", "house"]
    line = lambda: " ".join(rng.choice(filler) for _ in range(rng.randrange(3, 25)))
    rows, want = [], {}
    for i in range(240):
        lines = [line() for _ in range(rng.randrange(1, 6))]
        if i % 4 == 0:
            name = list(NOTICES)[i // 4 % len(NOTICES)]
            lines.insert(rng.randrange(len(lines) + 1), NOTICES[name])
            want[i] = name
        rows.append((i, "\n".join(lines)))
    for k, text in enumerate(STRANGE):
        rows.append((300 + k, line() + "\n" + text))
    return rows, want


def slow_families(model, text):
    """Families confirmed by trying every window that starts at a word, of several lengths: plain Python over sets."""
    found = set()
    for paragraph in licences.paragraphs(text):
        words = licences.words_of(paragraph)
        for size in (8, 16, 40, 120):
            for at in range(max(1, len(words) - size + 1)):
                features = set(words[at : at + size]) - {"#"} | {f"{a} {b}" for a, b in zip(words[at : at + size], words[at + 1 : at + size])}
                p = model.scores(features)
                k = max(range(len(p) - 1), key=lambda k: p[k])
                shares = {}
                for f, t, own in model.templates:
                    if 2 * len(own & features) >= len(own):
                        shares[f] = max(shares.get(f, 0), len(t & features) / len(t))
                best = shares.get(licences.FAMILIES[k], 0)
                if p[k] >= model.least and best >= 0.5 and best == max(shares.values()):
                    found.add(licences.FAMILIES[k])
    return found


def test_licences_are_found_and_confirmed(spark):
    rows, want = licence_corpus()
    two = "word " * 50 + "This module is offered under the MIT license " + "zebra " * 200 + " figures may be shared under CC BY-SA 4.0 " + "word " * 30
    rows += [(900, None), (901, ""), (None, NOTICES["mit"]), (902, "word " * 30000 + NOTICES["gpl"].replace("\n", " ") + " word" * 50), (903, two), (904, NOTICES["apache"] + "\n\n" + NOTICES["bsd"]), (904, "x")]
    docs = extra(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {}
    for r in licences.licence_scan(docs).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    one = {i: r[0] for i, r in got.items() if len(r) == 1}
    assert {i: one[i]["licence"] for i in range(240)} == {i: want.get(i, licences.UNKNOWN) for i in range(240)}
    assert all(one[i]["families"] == [f] and one[i]["n_paragraphs"] >= 1 for i, f in want.items())
    assert all(one[300 + k]["licence"] == licences.UNKNOWN for k in range(len(STRANGE)))
    assert one[900]["licence"] == one[901]["licence"] == licences.UNKNOWN and one[None]["licence"] == "mit" and one[902]["licence"] == "gpl"
    assert one[903]["families"] == ["cc-by-sa", "mit"]
    assert sorted(r["families"] for r in got[904]) == [[], ["apache", "bsd"]]
    assert licences.licence_scan(docs.limit(0)).count() == 0


def test_marked_windows_find_what_all_windows_find(spark):
    rows, want = licence_corpus()
    model = licences.fit(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    for i, text in rows[:80] + rows[240:]:
        found = {w[0] for p in licences.paragraphs(text) for w in model.statements(p) if w[3]}
        assert found == slow_families(model, text) == ({want[i]} if i in want else set())


def test_all_windows_of_all_texts_are_counted(spark):
    """A sample of texts would misjudge word pairs whose share of all windows is near the limit, and miss what lies late in a text."""
    rng = random.Random(8)
    some = sorted({p for w in licences.TEMPLATES["gpl"] for p in zip(licences.words_of(w), licences.words_of(w)[1:]) if "#" not in p})[:30]
    texts = [["zebra"] * 120 * rng.randrange(2, 4) for _ in range(1500)]
    for k, p in enumerate(some):  # each in 5 windows more than the one before, in different texts, never in the first window
        for i in rng.sample(range(len(texts)), 5 * k + 1):
            at = rng.choice([j for j in range(121, len(texts[i]) - 3) if texts[i][j : j + 3] == ["zebra"] * 3])
            texts[i][at + 1 : at + 3] = p
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    windows = [set(zip(w[a : a + 120], w[a + 1 : a + 120])) for w in texts for a in range(0, len(w), 120)]
    usual = {p for p in some if sum(p in w for w in windows) > licences.USUAL * len(windows)}
    assert 5 < len(usual) < 28
    pairs = licences.fit(docs, "doc_id", "text").pairs
    assert {p for p in some if p not in pairs} == usual


def test_classifier_and_templates_both_decide(spark):
    """Without the classifier's unknown class, or without templates, strange licences would pass."""
    rows, _ = licence_corpus()
    model = licences.fit(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    model.least = 0.0
    assert any(model.statements(t) for t in STRANGE)
    assert not any(w[3] for t in STRANGE for w in model.statements(t))
