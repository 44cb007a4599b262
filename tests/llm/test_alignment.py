"""Alignments of segments against whole texts, and the operator against plain counts over all documents."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gneiss.llm import alignment

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(*PATHS)


def whole(aligner, text):
    """Groups of ids of the whole text, by the contract's words, or None."""
    if not text:
        return None
    a, b = aligner.a.encode(f" {text}", add_special_tokens=False).ids, aligner.b.encode(text)
    xs, ys = [aligner.a_bytes[i] for i in a], [aligner.b_bytes[i] for i in b]
    if not b"".join(xs) == f" {text}".encode() == b"".join(ys):
        return None
    ends = lambda parts: [sum(map(len, parts[: i + 1])) for i in range(len(parts))]
    out, i, j, ea, eb = [], 0, 0, ends(xs), ends(ys)
    for e in sorted(set(ea) & set(eb)):
        n, m = ea.index(e) + 1, eb.index(e) + 1
        out.append((a[i:n], b[j:m]))
        i, j = n, m
    return out


def written(found):
    return ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in found)


def test_segments_give_the_whole_texts_tokens(aligner):
    rng = random.Random(3)
    parts = list(" \t\n\r\x0b\x0c\xa0 　\x85\x1c") + list("abcdeéß漢字あ,.;:!'<>/{}()=-_0123😀̀")
    parts += ["foo", "the", "<s>", "<|endoftext|>", "<0x41>", "don't", "\r\n", ");\r\n", "\x00", "▁", "  "]
    assert aligner.cuts == " \t\n\x0b\x0c"  # a piece like `;\r` spans the cut before a carriage return
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 25)))
        segments = re.findall(aligner.pattern, f" {text}")
        assert "".join(segments) == f" {text}"
        got, want = aligner.align(segments), whole(aligner, text)
        assert (None in got) == (want is None)
        assert want is None or ";".join(got) == written(want)


@pytest.mark.parametrize("allowed", ["", " ", " \t\n\x0b\x0c", alignment.CUTS])
def test_short_pattern_has_the_same_matches(allowed):
    rng, find = random.Random(2), alignment.segmenter(allowed)
    for _ in range(2000):
        text = "".join(rng.choice("ab  \t\n" + ("\r\xa0\u3000" if rng.random() < 0.3 else "")) for _ in range(rng.randrange(12)))
        assert find(text) == re.findall(alignment.segment_pattern(allowed), text)


def test_cuts_need_all_tokens():
    assert alignment.cuts([b"ab", b" a", b"\n\n"]) == alignment.CUTS
    assert alignment.cuts([b"a b"]) == "\t\n\x0b\x0c\r"
    assert alignment.cuts([b" \n", b"\xc2\xa0 "]) == " \t\x0b\x0c\r"


def plain(aligner, rows):
    found = [(i, whole(aligner, t)) for i, t in rows]
    links = [Counter((p, q) for a, b in d or () for p in a for q in b) for _, d in found]
    count = Counter(k for own in links for k in own)
    best = Counter()
    for (p, _), c in count.items():
        best[p] = max(best[p], c)
    return [
        (i, sum(len(a) for a, _ in d), sum(len(b) for _, b in d), len(d), own.total(), sum(n for k, n in own.items() if count[k] == best[k[0]]), sum(n * count[k] for k, n in own.items()), hashlib.sha256(written(d).encode()).hexdigest())
        if d else (i, 0, 0, 0, 0, 0, 0, "")
        for (i, d), own in zip(found, links)
    ]


@pytest.mark.parametrize("common", [0, 7, 100_000])
def test_documents_agree_with_plain_counts(spark, aligner, common):
    rng = random.Random(11)
    words = ["the", "of", "größer", "漢字かな", "don't", "x=1;", "tokenization", "(a)", "http://ex.com/a?b", "===="] + [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(words[: 5 + i]) for _ in range(rng.randrange(30)))) for i in range(60)]
    rows += [(70, None), (71, ""), (72, " "), (73, "\n"), (74, "q" * 20_000), (75, "▁ a"), (None, "a b"), (None, ""), (1, "the the"), (1, "the the"), (76, "<|endoftext|> <s>")]
    rows += [(1000 + i, "hot" * 40 + " of") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("x")).withColumn("segment", F.lit(1)).withColumn("n", F.lit(2))
    order = lambda found: sorted(tuple(-1 if v is None else v for v in r) for r in found)
    assert order(alignment.public_alignment(docs, common=common).collect()) == order(plain(aligner, rows))


def test_empty_table_and_kept_groups(spark, aligner):
    docs = spark.createDataFrame([(1, "so it is"), (2, None)], "doc_id long, text string")
    assert alignment.public_alignment(docs.limit(0)).count() == 0
    got = {r["doc_id"]: r["groups"] for r in alignment.public_alignment(docs, keep_groups=True).collect()}
    assert got == {1: written(whole(aligner, "so it is")), 2: ""}
