"""Base spans against the contract's plain patterns; added spans on statements that are not among the seeds."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from gneiss.llm import personal

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base(text):
    checks = {
        "email": lambda x, d: True,
        "ip": lambda x, d: all(int(p) <= 255 for p in x.split(".")),
        "card": lambda x, d: 13 <= len(d) <= 19 and luhn(d),
        "phone": lambda x, d: 9 <= len(d) <= 15,
    }
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if checks[k](m[0], re.sub("[^0-9]", "", m[0]))]


def written(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def agree(docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = personal.personal_digests(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        want = base(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(written(want).encode()).hexdigest(), (r, want)
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(w[0] == k for w in want) for k in PLAIN]
        spans = [(x[0], int(x[1]), int(x[2])) for x in (s.split(":") for s in r["spans"].split(",") if s)]
        assert set(want) <= set(spans) and spans == sorted(spans, key=lambda s: (list(PLAIN).index(s[0]), s[1], s[2]))
    return {r["doc_id"]: r["spans"] for r in got}


def test_base_spans_of_awkward_texts(spark):
    rng = random.Random(12)
    bits = ["@", ".", "a", "B9", "+", "-", " ", "1", "22", "255", "256", "0", "é", "😀", "(", ")", "_", "%", "4111 1111 1111 1111", "+1 (201) 555-0123", "x@y.zz", "10.0.0.1", "\n"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(40)))) for i in range(1500)]
    rows += [(2000, None), (2001, ""), (2002, "0.0.0.0 000.1.2.255 1.2.3.4.5.6.7.8"), (2003, "a@b.c@d.e x@y a.b.c@d.e.f_g@h.i")]
    agree(spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("x")).withColumn("id", F.lit(0)).withColumn("kind", F.lit(1)))


def test_long_texts_cost_linear_time(spark):
    long = ["9" * 5000, "a" * 5000, "a.b@" * 20_000, "1." * 20_000, "+1" + " " * 200_000 + "x", "a@" + "b." * 20_000, "(1) " * 20_000, "1 " * 50_000, "ab:" * 20_000, "x at " * 20_000]
    agree(spark.createDataFrame(list(enumerate(long)), "doc_id long, text string"))
    # of these the plain patterns take quadratic time
    runs = ["9" * 1_000_000, "a" * 1_000_000 + " @", "a." * 500_000 + " @", "1." * 3 + "2" * 1_000_000]
    got = personal.personal_digests(spark.createDataFrame(list(enumerate(runs)), "doc_id long, text string")).collect()
    assert [r["spans"] for r in got] == [""] * 4


def test_empty_table_and_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "a@b.cc"), (1, "no"), (None, "+1 201 555 0123")], "doc_id long, text string")
    assert personal.personal_digests(docs.limit(0)).count() == 0
    assert sorted((r["doc_id"] or 0, r["n_email"], r["n_phone"]) for r in personal.personal_digests(docs).collect()) == [(0, 0, 1), (1, 0, 0), (1, 1, 0)]


PERSONAL = [
    ("you may call 555 318 4402 until five", "phone"), ("my phone: (044) 555-9034", "phone"), ("mobile 0049 171 555 9911", "phone"), ("her cell is 212-555-0181", "phone"),
    ("reach me by e-mail: li [at] uni [dot] edu", "email"), ("contact pat(at)firm.org soon", "email"), ("write to joe @ host.net", "email"),
    ("server 172[.]16[.]9[.]77 refused", "ip"), ("login from 2001:0:3ef5:12:9:8:7:1", "ip"),
    ("my card 4242.4242.4242.4242 expired", "card"), ("paid by mastercard 5105/1051/0510/5100", "card"),
]
CLEAN = [
    "in 1998 there were 120 of 4500 left", "on 2019-03-07 at 10:45:12", "pages 33-47 and 120-125", "chapter 3.2.1 of part 12", "the ratio was 3:2:1", "they sat at home dot nothing",
    "serial 8844.1100.2233.9987", "lot 12/2018/4471", "build 20.4.1", "pi is 3.14159265358979", "look at the dot there", "12 345 678 people",
]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = "the of and in to some other words here".split()
    filler = lambda: " ".join(rng.choice(words) for _ in range(12))
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    made = [lambda: f"u{number(3)}@mail.example.com", lambda: ".".join(str(rng.randrange(256)) for _ in range(4)), lambda: number(16), lambda: f"+1 ({number(3)}) 555-{number(4)}", lambda: f"{number(4)}-{number(2)}-{number(2)}"]
    return [(1000 + i, f"{filler()} {rng.choice(made)()} {filler()}") for i in range(600)]


def test_added_spans_on_held_out_statements(spark, corpus):
    rows = corpus + [(i, t) for i, (t, _) in enumerate(PERSONAL)] + [(100 + i, t) for i, t in enumerate(CLEAN)]
    got = agree(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sum(f"{kind}:" in got[i] for i, (_, kind) in enumerate(PERSONAL)) >= 9
    assert [t for i, t in enumerate(CLEAN) if got[100 + i]] == []
    texts = dict(rows)
    extra = [texts[i] for i, spans in got.items() if i >= 1000 and spans != written(base(texts[i]))]
    assert extra == []  # plain corpus rows have nothing to add


def test_trees_and_threshold():
    counts = [((k, d, 0, 0, 0, v, 0, 0, c), 50.0 if v and c else 0.0, 0.0 if v and c else 50.0) for k in range(2) for d in range(3) for v in (0, 1) for c in (0, 1)]
    trees = personal.boost(counts)
    score = lambda x: sum(personal.value(t, x) for t in trees)
    least = personal.threshold(counts, trees)
    assert all((score(x) >= least) == (yes > 0) for x, yes, _ in counts)
    assert personal.threshold([(x, 0.0, 1.0) for x, *_ in counts], trees) == float("inf")


def test_redaction(spark):
    row = spark.createDataFrame([("é mail a@b.cc or +1 201 555 0123!",)], "text string")
    spans = F.array(F.struct(F.lit("email").alias("kind"), F.lit(7).alias("start"), F.lit(13).alias("end")), F.struct(F.lit("phone").alias("kind"), F.lit(17).alias("start"), F.lit(32).alias("end")))
    assert row.select(personal.redacted(F.col("text"), spans)).first()[0] == "é mail [email] or [phone]!"
