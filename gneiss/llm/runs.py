"""Periodic runs of words: repeated k-grams mask what cannot join a run, Main-Lorentz finds the runs in the rest.

A run is a stretch of words with smallest period q, of at least `periods` periods and `least` words, that neither neighbouring word
continues. Shifted by its period, it overlaps itself by at least k = overlap(periods, least) words, so every word of it lies in
a k-gram that occurs twice in the document. All other words are masked; only stretches of at least `least` words survive.

Main-Lorentz divides at midpoints: each run is cut by a first one, c, and there its period shows as equal words left or right of c.
All midpoints of one level, of all documents of a slice, are worked at once; what two suffixes share is found by bisection over
polynomial hashes, and each run found is compared word by word, so a collision of hashes costs time, not correctness.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm.shared import NOT_WS

#: Words whose k-grams are looked at together; a longer document makes a slice of its own.
SLICE = 1_000_000
PRIME = (1 << 31) - 1
SCHEMA = "runs array<struct<start:long,length:long,period:long>>, collapsed string"


def overlap(periods: int, least: int) -> int:
    """The fewest words by which a run overlaps itself when shifted by its period."""
    return min(max(least, periods * q) - q for q in range(1, least + 1))


def survivors(words: np.ndarray, doc: np.ndarray, k: int, least: int) -> list[tuple[int, int]]:
    """Stretches (start, end) of at least `least` words of one document that lie in k-grams repeated in it."""
    n = len(words)
    if n < k:
        return []
    grams = n - k + 1
    key = doc[:grams].astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        for j in range(k):
            key = key * np.uint64(0x9E3779B97F4A7C15) + words[j : j + grams].astype(np.uint64)
            key ^= key >> np.uint64(29)
    inside = np.flatnonzero(doc[:grams] == doc[k - 1 :])
    again = inside[pd.Series(key[inside]).duplicated(keep=False).to_numpy()]
    edge = np.zeros(n + 1, np.int32)
    edge[again] += 1
    edge[again + k] -= 1
    covered = np.cumsum(edge[:n]) > 0
    opens = covered & np.r_[True, ~covered[:-1] | (doc[1:] != doc[:-1])]
    closes = covered & np.r_[~covered[1:] | (doc[1:] != doc[:-1]), True]
    return [(s, e) for s, e in zip(np.flatnonzero(opens).tolist(), (np.flatnonzero(closes) + 1).tolist()) if e - s >= least]


class Suffixes:
    """Common prefixes and suffixes of pairs of places in an array, by bisection over hashes modulo a prime."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        power = np.ones(1, np.int64)
        base = 1_000_003
        while len(power) <= n:
            power = np.r_[power, power * pow(base, len(power), PRIME) % PRIME]
        self.power = power[: n + 1]
        self.sums = np.r_[0, np.cumsum((values % PRIME) * self.power[:n] % PRIME)]

    def equal(self, i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        left = (self.sums[i + length] - self.sums[i]) % PRIME * self.power[j - i] % PRIME
        return left == (self.sums[j + length] - self.sums[j]) % PRIME

    def longest(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """Equal values from i and j (i < j) on, or before them, `most` at most."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.equal(i - mid, j - mid, mid) if back else self.equal(i, j, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low


def reach(values: np.ndarray, i: int, q: int) -> tuple[int, int]:
    """The stretch around i and i + q in which values q apart are equal, by comparing them."""
    s = i
    while s > 0 and values[s - 1] == values[s - 1 + q]:
        s -= 1
    e = i + q
    while e < len(values) and values[e] == values[e - q]:
        e += 1
    return s, e


def main_lorentz(values: np.ndarray, ends: np.ndarray, periods: int, least: int) -> dict[tuple[int, int], int]:
    """{(start, end): smallest period} of the runs in an array of stretches; ends[i] is where i's stretch ends.

    Stretches are parted by values that occur nowhere else.
    """
    n, found, shared = len(values), {}, Suffixes(values)
    starts = np.r_[0, np.flatnonzero(np.diff(ends)) + 1]
    begin = np.repeat(starts, np.diff(np.r_[starts, n]))
    longest = int((ends - begin).max(initial=0))
    half = 1
    while half < n:
        centres = np.arange(half, n, 2 * half)
        most = min(2 * half, longest) // periods
        per = max(1, 2_000_000 // max(1, most))
        for at in range(0, len(centres) if most else 0, per):
            c = np.repeat(centres[at : at + per], most)
            q = np.tile(np.arange(1, most + 1), len(centres[at : at + per]))
            for left in (False, True):  # the period shows to the right of c, or to the left
                i = c - q if left else c
                ok = (i >= begin[c]) & (i + q < ends[c])
                i, p = i[ok], q[ok]
                near = values[i] == values[i + p]
                if left:
                    near = (i > 0) & (values[i - 1] == values[i + p - 1])
                i, p = i[near], p[near]
                if not len(i):
                    continue
                s = i - shared.longest(i, i + p, i - begin[i], True)
                e = i + p + shared.longest(i, i + p, ends[i] - i - p, False)
                long = (e - s >= least) & (e - s >= periods * p)
                for s1, e1, p1, i1 in zip(s[long].tolist(), e[long].tolist(), p[long].tolist(), i[long].tolist()):
                    if found.get((s1, e1), p1 + 1) > p1:
                        if not np.array_equal(values[s1 : e1 - p1], values[s1 + p1 : e1]):
                            s1, e1 = reach(values, i1, p1)
                            if e1 - s1 < max(least, periods * p1):
                                continue
                        found[s1, e1] = min(p1, found.get((s1, e1), p1))
        half *= 2
    return found


def runs_of(texts: list[list[str]], periods: int, least: int) -> list[list[tuple[int, int, int]]]:
    """For each list of words its runs (start, length, period), by start, then period."""
    sizes = np.array([len(t) for t in texts])
    out: list[list] = [[] for _ in texts]
    code = dict.fromkeys(w for t in texts for w in t)
    for number, w in enumerate(code):
        code[w] = number
    words = np.fromiter((code[w] for t in texts for w in t), np.int64, int(sizes.sum()))
    doc = np.repeat(np.arange(len(texts)), sizes)
    stretches = survivors(words, doc, overlap(periods, least), least)
    if not stretches:
        return out
    parts, place, ends, total = [], [], [], 0
    for number, (s, e) in enumerate(stretches):  # each stretch, then a value of its own
        parts += [words[s:e], [len(code) + number]]
        place += [np.arange(s, e), [-1]]
        total += e - s + 1
        ends.append(np.full(e - s + 1, total))
    place = np.concatenate(place)
    first = np.cumsum(sizes) - sizes
    for (s, e), q in main_lorentz(np.concatenate(parts), np.concatenate(ends), periods, least).items():
        d = int(doc[place[s]])
        out[d].append((int(place[s] - first[d]), e - s, q))
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def kept_words(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """Words that no run holds after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words), bool)
    for s, length, q in runs:
        gone[s + q : s + length] = True
    return [w for w, g in zip(words, gone.tolist()) if not g]


def word_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", periods: int = 4, least: int = 6) -> DataFrame:
    """(id, runs, collapsed): the runs of each text by start, then period, and its words without the repeats, joined by one space.

    Null counts as empty; texts without words give no runs and an empty text. Ids may be null or repeat: each row is
    worked for itself. Other columns are not read. At least three periods must be asked for: then one word more than a period
    lies on one side of each midpoint. Memory in a task: a slice of SLICE words, or one longer text.
    """
    if periods < 3 or least < periods:
        raise ValueError("a run needs three periods and as many words at least")
    find = re.compile(NOT_WS).findall

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts, at = frame["_text"].tolist(), 0
            while at < len(texts):
                words, size, start = [], 0, at
                while at < len(texts) and (at == start or size < SLICE):
                    words.append(find(texts[at] or ""))
                    size += len(words[-1])
                    at += 1
                runs = runs_of(words, periods, least)
                yield pd.DataFrame({
                    "_id": frame["_id"].iloc[start:at],
                    "runs": [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs],
                    "collapsed": [" ".join(kept_words(w, r)) for w, r in zip(words, runs)],
                })

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInPandas(work, f"_id {kind}, {SCHEMA}").withColumnRenamed("_id", id_col)


def replanted(id_: Column, text: Column) -> Column:
    """The text; where the crc32 of the id ends in 0, its words from a place on repeat with a period that the crc32 chooses."""
    h = F.crc32(id_.cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({NOT_WS})"), 1)

    def repeated(x: Column) -> Column:
        n = F.size(x)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.concat_ws(" ", F.transform(x, lambda w, i: F.get(x, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))))

    # one lambda parameter holds the words, so that they are extracted once
    return F.when(h % 10 == 0, F.get(F.transform(F.array(words), lambda x: F.when(F.size(x) > 0, repeated(x)).otherwise("")), F.lit(0))).otherwise(text)


def run_digests(docs: DataFrame) -> DataFrame:
    """The contract's row for each document of (doc_id, text): counts, the longest run, digests of all runs and of the collapsed text."""
    found = word_runs(docs.select("doc_id", replanted(F.col("doc_id"), F.col("text")).alias("text")))
    first = F.get(F.array_sort("runs", lambda a, b: F.when(a.length > b.length, -1).when(a.length < b.length, 1)
                               .when(a.start < b.start, -1).when(a.start > b.start, 1).when(a.period < b.period, -1).when(a.period > b.period, 1).otherwise(0)), F.lit(0))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n")))
    return found.withColumn("_first", first).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_first.start").alias("start"),
        F.col("_first.length").alias("length"),
        F.col("_first.period").alias("period"),
        F.floor(F.col("_first.length") * 1000 / F.col("_first.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
