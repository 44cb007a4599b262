"""Toxicity by a lexicon trie, Levenshtein automata and windows of context.

The lexicon (words, and stems that take any ending) is learned from labelled documents. Its trie, walked by
Levenshtein automata made deterministic state by state, finds terms and misspelled terms. Each hit's window tells
quoted from direct use. Loose stems, which clean documents hold too by chance, lie in a trie of their own and
count by their number; a logistic regression on all these counts gives the score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents that the lexicon and the regression are fitted on, at most: first by hash of their id.
TOXIC_SAMPLE, CLEAN_SAMPLE = 2000, 6000
#: Candidates and terms of the lexicon at most; toxic documents a term must be in, and must newly explain.
CANDIDATES, TERMS, LEAST = 4000, 500, 3
#: Lengths of stems; words of context on each side of a hit; letters from which a word may have one edit, or two.
STEMS, WINDOW, ONE_EDIT, TWO_EDITS = range(4, 9), 6, 5, 9
EDGES = ".,;:!?()[]{}<>|/\\+=~`^…-–—_*#&%$" + "\"'“”„‟«»‹›‘’‚"
QUOTES = re.compile("[\"“”„‟«»‹›‘’‚]|(?<!\\w)'|'(?!\\w)")
#: Words that report what others say.
REPORTING = frozenset("said says say called calls quoted quote wrote writes word term slur sagte nennt wort dit mot appelé dijo llamó palabra".split())
FEATURES = 9
#: One clean text in so many is also taught with a quotation planted in it.
QUOTED = 4
#: Loose stems also occur in clean documents by chance: how many standard deviations more often than by chance
#: they must be in toxic ones, and the share of these they must be in. They count by how many of them a text holds.
SURPRISE, LOOSE_SHARE, LOOSE = 5.0, 0.02, 200


def words_of(text: str | None) -> list[str]:
    return [w for w in (x.strip(EDGES) for x in (text or "").lower().split()) if w]


def half(text: str | None) -> int:
    return zlib.crc32((text or "").encode()) & 1


def candidates(words: set[str]) -> set[str]:
    """The words, and their stems of four letters and more, marked by a closing asterisk."""
    found = {w for w in words if 3 <= len(w) <= 30}
    return found | {w[:n] + "*" for w in found for n in STEMS if len(w) > n}


class Lexicon:
    """The trie of terms, with automata for misspelled ones; `hit` is memoised by word and by state.

    A stem takes any ending, also where the stem itself is misspelled. `first`: a word's first letter may be edited as
    any other. `exact`: no edits at all. `context`: quotation marks and reporting words tell quoted from direct use.
    """

    def __init__(self, terms: list[str], ordinary: frozenset[str] = frozenset(), loose: list[str] | None = None, first: bool = False, exact: bool = False, context: bool = True):
        self.children: list[dict[str, int]] = [{}]
        self.edits: list[int] = [-1]  # edits a word that ends here may have; -1: no word ends here
        self.stem: list[int] = [-1]  # the same of a stem
        self.reach: list[int] = [0]  # most edits of what ends here or below
        for term in terms:
            plain = term.rstrip("*")
            budget = 0 if exact else 2 if len(plain) >= TWO_EDITS else 1 if len(plain) >= ONE_EDIT else 0
            node, path = 0, [0]
            for c in plain:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    for values in (self.edits, self.stem, self.reach):
                        values.append(-1)
                node = self.children[node][c]
                path.append(node)
            (self.stem if term.endswith("*") else self.edits)[node] = budget
            for on in path:
                self.reach[on] = max(self.reach[on], budget)
        self.first = first
        self.context = context
        self.ordinary = ordinary
        self.loose = Lexicon(loose, exact=True) if loose else None
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.final: list[int] = []
        self.known: dict[str, int] = {}
        self.start = self.state({(0, 0)})

    def editable(self, node: int, edits: int) -> bool:
        """Whether one more edit may be made at the place: not before the first letter, unless `first`."""
        return (node > 0 or self.first and node == 0) and edits < self.reach[node]

    def state(self, places: set[tuple[int, int]]) -> int:
        """Number of the deterministic state: places are (trie node, edits so far), deletions of trie letters included.

        Node -1 is a complete stem, which any letters follow. Places that can lead to no hit, or to none with
        fewer edits than a complete stem has, are left out; with none left the state is -1.
        """
        open_ = list(places)
        places = set(places)
        while open_:
            node, edits = open_.pop()
            if self.editable(node, edits):
                for child in self.children[node].values():
                    if (child, edits + 1) not in places:
                        places.add((child, edits + 1))
                        open_.append((child, edits + 1))
        done = min((e for n, e in places if n < 0 or e <= self.stem[n]), default=9)
        least: dict[int, int] = {}
        for node, edits in places:
            if node >= 0 and edits <= self.reach[node] and edits < done:
                least[node] = min(edits, least.get(node, 9))
        if done < 9:
            least[-1] = done
        if not least:
            return -1
        key = frozenset(least.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            self.final.append(min((e for n, e in key if n < 0 or e <= self.edits[n]), default=-1))
        return self.states[key]

    def step(self, state: int, c: str) -> int:
        """The next state; -1: no term left, -2: a stem is complete without edits."""
        after: set[tuple[int, int]] = set()
        for node, edits in self.sets[state]:
            if node < 0:
                after.add((node, edits))
                continue
            editable = self.editable(node, edits)
            for letter, child in self.children[node].items():
                if letter == c:
                    if self.stem[child] >= 0 and not edits:
                        return -2
                    after.add((child, edits))
                elif editable:
                    after.add((child, edits + 1))
            if editable:
                after.add((node, edits + 1))
        return self.state(after)

    def hit(self, word: str) -> int:
        """Edits between the word, or for a stem a beginning of it, and the nearest term, or -1."""
        found = self.known.get(word)
        if found is None:
            state = self.start
            for c in word:
                step = self.steps[state].get(c)
                if step is None:
                    step = self.steps[state][c] = self.step(state, c)
                state = step
                if state < 0:
                    break
            found = 0 if state == -2 else -1 if state < 0 else self.final[state]
            if found > 0 and word in self.ordinary:
                found = -1
            if len(self.known) > 400_000:
                self.known.clear()
            self.known[word] = found
        return found

    def features(self, text: str | None) -> list[float]:
        """Counts of a text: direct, quoted and misspelled hits and how they lie in it."""
        tokens = (text or "").lower().split()
        found = {t: w for t in set(tokens) if (w := t.strip(EDGES))}
        near = {t for t, w in found.items() if self.hit(w) >= 0}
        stems = {t for t, w in found.items() if self.loose.hit(w) >= 0} if self.loose else set()
        if not near and not stems:
            return [0.0] * FEATURES
        held = sum(t in stems for t in tokens) if stems else 0
        loose = [math.log1p(len({found[t] for t in stems})), math.log1p(held), min(1.0, 20 * held / len(tokens))]
        direct = quoted = misspelled = close = 0
        last = -10 * WINDOW
        for i, t in enumerate(tokens):
            if t not in near:
                continue
            left, right = tokens[max(0, i - WINDOW) : i], tokens[i + 1 : i + 1 + WINDOW]
            # quoted: an odd number of quotation marks before it and one after, or a reporting word just before
            before = len(QUOTES.findall(" ".join(left))) + bool(QUOTES.match(t))
            after = len(QUOTES.findall(" ".join(right))) + bool(QUOTES.search(t[1:]))
            if self.hit(t.strip(EDGES)) > 0:
                misspelled += 1
            elif self.context and (before % 2 and after or any(w.strip(EDGES) in REPORTING for w in left[-2:])):
                quoted += 1
            else:
                direct += 1
            close += i - last <= WINDOW
            last = i
        mass = direct + 0.7 * misspelled + 0.3 * quoted
        return [min(1.0, mass), math.log1p(mass), math.log1p(quoted), math.log1p(misspelled), math.log1p(close), min(1.0, 20 * mass / len(tokens)), *loose]


def misspelled(text: str, lexicon: Lexicon) -> str | None:
    """The text with one letter of each term it holds exactly replaced, doubled or left out, by a hash; None if it holds none."""
    found, changed = (text or "").lower().split(), False
    for i, t in enumerate(found):
        w = t.strip(EDGES)
        if len(w) >= ONE_EDIT and lexicon.hit(w) == 0:
            h = zlib.crc32(f"{i} {w}".encode())
            at, letter = h % len(w), "*0aeiouxz"[h // 64 % 9]
            found[i] = t.replace(w, w[:at] + (letter, "", w[at] * 2)[h // 8 % 3] + w[at + 1 :])
            changed = True
    return " ".join(found) if changed else None


def quoting(text: str, terms: list[str]) -> str:
    """The text with a passage that quotes a term, at a place chosen by a hash."""
    found, h = (text or "").split(), zlib.crc32((text or "").encode())
    at, term = h % (len(found) + 1), terms[h % len(terms)].rstrip("*")
    report = sorted(REPORTING)[h // 7 % len(REPORTING)]
    return " ".join([*found[:at], *((report, f'"{term}"') if h & 8 else (f'"{term}"', report)), *found[at:]])


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.05, rounds: int = 60) -> np.ndarray:
    """Weights of a regularised logistic regression, the constant last, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
    ridge[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w = w + step * min(1.0, 4 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def learn(sample: DataFrame, plant: bool = True) -> tuple[list[str], frozenset[str], list[str], np.ndarray]:
    """Lexicon, ordinary words near its terms, loose stems, and weights, from a bounded sample (text, toxic).

    Spark counts the documents of each candidate; the greedy choice on the driver takes the candidate that
    explains most toxic documents that none explains yet, for as long as it explains LEAST of them. `plant`: toxic texts
    with their terms misspelled, and every QUOTED-th clean one with a term quoted, teach too.
    """
    sample = sample.repartition(24).persist()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            toxic, clean = Counter(), Counter()
            for text, y in zip(pdf["text"], pdf["toxic"]):
                (toxic if y else clean).update(candidates(set(words_of(text))))
            # what no toxic document of this batch holds may still be in another: all are counted
            terms = [*toxic.keys() | clean.keys()]
            yield pd.DataFrame({"term": pd.Series(terms, dtype=object), "toxic": [toxic[t] for t in terms], "clean": [clean[t] for t in terms]})

    sums = sample.mapInPandas(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    fit = sums.filter((F.col("toxic") >= LEAST) & (F.col("clean") * 20 <= F.col("toxic")))
    chosen = [r["term"] for r in fit.orderBy(F.expr("toxic - 10 * clean").desc(), F.length("term"), "term").limit(CANDIDATES).collect()]
    allowed = frozenset(chosen)

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"terms": [sorted(candidates(set(words_of(t))) & allowed) for t in pdf["text"]]})

    held_terms = [set(r["terms"]) for r in sample.filter("toxic = 1").mapInPandas(held, "terms array<string>").collect()]
    open_, terms = held_terms, []
    while open_ and len(terms) < TERMS:
        gain = Counter(t for doc in open_ for t in doc)
        # of equal gains the longest: a stem no shorter than its words need
        best = max(gain, key=lambda t: (gain[t], len(t), t), default=None)
        if best is None or gain[best] < LEAST:
            break
        terms.append(best)
        open_ = [doc for doc in open_ if best not in doc]
    # and other terms no clean document holds, in a fiftieth of the toxic ones or more
    strong = set(terms)
    floor = max(2 * LEAST, 0.02 * len(held_terms))
    strong |= {r["term"] for r in fit.filter(F.col("clean") == 0).filter(F.col("toxic") >= floor).orderBy(F.desc("toxic"), "term").limit(TERMS).collect()}
    terms = sorted(strong)
    # stems that are far more common in toxic documents than by chance, though clean ones hold them too
    n_toxic, n_clean = len(held_terms), sample.filter("toxic = 0").count()
    usual = (F.col("toxic") + F.col("clean")) * (n_toxic / max(1, n_toxic + n_clean))
    surprise = (F.col("toxic") - usual) / F.sqrt(usual + 1)
    often = sums.filter(F.col("term").endswith("*") & (F.col("clean") * 20 > F.col("toxic")) & (F.col("toxic") >= max(2 * LEAST, LOOSE_SHARE * n_toxic)) & (surprise >= SURPRISE))
    loose = sorted(r["term"] for r in often.orderBy(surprise.desc(), F.length("term").desc(), "term").limit(LOOSE).collect())
    plain = Lexicon(terms, first=True)

    def edited(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            words = sorted({(half(t), w) for t in pdf["text"] for w in set(words_of(t)) if plain.hit(w) > 0})
            yield pd.DataFrame({"half": pd.Series([h for h, _ in words], dtype="int64"), "word": pd.Series([w for _, w in words], dtype=object)})

    by_half = [(r["half"], r["word"]) for r in sample.filter("toxic = 0").mapInPandas(edited, "half long, word string").distinct().collect()]
    ordinary = frozenset(w for _, w in by_half)
    # a text's own words would hide how often unseen ones come near a term, so each half is fitted with those of the other
    fitted = [Lexicon(terms, frozenset(w for h, w in by_half if h != k), loose, first=True) for k in (0, 1)]

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"x": [fitted[half(t)].features(t) for t in pdf["text"]], "y": pdf["toxic"].astype("float64")})

    # few labelled texts misspell a term or quote one: planted ones of both kinds teach what such hits weigh
    words = [t for t in terms if not t.endswith("*")] or terms

    def planted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            wrong = [m for t, y in zip(pdf["text"], pdf["toxic"]) if y and (m := misspelled(t, plain))]
            quotes = [quoting(t, words) for t, y in zip(pdf["text"], pdf["toxic"]) if not y and words and zlib.crc32((t or "").encode()) % QUOTED == 0]
            yield pd.DataFrame({"text": pd.Series(wrong + quotes, dtype=object), "toxic": pd.Series([1] * len(wrong) + [0] * len(quotes), dtype="int32")})

    every = sample.unionByName(sample.mapInPandas(planted, "text string, toxic int")) if plant else sample
    rows = every.mapInPandas(measure, "x array<double>, y double").toPandas()
    sample.unpersist()
    if not len(rows):
        return terms, ordinary, loose, np.zeros(FEATURES + 1)
    return terms, ordinary, loose, logistic(np.stack(rows["x"].to_numpy()).astype(float), rows["y"].to_numpy())


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def scorer(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Callable[[Column], Column]:
    """A function from a text column to its toxicity score, learned as `toxicity` says."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_known")).agg(F.max(label_col).cast("int").alias("toxic"))
    known = known.filter(F.crc32(F.col("_known").cast("string")) % 3 != 1)
    # only rows that have a document can teach
    known = known.join(docs.select(F.col(id_col).alias("_known")).distinct(), "_known", "left_semi").withColumn("h", F.xxhash64("_known"))
    few = known.filter("toxic = 1").orderBy("h", "_known").limit(TOXIC_SAMPLE).union(known.filter("toxic = 0").orderBy("h", "_known").limit(CLEAN_SAMPLE))
    chosen = [(r["_known"], r["toxic"]) for r in few.select("_known", "toxic").collect()]
    share = sum(y for _, y in chosen) / len(chosen) if chosen else 0.5
    if 0 < share < 1:
        picked = docs.sparkSession.createDataFrame(chosen, "_known long, toxic int")
        rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
        # copies of a text teach once, or all words of a much copied one would seem terms
        texts = rows.join(F.broadcast(picked), F.col("_id") == F.col("_known")).groupBy("text").agg(F.max("toxic").alias("toxic"))
        terms, ordinary, loose, weights = learn(texts)
    else:
        terms, ordinary, loose, weights = [], frozenset(), [], np.append(np.zeros(FEATURES), np.log((share + 1e-9) / (1 - share + 1e-9)))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon = Lexicon(terms, ordinary, loose, first=True)
        for texts in batches:
            x = np.array([lexicon.features(t) for t in texts], float).reshape(len(texts), FEATURES)
            yield pd.Series(1 / (1 + np.exp(-(x @ weights[:-1] + weights[-1]))))

    return score


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.7) -> DataFrame:
    """(id, held_out, score, predicted) for each row of docs.

    Learns from labelled rows that are not held out (crc32 of the id as text, mod 3, is not 1), at most
    TOXIC_SAMPLE and CLEAN_SAMPLE of them, in order of a hash of their id; a document labelled more than once is toxic
    if any label says so; null labels are none. Null and empty texts have no hits and get the score of such texts.
    Null ids are scored and not held out. Without toxic or clean labels to learn from, all scores are the share of toxic
    labels, or 0.5 with no labels at all. An empty table gives no rows; other columns are not read.
    """
    score = scorer(docs, labels, id_col, text_col, label_col)
    scored = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), score(F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of docs whose score is under the threshold, all columns as they were."""
    return docs.filter(scorer(docs, labels, id_col, text_col)(docs[text_col]) < threshold)
