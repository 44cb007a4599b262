"""Alignment of two tokenizers over all texts, each distinct segment of text tokenised and aligned once.

A text is cut before white space where neither vocabulary has a token that spans the cut (checked over all tokens), so that a
text's tokens are its segments' tokens in order. Distinct segments are counted in Spark, encoded by both tokenizers and aligned:
byte offsets where tokens of both end cut them into groups. Alignments are joined back to the documents: those of the COMMON
most frequent short segments by a dictionary of bounded size, all others by a join, salted where a segment is hot.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import cached_property, lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gneiss.llm.shared import HOT, split_join, staged

#: Segments of the dictionary that every task holds, and the characters each has at most.
COMMON, SHORT = 1 << 18, 24
#: Distinct segments a task counts, and pairs it gathers, before it hands them on.
HELD, GATHERED = 500_000, 2_000_000
#: White space before which a text may be cut, and all that patterns of tokenizers may take as white space.
CUTS = " \t\n\x0b\x0c\r"
SPACES = "\t-\r\x1c- \x85\xa0 ᠎ -     　"


def byte_level() -> dict[str, int]:
    """Bytes by the characters that stand for them in byte-level vocabularies: printable ones for themselves, the others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Aligner:
    """Both tokenizers, their tokens' bytes, and the cuts between segments that both allow."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        level = byte_level()
        self.a_bytes = {i: bytes(level[c] for c in t) for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        pieces = {i: self.b.id_to_piece(i) for i in range(self.b.get_piece_size())}
        self.b_bytes = {i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces.items()}
        self.space = self.b.piece_to_id("▁")

    @cached_property
    def cuts(self) -> str:
        return cuts([*self.a_bytes.values(), *self.b_bytes.values()])

    @property
    def pattern(self) -> str:
        return segment_pattern(self.cuts)

    def align(self, segments: list[str]) -> list[str | None]:
        """Groups `a1,a2|b1;a3|b2` of each segment; None where the tokens' bytes are not the segment's."""
        a = [e.ids for e in self.a.encode_batch(segments, add_special_tokens=False)]
        # this tokenizer puts a space before each text: the segment's own where it starts with one, else a token to leave out
        b = self.b.encode([s[1:] if s[0] == " " else s for s in segments], num_threads=1)
        out = []
        for s, x, y in zip(segments, a, b):
            if s[0] != " ":
                y = y[1:]
            elif len(s) == 1:
                y = [self.space]
            raw, xs, ys = s.encode(), [self.a_bytes[i] for i in x], [self.b_bytes[i] for i in y]
            out.append(groups(x, y, list(map(len, xs)), list(map(len, ys))) if b"".join(xs) == raw == b"".join(ys) else None)
        return out


@lru_cache(maxsize=1)
def loaded(a_path: str, b_path: str) -> Aligner:
    """The tokenizers, loaded once in a process."""
    return Aligner(a_path, b_path)


def cuts(tokens: Iterable[bytes]) -> str:
    """The white space of CUTS that no token holds after a character outside SPACES, nor, but for spaces, after a space."""
    space, spanned = re.compile(f"[{SPACES}]").match, set()
    for t in tokens:
        text = t.decode("utf-8", "replace")
        for last, c in zip(text, text[1:]):
            if c in CUTS and (not space(last) or (last == " " and c != " ")):
                spanned.add(c)
    return "".join(c for c in CUTS if c not in spanned)


def segment_pattern(allowed: str) -> str:
    """A pattern whose matches are a text's segments: each starts with white space out of `allowed` that follows other characters."""
    other = f"(?:(?![{re.escape(allowed)}])[{SPACES}])" if allowed else f"[{SPACES}]"
    return rf"[{SPACES}]*[^{SPACES}]+(?:{other}[{SPACES}]*[^{SPACES}]+)*(?:{other}[{SPACES}]*\Z)?|[{SPACES}]+"


def segmenter(allowed: str) -> Callable[[str], list[str]]:
    """The segments of a text; texts whose white space is all allowed, most of them, by a shorter pattern with the same matches."""
    own = f"[{re.escape(allowed)}]" if allowed else "(?!)"
    white = re.compile(f"[{SPACES}]").match
    others = "".join(c for c in map(chr, range(0x3001)) if white(c) and c not in allowed)
    whole, plain = re.compile(segment_pattern(allowed)).findall, re.compile(f"{own}*[^{re.escape(allowed)}]+|{own}+").findall if allowed else None
    odd = re.compile(f"[{re.escape(others)}]").search if others else None
    return lambda text: whole(text) if plain is None or (odd and odd(text)) else plain(text)


def groups(a: list[int], b: list[int], a_sizes: list[int], b_sizes: list[int]) -> str:
    """Ids of both sides, cut where tokens of both end."""
    if len(a) == 1 or len(b) == 1:
        return f"{','.join(map(str, a))}|{','.join(map(str, b))}"
    a_ends, b_ends = list(accumulate(a_sizes)), list(accumulate(b_sizes))
    out, i, j, b_at = [], 0, 0, {e: n for n, e in enumerate(b_ends, 1)}
    for n, end in enumerate(a_ends, 1):
        if end in b_at:
            out.append(f"{','.join(map(str, a[i:n]))}|{','.join(map(str, b[j:b_at[end]]))}")
            i, j = n, b_at[end]
    return ";".join(out)


def measure(text: str) -> tuple[int, int, int, dict[int, int]]:
    """(A tokens, B tokens, groups, links by id pair) of a segment's groups; a pair is its A id times 2**32 plus its B id."""
    n_a = n_b = n = 0
    links: dict[int, int] = {}
    for group in text.split(";"):
        a, _, b = group.partition("|")
        n += 1
        if "," in a or "," in b:
            xs, ys = a.split(","), b.split(",")
            n_a, n_b = n_a + len(xs), n_b + len(ys)
            for x, cx in Counter(xs).items():  # distinct ids only: a group of many equal tokens is one pair
                for y, cy in Counter(ys).items():
                    pair = int(x) << 32 | int(y)
                    links[pair] = links.get(pair, 0) + cx * cy
        else:
            n_a, n_b, pair = n_a + 1, n_b + 1, int(a) << 32 | int(b)
            links[pair] = links.get(pair, 0) + 1
    return n_a, n_b, n, links


class Dictionary:
    """Segments with their groups and measures, packed for tasks."""

    def __init__(self, segments: list[str], texts: list[str | None]):
        found = [(0, 0, 0, {}) if t is None else measure(t) for t in texts]
        self.place = {s: i for i, s in enumerate(segments)}
        self.groups = texts
        self.bad = np.array([t is None for t in texts], bool)
        self.sizes = np.array([(a, b, g, sum(links.values())) for a, b, g, links in found], np.int64).reshape(-1, 4)
        self.offsets = np.r_[0, np.cumsum([len(links) for *_, links in found], dtype=np.int64)]
        self.pairs = np.array([p for *_, links in found for p in links], np.int64)

    def pairs_of(self, places: np.ndarray) -> np.ndarray:
        first, n = self.offsets[places], self.offsets[places + 1] - self.offsets[places]
        return self.pairs[np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())] if len(places) else self.pairs[:0]


@contextmanager
def shuffles_end(spark: SparkSession):
    """Within, each job's shuffle files go when it ends: what is needed later has been written as a table."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def flat(frame: pa.RecordBatch, column: str) -> list:
    return frame.column(column).to_pylist()


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def salted_join(rows: DataFrame, values: DataFrame, key: str, size: str, total: int, spread: Column) -> DataFrame:
    """Inner join of rows to values, one row for each key, however large a value is: a hot key's value is copied to as many places as its rows need.

    `size` is the number of a key's rows; only hot keys' hashes (at most HOT of them) are broadcast.
    """
    limit = max(1000, total // HOT)
    hot = values.filter(F.col(size) > limit).groupBy(F.xxhash64(key).alias("_hash")).agg(F.max(F.ceil(F.col(size) / limit)).cast("int").alias("_parts"))
    with_parts = lambda x: x.join(F.broadcast(hot), F.xxhash64(x[key]) == F.col("_hash"), "left").withColumn("_parts", F.coalesce("_parts", F.lit(1))).drop("_hash")
    left = with_parts(rows).withColumn("_salt", F.pmod(F.xxhash64(spread), F.col("_parts")).cast("int")).drop("_parts")
    right = with_parts(values).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return left.join(right, [key, "_salt"]).drop("_salt")


def align_documents(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", common: int = COMMON, keep_groups: bool = False) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256[, groups]) for each row of docs.

    Texts that are null or empty, or that either tokenizer does not give back byte by byte, have no tokens: zeros, an empty
    text and digest, and they count for no pair. Rows that repeat an id, null ids included, are documents of their own. Other columns are
    not read. A text without white space is one segment.
    """
    with shuffles_end(docs.sparkSession):
        return _align_documents(docs, a_path, b_path, id_col, text_col, common, keep_groups)


def _align_documents(docs: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str, common: int, keep_groups: bool) -> DataFrame:
    spark, context = docs.sparkSession, docs.sparkSession.sparkContext
    allowed = loaded(a_path, b_path).cuts
    rows = staged(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text")), "alignment-rows")
    texts = rows.filter("text <> ''").select("row", "text")

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, find = pa.schema([("segment", pa.string()), ("n", pa.int64())]), segmenter(allowed)
        seen: Counter = Counter()
        for frame in frames:
            for text in flat(frame, "text"):
                seen.update(set(find(f" {text}")))
                if len(seen) > HELD:
                    yield batch(schema, list(seen), list(seen.values()))
                    seen.clear()
        yield batch(schema, list(seen), list(seen.values()))

    def encode(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("sid", pa.int64()), ("segment", pa.string()), ("n", pa.int64()), ("groups", pa.string())])
        aligner = loaded(a_path, b_path)
        for frame in frames:
            for at in range(0, frame.num_rows, 4096):
                part = frame.slice(at, 4096)
                yield batch(schema, part.column("sid"), part.column("segment"), part.column("n"), aligner.align(flat(part, "segment")))

    counted = texts.mapInArrow(count, "segment string, n long").groupBy("segment").agg(F.sum("n").alias("n"))
    counted = counted.select(F.monotonically_increasing_id().alias("sid"), "segment", "n")
    aligned = staged(counted.mapInArrow(encode, "sid long, segment string, n long, groups string"), "alignments")

    chosen = aligned.filter(F.length("segment") <= SHORT).orderBy(F.desc("n"), "segment").limit(common).select("sid", "segment", "groups").toArrow()
    sids = chosen.column("sid").to_pylist()
    held = context.broadcast(Dictionary(chosen.column("segment").to_pylist(), chosen.column("groups").to_pylist()))
    chosen_sids = staged(spark.createDataFrame(chosen.select(["sid"])) if sids else aligned.select("sid").limit(0), "alignment-common")
    rest = aligned.join(F.broadcast(chosen_sids), "sid", "left_anti")

    def rare(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, find = pa.schema([("row", pa.int64()), ("nth", pa.int32()), ("segment", pa.string()), ("times", pa.int32())]), segmenter(allowed)
        place = held.value.place
        for frame in frames:
            out: tuple[list, ...] = ([], [], [], [])
            for row, text in zip(flat(frame, "row"), flat(frame, "text")):
                found = Counter(s for s in find(f" {text}") if s not in place)
                out[0].extend([row] * len(found))
                out[1].extend(range(len(found)))
                out[2].extend(found)
                out[3].extend(found.values())
                if len(out[0]) > HELD:
                    yield batch(schema, *out)
                    out = ([], [], [], [])
            yield batch(schema, *out)

    total = rest.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rarely = salted_join(texts.mapInArrow(rare, "row long, nth int, segment string, times int"), rest, "segment", "n", total, F.col("row"))
    rarely = staged(rarely.select("row", "nth", "sid", "times", "groups"), "alignment-rare")

    def compose(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "id", "n_a", "n_b", "n_groups", "n_links", "digest", "groups", "pairs", "docs"]
        find, known = segmenter(allowed), held.value
        for frame in frames:
            schema = pa.schema([("row", pa.int64()), ("id", frame.column("id").type), *[(n, pa.int64()) for n in names[2:6]], ("digest", pa.string()), ("groups", pa.string()), ("pairs", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64()))])
            out, gathered, size = [], [], 0

            def gone():
                pairs, docs = np.unique(np.concatenate(gathered), return_counts=True) if gathered else ([], [])
                made = [*out, (None, None, 0, 0, 0, 0, None, None, list(pairs), list(docs))]
                return batch(schema, *zip(*made))

            for row, id_, text, extra in zip(*(flat(frame, c) for c in ("row", "id", "text", "rare"))):
                segments = find(f" {text}") if text else []
                places = list(map(known.place.get, segments))
                # segments outside the dictionary, in the order in which rare() numbered them
                often = Counter([s for p, s in zip(places, segments) if p is None])
                more = dict(zip(often, extra or ()))
                used, times = np.unique(np.array([p for p in places if p is not None], np.int64), return_counts=True)
                if not segments or known.bad[used].any() or None in more.values():
                    out.append((row, id_, 0, 0, 0, 0, "", "", [], []))
                    continue
                whole = ";".join([known.groups[p] if p is not None else more[s] for p, s in zip(places, segments)])
                n_a, n_b, n, n_links = (known.sizes[used].T @ times).tolist()
                pairs: list[int] = []
                for s, g in more.items():
                    a, b, c, links = measure(g)
                    k = often[s]
                    n_a, n_b, n, n_links = n_a + k * a, n_b + k * b, n + k * c, n_links + k * sum(links.values())
                    pairs += links
                gathered.append(np.unique(np.concatenate([known.pairs_of(used), np.array(pairs, np.int64)])))
                out.append((row, id_, n_a, n_b, n, n_links, hashlib.sha256(whole.encode()).hexdigest(), whole if keep_groups else None, [], []))
                size += len(gathered[-1])
                if size > GATHERED:
                    yield gone()
                    out, gathered, size = [], [], 0
            yield gone()

    lists = rarely.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "groups"))), lambda x: x.groups).alias("rare"))
    kind = rows.schema["id"].dataType.simpleString()
    composed = rows.join(lists, "row", "left").mapInArrow(compose, f"row long, id {kind}, n_a long, n_b long, n_groups long, n_links long, digest string, groups string, pairs array<long>, docs array<long>")
    composed = staged(composed, "alignment-composed")

    def links(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("sid", pa.int64()), ("pair", pa.int64()), ("links", pa.int64())])
        for frame in frames:
            for at in range(0, frame.num_rows, 4096):
                part = frame.slice(at, 4096)
                found = [measure(g)[3] for g in flat(part, "groups")]
                yield batch(schema, [s for s, f in zip(flat(part, "sid"), found) for _ in f], [p for f in found for p in f], [n for f in found for n in f.values()])

    # what each segment's links count, from the documents of each id pair
    of_segments = staged(aligned.filter("groups is not null").select("sid", "groups").mapInArrow(links, "sid long, pair long, links long"), "alignment-links")
    pairs = composed.filter("row is null").select(F.explode(F.arrays_zip("pairs", "docs")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.docs").alias("docs"))
    pairs = pairs.withColumn("best", F.max("docs").over(Window.partitionBy(F.shiftright("pair", 32))))
    pairs = pairs.join(of_segments.groupBy("pair").agg(F.count("*").alias("segments")), "pair")
    valued = split_join(of_segments, pairs, "pair", "segments", of_segments.count(), F.col("sid")).filter("docs is not null").groupBy("sid")
    valued = staged(valued.agg(F.sum(F.when(F.col("docs") == F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("docs")).alias("count_sum")), "alignment-values")

    values = np.zeros((len(sids), 2), np.int64)
    got = valued.join(F.broadcast(chosen_sids), "sid").toArrow()
    at = {s: i for i, s in enumerate(sids)}
    values[[at[s] for s in got.column("sid").to_pylist()]] = np.column_stack([got.column(c).to_numpy() for c in ("n_best", "count_sum")]).reshape(-1, 2)
    counts = context.broadcast(values)

    def common_sums(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, find = pa.schema([("row", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64())]), segmenter(allowed)
        place, value = held.value.place.get, counts.value
        for frame in frames:
            sums = [value[[p for p in map(place, find(f" {t}")) if p is not None]].sum(0) for t in flat(frame, "text")]
            yield batch(schema, frame.column("row"), [int(s[0]) for s in sums], [int(s[1]) for s in sums])

    of_rare = split_join(rarely.select("row", "sid", "times"), valued.join(rest.select("sid", "n"), "sid"), "sid", "n", total, F.col("row"))
    of_rare = of_rare.select("row", (F.col("times") * F.col("n_best")).alias("n_best"), (F.col("times") * F.col("count_sum")).alias("count_sum"))
    sums = texts.mapInArrow(common_sums, "row long, n_best long, count_sum long").union(of_rare).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    whole = composed.filter("row is not null").join(sums, "row", "left")
    summed = lambda c: F.when(F.col("n_a") > 0, F.coalesce(c, F.lit(0))).otherwise(0).alias(c)
    return whole.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", summed("n_best"), summed("count_sum"), F.col("digest").alias("groups_sha256"), *(["groups"] if keep_groups else []))


def public_alignment(docs: DataFrame, **options) -> DataFrame:
    """Alignment of the byte-level BPE of 50k ids with the sentence pieces of 32k ids among the public tokenizers."""
    import public_tokenizers

    return align_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), **options)
