"""Best-fit packing by a linear grouping scheme over the histogram of lengths.

Lengths are bounded by the capacity, so their histogram is small whatever the corpus. Large lengths are rounded up
to the largest of their equal-cardinality group; the few sizes left are packed by full configurations; actual
lengths replace the rounded ones; small lengths go best-fit into what room is left. The plan is a list of runs
(like sequences with consecutive numbers), so documents find their place by length and rank alone.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.llm.shared import staged

#: Tokens a sequence holds, groups of large lengths, and buckets in which ranks are counted.
CAPACITY, GROUPS, BUCKETS = 2048, 64, 512
#: Pieces of text whose ids a process keeps, the characters of the longest that it keeps, texts whose new pieces are encoded together,
#: and pieces that are encoded as one text.
KEPT, LONGEST, TOGETHER, JOINED = 300_000, 64, 256, 256
#: Characters (as in a pattern's set) of which both pattern libraries know the same classes: a test goes through all of them.
AGREED = r"\x00-\u04ff\u1e00-\u1fff\u2000-\u2064\u3000-\u30ff\u4e00-\u9fff\uac00-\ud7a3"


class Encoder:
    """Ids of the tokenizer file at `path`, without special tokens added.

    `pattern` is the tokenizer's own rule for cutting a text into pieces, whose ids do not depend on each other; so each distinct
    piece is encoded once and its ids are kept. Texts with a special token's string, and those with characters for which
    the two pattern libraries may know different classes (outside AGREED), are encoded whole by the same tokenizer.
    """

    def __init__(self, path: str, pattern: str | None = None):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        self.full_path, self.pattern = path, pattern
        self.full = Tokenizer.from_file(path)
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]
        self.whole = re.compile("|".join([*map(re.escape, self.special), f"[^{AGREED}]"]))
        self.split = re.compile(spelled_out(pattern)).findall if pattern else None
        self.ids: dict[str, bytes] = {}
        self.line_feed = self.full.encode("\n", add_special_tokens=False).ids[0]

    def __call__(self, text: str) -> np.ndarray:
        return np.frombuffer(self.packed([text])[0], "<u4")

    def packed(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers; new pieces of all texts are encoded together."""
        pieces = [None if self.is_whole(t) else self.split(t) for t in texts]
        distinct = set().union(*filter(None, pieces))
        new = distinct.difference(self.ids)
        # the first pieces seen are mostly the frequent ones: once there are enough, they stay and rarer ones are not kept
        full = len(self.ids) + len(new) > KEPT
        if full and 2 * len(new) > len(distinct):  # other texts than those whose pieces are kept
            self.ids.clear()
            new, full = distinct, len(distinct) > KEPT
        listed = list(new)
        for at in range(0, len(listed), 4096):
            part = listed[at : at + 4096]
            self.ids.update(zip(part, self.of_pieces(part)))
        of = self.ids.__getitem__
        out = [self.encoded([t])[0] if p is None else b"".join(map(of, p)) for t, p in zip(texts, pieces)]
        for p in listed:
            if full or len(p) > LONGEST:
                del self.ids[p]
        return out

    def is_whole(self, text: str) -> bool:
        return self.split is None or (any(s in text for s in self.special) if text.isascii() else self.whole.search(text) is not None)

    def of_pieces(self, pieces: list[str]) -> list[bytes]:
        """Each piece's ids. Pieces without white space but for a space before them are encoded many at once, a line for each: a
        line feed between such pieces is always a piece of its own, and its id is in no other."""
        single, joined = [], []
        for p in pieces:
            first = p[1:2] if p[0] == " " else p[0]
            (joined if first and not first.isspace() else single).append(p)
        out = dict(zip(single, self.encoded(single))) if single else {}
        for at in range(0, len(joined), JOINED):
            part = joined[at : at + JOINED]
            ids = np.array(self.full.encode_batch_fast(["\n".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = [*np.flatnonzero(ids == self.line_feed).tolist(), len(ids)]
            if len(ends) != len(part):
                raise ValueError("a line feed was not a piece of its own")
            packed = ids.tobytes()
            out.update((p, packed[4 * a + 4 : 4 * b]) for p, a, b in zip(part, [-1, *ends], ends))
        return [out[p] for p in pieces]

    def encoded(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.full.encode_batch_fast(texts, add_special_tokens=False)]


def spelled_out(pattern: str) -> str:
    """A pattern of the regex library for the standard one, which is quicker: its classes as ranges of AGREED characters."""
    import regex

    known = re.findall(f"[{AGREED}]", "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000))

    def ranges(name: str) -> str:
        held, out = [ord(c) for c in regex.findall(name, "".join(known))], []
        for c in held:
            if out and out[-1][1] == c - 1:
                out[-1][1] = c
            else:
                out.append([c, c])
        return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)

    spaces, letters, digits = map(ranges, (r"\s", r"\p{L}", r"\p{N}"))
    pattern = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{digits}]")
    return pattern.replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{digits}]").replace(r"\s", f"[{spaces}]").replace(r"\S", f"[^{spaces}]")


@functools.lru_cache(1)
def public_encoder() -> Encoder:
    """The byte-level BPE of 50k ids among the public tokenizers."""
    import public_tokenizers

    return Encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[int, int, int, int, int, int]]:
    """Segments (length, first rank, items, copies, offset, first sequence) that place every item.

    The item of rank r in its segment (from 0) lies in sequence first + r div copies, at offset + (r mod copies) * length.
    """
    runs: list[list] = []  # [sequences, room, [(length, first rank, copies, offset)]]
    taken = dict.fromkeys(histogram, 0)

    def entry(length: int, count: int, copies: int, offset: int) -> tuple[int, int, int, int]:
        taken[length] += count * copies
        return length, taken[length] - count * copies, copies, offset

    large = sorted((x for x in histogram if 4 * x >= capacity and histogram[x] > 0), reverse=True)
    each = max(1, -(-sum(histogram[x] for x in large) // groups))
    queues: list[list[list[int]]] = []  # for each group its [length, count], largest first
    space = 0
    for x in large:
        left = histogram[x]
        while left:
            if not space:
                queues.append([])
                space = each
            part = min(left, space)
            queues[-1].append([x, part])
            left, space = left - part, space - part
    merged: dict[int, list[list[int]]] = {}
    for q in queues:  # groups of one size are one
        merged.setdefault(q[0][0], []).extend(q)
    counts = {size: sum(n for _, n in q) for size, q in merged.items()}
    while counts:
        chosen = configuration(counts, capacity)
        times = min(counts[s] // chosen.count(s) for s in set(chosen))
        for s in chosen:
            counts[s] -= times
        counts = {s: n for s, n in counts.items() if n}
        # actual lengths for the rounded ones: a run for each stretch in which no slot's length changes
        while times:
            heads: list[list[int]] = []
            for s in chosen:
                heads.append(merged[s][0])
            stretch = min([times, *(h[1] // sum(h is g for g in heads) for h in heads)])
            if not stretch:  # one head is asked for more often than it has items: a single sequence takes the next ones too
                stretch, heads = 1, []
                for s in chosen:
                    queue = merged[s]
                    heads.append(next(h for h in queue if h[1] > sum(h is g for g in heads)))
            items, offset = [], 0
            for h in heads:
                items.append(entry(h[0], stretch, 1, offset))
                offset += h[0]
                h[1] -= stretch
            for s in set(chosen):
                merged[s][:] = [h for h in merged[s] if h[1]]
            runs.append([stretch, capacity - offset, items])
            times -= stretch
    rooms: dict[int, list[int]] = {}
    for i, r in enumerate(runs):
        rooms.setdefault(r[1], []).append(i)
    mask = sum(1 << room for room in rooms)

    def put(i: int) -> None:
        nonlocal mask
        rooms.setdefault(runs[i][1], []).append(i)
        mask |= 1 << runs[i][1]

    for x in sorted((x for x in histogram if 4 * x < capacity and histogram[x] > 0), reverse=True):
        left = histogram[x]
        while left:
            fits = mask >> x
            if not fits:  # new sequences: full ones first
                copies = min(capacity // x, left)
                runs.append([left // copies, capacity, []])
                put(len(runs) - 1)
                continue
            room = x + (fits & -fits).bit_length() - 1
            i = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
            run = runs[i]
            if run[0] > left:  # only some of these sequences get one
                runs.append([run[0] - left, run[1], split(run, left)])
                put(len(runs) - 1)
            copies = min(room // x, left // run[0])
            run[2].append(entry(x, run[0], copies, capacity - run[1]))
            run[1] -= copies * x
            left -= copies * run[0]
            put(i)
    segments, sequence = [], 0
    for count, _, items in runs:
        segments += [(length, first, count * copies, copies, offset, sequence) for length, first, copies, offset in items]
        sequence += count
    return segments


def split(run: list, at: int) -> list[tuple[int, int, int, int]]:
    """Cut the run after `at` sequences; the items of the rest."""
    run[0] = at
    return [(length, first + at * copies, copies, offset) for length, first, copies, offset in run[2]]


def configuration(counts: dict[int, int], capacity: int) -> list[int]:
    """The fullest set of up to four sizes that holds the largest one left."""
    sizes = sorted(counts)
    top = sizes[-1]
    best = [top]
    room = capacity - top

    def largest(limit: int, used: list[int]) -> int | None:
        at = bisect_right(sizes, limit)
        while at:
            at -= 1
            if counts[sizes[at]] > used.count(sizes[at]):
                return sizes[at]
        return None

    for b in [s for s in sizes if s <= room]:
        if counts[b] <= (b == top):
            continue
        options = [[top, b]]
        c = largest(room - b, [top, b])
        if c is not None:
            options.append([top, b, c])
            for c in [s for s in sizes if b <= s <= room - b and counts[s] > [top, b].count(s)]:
                d = largest(room - b - c, [top, b, c])
                if d is not None:
                    options.append([top, b, c, d])
        best = max([best, *options], key=lambda o: (sum(o), -len(o)))
        if sum(best) == capacity:
            break
    return best


def pieces(docs: DataFrame, encoder=public_encoder, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start, length, ids_crc32): each document's ids and a closing 0, cut where longer than capacity.

    The first piece takes what full pieces leave, so that all others fill a sequence each.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder()
        for pdf in batches:
            out = []
            for at in range(0, len(pdf), TOGETHER):
                part = pdf[at : at + TOGETHER]
                for doc, ids in zip(part["_id"].array, encode.packed([t or "" for t in part["_text"]])):
                    ids += b"\0\0\0\0"
                    n = len(ids) // 4
                    first = n - capacity * ((n - 1) // capacity)
                    cuts = [0, *range(first, n + 1, capacity)]
                    out += [(doc, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            frame = pd.DataFrame(out, columns=["_id", "piece", "start", "length", "ids_crc32"])
            yield frame.astype({"_id": "Int64"})

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInPandas(run, "_id long, piece int, start long, length long, ids_crc32 long").withColumnRenamed("_id", id_col)


def pack(docs: DataFrame, encoder=public_encoder, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of each row of docs.

    Null and empty texts are the closing id alone. Pieces of one length are ranked by id and piece in
    hash buckets, so that a length that most pieces share is ranked in parallel; rows that repeat an id each get a
    place. Null ids are kept. An empty table gives no rows; other columns are not read. The histogram
    (capacity rows at most) goes to the driver; the plan, whose size follows capacity and GROUPS, is broadcast.
    """
    spark = docs.sparkSession
    cut = staged(pieces(docs.select(F.col(id_col).alias("_row"), F.col(text_col).alias("_text")), encoder, "_row", "_text", capacity), "pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    segments = spark.createDataFrame(plan(histogram, capacity), "_length long, _first long, _items long, _copies long, _offset long, _sequence long")
    keyed = cut.withColumn("_bucket", F.pmod(F.xxhash64("_row", "piece"), F.lit(BUCKETS)))
    rank = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("_row", "piece", "ids_crc32")) - 1
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = keyed.groupBy("length", "_bucket").count().select("length", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    ranked = keyed.withColumn("_rank", rank).join(bases, ["length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_base"))
    match = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_first") + F.col("_items"))
    placed = ranked.join(F.broadcast(segments), match)
    return placed.select(
        F.col("_row").alias(id_col),
        "piece",
        "start",
        "length",
        "ids_crc32",
        F.expr("_sequence + (_rank - _first) div _copies").alias("sequence_id"),
        F.expr("_offset + (_rank - _first) % _copies * length").alias("offset"),
    )
