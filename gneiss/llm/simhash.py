"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints within `max_bits` differing bits agree in at least one of max_bits + 1 blocks of bits, so
each distinct fingerprint goes to one bucket for each block. In a bucket the fingerprints are sorted by Gray rank
and grouped into nodes; a node keeps the bits that all its members share and that its parent does not
already keep. A search adds up differences from the top and drops a whole node once they exceed the limit.
A bucket that is too full is dealt out by blocks of its other bits, again and again. Buckets return spanning links only, so a group of n near copies costs n rows, not n * n.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.shared import components, split_join, staged, without

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Shingles hashed at a time, so that memory does not follow a text's length.
CHUNK = 1 << 16
#: Distinct fingerprints a bucket should hold, children of a node, and the size from which a bucket is split.
BUCKET, FANOUT, SPLIT = 4096, 16, 1 << 16


def fingerprint(text: str | None, words: int = 3) -> int:
    """The text's 64-bit SimHash as a signed integer; zero for a text without words."""
    found = (text or "").encode().translate(LOWER).split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(found) >= words:
        starts, ends = starts[: len(found) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_digest
    for at in range(0, len(starts), CHUNK):
        cuts = zip(starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist())
        bits = np.unpackbits(np.frombuffer(b"".join([digest(joined[a:b], 42) for a, b in cuts]), np.uint8))
        ones += bits.reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts)).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp) for each row of docs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"_id": pdf["_id"], "fp": [fingerprint(t, words) for t in pdf["_text"]]})

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInPandas(run, "_id long, fp long").withColumnRenamed("_id", id_col)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Codes in Gray order below levels of nodes that share masked bit patterns."""

    def __init__(self, codes: np.ndarray):
        self.order = np.argsort(gray_rank(codes), kind="stable")
        self.codes = codes[self.order]
        both, either = self.codes, self.codes
        levels = []
        while len(both) > 1:
            cuts = np.arange(0, len(both), FANOUT)
            both, either = np.bitwise_and.reduceat(both, cuts), np.bitwise_or.reduceat(either, cuts)
            levels.append((both, ~(both ^ either)))
        self.levels = [(self.codes, np.full(len(self.codes), np.uint64(0xFFFFFFFFFFFFFFFF))), *levels]
        self.own = [  # the bits a node adds to those of its parent
            mask & ~up[1][np.arange(len(mask)) // FANOUT] for (_, mask), up in zip(self.levels, self.levels[1:])
        ] + [self.levels[-1][1]]

    def groups(self, max_bits: int, queries: int = 512) -> np.ndarray:
        """For each code, in the given order, the place of a code that stands for its group."""
        n = len(self.codes)
        label, top = np.arange(n), len(self.levels) - 1
        for start in range(0, n, queries):
            # a node whose members all have one label needs no search from members of that label
            same, low, high = [label], label, label
            for _ in range(top):
                cuts = np.arange(0, len(low), FANOUT)
                low, high = np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
                same.append(np.where(low == high, low, -1))
            q = np.arange(start, min(start + queries, n))
            node, apart = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
            for level in range(top, -1, -1):
                pattern, own = self.levels[level][0], self.own[level]
                if level < top:
                    node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                    q, apart = np.repeat(q, FANOUT), np.repeat(apart, FANOUT)
                    inside = node < len(pattern)
                    q, node, apart = q[inside], node[inside], apart[inside]
                open_ = ((node + 1) * FANOUT**level > q + 1) & (same[level][node] != label[q])
                q, node, apart = q[open_], node[open_], apart[open_]
                apart = apart + np.bitwise_count((self.codes[q] ^ pattern[node]) & own[node])
                near = apart <= max_bits
                q, node, apart = q[near], node[near], apart[near]
            merge(label, q, node)
        groups = np.empty(n, np.int64)
        groups[self.order] = self.order[label]
        return groups


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the groups of each pair, in place; label[i] is the root of i."""
    while len(a):
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return
        a, b = a[differ], b[differ]
        np.minimum.at(label, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
        while not np.array_equal(label, up := label[label]):
            label[:] = up


def blocks(bits: int, parts: int) -> list[tuple[int, int]]:
    """(start, width) of `parts` even blocks of `bits` bits, counted from the highest bit."""
    edges = [bits * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def dealt(frame: DataFrame, width: int, parts: int, bits: int) -> DataFrame:
    """One row for each of `parts` blocks of the column `rest` (`width` bits): `key` of the block's leading `bits` bits below
    the old key, and `rest` without the block (its first width // parts bits), so `width - width // parts` bits."""
    cut = width // parts
    out = []
    for i, (start, wide) in enumerate(blocks(width, parts)):
        wide = min(bits, wide)
        own = F.shiftrightunsigned("rest", width - start - wide).bitwiseAND((1 << wide) - 1) if wide else F.lit(0).cast("long")
        below = width - start - cut
        low = F.col("rest").bitwiseAND((1 << below) - 1)
        high = F.shiftleft(F.shiftrightunsigned("rest", width - start), below) if start else F.lit(0).cast("long")
        out.append(F.struct(F.xxhash64("key", F.lit(i), own).alias("key"), high.bitwiseOR(low).alias("rest"), F.when(F.col("block") < 0, i).otherwise(F.col("block")).alias("block")))
    return frame.withColumn("d", F.explode(F.array(*out))).select("fp", "node", "d.key", "d.rest", "d.block")


def links(codes: DataFrame, n: int, max_bits: int, bucket: int = BUCKET, split: int = SPLIT) -> DataFrame:
    """Spanning links (a, b) between nodes of codes (fp, node) with at most max_bits differing bits.

    The bucket count follows n. A bucket of over `split` codes is dealt out anew by blocks of its other bits, as often as
    needed: members that agree in a block differ in at most max_bits of the rest, so the same argument holds and none of its
    links is lost. Each time the rest shrinks by a block, so after a few rounds no more than `split` distinct codes can share a bucket.
    """
    parts = max_bits + 1
    spans = blocks(64, parts)
    bits = max(0, int(np.ceil(np.log2(max(1, n) / bucket))))
    start = codes.select("fp", "node", F.col("fp").alias("rest"), F.lit(0).cast("long").alias("key"), F.lit(-1).alias("block"))
    keyed = dealt(start, 64, parts, bits) if bits else start
    width, ready = 64 - 64 // parts if bits else 64, []
    while n > split and 1 << width > split:
        sizes = keyed.groupBy("key").agg(F.count("*").alias("held")).filter(F.col("held") > split)
        sizes = staged(sizes, "full-buckets")
        total = sizes.agg(F.sum("held")).first()[0]
        if not total:
            break
        marked = split_join(keyed, sizes, "key", "held", total, F.col("node"))
        ready.append(marked.filter("held is null").drop("held"))
        # one block is left out of a round only by its own bits, so all blocks of the rest are used
        keyed = staged(dealt(marked.filter("held is not null").drop("held"), width, parts, 64), "dealt-codes")
        width -= width // parts
    for part in ready:
        keyed = keyed.unionByName(part)

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        codes, nodes = pdf["fp"].to_numpy().view(np.uint64), pdf["node"].to_numpy()
        start = spans[max(0, int(pdf["block"].iat[0]))][0]
        turned = (codes << np.uint64(start)) | (codes >> np.uint64(64 - start)) if start else codes
        group = GrayIndex(turned).groups(max_bits) if len(codes) > 1 else np.arange(len(codes))
        linked = group != np.arange(len(codes))
        return pd.DataFrame({"a": nodes[linked], "b": nodes[group[linked]]})

    return keyed.select("key", "block", "fp", "node").groupBy("key").applyInPandas(search, "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 3) -> DataFrame:
    """(id, fingerprint, component_id) for each row of docs.

    Null and wordless texts have fingerprint zero and link like any other; texts of fewer words than a
    shingle are one shingle. component_id is the smallest id reachable by links, null ids left out;
    a fingerprint whose rows all have null ids links with nothing and has a null component. Rows that repeat an id
    each get a row. An empty table gives no rows; other columns are not read.
    """
    found = staged(fingerprints(docs.select(F.col(id_col).alias("_row"), F.col(text_col).alias("_text")), "_row", "_text", words), "fingerprints")
    codes = staged(found.groupBy("fp").agg(F.min("_row").alias("node"), F.count("*").alias("rows")), "codes")
    near = codes.filter("node is not null").select("fp", "node")
    roots = components(links(near, near.count(), max_bits))
    named = codes.join(roots, "node", "left").select("fp", "rows", F.coalesce("root", "node").alias("component_id"))
    joined = split_join(found, named, "fp", "rows", found.count(), F.coalesce(F.col("_row"), F.lit(0)))
    return joined.select(F.col("_row").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 3) -> DataFrame:
    """The rows of docs whose id is their component's smallest, all columns as they were; null ids stay."""
    losers = simhash_groups(docs, id_col, text_col, words, max_bits).filter(F.col(id_col) != F.col("component_id"))
    return without(docs, losers.select(id_col), id_col)
