"""Language-model scores by online logistic context mixing.

A text is a sequence of words. Frequent words have binary codes (Huffman's), all others share one; so a text is a
sequence of bits, each decided at a node of the code tree. Predictors with hashed contexts that cross words (the node
alone, after the word before, after the two before, after the one before that, and the node and word before in this
text so far) each give the bit's probability from counts: four of all training text, two of the text itself, online. A
mixer adds their logits with weights gated by how much each context has seen; an adaptive probability map refines the
sum. Less frequent words then are drawn by discounted counts and the text's own; those that training never saw are together
the unknown token, as in the unigram base. Unknown words' spellings, by a like mixer over bytes, complete the
text's bits.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm.shared import split_join, staged
from gneiss.llm.simhash import LOWER

#: log2 of the slots of each predictor: bytes before it 0 to 4, and the place in the word.
SLOTS = (16, 16, 18, 20, 20, 16)
STARTS = np.concatenate(([0], np.cumsum([1 << s for s in SLOTS])))
#: Pieces in which tables are added up; one word in HELD is kept from the tables until it has trained mixer and map; words of one task that trains them.
PIECES, HELD, SPELT = 16, 10, 50_000
#: Weight sets: 8 bits of a byte by orders 0 to 4 as the longest context with counts.
SETS, EPOCHS, RATE = 40, 4, 0.02
#: Cells of the probability map for each partial byte.
CELLS = 33
#: Most frequent training words, which have codes of their own; strength of a text's own rarer words (tokens the corpus's counts are worth).
HEAD, STRENGTH = 1 << 14, 500.0
#: log2 of the slots of the contexts that training counts, at most: the node, and node after one word, two words, the one before the last.
WORD_SLOTS = (15, 18, 20, 18)
#: Contexts in all: those, and node and word before of the text itself. Weight sets by what the contexts have seen.
INPUTS, GATES, MAPS = 6, 64, 16
#: Tokens in which a text's own counts are kept, tokens computed at once, tokens a task that trains the mixer has at least where there are as many.
SEGMENT, CHUNK, MIXED = 1 << 15, 1 << 13, 100_000
#: Columns of a text's own row and of the rows of its less frequent words.
NAMES = ["row", "word", "k", "id", "held", "n_tokens", "n_known", "bytes", "base", "score"]
#: Distinct words that one task counts before it hands them on, and those whose bits it counts at once.
FLUSH, GATHER = 600_000, 40_000
#: Rows scored and handed on at once.
SLICE = 500


def stretch(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -20, 20)))


class Bits:
    """The bits of words with a closing space, and each predictor's slot for each of them."""

    def __init__(self, words: list[bytes]):
        sizes = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
        byte = np.frombuffer(b" ".join(words) + b" " if words else b"", np.uint8).astype(np.uint64)
        self.word = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(len(byte)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        context, before = [np.zeros(len(byte), np.uint64)], np.zeros(len(byte), np.uint64)
        for order in range(1, 5):
            back = np.zeros(len(byte), np.uint64)
            back[order:] = byte[:-order] if order else byte
            before = (before << np.uint64(9)) | np.where(place >= order, back + np.uint64(1), np.uint64(0))
            context.append(before)
        context.append(np.minimum(place, 31).astype(np.uint64))
        self.context, self.byte = context, byte

    def bit(self, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bit j of each byte from the highest, the partial byte before it, slots by predictor)."""
        partial = (np.uint64(1) << np.uint64(j)) | (self.byte >> np.uint64(8 - j))
        slots = []
        for k, c in enumerate(self.context):
            mixed = (c * np.uint64(0x9E3779B97F4A7C15) + partial * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (c >> np.uint64(7))
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            slots.append((mixed >> np.uint64(64 - SLOTS[k])).astype(np.int64) + STARTS[k])
        return ((self.byte >> np.uint64(7 - j)) & np.uint64(1)).astype(np.int64), partial.astype(np.int64), np.stack(slots)


def add_counts(table: np.ndarray, words: list[bytes]) -> None:
    """Count each bit of the words in each predictor's slot; table has two counts for each slot."""
    bits = Bits(words)
    for j in range(8):
        bit, _, slots = bits.bit(j)
        for k, size in enumerate(SLOTS):
            at = 2 * STARTS[k]
            table[at : at + (2 << size)] += np.bincount(slots[k] * 2 + bit - at, minlength=2 << size).astype(np.uint32)


class Speller:
    """Probability of words' spellings: tables, mixer and probability map."""

    def __init__(self, table: np.ndarray):
        self.weights = np.full((SETS, 2 * len(SLOTS)), 0.15)
        self.map = np.tile(squash(np.linspace(-8, 8, CELLS)), (256, 1))
        self.look(table)

    def look(self, table: np.ndarray) -> None:
        """Take the counts of the table."""
        count = table.reshape(-1, 2).astype(np.float64)
        seen = count.sum(1)
        # the logit of each slot, and whether the slot has counts
        self.logit = stretch((count[:, 1] + 0.4) / (seen + 0.8)).astype(np.float32)
        self.seen = np.minimum(seen, 255).astype(np.uint8)

    def inputs(self, slots: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
        """Logits of each predictor, halved in a second copy where it has few counts, and the weight set."""
        x, seen = self.logit[slots].astype(np.float64), self.seen[slots]
        longest = np.argmax((seen[:5] > 0)[::-1], axis=0)
        return np.concatenate([x, x * (seen > 3)]).T, j * 5 + (4 - longest)

    def cells(self, logit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = (np.clip(logit, -7.999, 7.999) + 8) * (CELLS - 1) / 16
        low = at.astype(np.int64)
        return low, at - low

    def train(self, words: list[bytes], batch: int = 128) -> None:
        """Online: after each batch of words, mixer weights and map move towards the bits they should have given."""
        for epoch in range(EPOCHS):
            for first in range(0, len(words), batch):
                bits = Bits(words[first : first + batch])
                for j in range(8):
                    bit, partial, slots = bits.bit(j)
                    x, sets = self.inputs(slots, j)
                    logit = np.einsum("nk,nk->n", x, self.weights[sets])
                    error = bit - squash(logit)
                    gradient, n = np.zeros_like(self.weights), np.bincount(sets, minlength=SETS)[:, None]
                    np.add.at(gradient, sets, x * error[:, None])
                    self.weights += RATE / (1 + epoch) * gradient / np.maximum(1, np.sqrt(n))
                    low, part = self.cells(logit)
                    for cell, share in ((low, 1 - part), (low + 1, part)):
                        step, hits = np.zeros_like(self.map), np.zeros_like(self.map)
                        np.add.at(step, (partial, cell), share * (bit - self.map[partial, cell]))
                        np.add.at(hits, (partial, cell), share)
                        self.map += 0.2 * step / np.maximum(4, hits)

    def log2(self, words: list[bytes], batch: int = 4096) -> np.ndarray:
        """log2 probability of each word's spelling."""
        found = []
        for first in range(0, len(words), batch):
            part = words[first : first + batch]
            bits, total = Bits(part), np.zeros(len(part))
            for j in range(8):
                bit, partial, slots = bits.bit(j)
                x, sets = self.inputs(slots, j)
                logit = np.einsum("nk,nk->n", x, self.weights[sets])
                low, share = self.cells(logit)
                refined = self.map[partial, low] * (1 - share) + self.map[partial, low + 1] * share
                p = np.clip((squash(logit) + refined) / 2, 1e-6, 1 - 1e-6)
                total += np.bincount(bits.word, np.log2(np.where(bit, p, 1 - p)), len(part))
            found.append(total)
        return np.concatenate(found) if found else np.zeros(0)


def tokens(text: str | None) -> list[bytes]:
    """Words of the text, A-Z in lower case, then the end, which is the empty word."""
    return [*(text or "").encode().translate(LOWER).split(), b""]


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x > 0: Stirling's series after eight steps of the recurrence."""
    z = x + 8
    steps = F.log(x * (x + 1) * (x + 2) * (x + 3)) + F.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) - steps


def learn_speller(lexicon: DataFrame, distinct: int) -> Speller:
    """Tables from all training words (each distinct word once); mixer and map from those kept out of them, all of which then join the tables."""
    kept = F.pmod(F.xxhash64(F.lit(1), F.col("word")), F.lit(HELD)) == 0
    known = lexicon.filter("c > 0")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, waiting = np.zeros(2 * STARTS[-1], np.uint32), []
        for pdf in batches:
            waiting += [bytes(w) for w in pdf["word"]]
            if len(waiting) >= GATHER:
                add_counts(table, waiting)
                waiting = []
        add_counts(table, waiting)
        for k, piece in enumerate(np.array_split(table, PIECES)):
            yield pd.DataFrame({"piece": [k], "counts": [zlib.compress(piece.tobytes(), 1)]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(c), np.uint32).astype(np.uint64) for c in pdf["counts"])
        return pd.DataFrame({"piece": pdf["piece"].iloc[:1], "counts": [zlib.compress(np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes(), 1)]})

    def table(words: DataFrame, tasks: int) -> np.ndarray:
        tables = words.select("word").repartition(tasks).mapInPandas(count, "piece int, counts binary")
        rows = tables.groupBy("piece").applyInPandas(add, "piece int, counts binary").collect()
        pieces = {r["piece"]: np.frombuffer(zlib.decompress(r["counts"]), np.uint32) for r in rows}
        return np.concatenate([pieces[k] for k in range(PIECES)]) if pieces else np.zeros(2 * STARTS[-1], np.uint32)

    rest = table(known.filter(~kept), int(min(256, max(1, distinct // 50_000))))
    model = Speller(rest)
    ready = lexicon.sparkSession.sparkContext.broadcast(model)

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = sorted((bytes(w) for pdf in batches for w in pdf["word"]), key=zlib.crc32)
        if words:
            mine = ready.value
            mine.train(words)
            yield pd.DataFrame({"n": [len(words)], "weights": [mine.weights.ravel().tolist()], "maps": [mine.map.ravel().tolist()]})

    tasks = max(1, distinct // HELD // SPELT)
    found = known.filter(kept).select("word").repartition(tasks, F.xxhash64("word")).mapInPandas(train, TRAINED).collect()
    ready.unpersist()
    if found:
        model.weights, model.map = averaged(found, model.weights.shape, model.map.shape)
        both = rest.astype(np.uint64) + table(known.filter(kept), max(1, tasks // HELD))
        model.look(np.minimum(both, 2**32 - 1).astype(np.uint32))
    return model


#: What a task that trains a mixer returns: how much it was trained on, its weights, its probability maps.
TRAINED = "n long, weights array<double>, maps array<double>"


def averaged(found: list, weights: tuple[int, int], maps: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Weights and maps of tasks that started alike, averaged by how much each was trained on."""
    share = [r["n"] for r in found]
    return tuple(np.average([r[name] for r in found], 0, share).reshape(shape) for name, shape in (("weights", weights), ("maps", maps)))


def of_pairs(of) -> np.ndarray:
    """of(zeros, ones) for each pair of counts under 256, at zeros + 256 * ones; then the same with a zero, and with a one, taken back."""
    v = np.arange(1 << 16)
    zeros, ones = v & 255, v >> 8
    return np.concatenate([of(zeros, ones), of(np.maximum(zeros - 1, 0), ones), of(zeros, np.maximum(ones - 1, 0))])


#: Logit of a pair of counts, and what gates see of it: steps of the sum of counts.
LOGIT = of_pairs(lambda z, o: np.log((o + 0.3) / (z + 0.3)).astype(np.float32))
FEW, SOME, OWN = (of_pairs(lambda z, o, at=at: sum((z + o >= a).astype(np.int8) for a in at)) for at in ((1, 2, 8), (1, 4, 32), (1, 2, 4)))


def huffman(counts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, node, bit): symbol s decides bit[start[s]:start[s + 1]] at nodes node[...], root first; ties by order."""
    heap = [(c, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    up: dict[int, tuple[int, int]] = {}
    for node in range(len(counts), 2 * len(counts) - 1):
        for bit in (0, 1):
            up[heap[0][1]] = (node, bit)
            if bit == 0:
                first = heapq.heappop(heap)[0]
        heapq.heapreplace(heap, (first + heap[0][0], node))
    paths = []
    for s in range(len(counts)):
        path, at = [], s
        while at in up:
            at, bit = up[at]
            path.append((at - len(counts), bit))
        paths.append(path[::-1])
    start = np.concatenate(([0], np.cumsum([len(p) for p in paths]))).astype(np.int64)
    flat = np.array([x for p in paths for x in p], np.int64).reshape(-1, 2)
    return start, flat[:, 0].copy(), flat[:, 1].copy()


class WordMixer:
    """Probability of words in texts: codes, counts of hashed contexts, gated weights and probability maps."""

    def __init__(self, words: list[bytes], counts: list[int], rest: int, tokens_: int):
        self.symbol = {w: i for i, w in enumerate(words)}
        self.counts = counts
        self.rest = len(words)  # the symbol of all other words
        self.start, self.node, self.bit = huffman([*counts, max(1, rest)])
        self.node, self.bit = self.node.astype(np.int32), self.bit.astype(np.int32)
        reach = max(10, math.ceil(math.log2(max(2, tokens_))) + 2)
        self.sizes = [min(s, reach) if k else s for k, s in enumerate(WORD_SLOTS)]
        self.offsets = np.concatenate(([0], np.cumsum([1 << s for s in self.sizes])))
        self.table = np.zeros((0, 2), np.uint8)
        self.weights = np.full((GATES, INPUTS), 0.3)
        self.maps = np.tile(squash(np.linspace(-8, 8, CELLS)), (MAPS, 1))
        self.trained = 0

    def chunk(self, texts: list[list[bytes]]) -> dict[str, np.ndarray]:
        """Bits of the texts' tokens, with the slots of their contexts and what the text itself has seen so far."""
        get, rest = self.symbol.get, self.rest
        symbols = np.array([get(w, rest) for t in texts for w in t], np.int64)
        names = symbols.astype(np.uint64) + np.uint64(1)
        far = np.nonzero(symbols == rest)[0]
        if len(far):
            flat = [w for t in texts for w in t]
            names[far] = np.fromiter((zlib.crc32(flat[i]) for i in far), np.uint64, len(far)) + np.uint64(1 << 32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        text = np.repeat(np.arange(len(texts)), sizes)
        place = np.arange(len(symbols)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        one, two = np.zeros_like(names), np.zeros_like(names)
        one[1:], two[2:] = names[:-1], names[:-2]
        one[place < 1] = 0
        two[place < 2] = 0
        length = self.start[symbols + 1] - self.start[symbols]
        token = np.repeat(np.arange(len(symbols), dtype=np.int32), length)
        at = np.arange(len(token)) + np.repeat(self.start[symbols] - np.cumsum(length) + length, length)
        node, bit = self.node[at], self.bit[at]
        mix = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
        keys = (one * mix[0], one * mix[0] + (two + np.uint64(7)) * mix[1], (two + np.uint64(3)) * mix[2])
        own = node.astype(np.uint64) * mix[3]
        slots = [node]
        for k, key in enumerate(keys, 1):
            h = (key[token] ^ own) * mix[1]
            slots.append((h >> np.uint64(64 - self.sizes[k])).astype(np.int32) + np.int32(self.offsets[k]))
        return {"text": text, "token": token, "bit": bit, "node": node, "slots": slots, "one": one}

    def seen_before(self, text: np.ndarray, keys: list[np.ndarray], bit: np.ndarray) -> np.ndarray:
        """Counts of earlier bits of the same text with the same 16-bit keys, zeros + 256 * ones, each 255 at most.

        Bits lie in order of texts, so stable sorts by the keys alone (by counting, as they are short) keep texts together.
        """
        order = np.argsort(keys[0], kind="stable")
        for key in keys[1:]:
            order = order[np.argsort(key[order], kind="stable")]
        b, first = bit[order], np.ones(len(order), bool)
        if len(order):
            same = [x[order] for x in (text, *keys)]
            first[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in same])
        place = np.arange(len(order), dtype=np.int32)
        began = np.maximum.accumulate(np.where(first, place, 0))
        before = np.cumsum(b, dtype=np.int32) - b
        ones = before - before[began]
        out = np.empty(len(order), np.uint16)
        out[order] = np.minimum(place - began - ones, 255) + 256 * np.minimum(ones, 255)
        return out

    def add_counts(self, table: np.ndarray, texts: list[list[bytes]]) -> None:
        """Count the texts' bits in the slots of their contexts; table has two counts for each slot."""
        c = self.chunk(texts)
        for slots in c["slots"]:
            np.add.at(table, slots.astype(np.int64) * 2 + c["bit"], np.uint32(1))

    def inputs(self, c: dict, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(logits of the predictors, weight set, probability map) of each bit.

        What a training token itself gave to the counts is taken back, so that what occurs once in training scores as if held out.
        """
        bit, token = c["bit"], c["token"]
        # where in the tables of pairs: as counted, or with this very bit taken back
        own = np.where(held, 0, 1)[c["text"]][token].astype(np.int32) * ((bit + 1) << 16)
        x, flat = np.empty((INPUTS, len(bit)), np.float32), self.table.view(np.uint16).ravel()
        pairs = [flat[slots] + own for slots in c["slots"]]
        text, node = c["text"][token].astype(np.int32), c["node"].astype(np.uint16)
        after = (c["one"] * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(48)).astype(np.uint16)[token]
        pairs.append(self.seen_before(text, [node], bit))
        pairs.append(self.seen_before(text, [node, after], bit))
        for k, pair in enumerate(pairs):
            np.take(LOGIT, pair, out=x[k])
        own = OWN[pairs[5]]
        return x, FEW[pairs[2]] * np.int8(16) + SOME[pairs[1]] * np.int8(4) + own, OWN[pairs[4]] * np.int8(4) + own

    def cells(self, logit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = (np.clip(logit, -7.999, 7.999) + 8) * (CELLS - 1) / 16
        low = at.astype(np.int64)
        return low, at - low

    def train(self, texts: list[list[bytes]], held: np.ndarray, batch: int = 2048) -> None:
        """Online: after each batch of bits, weights and maps move towards the bits they should have given."""
        c = self.chunk(texts)
        x, gates, maps = self.inputs(c, held)
        rate = 0.02
        for a in range(0, len(gates), batch):
            part = slice(a, a + batch)
            xs, g, m, y = x[:, part].T.astype(np.float64), gates[part].astype(np.int64), maps[part].astype(np.int64), c["bit"][part]
            logit = np.einsum("nk,nk->n", xs, self.weights[g])
            error = y - squash(logit)
            n = np.bincount(g, minlength=GATES)[:, None]
            gradient = np.stack([np.bincount(g, error * xs[:, k], GATES) for k in range(INPUTS)], 1)
            self.weights += rate * gradient / np.maximum(1, np.sqrt(n))
            low, share = self.cells(logit)
            for cell, part_ in ((low, 1 - share), (low + 1, share)):
                flat = m * CELLS + cell
                hits = np.bincount(flat, part_, MAPS * CELLS)
                step = np.bincount(flat, part_ * (y - self.maps.ravel()[flat]), MAPS * CELLS)
                self.maps += (0.1 * step / np.maximum(4, hits)).reshape(MAPS, CELLS)

    def log2(self, texts: list[list[bytes]], held: np.ndarray) -> np.ndarray:
        """log2 probability of each text's symbols."""
        c = self.chunk(texts)
        x, gates, maps = self.inputs(c, held)
        logit, weights = np.zeros(x.shape[1], np.float32), self.weights.T.astype(np.float32).copy()
        for k in range(INPUTS):
            logit += x[k] * weights[k][gates]
        at = (np.clip(logit, -7.999, 7.999) + np.float32(8)) * np.float32((CELLS - 1) / 16)
        low = at.astype(np.int32)
        share, low = at - low, low + maps * np.int32(CELLS)
        flat = self.maps.ravel().astype(np.float32)
        refined = flat[low] * (1 - share) + flat[low + 1] * share
        mixed = 1 / (1 + np.exp(-np.clip(logit, -20, 20)))
        p = np.clip((mixed + refined) * np.float32(0.5), 1e-6, 1 - 1e-6)
        p = np.where(c["bit"] == 1, p, 1 - p)
        return np.bincount(c["text"][c["token"]], np.log2(p), len(texts))


def segments(found: list[bytes]) -> list[list[bytes]]:
    return [found[a : a + SEGMENT] for a in range(0, len(found), SEGMENT)]


def packed(table: np.ndarray) -> bytes:
    return zlib.compress(table.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(bytes(data)), np.uint32)


def added_up(tables: DataFrame, tasks: int) -> dict[int, np.ndarray]:
    """Sums of (task, piece, counts) by piece, in two rounds, so that no group holds over about sqrt(tasks) tables.

    Each slot's pair of counts is halved together until both are under 256.
    """

    def total(pdf: pd.DataFrame) -> np.ndarray:
        found = np.zeros(len(unpacked(pdf["counts"].iat[0])), np.uint64)
        for c in pdf["counts"]:
            found += unpacked(c)
        return np.minimum(found, 2**32 - 1).astype(np.uint32)

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"task": pdf["task"].iloc[:1], "piece": pdf["piece"].iloc[:1], "counts": [packed(total(pdf))]})

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = total(pdf).reshape(-1, 2)
        shift = np.maximum(0, np.ceil(np.log2((pairs.max(1) + np.float32(1)) / 256))).astype(np.uint32)
        return pd.DataFrame({"piece": pdf["piece"].iloc[:1], "counts": [packed((pairs >> shift[:, None]).astype(np.uint8))]})

    schema, fan = "task int, piece int, counts binary", max(1, math.isqrt(max(1, tasks)))
    once = tables.withColumn("task", F.col("task") % fan).groupBy("task", "piece").applyInPandas(add, schema)
    rows = once.groupBy("piece").applyInPandas(finish, "piece int, counts binary").collect()
    return {r["piece"]: np.frombuffer(zlib.decompress(bytes(r["counts"])), np.uint8) for r in rows}


def learn_words(rows: DataFrame, model: WordMixer, n_tokens: int) -> WordMixer:
    """Counts of contexts, weights and maps, all from all training text.

    The tables have a fixed greatest size. Tasks that train mixers start alike, and their weights are averaged by the tokens each has read;
    `trained` is the sum of these.
    """
    spark = rows.sparkSession
    learned = rows.filter("not held")
    shared = spark.sparkContext.broadcast(model)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = shared.value
        table, waiting, n = np.zeros(2 * mine.offsets[-1], np.uint32), [], 0
        for pdf in batches:
            for text in pdf["text"]:
                waiting += segments(tokens(text))
                n += len(text or "") // 4
                if n >= CHUNK:
                    for part in batched(waiting):
                        mine.add_counts(table, part)
                    waiting, n = [], 0
        for part in batched(waiting):
            mine.add_counts(table, part)
        task = TaskContext.get().partitionId()
        for k, piece in enumerate(np.array_split(table, PIECES)):
            yield pd.DataFrame({"task": [task], "piece": [k], "counts": [packed(piece)]})

    source = learned.select("text")
    tasks = source.rdd.getNumPartitions()
    pieces = added_up(source.mapInPandas(count, "task int, piece int, counts binary"), tasks)
    if pieces:
        model.table = np.concatenate([pieces[k] for k in range(PIECES)]).reshape(-1, 2)
    else:
        model.table = np.zeros((model.offsets[-1], 2), np.uint8)
    shared.unpersist()
    ready = spark.sparkContext.broadcast(model)

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine, n = ready.value, 0
        for pdf in batches:
            for part in batched(s for t in pdf["text"] for s in segments(tokens(t))):
                mine.train(part, np.zeros(len(part), bool))
                n += sum(map(len, part))
        if n:
            yield pd.DataFrame({"n": [n], "weights": [mine.weights.ravel().tolist()], "maps": [mine.maps.ravel().tolist()]})

    found = source.coalesce(max(1, min(tasks, n_tokens // MIXED))).mapInPandas(train, TRAINED).collect()
    ready.unpersist()
    model.trained = sum(r["n"] for r in found)
    if found:
        model.weights, model.maps = averaged(found, (GATES, INPUTS), (MAPS, CELLS))
    return model


def batched(parts: Iterable[list[bytes]]) -> Iterator[list[list[bytes]]]:
    """The segments, about CHUNK tokens at a time."""
    held, n = [], 0
    for p in parts:
        held.append(p)
        n += len(p)
        if n >= CHUNK:
            yield held
            held, n = [], 0
    if held:
        yield held


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: int = 1, folds: int = 5) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for each row of docs.

    A row is held out where crc32(id as text) mod folds is `fold`; null ids are not. Everything is learned from the other
    rows. base_score is the add-half unigram score; score is the log10 probability of the token sequence, in which all
    words unknown to training are one token, as in the base; bits_per_byte is the code length with unknown words spelled
    out, over the text's bytes (the closing token included). What a training row's token gave to the context counts is
    taken back when it is scored. Null and empty texts are the end alone. Rows that repeat an
    id each get a row; an empty table gives no rows; other columns are not read. With nothing to learn from, all tokens are unknown.

    Word counts are added up in tasks and shuffled by word. The HEAD most frequent training words (a fixed number) and the
    tables of contexts (of fixed size) are held by every task; other words of a text go to their counts by a join, for which words that
    hold over a thousandth of all tokens are broadcast.
    """
    spark = docs.sparkSession
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), held.alias("held"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        learned, other = Counter(), Counter()

        def out() -> pd.DataFrame:
            words = [*learned.keys() | other.keys()]
            frame = pd.DataFrame({"word": words, "c": [learned[w] for w in words], "n": [learned[w] + other[w] for w in words]})
            learned.clear()
            other.clear()
            return frame

        for pdf in batches:
            for held, text in zip(pdf["held"], pdf["text"]):
                (other if held else learned).update(tokens(text))
                if len(learned) + len(other) > FLUSH:
                    yield out()
        yield out()

    counted = rows.select("held", "text").mapInPandas(count, "word binary, c long, n long")
    lexicon = staged(counted.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n")), "lexicon")
    sums = lexicon.agg(
        F.sum("c").alias("N"), F.count_if(F.col("c") > 0).alias("V"), F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2"), F.sum("n").alias("all")
    ).first()
    N, V, every = sums["N"] or 0, sums["V"] or 0, sums["all"] or 0
    discount = min(0.95, max(0.05, (sums["n1"] + 0.5) / (sums["n1"] + 2 * sums["n2"] + 1)))
    # the count from which words have codes, by a histogram in steps of a sixteenth of a power of two
    step = F.floor(16 * F.log2(F.col("c"))).cast("int")
    room, least = HEAD, None
    for r in sorted(lexicon.filter("c > 0").groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        room -= r["count"]
        if room < 0:
            break
        least = r["step"]
    top = lexicon.filter("c > 0").filter(step >= least).select("word", "c").collect() if least is not None else []
    top = sorted(((bytes(r["word"]), r["c"]) for r in top), key=lambda x: (-x[1], x[0]))
    rest = N - sum(c for _, c in top)
    mixer = learn_words(rows, WordMixer([w for w, _ in top], [c for _, c in top], rest, N), N)
    speller = learn_speller(lexicon, V)
    model = spark.sparkContext.broadcast(mixer)
    spelling = spark.sparkContext.broadcast(speller)

    # words without a code: their share of what they all have, and of unknown ones the length of the spelling in bits
    held_back = discount * (V - len(top))
    mass = max(1e-9, rest - held_back) + max(held_back, 1e-3)
    unknown = max(held_back, 1e-3) / mass

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"word": pdf["word"], "n": pdf["n"], "l": spelling.value.log2([bytes(w) for w in pdf["word"]])})

    unseen = lexicon.filter("c = 0").select("word", "n").mapInPandas(spell, "word binary, n long, l double")
    drawn = lexicon.filter("c > 0") if least is None else lexicon.filter("c > 0").filter(step < least)
    p = F.greatest(F.col("c") - discount, F.lit(1e-3)) / mass
    scored = drawn.select("word", "n", "c", p.alias("p"), F.lit(0.0).alias("l")).unionByName(unseen.select("word", "n", F.lit(0).cast("long").alias("c"), F.lit(0.0).alias("p"), "l"))
    scored = staged(scored, "spelled")
    floor = N + 0.5 * (V + 1)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine, log10 = model.value, math.log10
        known = dict(zip(mine.symbol, mine.counts))
        for pdf in (batch.iloc[at : at + SLICE] for batch in batches for at in range(0, len(batch), SLICE)):
            out, words, counts, of_row = [], [], [], []
            bits, flags, waiting, owner, n_waiting = np.zeros(len(pdf)), pdf["held"].to_numpy(bool), [], [], 0

            def mix() -> None:
                own = np.array(owner, np.int64)
                if len(own):
                    np.add.at(bits, own, mine.log2(waiting, flags[own]))
                waiting.clear()
                owner.clear()

            for i, (row, doc, held, text) in enumerate(zip(pdf["row"], pdf["id"].array, pdf["held"], pdf["text"])):
                found = tokens(text)
                for part in segments(found):
                    waiting.append(part)
                    owner.append(i)
                    n_waiting += len(part)
                    if n_waiting >= CHUNK:
                        mix()
                        n_waiting = 0
                n_known, base, before = 0, 0.0, len(words)
                for word, n in Counter(found).items():
                    c = known.get(word)
                    if c is None:
                        words.append(word)
                        counts.append(n)
                    else:
                        base += n * log10((c + 0.5) / floor)
                        n_known += n
                of_row.append(len(words) - before)
                # a word cannot hold a space, so this key meets no word
                out.append((row, b" %d" % row, 0, doc, held, len(found), n_known, len((text or "").encode()) + 1, base))
            mix()
            frame = pd.DataFrame(out, columns=NAMES[:-1])
            frame["score"] = bits * log10(2)
            yield frame.astype({"id": "Int64", "held": "boolean"})
            tail = pd.DataFrame({"row": np.repeat(pdf["row"].to_numpy(), of_row), "word": pd.Series(words, dtype=object), "k": np.array(counts, np.int64)})
            for name in NAMES[3:]:
                tail[name] = pd.array([pd.NA], "Int64" if name == "id" else "boolean").take(np.zeros(len(tail), np.int64)) if name in ("id", "held") else np.float64(0) if name in NAMES[8:] else np.int64(0)
            yield tail

    parts = rows.mapInPandas(read, "row long, word binary, k long, id long, held boolean, n_tokens long, n_known long, bytes long, base double, score double")
    joined = split_join(parts, scored.select("word", "n", "c", "p", "l"), "word", "n", every, F.col("row"))
    is_known, is_new = (F.col("k") > 0) & (F.col("c") > 0), (F.col("k") > 0) & (F.col("c") == 0)
    a = F.col("p") * STRENGTH
    own = F.when(is_known, F.when(F.col("k") == 1, F.log(a)).otherwise(log_gamma(a + F.col("k")) - log_gamma(a))).otherwise(0.0)
    summed = joined.groupBy("row").agg(
        F.max("id").alias("id"),
        F.max("held").alias("held_out"),
        F.sum("n_tokens").alias("n_tokens"),
        (F.sum("n_known") + F.sum(F.when(is_known, F.col("k")).otherwise(0))).alias("n_known"),
        F.sum("bytes").alias("bytes"),
        (F.sum("base") + F.sum(F.when(F.col("k") > 0, F.col("k") * F.log10((F.col("c") + 0.5) / F.lit(floor))).otherwise(0.0))).alias("base_score"),
        (F.sum("score") + F.sum(own) / math.log(10)).alias("known_score"),
        F.sum("k").alias("rare"),
        F.sum(F.when(is_new, F.col("k") * F.col("l") * math.log10(2)).otherwise(0.0)).alias("spelled"),
    )
    many, u = F.col("n_tokens") - F.col("n_known"), F.lit(unknown * STRENGTH)
    drawn_as = F.when(many > 0, log_gamma(u + many) - log_gamma(u)).otherwise(0.0)
    drawn_from = F.when(F.col("rare") > 0, log_gamma(STRENGTH + F.col("rare")) - math.lgamma(STRENGTH)).otherwise(0.0)
    result = summed.withColumn("score", F.col("known_score") + (drawn_as - drawn_from) / math.log(10))
    bits = -(F.col("score") + F.col("spelled")) * math.log2(10) / F.col("bytes")
    return result.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(N).cast("long").alias("train_tokens"), "base_score", "score", bits.alias("bits_per_byte"))
