"""Embedding near-dedup by PCA-ordered tiled comparison.

Vectors link with those of their own length. Distinct vectors are turned onto the principal axes, largest variance first, and cut into tiles along the
leading axes. A pair of tiles is compared where their boxes can hold a link. Inside, products are summed over
the leading dimensions first; what the remaining ones can add is bounded by the norms of the suffixes, and
a pair stops as soon as its cosine cannot reach the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.shared import components, hash_sample, split_join, staged
from gneiss.llm.simhash import merge

#: Vectors a tile should hold, rows of the sample that fits axes and tile edges, leading axes of tile boxes.
TILE, SAMPLE, BOX = 4096, 20_000, 8
#: Most frequent lengths that get axes of their own, and the longest one that does; all other lengths (each of them holds
#: under 1 / LENGTHS of the vectors, or is very long) are compared along their own dimensions, chunk by chunk.
LENGTHS, LONGEST = 16, 2048
#: Rows of a tile compared at once, and the numbers of dimensions after which pairs may stop.
STRIP, STOPS = 512, (8, 16, 32)
#: Share of open pairs below which they are followed one by one.
OPEN = 0.02
#: Cosines this close to the threshold are taken again from the vectors as stored.
CLOSE = 1e-7


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; scaled by the largest component first, so that nothing overflows."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def axes(sample: np.ndarray) -> np.ndarray:
    """Principal axes of unit vectors about the origin, as columns, largest variance first."""
    return np.linalg.eigh(sample.T @ sample)[1][:, ::-1].copy()


def tree(points: np.ndarray, leaves: int) -> list[tuple[int, float]]:
    """A complete binary tree of cuts (axis, value) in heap order; each cut is a median along the widest leading axis."""
    cuts, level = [], [points]
    while len(level) < leaves:
        below = []
        for part in level:
            spread = np.ptp(part[:, :BOX], axis=0) if len(part) else np.zeros(1)
            axis = int(spread.argmax())
            value = float(np.median(part[:, axis])) if len(part) else 0.0
            cuts.append((axis, value))
            left = part[:, axis] <= value
            below += [part[left], part[~left]]
        level = below
    return cuts


def tile_of(points: np.ndarray, cuts: list[tuple[int, float]]) -> np.ndarray:
    node = np.zeros(len(points), np.int64)
    if cuts:
        axis, value = np.array([c[0] for c in cuts]), np.array([c[1] for c in cuts])
        while node[0] < len(cuts) if len(node) else False:
            node = 2 * node + 1 + (points[np.arange(len(points)), axis[node]] > value[node])
    return node - len(cuts)


def compare(a: np.ndarray, b: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of a, rows of b, cosine) of the pairs that may reach the threshold, strip by strip.

    a, b: unit vectors on ordered axes. `same`: both are one tile, only b after a counts.
    """
    stops = [s for s in STOPS if s < a.shape[1]] + [a.shape[1]]
    rest_a, rest_b = (np.sqrt(np.maximum(0, 1 - np.cumsum(x * x, axis=1))) for x in (a, b))
    for start in range(0, len(a), STRIP):
        strip, done, dots = a[start : start + STRIP], 0, 0.0
        for at, stop in enumerate(stops):  # whole products while many pairs are open
            dots = dots + strip[:, done:stop] @ b[:, done:stop].T
            done = stop
            i, j = np.nonzero(dots >= threshold - CLOSE - np.outer(rest_a[start : start + STRIP, stop - 1], rest_b[:, stop - 1]))
            if len(i) < OPEN * dots.size:
                break
        if same:
            i, j = i[j > i + start], j[j > i + start]
        for first in range(0, len(i), 1 << 16):
            p, q = i[first : first + (1 << 16)], j[first : first + (1 << 16)]
            sums = dots[p, q]
            for before, stop in zip(stops[at:], stops[at + 1 :]):
                sums = sums + np.einsum("nd,nd->n", strip[p, before:stop], b[q, before:stop])
                keep = sums >= threshold - CLOSE - rest_a[p + start, stop - 1] * rest_b[q, stop - 1]
                p, q, sums = p[keep], q[keep], sums[keep]
            yield p + start, q, sums


def embedding_groups(table: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", tile: int = TILE, sample_rows: int = SAMPLE) -> DataFrame:
    """(id, n_links, component_id, kept) for each row of table.

    Vectors of equal length link at cosine >= threshold in double precision; between lengths there is no cosine.
    Vectors that are null, empty, zero or hold null or non-finite components link with nothing:
    no links, a component of their own, kept. Rows with a null id are counted by no vector and have a null component.
    Rows that repeat an id each get a row. An empty table gives no rows; other columns are not read.

    Equal vectors are one distinct vector with a weight. Axes and tile edges come from about sample_rows distinct
    vectors chosen by hash (they shape the tiles only; every vector is compared). Every link is counted; for groups a tile
    pair returns spanning links only.
    """
    spark = table.sparkSession
    vector = F.col(vector_col).cast("array<double>")
    fine = "v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"
    rows = table.select(F.col(id_col).cast("long").alias("_id"), vector.alias("v")).withColumn("ok", F.coalesce(F.expr(fine), F.lit(False)))
    rows = rows.withColumn("ok", F.col("ok") & F.col("_id").isNotNull())
    good = rows.filter("ok").select("_id", "v")
    distinct = staged(good.groupBy("v").agg(F.min("_id").alias("node"), F.count("*").alias("weight")).withColumn("dim", F.size("v")), "vectors")
    lengths = distinct.groupBy("dim").agg(F.count("*").alias("n"))
    models: dict[int, tuple[np.ndarray, list[tuple[int, float]]]] = {}
    for dim, n in lengths.filter(F.col("dim") <= LONGEST).orderBy(F.desc("n"), "dim").limit(LENGTHS).collect():
        mine = distinct.filter(F.col("dim") == dim)
        sample = hash_sample(mine, ["v"], sample_rows, n).select("v").limit(2 * sample_rows).toPandas()["v"]
        if not len(sample):
            sample = mine.select("v").limit(1).toPandas()["v"]
        sample = unit(np.stack(sample.to_numpy()).astype(np.float64))
        turn = axes(sample)
        leaves = 1
        while leaves * tile < n:
            leaves *= 2
        models[dim] = turn, tree(sample @ turn, leaves)

    def turned(pdf: pd.DataFrame, dim: int) -> np.ndarray:
        points = unit(np.stack(pdf["v"].to_numpy()).astype(np.float64))
        return points @ models[dim][0] if dim in models else points

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, pdf in batch.groupby("dim"):
                points = turned(pdf, dim)
                lead = np.zeros((len(pdf), BOX))
                lead[:, : min(BOX, dim)] = points[:, :BOX]
                yield pd.DataFrame({"dim": pdf["dim"], "tile": tile_of(points, models[dim][1]), "node": pdf["node"], "weight": pdf["weight"], "v": pdf["v"], "lead": list(lead)})

    modelled = F.col("dim").isin(list(models))
    # lengths without axes: chunks by hash whose boxes all meet
    chunk = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / tile).cast("long"))
    plain = distinct.filter(~modelled).join(lengths, "dim").select("dim", chunk.alias("tile"), "node", "weight", "v", F.array_repeat(F.lit(0.0), BOX).alias("lead"))
    tiled = distinct.filter(modelled).mapInPandas(place, "dim int, tile long, node long, weight long, v array<double>, lead array<double>")
    tiled = staged(tiled.unionByName(plain), "tiles")
    ends = [f(F.col("lead")[k]).alias(f"{f.__name__}{k}") for k in range(BOX) for f in (F.min, F.max)]
    boxes = tiled.groupBy("dim", "tile").agg(*ends)
    # tiles meet where their boxes are no further apart than two unit vectors with a cosine at the threshold
    reach = float(np.sqrt(2 - 2 * threshold) + 1e-6)
    gap = " + ".join(f"pow(greatest(0, a.min{k} - b.max{k}, b.min{k} - a.max{k}), 2)" for k in range(BOX))
    cells = "sequence(cast(floor((min0 - {0}) / {1}) as int), cast(floor((max0 + {0}) / {1}) as int))"
    here = boxes.withColumn("cell", F.explode(F.expr(cells.format(0, reach)))).alias("a")
    near = boxes.withColumn("cell", F.explode(F.expr(cells.format(reach, reach)))).alias("b")
    meet = here.join(near, F.expr(f"a.dim = b.dim and a.cell = b.cell and a.tile <= b.tile and {gap} <= {reach * reach}"))
    meet = meet.select(F.col("a.dim").alias("dim"), F.col("a.tile").alias("left"), F.col("b.tile").alias("right")).distinct()
    ends = meet.select("dim", "left", "right", F.col("left").alias("tile"), F.lit(0).alias("side"))
    ends = ends.unionByName(meet.filter("left <> right").select("dim", "left", "right", F.col("right").alias("tile"), F.lit(1).alias("side")))
    ready = tiled.select("dim", "tile", "node", "weight", "v").join(ends, ["dim", "tile"])

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "node"], kind="stable")
        points, stored = turned(pdf, int(pdf["dim"].iat[0])), pdf["v"].to_numpy()
        node, weight, side = (pdf[c].to_numpy() for c in ("node", "weight", "side"))
        cut, same = int((side == 0).sum()), not side.any()
        shift = 0 if same else cut
        label, count = np.arange(len(pdf)), np.zeros(len(pdf), np.int64)
        for i, j, cosine in compare(points[:cut], points[shift:], threshold, same):
            j = j + shift
            for k in np.nonzero(np.abs(cosine - threshold) <= CLOSE)[0]:
                x, y = (v / np.abs(v).max() for v in (stored[i[k]].astype(np.float64), stored[j[k]].astype(np.float64)))
                cosine[k] = x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y))
            keep = cosine >= threshold
            i, j = i[keep], j[keep]
            np.add.at(count, i, weight[j])
            np.add.at(count, j, weight[i])
            merge(label, i, j)
        linked = (count > 0) | (label != np.arange(len(pdf)))
        return pd.DataFrame({"node": node[linked], "links": count[linked], "other": node[label[linked]]})

    found = staged(ready.groupBy("dim", "left", "right").applyInPandas(links, "node long, links long, other long"), "links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = distinct.join(counts, "node", "left").join(roots, "node", "left")
    named = named.select("v", "weight", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("root", "node").alias("root"))
    keyed = rows.withColumn("v", F.when(F.col("ok"), F.col("v")))
    joined = split_join(keyed, named, "v", "weight", table.count(), F.coalesce("_id", F.lit(0)))
    component = F.when(F.col("ok"), F.col("root")).otherwise(F.col("_id"))
    return joined.select(
        F.col("_id").alias(id_col),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("_id").eqNullSafe(component).alias("kept"),
    )
