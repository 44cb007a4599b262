"""Writes as snapshots: upserts, first writer wins, compare-and-set, leases, packing in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str, keep: list[str], replace: list[str]) -> DataFrame:
    """The next snapshot: new rows replace `replace` columns, old rows keep `keep` columns where they exist."""
    o = old.select(F.col(key).alias("_k"), F.struct(*keep, *replace).alias("_o"))
    n = new.select(F.col(key).alias("_n_k"), F.struct(*keep, *replace).alias("_n"))
    both = o.join(n, F.col("_k") == F.col("_n_k"), "full")
    kept = [F.when(F.col("_k").isNotNull(), F.col(f"_o.{c}")).otherwise(F.col(f"_n.{c}")).alias(c) for c in keep]
    replaced = [F.when(F.col("_n_k").isNotNull(), F.col(f"_n.{c}")).otherwise(F.col(f"_o.{c}")).alias(c) for c in replace]
    return both.select(F.coalesce("_k", "_n_k").alias(key), *kept, *replaced)


def latest(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The last row of each key, by map-side aggregation rather than a sort of the group."""
    columns = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_r")).select(*key, "_r.*")


def first_writer(rows: DataFrame, key: list[str], content: Column, order: Column, withdrawn: Column) -> DataFrame:
    """Rows with a decision: created for the first of each key, then already_received for the same content,
    tombstone where the first was withdrawn, else conflict."""
    first = rows.groupBy(*key).agg(
        F.min(order).alias("_first"), F.min_by(content, order).alias("_content"), F.min_by(withdrawn, order).alias("_withdrawn")
    )
    joined = rows.join(first, key)
    decision = (
        F.when(order == F.col("_first"), "created").when(F.col("_withdrawn"), "tombstone").when(content.eqNullSafe(F.col("_content")), "already_received").otherwise("conflict")
    )
    return joined.withColumn("decision", decision).drop("_first", "_content", "_withdrawn")


def compare_and_set(rows: DataFrame, column: str, condition: Column, value: Column) -> DataFrame:
    """Rows with the column set where the condition holds, and `changed` saying so."""
    hit = F.coalesce(condition, F.lit(False))
    return rows.withColumn("changed", hit).withColumn(column, F.when(hit, value).otherwise(F.col(column)))


def ordered_fold(rows: DataFrame, key: list[str], order: list[str], step, start, out: str) -> DataFrame:
    """Rows with one more column: a sequential fold over each key's rows in order, with constant memory.

    Rows are dealt out by key and sorted within partitions, so a key of any size streams through one task and only the fold's
    state is held. step(state, row) gives (state, value); rows come as tuples of the frame's columns.
    """
    columns, places = rows.columns, [rows.columns.index(c) for c in key]

    def run(batches):
        at, state = None, start
        for batch in batches:
            values = []
            for row in zip(*(batch[c].to_numpy() for c in columns)):
                mine = tuple(row[p] for p in places)
                if mine != at:
                    at, state = mine, start
                state, value = step(state, row)
                values.append(value)
            yield batch.assign(**{out: values})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.repartition(*key).sortWithinPartitions(*key, *order).mapInPandas(run, f"{schema}, `{out}` long")


def lease_grants(rows: DataFrame, key: str, micros: str, lease: int) -> DataFrame:
    """(key, micros) of requests that get the key's exclusive lease: the first, then each first one after its end."""

    def step(last: int, row: tuple) -> tuple[int, int]:
        granted = row[1] >= last + lease
        return (row[1] if granted else last), int(granted)

    folded = ordered_fold(rows.select(key, micros), [key], [micros], step, -(1 << 62), "_granted")
    return folded.filter("_granted = 1").drop("_granted")


def pack_in_order(rows: DataFrame, key: str, order: list[str], size: str, most_items: int, most_size: int) -> DataFrame:
    """Rows with `chunk`: consecutive rows of a key fill a chunk until an item more would pass either limit.

    A row over the size limit is a chunk of its own. The order must be total.
    """

    def step(state: tuple, row: tuple) -> tuple[tuple, int]:
        chunk, items, total = state
        if items and (items + 1 > most_items or total + row[-1] > most_size):
            chunk, items, total = chunk + 1, 0, 0
        return (chunk, items + 1, total + row[-1]), chunk

    slim = rows.select(key, *order, F.col(size).cast("long").alias(size))
    return ordered_fold(slim, [key], order, step, (0, 0, 0), "chunk").withColumn("chunk", F.col("chunk").cast("int"))
