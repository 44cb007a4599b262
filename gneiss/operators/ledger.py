"""The ledger's predicates, writes and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Answers of the service that may be tried again, and the order of a vendor's matrix.
RETRY_STATUS, MATRIX_ORDER = (408, 425, 429), (0, 3, 4, 1, 5, 2)


def visible(committed: Column, upload_withdrawn: Column, reservation_withdrawn: Column, kind: Column, completed: Column, licensed: Column, scheduled: Column, now: Column) -> Column:
    """The eight conditions under which a series is shown; `now` is bound by the caller."""
    return committed & ~upload_withdrawn & ~reservation_withdrawn & kind & completed.isNotNull() & licensed & scheduled.isNotNull() & (scheduled <= now)


def approved(held: DataFrame, asked: DataFrame, key: str, replace: list[str], now: int) -> DataFrame:
    """The next snapshot of registrations (key, columns, revoked, created, updated) after approval of pending requests."""
    new = asked.filter("status = 'pending'").select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in replace])
    both = held.join(new, held[key] == F.col("_k"), "full")
    hit = F.col("_k").isNotNull()
    return both.select(
        F.coalesce(F.col(key), F.col("_k")).alias(key),
        *[F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in replace],
        F.when(hit, False).otherwise(F.col("revoked")).alias("revoked"),
        F.coalesce("created", F.lit(now)).alias("created"),
        F.when(hit, now).otherwise(F.col("updated")).alias("updated"),
    )


def writable_until(provisional: Column, expires: Column) -> Column:
    return F.coalesce(provisional, expires)


def effective_status(status: Column, completed: Column, until: Column, now: Column) -> Column:
    """Open rows past their time are expired; uploading rows with all parts are checkpointed."""
    return F.when(status.isin("created", "uploading") & (until <= now), "expired").when((status == "uploading") & completed, "checkpointed").otherwise(status)


def retired_hash(request_hash: Column, status: Column, unique: Column) -> Column:
    """The hash of an expired request gives way to a new request of the same hash."""
    return F.when(status == "expired", F.concat_ws(":", request_hash, F.lit("expired"), unique)).otherwise(request_hash)


def shown(report: Column, local: list[str]) -> Column:
    """JSON of a struct without its local fields; missing fields are left out."""
    return F.to_json(report.dropFields(*local))


def request_codes(version: str, known: list[str], longest: int) -> Column:
    """Codes of what is wrong with a request (keys, name, email, plans, agreed, version), in order."""
    name = F.trim(F.regexp_replace("name", r"(?U)\s+", " "))
    bad = [
        ("UNKNOWN_FIELD", F.size(F.array_except("keys", F.array(*map(F.lit, known)))) > 0),
        ("NAME", ~F.coalesce(F.length(name).between(2, longest), F.lit(False))),
        ("EMAIL", ~F.coalesce((F.length("email") <= 254) & F.col("email").rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), F.lit(False))),
        ("PLANS", F.col("plans").isNull()),
        ("AGREEMENT", ~F.coalesce("agreed", F.lit(False))),
        ("POLICY_UPDATE_REQUIRED", F.coalesce("agreed", F.lit(False)) & ~F.col("version").eqNullSafe(F.lit(version))),
    ]
    return F.array_compact(F.array(*[F.when(condition, code) for code, condition in bad]))


def looked_up(rows: DataFrame, key: str, table: DataFrame, table_key: str, value: str) -> DataFrame:
    """Rows with the value of their key and `lookup`: found, missing or duplicate (then without a value)."""
    once = table.groupBy(F.col(table_key).alias("_k")).agg(F.min(value).alias("_v"), F.count("*").alias("_n"))
    joined = rows.join(once, F.col(key) == F.col("_k"), "left")
    state = F.when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "duplicate").otherwise("found")
    return joined.select(*rows.columns, F.when(F.col("_n") == 1, F.col("_v")).alias(value), state.alias("lookup"))


def api_retryable(status: Column, transient: Column) -> Column:
    return status.isin(*RETRY_STATUS) | status.between(500, 599) | transient


def storage_retryable(status: Column) -> Column:
    return (status == 429) | status.between(500, 599)


def vendor_matrix(m: Column) -> Column:
    """The six values of a symmetric matrix in the vendor's order."""
    return F.array(*[m[i] for i in MATRIX_ORDER])


def two_distinct(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, values): the first two distinct values; groups collapse by aggregation before they are ranked."""
    first = rows.groupBy(key, value).agg(F.min(order).alias("_at"))
    few = first.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_at"))).filter("_n <= 2")
    return few.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_n", value))).alias("_l")).select(key, F.transform("_l", lambda x: x[value]).alias("values"))


def tolerant_distinct(rows: DataFrame, key: str, value: str, tolerance: float) -> DataFrame:
    """(key, values, signatures): values in order, each further than the tolerance from the last one kept.

    Distinct values are found by aggregation first; the fold then runs over those alone.
    """
    lists = rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.lit(1).alias("_1")).groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("_all"))
    fold = F.aggregate("_all", F.array().cast("array<double>"), lambda s, v: F.when((F.size(s) == 0) | (v - F.element_at(s, -1) > tolerance), F.concat(s, F.array(v))).otherwise(s))
    return lists.select(key, fold.alias("values")).withColumn("signatures", F.size("values").cast("long"))


def first_seen_distinct(rows: DataFrame, key: str, order: str, values: list[str], tolerances: list[float]) -> DataFrame:
    """(key, order, values, rank): rows in order, each kept if no kept one of its key agrees with it in every value within that value's tolerance.

    Equal rows collapse to their first before the shuffle. Then a key's rows stream in order through one task, which holds the kept ones in a grid
    of cells a tolerance wide: a row is compared with those of its own and neighbouring cells only. Nulls and non-finite values are left out.
    """
    from itertools import product
    from math import floor

    finite = " and ".join(f"`{v}` is not null and not isnan(`{v}`) and abs(`{v}`) < double('inf')" for v in values)
    slim = rows.select(key, order, *[F.col(v).cast("double").alias(v) for v in values]).filter(finite).groupBy(key, *values).agg(F.min(order).alias(order)).select(key, order, *values)
    width = [t or 1.0 for t in tolerances]
    near = list(product((-1, 0, 1), repeat=len(values)))

    def run(batches):
        at, kept, rank = object(), {}, 0
        for batch in batches:
            keep = []
            for row in zip(*(batch[c].tolist() for c in batch.columns)):
                if row[0] != at:
                    at, kept, rank = row[0], {}, 0
                point = row[2:]
                cell = tuple(floor(x / w) for x, w in zip(point, width))
                others = (p for step in near for p in kept.get(tuple(c + s for c, s in zip(cell, step)), ()))
                fresh = not any(all(abs(x - y) <= t for x, y, t in zip(point, p, tolerances)) for p in others)
                if fresh:
                    kept.setdefault(cell, []).append(point)
                    rank += 1
                keep.append(rank if fresh else 0)
            yield batch.assign(rank=keep)[[k > 0 for k in keep]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields)
    return slim.repartition(key).sortWithinPartitions(key, order, *values).mapInPandas(run, f"{schema}, rank long")


def strict_offsets(rows: DataFrame, key: str, number: str, offset: str, length: str, *more: Column) -> DataFrame:
    """(key, offsets, more): whether a group's offsets start at zero and strictly increase, and no length is zero."""
    before = F.lag(offset).over(Window.partitionBy(key).orderBy(number))
    fine = F.when(F.col(number) == 1, F.col(offset) == 0).otherwise(F.col(offset) > before)
    return rows.withColumn("_fine", fine & (F.col(length) > 0)).groupBy(key).agg(F.bool_and("_fine").alias("offsets"), *more)


def violations(rows: DataFrame, unique: list[str], check: Column, reference: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """One row (repeated_keys, failed_checks, orphans): what a write broke; nothing may be published unless all are zero."""
    repeated = rows.groupBy(*unique).count().filter("count > 1").agg(F.count("*").alias("repeated_keys"))
    failed = rows.agg(F.count_if(~F.coalesce(check, F.lit(False))).alias("failed_checks"))
    orphans = rows.join(parents.select(F.col(parent_key).alias("_p")), F.col(reference) == F.col("_p"), "left_anti").agg(F.count("*").alias("orphans"))
    one = F.lit(1).alias("_one")
    return repeated.withColumn("_one", one).join(failed.withColumn("_one", one), "_one").join(orphans.withColumn("_one", one), "_one").drop("_one")


def manifest_mismatches(manifest: DataFrame, archive: DataFrame) -> DataFrame:
    """One row of counts over (path, size, digest): missing, extra, changed, and repeated paths of the archive."""
    once = archive.groupBy("path").agg(F.min("size").alias("_size"), F.min("digest").alias("_digest"), F.count("*").alias("_n")).withColumnRenamed("path", "_path")
    both = manifest.join(once, F.col("path") == F.col("_path"), "full")
    changed = (F.col("size") != F.col("_size")) | (F.col("digest") != F.col("_digest"))
    return both.agg(F.count_if(F.col("_path").isNull()).alias("missing"), F.count_if(F.col("path").isNull()).alias("extra"), F.count_if(changed).alias("changed"), F.count_if(F.col("_n") > 1).alias("repeated"))


def may_cancel(staged: Column, series: Column, within: Column) -> Column:
    return staged & series.isNotNull() & within
