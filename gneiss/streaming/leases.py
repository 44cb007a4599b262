"""Leases on a stream of claims, in event time: a claim while a lease runs is refused, and a lease that nobody renews ends by a timer.

Each key's state is one value; the timer fires when the watermark passes the lease's end, so a lease ends without a later event of its key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "user_id long, at_us long, kind string, holder long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Leases(StatefulProcessor):
    """Rows (user_id, at_us, kind, holder): `granted` and `refused` claims, `released` ones, and `expired` leases at their end.

    Claims are the rows whose event_type is in `claims`; rows whose type is in `releases` end a running lease. Within a micro-batch rows are
    taken by time, then event_id; of two batches the first one's rows count first. Rows without key or time are dropped. A claim at the very end of a lease finds it ended.
    """

    def __init__(self, length_us: int, claims: tuple[str, ...], releases: tuple[str, ...]):
        self.length_us, self.claims, self.releases = length_us, claims, releases

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", "end_us long, holder long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        end, holder = self.lease.get() if self.lease.exists() else (None, None)
        before, out = end, []
        events = pd.concat(list(rows)).sort_values(["at_us", "event_id"])
        for at, event, kind in zip(events["at_us"], events["event_id"], events["event_type"]):
            at, event = int(at), int(event)
            if end is not None and end <= at:
                out.append((key[0], end, "expired", holder))
                end = holder = None
            if kind in self.claims and end is None:
                end, holder = at + self.length_us, event
                out.append((key[0], at, "granted", event))
            elif kind in self.claims:
                out.append((key[0], at, "refused", event))
            elif kind in self.releases and end is not None:
                out.append((key[0], at, "released", holder))
                end = holder = None
        if before is not None and before != end:
            self.handle.deleteTimer(-(-before // 1000))
        if end is None:
            self.lease.clear()
        else:
            self.lease.update((end, holder))
            if before != end:
                self.handle.registerTimer(-(-end // 1000))
        yield pd.DataFrame(out, columns=["user_id", "at_us", "kind", "holder"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.lease.exists():
            end, holder = self.lease.get()
            # events of this batch may have moved the lease after the timer was due
            if end <= expiredTimerInfo.getExpiryTimeInMs() * 1000:
                self.lease.clear()
                yield pd.DataFrame({"user_id": [key[0]], "at_us": [end], "kind": ["expired"], "holder": [holder]})

    def close(self) -> None:
        pass


def leases(events: DataFrame, length_us: int, late: str, claims: tuple[str, ...] = ("purchase",), releases: tuple[str, ...] = ("error",)) -> DataFrame:
    """A stream (user_id, event_id, event_type, at_us) as lease decisions; `late` bounds how far events may lag behind the newest."""
    marked = events.withColumn("at", F.timestamp_micros("at_us")).withWatermark("at", late)
    return marked.groupBy("user_id").transformWithStateInPandas(Leases(length_us, claims, releases), OUT, "Append", "eventtime")


def run_available(spark: SparkSession, path: str, folder: str, length_us: int, late: str = "1 hour", files_per_trigger: int = 1) -> DataFrame:
    """All events below path (a folder of files, or one file), then every decision so far; run again, it goes on from its checkpoint.

    Every micro-batch writes to a folder of its number, so one that is run again replaces its own rows. Leases that still run are no rows.
    """
    table = spark.read.parquet(path)
    reader = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files_per_trigger)
    parent, _, name = path.rstrip("/").rpartition("/")
    alone = [f.rpartition("/")[2] for f in table.inputFiles()] == [name]
    stream = reader.option("pathGlobFilter", name).parquet(parent) if alone else reader.parquet(path)
    at = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    decisions = leases(stream.select("user_id", "event_id", "event_type", at.alias("at_us")).filter("user_id is not null and at_us is not null"), length_us, late)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/decisions/batch={number}")

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)  # the only store that holds timers
    try:
        query = decisions.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
        query.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if before is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.parquet(f"{folder}/decisions").drop("batch")
