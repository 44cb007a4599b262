"""The upload life-cycle as Structured Streaming: windows with late data, and a state machine with timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gneiss.operators.state import latest

OUT = "user_id long, status string, updated_us long, events long"
STATE = "done_us long, failed_us long, last_us long, events long"


def window_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by window and type; rows later than `late` are dropped by the watermark."""
    return (
        events.withWatermark("at", late)
        .groupBy(F.window("at", width), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("window.start").alias("start"), "event_type", "n", "total")
    )


def status(done: int, failed: int, last: int) -> str:
    if done < 0:
        return "uploading"
    return "withdrawn" if failed > done else "committed" if last == done else "checkpointed"


def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, idle_ms: int = 0) -> Iterator[pd.DataFrame]:
    """One upload's state after a batch: only maxima are kept, so order and repeats within a batch do not matter.

    idle_ms: time without events after which the timer ends the upload; one that never was committed is then expired.
    """
    if state.hasTimedOut:
        done, failed, last, n = state.get
        state.remove()
        yield pd.DataFrame({"user_id": [key[0]], "status": ["expired" if done < 0 else status(done, failed, last)], "updated_us": [last], "events": [n]})
        return
    done, failed, last, n = state.get if state.exists else (-1, -1, -1, 0)
    for pdf in batches:
        at, kind = pdf["at_us"], pdf["event_type"]
        done = max(done, int(at[kind == "purchase"].max()) if (kind == "purchase").any() else -1)
        failed = max(failed, int(at[kind == "error"].max()) if (kind == "error").any() else -1)
        last, n = max(last, int(at.max())), n + len(pdf)
    state.update((done, failed, last, n))
    if idle_ms:
        state.setTimeoutDuration(idle_ms)
    yield pd.DataFrame({"user_id": [key[0]], "status": [status(done, failed, last)], "updated_us": [last], "events": [n]})


def lifecycle(events: DataFrame, idle_ms: int = 0) -> DataFrame:
    """Updates (user_id, status, updated_us, events) of a stream (user_id, event_type, at_us).

    With idle_ms a processing-time timer for each upload ends it after so long without events; without, states stay.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        return advance(key, batches, state, idle_ms)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return events.groupBy("user_id").applyInPandasWithState(run, OUT, STATE, "update", timeout)


def run_available(spark: SparkSession, path: str, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """All events below path through the state machine, then each upload's last state.

    Every micro-batch writes its updates to a folder named by its number, so a batch that is run again replaces its own.
    """
    table = spark.read.parquet(path)
    reader = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files_per_trigger)
    folder_, _, name = path.rstrip("/").rpartition("/")
    if [f.rpartition("/")[2] for f in table.inputFiles()] == [name]:  # a stream reads folders: a lone file is picked out of its own
        stream = reader.option("pathGlobFilter", name).parquet(folder_)
    else:
        stream = reader.parquet(path)
    at = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    updates = lifecycle(stream.select("user_id", "event_type", at.alias("at_us")))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/updates/batch={number}")

    query = updates.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{folder}/updates")
    return latest(rows.withColumn("batch", F.col("batch").cast("long")), ["user_id"], F.col("batch")).drop("batch")
