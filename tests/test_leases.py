"""Leases in event time: expiry by timer alone, and going on from the checkpoint."""

from __future__ import annotations

import datetime

from gneiss.streaming import leases

HOUR = 3_600_000_000
START = datetime.datetime(2024, 1, 1)


def put(spark, folder, name, rows):
    """rows: (user, event, kind, hours after the start)."""
    made = [(u, e, k, START + datetime.timedelta(hours=h)) for u, e, k, h in rows]
    spark.createDataFrame(made, "user_id long, event_id long, event_type string, ts timestamp_ntz").coalesce(1).write.parquet(f"{folder}/{name}")
    for part in (folder / name).glob("*.parquet"):
        part.rename(folder / f"{name}.parquet")


def test_leases_end_without_a_later_event_and_survive_a_restart(spark, tmp_path):
    source, out = tmp_path / "in", f"file://{tmp_path}/out"
    source.mkdir()
    hours = lambda rows: sorted((r["user_id"], (r["at_us"] - 1_704_067_200_000_000) / HOUR, r["kind"], r["holder"]) for r in rows)
    # within a file the rows come out of order; user 2 claims once and never comes back; null keys go
    put(spark, source, "a", [(1, 12, "purchase", 1.0), (1, 11, "purchase", 0.0), (2, 20, "purchase", 0.5), (None, 99, "purchase", 1.0)])
    first = hours(leases.run_available(spark, str(source), out, 2 * HOUR).collect())
    assert first == [(1, 0.0, "granted", 11), (1, 1.0, "refused", 12), (2, 0.5, "granted", 20)]
    # the restart finds the leases in its state: one is released, the other ends by its timer when user 3 moves the watermark
    put(spark, source, "b", [(1, 13, "error", 1.5), (1, 14, "purchase", 1.75), (3, 30, "view", 10.0)])
    second = hours(leases.run_available(spark, str(source), out, 2 * HOUR).collect())
    assert second == sorted(first + [(1, 1.5, "released", 11), (1, 1.75, "granted", 14), (1, 3.75, "expired", 14), (2, 2.5, "expired", 20)])
    # a claim at the very end of a lease finds it ended; nothing that was decided before comes again
    put(spark, source, "c", [(4, 40, "purchase", 11.0), (4, 41, "purchase", 13.0)])
    third = hours(leases.run_available(spark, str(source), out, 2 * HOUR).collect())
    assert third == sorted(second + [(4, 11.0, "granted", 40), (4, 13.0, "expired", 40), (4, 13.0, "granted", 41)])
