"""Streaming queries run over the tables' files to their end."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from gneiss.plans.registry import QUERIES, SQL
from gneiss.streaming import leases
from gneiss.streaming.lifecycle import run_available

#: How long a lease lasts, in microseconds.
LEASE = 6 * 3_600_000_000


def folder(spark: SparkSession) -> str:
    """A new folder for a stream's checkpoint and output, where driver and executors share one."""
    context = spark.sparkContext
    shared = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not shared:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="gneiss-")
    return f"{shared}/gneiss-streams/{uuid.uuid4().hex}"


def stream_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final states of all uploads from a stream of events."""
    return run_available(spark, f"{sf_dir}/events.parquet", folder(spark))


def stream_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as claims of a lease of six hours for each user, errors as releases: each decision, and expiry by event-time timers."""
    return leases.run_available(spark, f"{sf_dir}/events.parquet", folder(spark), LEASE)


QUERIES["stream_lifecycle"] = stream_lifecycle
SQL["stream_lifecycle"] = """
    WITH s AS (SELECT user_id, epoch_us(ts) AS us, event_type FROM events),
    f AS (SELECT user_id, max(us) AS updated_us, count(*) AS events, max(us) FILTER (event_type = 'purchase') AS done, max(us) FILTER (event_type = 'error') AS failed FROM s GROUP BY 1)
    SELECT user_id, CASE WHEN done IS NULL THEN 'uploading' WHEN failed > done THEN 'withdrawn' WHEN updated_us = done THEN 'committed' ELSE 'checkpointed' END AS status, updated_us, events FROM f"""
QUERIES["stream_leases"] = stream_leases
SQL["stream_leases"] = f"""
    WITH RECURSIVE e AS (SELECT user_id, event_id, event_type AS t, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS n FROM events),
    r AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS ends, CAST(NULL AS BIGINT) AS holder, CAST(NULL AS BIGINT) AS past, CAST(NULL AS BIGINT) AS past_holder, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS BIGINT) AS at_us, CAST(NULL AS BIGINT) AS who FROM e
        UNION ALL SELECT r.user_id, e.n, CASE WHEN t = 'error' THEN NULL WHEN r.ends > us THEN r.ends WHEN t = 'purchase' THEN us + {LEASE} END, CASE WHEN t = 'error' THEN NULL WHEN r.ends > us THEN r.holder WHEN t = 'purchase' THEN event_id END,
            CASE WHEN r.ends <= us THEN r.ends END, r.holder, CASE WHEN t = 'purchase' THEN CASE WHEN r.ends > us THEN 'refused' ELSE 'granted' END WHEN t = 'error' AND r.ends > us THEN 'released' END, us, CASE t WHEN 'purchase' THEN event_id ELSE r.holder END
        FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
    SELECT user_id, at_us, kind, who AS holder FROM r WHERE kind IS NOT NULL UNION ALL SELECT user_id, past, 'expired', past_holder FROM r WHERE past IS NOT NULL
    UNION ALL SELECT user_id, ends, 'expired', holder FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1) WHERE ends <= (SELECT max(us) FROM e) - 3600000000"""
