"""Streams (J): extras of the engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.catalog.base import query, table
from corvane.streaming import events as S


def _stream(spark, d):
    return S.file_stream(spark, d, "events.parquet", table(spark, d, "events").schema)


@query("SELECT epoch(date_trunc('hour', ts))::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def j01_tumbling_stream(spark, d):
    return S.tumbling(_stream(spark, d), "ts", "event_type", "value", "1 hour").select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS choice, max(ts) IS NOT NULL AS seen FROM events GROUP BY user_id")
def j02_last_answers_stream(spark, d):
    e = _stream(spark, d).select("user_id", "event_type", "ts", "event_id")
    return S.last_answers(e, "user_id", ["ts", "event_id"]).select("user_id", F.col("event_type").alias("choice"), F.col("ts").isNotNull().alias("seen"))


@query("""WITH l AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 1800000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM l)
SELECT user_id, count(*) AS n, floor(epoch(min(ts)))::BIGINT AS start FROM s GROUP BY user_id, k""")
def j03_sessions(spark, d):
    s = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", "n", F.unix_timestamp(F.col("w.start").cast("timestamp")).alias("start"))


@query("""SELECT epoch(date_trunc('hour', ts))::BIGINT AS start, event_type, count(*) AS n FROM events GROUP BY ALL
HAVING date_trunc('hour', any_value(ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def j04_closed_windows_stream(spark, d):
    events = _stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    closed = S.closed_windows(events, "ts", "event_type", "1 hour", "10 minutes")
    return S.run_to_files(closed.select(F.unix_timestamp("window.start").alias("start"), "event_type", "n"))
