"""Streaming extensions over the event table, as bounded queries and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.registry import query, table


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def ext_tumbling_windows(spark, sf_dir):
    w = F.window("ts", "1 hour")
    return table(spark, sf_dir, "events").groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("WITH e AS (SELECT UNNEST([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) AS start FROM events) SELECT start, count(*) AS n FROM e GROUP BY 1")
def ext_sliding_windows(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL '30 minutes' THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM e)
SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, g""")
def ext_session_windows(spark, sf_dir):
    # sessions end where the next event is later than 30 minutes; the window's own end is half open, so a microsecond is added
    return table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "1800000001 microseconds").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


@query("SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, max(value) AS greatest FROM events GROUP BY ALL")
def ext_available_now_stream(spark, sf_dir):
    from corvane.streaming.ingest import counted_by_type

    # a stream reads folders or globs; the glob finds the one table, file or folder
    return counted_by_type(spark, f"{sf_dir}/events.parque[t]")
