"""Event-time windows and sessions, run as batch; the same functions run on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella import streaming
from tessella.session import table

from . import query


@query("SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS start_s, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir) -> DataFrame:
    found = streaming.windowed(table(spark, sf_dir, "events"))
    return found.select(F.unix_timestamp("start").alias("start_s"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start_s, count(*) AS n FROM s GROUP BY user_id, s""")
def stream_sessions(spark, sf_dir) -> DataFrame:
    found = streaming.sessions(table(spark, sf_dir, "events"))
    return found.select("user_id", F.unix_timestamp("start").alias("start_s"), "n")


@query("SELECT event_id, event_type FROM events")
def stream_first_seen(spark, sf_dir) -> DataFrame:
    return streaming.first_seen(table(spark, sf_dir, "events")).select("event_id", "event_type")


@query("SELECT event_type, user_id % 3 AS g, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY CUBE (event_type, g)")
def agg_cube(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("g", F.col("user_id") % 3)
    return rows.cube("event_type", "g").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))
