"""Placement, admission, tracking and coherence over tables of devices, tasks and accesses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators import placement as P
from tessella.session import table

from . import query

_INPUT = """devices AS (SELECT device, memory, vcus, load FROM (VALUES (0, 1000000, 8000, 10), (1, 400, 1000, 5), (2, 300, 1000, 2), (3, 200, 1000, 3)) t(device, memory, vcus, load)),
tasks AS (SELECT o_orderkey AS task, o_orderkey % 350 AS memory, 1000 AS vcus FROM orders), reads AS (SELECT o_orderkey AS task, o_custkey AS array, 1 + o_orderkey % 8 AS bytes FROM orders),
copies AS (SELECT c_custkey AS array, CAST(c_custkey % 4 AS INTEGER) AS device FROM customer),
scored AS (SELECT task, d.device, 50 + 30 * near - 30 * (bytes - near) - 10 * (load / 20.0::DOUBLE) AS score FROM (SELECT t.task, d.device, load, bytes, CASE WHEN c.device = d.device THEN bytes ELSE 0 END AS near
  FROM tasks t JOIN devices d ON t.memory <= d.memory AND t.vcus <= d.vcus JOIN reads r ON r.task = t.task JOIN copies c ON c.array = r.array) d)"""


def scored(spark, sf_dir) -> DataFrame:
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = [(0, 1000000, 8000, 10), (1, 400, 1000, 5), (2, 300, 1000, 2), (3, 200, 1000, 3)]
    devices = spark.createDataFrame(rows, "device int, memory long, vcus long, load long")
    key = F.col("o_orderkey")
    tasks = orders.select(key.alias("task"), (key % 350).alias("memory"), F.lit(1000).alias("vcus"))
    reads = orders.select(key.alias("task"), F.col("o_custkey").alias("array"), (1 + key % 8).alias("bytes"))
    copies = customers.select(F.col("c_custkey").alias("array"), (F.col("c_custkey") % 4).cast("int").alias("device"))
    return P.scores(tasks, reads, copies, devices)


@query(f"WITH {_INPUT} SELECT task, device, round(score, 4) AS score FROM scored")
def place_scores(spark, sf_dir) -> DataFrame:
    return scored(spark, sf_dir).select("task", "device", F.round("score", 4).alias("score"))


@query(f"WITH {_INPUT}, r AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY score DESC, (device + 3) % 4 DESC) AS n FROM scored) SELECT task, device, round(score, 4) AS score FROM r WHERE n = 1")
def place_single(spark, sf_dir) -> DataFrame:
    return P.choose(scored(spark, sf_dir), 1, 4).select("task", "device", F.round("score", 4).alias("score"))


@query(f"""WITH {_INPUT}, m AS (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 1), (1, 2), (2, 0)) t(option, device)),
o AS (SELECT task, option, avg(score) AS score FROM m JOIN scored USING (device) GROUP BY ALL HAVING count(*) = CASE WHEN option = 2 THEN 1 ELSE 2 END),
r AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY score DESC, option DESC) AS n FROM o) SELECT task, option, round(score, 4) AS score FROM r WHERE n = 1""")
def place_multi(spark, sf_dir) -> DataFrame:
    options = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 2), (2, 0)], "option int, device int")
    return P.choose_option(scored(spark, sf_dir), options).select("task", "option", F.round("score", 4).alias("score"))


@query("""WITH q AS (SELECT CAST(o_custkey % 4 AS INTEGER) AS device, o_orderkey AS seq, 1 + o_orderkey % 5 AS need FROM orders),
u AS (SELECT *, CAST(sum(need) OVER (PARTITION BY device ORDER BY seq) AS BIGINT) AS used FROM q) SELECT device, seq, need, used, used <= 5000 AS admitted FROM u""")
def resource_admission(spark, sf_dir) -> DataFrame:
    key = F.col("o_orderkey")
    requests = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 4).cast("int").alias("device"), key.alias("seq"), (1 + key % 5).alias("need"))
    return P.admitted(requests, spark.range(4).select(F.col("id").cast("int").alias("device"), F.lit(5000).alias("memory")))


@query("""SELECT o_custkey, o_orderkey AS seq, CAST(sum(CASE WHEN o_orderkey % 2 = 0 THEN 3 ELSE -2 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS in_use FROM orders""")
def resource_release(spark, sf_dir) -> DataFrame:
    delta = F.when(F.col("o_orderkey") % 2 == 0, 3).otherwise(-2)
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("seq"), F.sum(delta).over(order).alias("in_use"))


@query("SELECT event_type, count(*) / (SELECT count(*) FROM events) AS share FROM events GROUP BY 1")
def load_normalised(spark, sf_dir) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("t")))).select("event_type", (F.col("n") / F.col("t")).alias("share"))  # one row


_MOVES = """m AS (SELECT CAST(user_id % 5 AS INTEGER) AS device, event_id AS seq, user_id AS arr, 8 * (1 + user_id % 3) AS bytes,
CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY event_id) % 4 IN (1, 2) THEN 1 ELSE -1 END AS delta FROM events)"""


@query(f"""WITH {_MOVES}, o AS (SELECT *, sum(delta) OVER (PARTITION BY device, arr ORDER BY seq) AS open FROM m)
SELECT device, seq, arr AS "array", CAST(sum(CASE WHEN open = 1 AND delta = 1 THEN bytes WHEN open = 0 AND delta = -1 THEN -bytes ELSE 0 END) OVER (PARTITION BY device ORDER BY seq) AS BIGINT) AS mapped FROM o""")
def tracker_presence(spark, sf_dir) -> DataFrame:
    turn = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) % 4
    user = F.col("user_id")
    moves = table(spark, sf_dir, "events").select(
        (user % 5).cast("int").alias("device"), F.col("event_id").alias("seq"), user.alias("array"), (8 * (1 + user % 3)).alias("bytes"), F.when(turn.isin(1, 2), 1).otherwise(-1).alias("delta")
    )
    return P.mapped_bytes(moves).select("device", "seq", "array", "mapped")


@query("SELECT event_id, CAST(count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS BIGINT) AS active FROM events")
def active_tasks(spark, sf_dir) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-3, 0)
    return table(spark, sf_dir, "events").select("event_id", F.count("*").over(order).alias("active"))


@query()
def coherence_msi(spark, sf_dir) -> DataFrame:
    kinds = F.array(*[F.lit(x) for x in ("read", "write", "read", "evict", "drop")])
    i = F.col("event_id")
    accesses = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("array"), i.alias("seq"), F.get(kinds, (i % 5).cast("int")).alias("op"), ((i * 7) % 4 - 1).cast("int").alias("device")
    )
    return P.coherence(accesses)
