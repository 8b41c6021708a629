"""Sorting, splitters, searches and the exchange between shards, over ``events.value``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import shard_of
from tessella.operators import sorting as S
from tessella.operators.positions import medians, with_position
from tessella.session import table

from . import query

SHARDS = 4
_SHARDED = f"s AS (SELECT event_id, value AS v, CAST(((event_id + 1) * {SHARDS} - 1) // n AS INTEGER) AS part FROM events, (SELECT count(*) AS n FROM events))"
_SPLIT = f"""m AS (SELECT part, count(*) AS m FROM s GROUP BY part), r AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY v, event_id) - 1 AS r FROM s),
w AS (SELECT part, j, (j + 1) * m // {SHARDS} - 1 AS r FROM m, range({SHARDS - 1}) q(j)), x AS (SELECT v FROM r JOIN w USING (part, r)),
p AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS p, count(*) OVER () AS n FROM x),
sp AS (SELECT t, v AS splitter FROM p, range({SHARDS - 1}) q(t) WHERE p.p = t * n // {SHARDS - 1} + ((t + 1) * n // {SHARDS - 1} - t * n // {SHARDS - 1}) // 2)"""


def sharded(spark, sf_dir) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", F.col("value").alias("v"))
    n = events.count()
    return events.withColumn("part", shard_of(F.col("event_id"), max(n, 1), SHARDS))


def split_values(spark, sf_dir) -> DataFrame:
    return S.splitters(S.regular_samples(sharded(spark, sf_dir), "part", "v", SHARDS), SHARDS)


@query(f"WITH {_SHARDED} SELECT event_id, part, v, row_number() OVER (PARTITION BY part ORDER BY v, event_id) - 1 AS r FROM s")
def sort_local(spark, sf_dir) -> DataFrame:
    return S.local_sort(sharded(spark, sf_dir), "part", "v", "event_id")


@query("SELECT event_id, value, row_number() OVER (ORDER BY value, event_id) - 1 AS pos FROM events")
def sort_sample(spark, sf_dir) -> DataFrame:
    return with_position(table(spark, sf_dir, "events").select("event_id", "value"), "value", "event_id")


@query(f"WITH {_SHARDED}, {_SPLIT} SELECT t, splitter FROM sp")
def splitters_regular(spark, sf_dir) -> DataFrame:
    return split_values(spark, sf_dir)


def _searched(side: str):
    def run(spark, sf_dir) -> DataFrame:
        bounds = [r["splitter"] for r in split_values(spark, sf_dir).orderBy("t").collect()]  # one fewer than shards
        return sharded(spark, sf_dir).select("event_id", S.bucket_of(F.col("v"), bounds, side).cast("long").alias("bucket"))

    return run


for _side, _op in (("left", "<"), ("right", "<=")):
    _run = _searched(_side)
    _run.__name__ = f"searchsorted_{_side}"
    query(f"WITH {_SHARDED}, {_SPLIT} SELECT event_id, (SELECT count(*) FROM sp WHERE splitter {_op} s.v) AS bucket FROM s")(_run)


@query("SELECT event_id, arg_max(t.b, t.lo) AS block FROM events JOIN (VALUES (0, 0.0), (1, 20.0), (2, 60.0), (3, 90.0)) t(b, lo) ON t.lo <= value GROUP BY event_id")
def block_lookup_asof(spark, sf_dir) -> DataFrame:
    block = S.bucket_of(F.col("value"), [0.0, 20.0, 60.0, 90.0], "right") - 1  # the last that begins at the value or below
    return table(spark, sf_dir, "events").select("event_id", block.alias("block")).filter("block >= 0")


@query("SELECT event_id, value, row_number() OVER (ORDER BY value, event_id) - 1 AS pos FROM events")
def sort_quick(spark, sf_dir) -> DataFrame:
    """The whole sort by rounds of partitioning; parts as small as an eighth of the table are sorted where they are."""
    events = table(spark, sf_dir, "events").select("event_id", "value")
    return S.quick_sort(events, "value", "event_id", least=max(1, events.count() // 8))


@query("""WITH m AS (SELECT median(value) AS p FROM events) SELECT event_id, value < p AS is_left, row_number() OVER (PARTITION BY value < p ORDER BY event_id) - 1 AS pos FROM events, m""")
def sort_quick_partition(spark, sf_dir) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "value")
    pivot = medians(events, "value").withColumnRenamed("median", "p")
    sides = events.crossJoin(F.broadcast(pivot)).select("event_id", (F.col("value") < F.col("p")).alias("is_left"))  # one row
    left, right = (with_position(sides.filter(F.col("is_left") == b), "event_id") for b in (True, False))
    return left.unionByName(right)


@query(f"""WITH {_SHARDED}, m AS (SELECT median(v) AS p, count(*) AS n FROM s)
SELECT event_id, row_number() OVER (ORDER BY v >= p, part, event_id) - 1 AS pos, CAST((row_number() OVER (ORDER BY v >= p, part, event_id) - 1) // CAST(ceil(n / {SHARDS}.0) AS BIGINT) AS INTEGER) AS bin FROM s, m""")
def balance_partition(spark, sf_dir) -> DataFrame:
    rows = sharded(spark, sf_dir)
    pivot = medians(rows, "v").withColumnRenamed("median", "p")
    rows = rows.crossJoin(F.broadcast(pivot)).withColumn("is_left", F.col("v") < F.col("p"))  # one row
    return S.balanced(rows, "is_left", "part", "event_id", SHARDS).select("event_id", "pos", "bin")


@query("""SELECT CAST(a.a AS INTEGER) AS src, CAST(b.b AS INTEGER) AS dst, (SELECT count(*) FROM events WHERE event_id % 4 = a.a AND user_id % 4 = b.b) AS n,
(SELECT count(*) FROM events WHERE event_id % 4 = a.a AND user_id % 4 < b.b) AS send_offset FROM range(4) a(a), range(4) b(b)""")
def alltoall_counts(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "events").select((F.col("event_id") % 4).cast("int").alias("src"), (F.col("user_id") % 4).cast("int").alias("dst"))
    return S.exchange_counts(rows, "src", "dst", 4)


@query("SELECT a.event_id AS dst, b.value AS v FROM events a JOIN events b ON b.event_id = (a.event_id * 7) % (SELECT count(*) FROM events)")
def gather_by_index(spark, sf_dir) -> DataFrame:
    events = table(spark, sf_dir, "events")
    index = events.select(F.col("event_id").alias("dst"), ((F.col("event_id") * 7) % events.count()).alias("event_id"))
    return index.join(events.select("event_id", F.col("value").alias("v")), "event_id").select("dst", "v")


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 20")
def sort_top_k(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "value").orderBy(F.desc("value"), "event_id").limit(20)


@query("""SELECT l_orderkey, l_shipdate, l_quantity, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_partkey, l_linenumber, l_suppkey, l_quantity) AS n
FROM lineitem QUALIFY n <= 5""")
def sort_queue_front(spark, sf_dir) -> DataFrame:
    order = Window.partitionBy("l_returnflag").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_quantity")
    ranked = table(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(order)).filter("n <= 5")
    return ranked.select("l_orderkey", "l_shipdate", "l_quantity", "n")
