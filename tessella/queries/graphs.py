"""Task graphs, their text, traces, and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import int_div, task_parts
from tessella.operators import graphs as G
from tessella.operators.positions import with_position
from tessella.session import table

from . import query

TASK_LINES = (
    "(T, (0,), 0) | {(0) : 1000, 1.0, 1, 0.5, 64} |  | 0 : 1 : 2",
    "(T, (1,), 0) | {(0) : 2000, 0.5, 1, 0.5, 128} | (T, (0,), 0) | 1, 2 :  : 0",
    "(D, (2, 3), 0) | {(1) : 500, 1.0, 0, 0.0, 0} | (T, (0,), 0) : (T, (1,), 0) |  : 3 : ",
)
TRACE_LINES = (
    "[100] >> Assigned InnerTask{ name: T_0, instance: 0, is_data_task: 0} to device",
    "[110] >> Running InnerTask{ name: T_0, instance: 0, is_data_task: 0}",
    "[115] >> Running InnerTask{ name: T_0.dm.0, instance: 0, is_data_task: 1}",
    "[150] >> Completed InnerTask{ name: T_0, instance: 0, is_data_task: 0}",
    "[120] >> Assigned InnerTask{ name: T_1, instance: 0, is_data_task: 0} to device",
    "[155] >> Running InnerTask{ name: T_1, instance: 0, is_data_task: 0}",
    "[190] >> Completed InnerTask{ name: T_1, instance: 0, is_data_task: 0}",
    "[195] >> unrelated",
)


def _lines(spark, lines) -> DataFrame:
    return spark.createDataFrame([(x,) for x in lines], "value string")


@query("SELECT 'T_' || i AS name, i, i % 64 AS reads FROM range(1000) r(i)")
def graph_independent(spark, sf_dir) -> DataFrame:
    return G.independent(spark, 1000)


@query("SELECT i, j, i - k AS parent_i FROM range(100) a(i), range(2) b(j), range(1, 4) c(k) WHERE k <= i")
def graph_serial(spark, sf_dir) -> DataFrame:
    return G.serial(spark, 100, 2, 3)


@query("SELECT CAST(r AS INTEGER) AS level, j, 2 * j + k AS parent_j FROM range(1, 9) a(r), range(256) b(j), range(2) c(k) WHERE j < (2 ** (8 - r))::BIGINT")
def graph_reduction(spark, sf_dir) -> DataFrame:
    return G.reduction(spark, 2, 8)


@query("SELECT CAST(r AS INTEGER) AS level, j, (2 ** r)::BIGINT * j + (2 ** (r - 1))::BIGINT AS reads, (2 ** r)::BIGINT * j AS inout FROM range(1, 9) a(r), range(256) b(j) WHERE j < (2 ** (8 - r))::BIGINT")
def graph_reduction_data(spark, sf_dir) -> DataFrame:
    return G.reduction_data(G.reduction(spark, 2, 8), 2)


@query("""WITH w AS (SELECT r, CASE WHEN r % 2 = 1 THEN 1 WHEN r = 4 THEN (100 - 2) // 3 + (100 - 2) % 3 ELSE (100 - 2) // 3 END AS w FROM range(5) a(r))
SELECT CAST(c.r AS INTEGER) AS level, i AS j, CAST(p.r AS INTEGER) AS parent_level, k AS parent_j FROM w c JOIN w p ON p.r = c.r - 1, range(100) x(i), range(100) y(k) WHERE i < c.w AND k < p.w""")
def graph_reduction_scatter(spark, sf_dir) -> DataFrame:
    return G.reduction_scatter(spark, 100, 4)


@query("SELECT 'T_' || i || '_' || j AS name, i AS i0, j AS i1 FROM range(0, 5, 2) a(i), range(1, 4) b(j)")
def graph_taskspace_index(spark, sf_dir) -> DataFrame:
    return G.task_index(spark, "T", [(-3, 9, 2), (1, 9, 1)], (5, 4), (0, 0))


@query("""SELECT * FROM (VALUES ('T', '[0, 0]', 1000.0::DOUBLE, 1.0::DOUBLE, 64::BIGINT, '[]', '[0]', '[1]', '[2]'), ('T', '[1, 0]', 2000.0, 0.5, 128, '[T_0_0]', '[1, 2]', '[]', '[0]'),
('D', '[2, 3, 0]', 500.0, 1.0, 0, '[T_0_0, T_1_0]', '[]', '[3]', '[]')) t(space, idx, time, vcus, memory, deps, reads, writes, read_writes)""")
def graph_parse_text(spark, sf_dir) -> DataFrame:
    found = G.parse_tasks(_lines(spark, TASK_LINES))
    return found.withColumns({c: F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]")) for c in ("idx", "deps", "reads", "writes", "read_writes")})


@query("SELECT * FROM (VALUES ('T_0', 100::BIGINT, 110::BIGINT, 150::BIGINT, 40::BIGINT), ('T_1', 120, 155, 190, 35)) t(task, assigned_t, start_t, end_t, duration)")
def trace_parse(spark, sf_dir) -> DataFrame:
    return G.task_times(G.parse_trace(_lines(spark, TRACE_LINES)))


@query("""SELECT 'O' AS space, '[' || o_orderkey || ', ' || o_custkey || ']' AS idx, CAST(o_orderkey % 1000 AS DOUBLE) AS time, (o_orderkey % 4) / 4.0::DOUBLE AS vcus, o_custkey AS memory,
CASE WHEN o_orderkey % 3 = 0 THEN '[]' ELSE '[O_' || o_orderkey // 3 || '_' || o_custkey || ']' END AS deps, '[' || o_custkey || ']' AS reads, '[]' AS writes, '[' || o_orderkey || ', ' || o_custkey || ']' AS read_writes FROM orders""")
def graph_round_trip(spark, sf_dir) -> DataFrame:
    """A task for each order, written as lines and read back."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    name = F.concat_ws("_", F.lit("O"), int_div(k, 3).cast("string"), c.cast("string"))
    none = F.array().cast("array<bigint>")
    tasks = table(spark, sf_dir, "orders").select(
        F.lit("O").alias("space"), F.array(k, c).alias("idx"), (k % 1000).cast("double").alias("time"), ((k % 4) / 4.0).alias("vcus"), c.alias("memory"),
        F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(name)).alias("deps"), F.array(c).alias("reads"), none.alias("writes"), F.array(k, c).alias("read_writes"),
    )
    found = G.parse_tasks(G.task_lines(tasks))
    return found.withColumns({c: F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]")) for c in ("idx", "deps", "reads", "writes", "read_writes")})


@query("""SELECT 'T_' || o_orderkey AS task, o_orderkey AS assigned_t, o_orderkey + 5 AS start_t, o_orderkey + 5 + o_custkey AS end_t, o_custkey AS duration FROM orders""")
def trace_round_trip(spark, sf_dir) -> DataFrame:
    """A trace with three lines for each order, and one of a data task that is left out."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    line = lambda t, what, name, data: F.format_string(f"[%d] >> {what} InnerTask{{ name: {name}, instance: 0, is_data_task: {data}}}", t, k)
    lines = F.array(line(k, "Assigned", "T_%d", 0), line(k + 5, "Running", "T_%d", 0), line(k + 6, "Running", "T_%d.dm.0", 1), line(k + 5 + c, "Completed", "T_%d", 0))
    return G.task_times(G.parse_trace(table(spark, sf_dir, "orders").select(F.explode(lines).alias("value"))))


@query("""SELECT name, CASE WHEN k % 2 = 0 THEN 'T_x' ELSE 'plain_' END AS space, CASE WHEN k % 2 = 0 THEN '[' || k || ', -' || c || ']' ELSE '[]' END AS idx
FROM (SELECT o_orderkey AS k, o_custkey + 1 AS c, CASE WHEN o_orderkey % 2 = 0 THEN 'T_x_' || o_orderkey || '_-' || (o_custkey + 1) ELSE 'plain_' END AS name FROM orders)""")
def graph_name_parse(spark, sf_dir) -> DataFrame:
    k, c = F.col("o_orderkey").cast("string"), (F.col("o_custkey") + 1).cast("string")
    name = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("T_x_"), k, F.lit("_-"), c)).otherwise(F.lit("plain_"))
    space, idx = task_parts(F.col("name"))
    return table(spark, sf_dir, "orders").select(name.alias("name")).select("name", space.alias("space"), F.concat(F.lit("["), F.array_join(idx.cast("array<string>"), ", "), F.lit("]")).alias("idx"))


@query("""SELECT c_custkey AS k, 'there' AS origin FROM customer WHERE c_acctbal < 0 UNION ALL
SELECT DISTINCT o_custkey, 'new' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def set_upsert(spark, sf_dir) -> DataFrame:
    there = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("k"), F.lit("there").alias("origin"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.lit("new").alias("origin")).distinct()
    return G.upserted(there, rows, "k")


@query("""WITH RECURSIVE e AS (SELECT c_custkey AS dst, c_custkey // 2 AS src FROM customer WHERE c_custkey > 0),
a AS (SELECT c_custkey AS task, x AS arr, CASE WHEN (c_custkey + x) % 3 = 0 THEN 'INOUT' ELSE 'IN' END AS mode FROM customer, range(2) r(x) WHERE (c_custkey + x) % 5 <> 0),
h AS (SELECT task, arr FROM a WHERE mode <> 'IN' UNION SELECT a.task, a.arr FROM h JOIN e ON e.src = h.task JOIN a ON a.task = e.dst AND a.arr = h.arr)
SELECT a.task, a.arr AS "array", e.src AS dep FROM a JOIN e ON e.dst = a.task JOIN h ON h.task = e.src AND h.arr = a.arr""")
def graph_array_dependencies(spark, sf_dir) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    edges = customers.filter("c_custkey > 0").select(int_div(key, 2).alias("src"), key.alias("dst"))
    both = customers.select(key.alias("task"), F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("array"))
    place = F.col("task") + F.col("array")
    accesses = both.filter(place % 5 != 0).withColumn("mode", F.when(place % 3 == 0, "INOUT").otherwise("IN"))
    return G.array_dependencies(edges, accesses)


@query("SELECT o_orderkey AS task, row_number() OVER (ORDER BY md5('7:' || o_orderkey), o_orderkey) - 1 AS pos FROM orders")
def graph_shuffle(spark, sf_dir) -> DataFrame:
    """Tasks in an order by hashes, which another seed changes and another partitioning does not."""
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(key.alias("task"), F.md5(F.concat(F.lit("7:"), key.cast("string"))).alias("h"))
    return with_position(rows, "h", "task").select("task", "pos")


_EDGES = "edges AS (SELECT o_orderkey AS dst, o_orderkey // 3 AS src FROM orders WHERE o_orderkey > 0)"
_TIMES = "times AS (SELECT o_orderkey AS task, o_orderkey * 10 AS start_t, o_orderkey * 10 + o_custkey AS end_t FROM orders)"


def edges_of(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders").filter("o_orderkey > 0")
    return orders.select(F.col("o_orderkey").alias("dst"), F.floor(F.col("o_orderkey") / 3).alias("src"))


def times_of(spark, sf_dir) -> DataFrame:
    start = F.col("o_orderkey") * 10
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task"), start.alias("start_t"), (start + F.col("o_custkey")).alias("end_t"))


@query(f"WITH {_EDGES} SELECT src, dst FROM edges WHERE dst % 10 = 0")
def verify_dependencies(spark, sf_dir) -> DataFrame:
    edges = edges_of(spark, sf_dir)
    return G.missing_dependencies(edges, edges.filter("dst % 10 <> 0"))


@query(f"WITH {_EDGES}, {_TIMES} SELECT src, dst, s.end_t AS src_end, d.start_t AS dst_start FROM edges JOIN times s ON s.task = src JOIN times d ON d.task = dst WHERE d.start_t < s.end_t")
def verify_order(spark, sf_dir) -> DataFrame:
    return G.order_violations(edges_of(spark, sf_dir), times_of(spark, sf_dir))


@query("SELECT o_orderkey AS task FROM orders WHERE o_orderstatus = 'P'")
def verify_complete(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task"), "o_orderstatus")
    return orders.select("task").join(orders.filter("o_orderstatus <> 'P'"), "task", "left_anti")


@query("SELECT count(*) AS n, count(DISTINCT o_orderkey) AS tasks, count(*) = count(DISTINCT o_orderkey) AS once FROM orders")
def verify_ntasks(spark, sf_dir) -> DataFrame:
    found = table(spark, sf_dir, "orders").agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("tasks"))
    return found.withColumn("once", F.col("n") == F.col("tasks"))


@query(f"WITH {_TIMES} SELECT task, end_t - start_t AS duration FROM times WHERE end_t - start_t < 100")
def verify_time(spark, sf_dir) -> DataFrame:
    return times_of(spark, sf_dir).select("task", (F.col("end_t") - F.col("start_t")).alias("duration")).filter("duration < 100")


@query("SELECT user_id, count(DISTINCT event_type) AS n, bool_or(event_type = 'click') AND bool_or(event_type = 'purchase') AS complete FROM events GROUP BY 1")
def verify_states(spark, sf_dir) -> DataFrame:
    seen = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("s"))  # of a few states
    wanted = F.array(F.lit("click"), F.lit("purchase"))
    return seen.select("user_id", F.size("s").cast("long").alias("n"), (F.size(F.array_except(wanted, "s")) == 0).alias("complete"))


@query("""WITH RECURSIVE e AS (SELECT c_custkey AS dst, c_custkey // 2 AS src FROM customer WHERE c_custkey > 0), l AS (SELECT 0::BIGINT AS node, 0 AS level UNION ALL SELECT dst, level + 1 FROM l JOIN e ON src = node)
SELECT node, level FROM l""")
def graph_levels(spark, sf_dir) -> DataFrame:
    customers = table(spark, sf_dir, "customer").filter("c_custkey > 0")
    return G.levels(customers.select(F.col("c_custkey").alias("dst"), F.floor(F.col("c_custkey") / 2).alias("src")))


@query("""SELECT o_orderkey, CASE c WHEN -1 THEN 'cpu' WHEN 0 THEN 'gpu' ELSE CASE WHEN c <= 4 THEN 'gpu' || (c - 1) ELSE 'gpu' || ((c - 5) % 4) END END AS device
FROM (SELECT o_orderkey, o_orderkey % 12 - 1 AS c FROM orders)""")
def placement_decode(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", G.placement(F.col("o_orderkey") % 12 - 1, 4).alias("device"))


@query(f"""WITH {_EDGES}, s AS (SELECT o_orderkey AS task, o_custkey % 9 AS state FROM orders) SELECT dst, 1 + count(*) FILTER (WHERE state < 1) AS unspawned, 1 + count(*) FILTER (WHERE state < 2) AS unmapped,
1 + count(*) FILTER (WHERE state < 3) AS unreserved, 1 + count(*) FILTER (WHERE state < 6) AS blocking FROM edges JOIN s ON task = src GROUP BY dst""")
def dep_counters(spark, sf_dir) -> DataFrame:
    states = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src"), (F.col("o_custkey") % 9).alias("state"))
    left = lambda n: 1 + F.count_if(F.col("state") < n)
    return edges_of(spark, sf_dir).join(states, "src").groupBy("dst").agg(left(1).alias("unspawned"), left(2).alias("unmapped"), left(3).alias("unreserved"), left(6).alias("blocking"))


@query("SELECT o_custkey AS space, count(*) FILTER (WHERE o_orderstatus <> 'F') AS incomplete, count(*) FILTER (WHERE o_orderstatus <> 'F') = 0 AS released FROM orders GROUP BY 1")
def barrier_ready(spark, sf_dir) -> DataFrame:
    counted = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("space")).agg(F.count_if(F.col("o_orderstatus") != "F").alias("incomplete"))
    return counted.withColumn("released", F.col("incomplete") == 0)
