"""Task graphs: generators, their text format, execution traces, and checks of a trace against its graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .positions import written


def independent(spark: SparkSession, n: int, partitions: int = 64) -> DataFrame:
    """``name``, ``i``, ``reads``: n tasks without edges, task i reading block i % partitions."""
    i = F.col("id")
    return spark.range(n).select(F.concat_ws("_", F.lit("T"), i).alias("name"), i.alias("i"), (i % partitions).alias("reads"))


def serial(spark: SparkSession, steps: int, chains: int, back: int) -> DataFrame:
    """Edges ``i``, ``j``, ``parent_i``: step i of chain j after the ``back`` steps before it."""
    cells = spark.range(steps * chains).select(F.floor(F.col("id") / chains).alias("i"), (F.col("id") % chains).alias("j"))
    k = F.explode(F.when(F.col("i") > 0, F.sequence(F.lit(1).cast("long"), F.least("i", F.lit(back).cast("long")))))
    return cells.select("i", "j", k.alias("k")).select("i", "j", (F.col("i") - F.col("k")).alias("parent_i"))


def reduction(spark: SparkSession, branch: int, levels: int) -> DataFrame:
    """Edges ``level``, ``j``, ``parent_j`` of a tree: task j of a level after ``branch`` tasks of the level below."""
    sizes = [branch ** (levels - r) for r in range(levels + 1)]
    found = None
    for r in range(1, levels + 1):
        j = spark.range(sizes[r]).select(F.lit(r).alias("level"), F.col("id").alias("j"))
        edges = j.select("level", "j", F.explode(F.expr(f"sequence({branch} * j, {branch} * j + {branch - 1})")).alias("parent_j"))
        found = edges if found is None else found.unionByName(edges)
    return found


def reduction_data(edges: DataFrame, branch: int) -> DataFrame:
    """For each task of a reduction over level 0: the blocks it ``reads`` and updates (``inout``)."""
    tasks = edges.select("level", "j").distinct()
    return tasks.select(
        "level",
        "j",
        F.expr(f"cast(power({branch}, level) as bigint) * j + cast(power({branch}, level - 1) as bigint)").alias("reads"),
        F.expr(f"cast(power({branch}, level) as bigint) * j").alias("inout"),
    )


def reduction_scatter(spark: SparkSession, n: int, levels: int) -> DataFrame:
    """Edges ``level``, ``j``, ``parent_level``, ``parent_j`` of alternating bulk levels and single bridge tasks."""
    bridges, bulks = levels // 2 + levels % 2, levels // 2 + 1
    each, rest = divmod(n - bridges, bulks)
    bulk = lambda b: each + (rest if b == bulks - 1 else 0)
    width = [bulk(r // 2) if r % 2 == 0 else 1 for r in range(levels + 1)]
    found = None
    for r in range(1, levels + 1):
        many = spark.range(max(width[r], width[r - 1])).select(F.col("id"))
        edges = many.select(
            F.lit(r).alias("level"),
            (F.col("id") if width[r] > 1 else F.lit(0).cast("long")).alias("j"),
            F.lit(r - 1).alias("parent_level"),
            (F.col("id") if width[r - 1] > 1 else F.lit(0).cast("long")).alias("parent_j"),
        )
        found = edges if found is None else found.unionByName(edges)
    return found


def task_index(spark: SparkSession, space: str, axes: list[tuple[int, int, int]], shape: tuple[int, ...], start: tuple[int, ...]) -> DataFrame:
    """The tasks that slices (start, stop, step) of a bounded space name, the first axis outermost."""
    frame = spark.range(1).select()
    for k, (a, b, step) in enumerate(axes):
        low, high = max(a, start[k]), min(b, start[k] + shape[k])
        values = F.sequence(F.lit(low), F.lit(high - 1), F.lit(step)) if low < high else F.array().cast("array<int>")
        frame = frame.select("*", F.explode(values.cast("array<long>")).alias(f"i{k}"))
    names = [F.col(f"i{k}").cast("string") for k in range(len(axes))]
    return frame.select(F.concat_ws("_", F.lit(space), *names).alias("name"), *[f"i{k}" for k in range(len(axes))])


def parse_tasks(lines: DataFrame) -> DataFrame:
    """Task lines ``id | runtimes | dependencies | reads : writes : read_writes`` of column ``value``, one row each.

    ``space``, ``idx``, ``time``, ``vcus``, ``memory`` (of the first runtime), ``deps`` (names), ``reads``, ``writes``,
    ``read_writes``. Ids are written ``(T, (0,), 0)`` or with their numbers alone.
    """
    parts = F.split("value", r"\s*\|\s*")
    numbers = lambda text: F.transform(F.regexp_extract_all(text, F.lit(r"(-?\d+)"), F.lit(1)), lambda x: x.cast("int"))
    ids = F.get(parts, F.lit(0))
    times = F.split(F.regexp_extract(F.get(parts, F.lit(1)), r"\{[^:}]*:([^}]*)\}", 1), r"\s*,\s*")
    data = F.split(F.coalesce(F.get(parts, F.lit(3)), F.lit("")), r"\s*:\s*")
    deps = F.filter(F.split(F.coalesce(F.get(parts, F.lit(2)), F.lit("")), r"\s*:\s*"), lambda x: F.trim(x) != "")
    number = lambda k, kind: F.trim(F.get(times, F.lit(k))).try_cast(kind)
    return lines.select(
        F.regexp_extract(ids, r"([A-Za-z]\w*)", 1).alias("space"),
        numbers(ids).alias("idx"),
        number(0, "double").alias("time"),
        number(1, "double").alias("vcus"),
        number(4, "long").alias("memory"),
        F.transform(deps, lambda x: F.concat_ws("_", F.regexp_extract(x, r"([A-Za-z]\w*)", 1), F.transform(numbers(x), lambda n: n.cast("string")))).alias("deps"),
        *[numbers(F.coalesce(F.get(data, F.lit(k)), F.lit(""))).alias(c) for k, c in enumerate(("reads", "writes", "read_writes"))],
    )


def task_lines(tasks: DataFrame) -> DataFrame:
    """The lines that ``parse_tasks`` reads back, as ``value``."""
    listed = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ", ")
    index = lambda i: F.concat(F.lit("("), listed(i), F.lit(")"))
    named = lambda n: F.concat(F.lit("("), F.regexp_extract(n, r"([A-Za-z]\w*?)_", 1), F.lit(", "), index(F.regexp_extract_all(n, F.lit(r"_(-?\d+)"), F.lit(1))), F.lit(")"))
    # Numbers written with 17 digits are read back as they were.
    runtime = F.concat(F.lit("{(0) : "), F.concat_ws(", ", F.col("time").cast("string"), F.col("vcus").cast("string"), F.lit("0"), F.lit("0"), F.col("memory").cast("string")), F.lit("}"))
    data = F.concat_ws(" : ", *[listed(c) for c in ("reads", "writes", "read_writes")])
    head = F.concat(F.lit("("), F.col("space"), F.lit(", "), index(F.col("idx")), F.lit(")"))
    return tasks.select(F.concat_ws(" | ", head, runtime, F.array_join(F.transform("deps", named), " : "), data).alias("value"))


#: Events of a trace line by the words that mark it, the first that occurs.
EVENTS = (("Assigned", "ASSIGNED"), ("Running", "START"), ("Runahead", "RUNAHEAD"), ("Completed", "COMPLETED"), ("Notified", "NOTIFY"), ("Adding", "ADD_DEPS"))


def parse_trace(lines: DataFrame) -> DataFrame:
    """Lines `` `[ns] >> message` `` of column ``value``: ``ts``, ``event``, ``task``, ``instance``, ``is_data_task``."""
    event = F.lit(None).cast("string")
    for word, name in reversed(EVENTS):
        event = F.when(F.col("value").contains(word), name).otherwise(event)
    body = F.regexp_extract("value", r"InnerTask\{(.*?)\}", 1)
    field = lambda name: F.trim(F.regexp_extract(body, rf"\b{name}: *([^,]*)", 1))
    return lines.select(
        F.regexp_extract("value", r"\[(\d+)\]", 1).try_cast("long").alias("ts"),
        event.alias("event"),
        field("name").alias("task"),
        field("instance").try_cast("int").alias("instance"),
        (field("is_data_task") == "1").alias("is_data_task"),
    ).filter("event is not null")


def task_times(trace: DataFrame) -> DataFrame:
    """``task``, ``assigned_t``, ``start_t``, ``end_t``, ``duration`` of the compute tasks that have all three."""
    own = trace.filter(~F.col("is_data_task") & ~F.col("task").contains(".dm."))
    at = lambda name: F.min(F.when(F.col("event") == name, F.col("ts")))
    times = own.groupBy("task").agg(at("ASSIGNED").alias("assigned_t"), at("START").alias("start_t"), at("COMPLETED").alias("end_t"))
    return times.dropna().withColumn("duration", F.col("end_t") - F.col("start_t"))


def missing_dependencies(truth: DataFrame, logged: DataFrame) -> DataFrame:
    """Edges ``src``, ``dst`` of the graph that the log lacks."""
    return truth.join(logged, ["src", "dst"], "left_anti")


def order_violations(edges: DataFrame, times: DataFrame) -> DataFrame:
    """Edges whose ``dst`` started before its ``src`` had ended."""
    src = times.select(F.col("task").alias("src"), F.col("end_t").alias("src_end"))
    dst = times.select(F.col("task").alias("dst"), F.col("start_t").alias("dst_start"))
    return edges.join(src, "src").join(dst, "dst").filter(F.col("dst_start") < F.col("src_end"))


def array_dependencies(edges: DataFrame, accesses: DataFrame) -> DataFrame:
    """``task``, ``array``, ``dep``: of the tasks before a task (``src``, ``dst``), those its own access must wait for.

    ``accesses`` has ``task``, ``array``, ``mode``. A task that writes an array is waited for; one that only reads it
    (``IN``) is waited for if it waits itself. So what has to be waited for spreads along edges between readers, by
    rounds that each go one edge further; the edges must have no cycle. What joins is shuffled and merged: tables sent
    to all executors would pass through the driver in each round.
    """
    own = accesses.groupBy("task", "array").agg(F.bool_and(F.col("mode") == "IN").alias("reads"))
    along = edges.select(F.col("src").alias("dep"), F.col("dst").alias("task")).distinct().join(own.hint("merge"), "task")
    along = written(along.join(own.select(F.col("task").alias("dep"), "array").hint("merge"), ["dep", "array"]))
    held = fresh = written(own.filter("not reads").select(F.col("task").alias("dep"), "array"))
    readers = along.filter("reads")
    while True:
        next_ = readers.join(fresh.hint("merge"), ["dep", "array"]).select(F.col("task").alias("dep"), "array").distinct()
        fresh = written(next_.join(held.hint("merge"), ["dep", "array"], "left_anti"))
        if fresh.isEmpty():
            break
        held = written(held.unionByName(fresh))
    return along.join(held.hint("merge"), ["dep", "array"]).select("task", "array", "dep")


def upserted(table: DataFrame, rows: DataFrame, *key: str) -> DataFrame:
    """``table`` with the rows of ``rows`` whose key it lacks: what is there stays as it is. Null keys are equal."""
    renamed = table.select(*[F.col(c).alias(f"_{n}") for n, c in enumerate(key)]).distinct()
    on = F.lit(True)
    for n, c in enumerate(key):
        on = on & F.col(c).eqNullSafe(F.col(f"_{n}"))
    return table.unionByName(rows.join(renamed, on, "left_anti"))


def levels(edges: DataFrame) -> DataFrame:
    """``node``, ``level``: the longest path to each node from one without parents. The edges must have no cycle.

    The joins of each round are shuffled and merged, as in ``array_dependencies``.
    """
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    found = written(nodes.select("node", F.lit(0).alias("level")))
    while True:
        pushed = edges.join(found.select(F.col("node").alias("src"), (F.col("level") + 1).alias("up")).hint("merge"), "src").groupBy("dst").agg(F.max("up").alias("up"))
        after = found.join(pushed.hint("merge"), found["node"] == pushed["dst"], "left").select("node", F.col("level").alias("old"), F.greatest("level", F.coalesce("up", F.lit(0))).alias("level"))
        after = written(after)
        found = after.select("node", "level")
        if after.filter("old <> level").isEmpty():
            return found


def placement(code: Column, gpus: int) -> Column:
    """-1 is the CPU, 0 any GPU, 1 to 4 a GPU by number, 5 and above a GPU in turn."""
    return (
        F.when(code == -1, "cpu").when(code == 0, "gpu").when(code <= 4, F.concat(F.lit("gpu"), (code - 1).cast("string")))
        .otherwise(F.concat(F.lit("gpu"), ((code - 5) % gpus).cast("string")))
    )
