"""Placement scores, admission, and the state of array copies, as queries over devices, tasks and accesses."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .positions import running_sum

#: Weights of a device's score: base, local data, data elsewhere, load.
BASE, LOCAL, AWAY, LOAD = 50, 30, 30, 10
#: Devices up to which their table is sent to all executors; a longer one is joined as Spark chooses.
SENT_DEVICES = 10_000
#: Tasks of the graph whose scores are made in one Spark task, about; more of them make more Spark tasks.
TASKS_OF_A_PART = 1 << 18


def parts_of(tasks: DataFrame) -> int:
    """Partitions for rows of ``tasks``, so that the memory of one is the same for a table of any length."""
    return max(tasks.sparkSession.sparkContext.defaultParallelism, -(-tasks.count() // TASKS_OF_A_PART))


def scores(tasks: DataFrame, reads: DataFrame, copies: DataFrame, devices: DataFrame) -> DataFrame:
    """``task``, ``device``, ``score`` for every device with the capacity for a task.

    ``tasks``: task, memory, vcus. ``reads``: task, array, bytes. ``copies``: array, device. ``devices``: device,
    memory, vcus, load (tasks mapped to it). Bytes that a device holds count for it, the others against it. A task has
    its bytes by device in one row, so that all meets by task alone, in one shuffle with ``parts_of`` partitions.
    """
    total = devices.agg(F.sum("load").alias("total"))
    share = F.when(F.col("total") > 0, F.col("load") / F.col("total")).otherwise(0.0)
    able = devices.crossJoin(F.broadcast(total)).select(  # one row
        "device", F.col("memory").alias("has_memory"), F.col("vcus").alias("has_vcus"), share.alias("share")
    )
    able = F.broadcast(able) if devices.count() <= SENT_DEVICES else able
    kind, parts = devices.schema["device"].dataType, parts_of(tasks)
    held = reads.join(copies, "array").groupBy("task", "device").agg(F.sum("bytes").alias("near"))
    held = held.filter("device is not null").select("task", F.lit(None).alias("all"), F.struct(F.col("device").cast(kind), "near").alias("on"))
    needed = reads.groupBy("task").agg(F.sum("bytes").alias("all")).select("task", "all", F.lit(None).alias("on"))
    moved = needed.unionByName(held).repartition(parts, "task").groupBy("task").agg(F.sum("all").alias("all"), F.map_from_entries(F.collect_list("on")).alias("held"))
    joined = tasks.repartition(parts, "task").join(moved.hint("merge"), "task", "left")
    joined = joined.join(able, (F.col("memory") <= F.col("has_memory")) & (F.col("vcus") <= F.col("has_vcus")))
    near, every = F.coalesce(F.try_element_at("held", F.col("device")), F.lit(0)), F.coalesce("all", F.lit(0))
    return joined.select("task", "device", (BASE + LOCAL * near - AWAY * (every - near) - LOAD * F.col("share")).alias("score"))


def choose(scored: DataFrame, start: int = 0, count: int = 1) -> DataFrame:
    """The best device of each task; of equal ones that which a round from ``start`` meets last."""
    turn = (F.col("device") - start + count) % count
    return scored.groupBy("task").agg(F.max_by("device", F.struct("score", turn)).alias("device"), F.max("score").alias("score"))


def choose_option(scored: DataFrame, members: DataFrame) -> DataFrame:
    """The best option of each task. ``members``: task, option, device. All must have scores; the mean counts.

    Without ``task`` in ``members`` all tasks have the same options, which then are sent to where the scores are.
    """
    if "task" not in members.columns:
        return _choose_common_option(scored, members)
    met = members.join(scored, ["task", "device"], "left").groupBy("task", "option").agg(
        F.avg("score").alias("score"), F.bool_and(F.col("score").isNotNull()).alias("able"), (F.count_distinct("device") == F.count("*")).alias("apart")
    )
    met = met.filter("able and apart")
    return met.groupBy("task").agg(F.max_by("option", F.struct("score", "option")).alias("option"), F.max("score").alias("score"))


def _choose_common_option(scored: DataFrame, members: DataFrame) -> DataFrame:
    options = members.groupBy("option").agg(F.collect_list("device").alias("devices"), F.count("*").alias("n"))
    options = options.filter((F.size("devices") == F.col("n")) & (F.size(F.array_distinct("devices")) == F.col("n")))
    options = options.agg(F.collect_list(F.struct("option", "devices")).alias("options"))  # one row
    lists = scored.groupBy("task").agg(F.collect_list(F.struct("device", "score")).alias("scores")).crossJoin(F.broadcast(options))
    fits = lambda o: F.filter("scores", lambda x: F.array_contains(o["devices"], x["device"]))
    whole = lambda x: (F.size(x) == F.size(F.array_distinct(x["device"]))) & F.forall(x, lambda y: y["score"].isNotNull())
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda t, y: t + y["score"]) / F.size(x)
    met = F.transform("options", lambda o: F.struct(fits(o).alias("x"), o["option"].alias("option"), F.size(o["devices"]).alias("n")))
    met = F.filter(met, lambda m: (F.size(m["x"]) == m["n"]) & whole(m["x"]))
    best = F.array_max(F.transform(met, lambda m: F.struct(mean(m["x"]).alias("score"), m["option"].alias("option"))))
    return lists.select("task", best.alias("best")).filter("best is not null").select("task", "best.option", "best.score")


def admitted(requests: DataFrame, capacity: DataFrame) -> DataFrame:
    """Requests in order, ``admitted`` until the first on its device that doesn't fit; later ones wait behind it.

    ``requests``: device, seq, need. ``capacity``: device, memory.
    """
    used = running_sum(requests, F.col("need"), "seq", name="used", by=["device"]).join(capacity, "device")
    first = used.filter(F.col("used") > F.col("memory")).groupBy("device").agg(F.min("seq").alias("full_at"))
    waiting = F.coalesce(F.col("seq") >= F.col("full_at"), F.lit(False))
    return used.join(first, "device", "left").select("device", "seq", "need", "used", (~waiting).alias("admitted"))


def mapped_bytes(events: DataFrame) -> DataFrame:
    """Running bytes by device of events ``device``, ``seq``, ``array``, ``bytes``, ``delta`` (1 or -1).

    An array counts once for a device, however many of its views are there.
    """
    own = Window.partitionBy("device", "array").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    counted = events.withColumn("open", F.sum("delta").over(own))
    change = F.when((F.col("open") == 1) & (F.col("delta") == 1), F.col("bytes")).when((F.col("open") == 0) & (F.col("delta") == -1), -F.col("bytes")).otherwise(0)
    return running_sum(counted, change, "seq", name="mapped", by=["device"])


INVALID, SHARED, MODIFIED = 0, 1, 2
HOST = -1


class Copies:
    """The states of one array's whole copies: a read shares, a write takes over, an eviction keeps the last copy."""

    def __init__(self, owner: int = HOST):
        self.state, self.owner = {owner: MODIFIED}, owner

    def read(self, device: int) -> list[tuple[str, int, int]]:
        if self.state.get(device, INVALID) != INVALID:
            return [("NOOP", device, device)]
        source = self.owner
        self.state |= {d: SHARED for d, s in self.state.items() if s == MODIFIED}
        self.state[device] = SHARED
        if source == HOST or (device % 2 == 0 and source % 2 == 1):
            self.owner = device
        return [("LOAD", device, source)]

    def write(self, device: int) -> list[tuple[str, int, int]]:
        if self.state.get(device, INVALID) == MODIFIED:
            return [("NOOP", device, device)]
        steps = [("LOAD", device, self.owner)] if self.state.get(device, INVALID) == INVALID else []
        steps += [("EVICT", d, d) for d in sorted(self.state) if d != device and self.state[d] != INVALID]
        self.state, self.owner = {device: MODIFIED}, device
        return steps or [("NOOP", device, device)]

    def evict(self, device: int, keep: bool = True) -> list[tuple[str, int, int]]:
        if self.state.get(device, INVALID) == INVALID:
            return [("NOOP", device, device)]
        others = sorted(d for d, s in self.state.items() if d != device and s != INVALID)
        if others:
            self.owner = others[0] if self.owner == device else self.owner
            del self.state[device]
            return [("EVICT", device, device)]
        if not keep:
            return [("ERROR", device, device)]
        if device == HOST:
            return [("NOOP", device, device)]
        self.state, self.owner = {HOST: MODIFIED}, HOST
        return [("LOAD", HOST, device), ("EVICT", device, device)]


def coherence(accesses: DataFrame) -> DataFrame:
    """The steps that accesses ``array``, ``seq``, ``op`` (read, write, evict, drop), ``device`` cause.

    ``array``, ``seq``, ``step``, ``opcode``, ``dst``, ``src``, and ``owner`` and ``state`` of the device after it.
    Accesses are sorted by array and sequence within partitions and folded row by row, so that a long history is
    never held as a whole.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Copies | None = None
        array = None
        for frame in frames:
            out = []
            for a, seq, op, device in frame[["array", "seq", "op", "device"]].itertuples(index=False):
                if held is None or a != array:
                    array, held = a, Copies()
                steps = {"read": held.read, "write": held.write, "evict": held.evict}.get(op, lambda d: held.evict(d, False))(device)
                out += [(a, seq, n, *s, held.owner, held.state.get(device, INVALID)) for n, s in enumerate(steps)]
            yield pd.DataFrame(out, columns=["array", "seq", "step", "opcode", "dst", "src", "owner", "state"])

    schema = "array long, seq long, step int, opcode string, dst int, src int, owner int, state int"
    return accesses.repartition("array").sortWithinPartitions("array", "seq").mapInPandas(fold, schema)
