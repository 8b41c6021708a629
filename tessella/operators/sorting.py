"""Distributed sorting, splitters, searches and the exchange between shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import int_div

from .positions import written, with_position


def sample_sort(frame: DataFrame, *order: str) -> DataFrame:
    """Sorted shards: Spark samples the keys for splitters, deals rows by range and sorts each range."""
    return frame.repartitionByRange(*order).sortWithinPartitions(*order)


def local_sort(frame: DataFrame, shard: str, *order: str) -> DataFrame:
    """Each shard's rows with their rank ``r`` from 0 within it. A shard is sorted by ranges, not in one task."""
    return with_position(frame, *order, name="r", by=[shard])


def regular_samples(frame: DataFrame, shard: str, value: str, shards: int) -> DataFrame:
    """For each shard its values at ranks ((j + 1) * m) // shards - 1, j from 0 to shards - 2."""
    ranked = local_sort(frame, shard, value)
    sizes = frame.groupBy(shard).agg(F.count("*").alias("m"))
    wanted = F.explode(F.sequence(F.lit(0), F.lit(shards - 2))).alias("j")
    ranks = sizes.select(shard, "m", wanted).withColumn("r", int_div((F.col("j") + 1) * F.col("m"), shards) - 1)
    return ranked.join(ranks, [shard, "r"]).select(shard, "j", F.col(value).alias("sample"))


def splitters(samples: DataFrame, shards: int) -> DataFrame:
    """Of the sorted samples, the middle one of each of shards - 1 equal parts: ``t``, ``splitter``."""
    s = shards - 1
    placed = with_position(samples.select("sample"), "sample", name="p")
    n = samples.agg(F.count("*").alias("n"))
    parts = n.select("n", F.explode(F.sequence(F.lit(0), F.lit(s - 1))).alias("t"))
    low, high = int_div(F.col("t") * F.col("n"), s), int_div((F.col("t") + 1) * F.col("n"), s)
    middle = parts.select("t", (low + int_div(high - low, 2)).alias("p"))
    return placed.join(F.broadcast(middle), "p").select("t", F.col("sample").alias("splitter"))


def bucket_of(value: Column, bounds: list, side: str = "left") -> Column:
    """How many of the sorted bounds lie below a value (``left``), or at it or below (``right``), by binary search."""

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        bound = F.lit(bounds[middle])
        return F.when((bound < value) if side == "left" else (bound <= value), search(middle + 1, high)).otherwise(search(low, middle))

    return search(0, len(bounds))


def quick_sort(frame: DataFrame, value: str, *ties: str, least: int = 1 << 16) -> DataFrame:
    """Adds ``pos``, the place of each row in the order of ``value`` and ``ties``, nulls first, by rounds of partitioning.

    A round splits every part of more than ``least`` rows at its middle value: what is below goes left, what is above
    right, and what equals the pivot is a part of its own, that no further round splits. All parts are split in one
    job. Then each part, bounded by ``least`` but for equal values, is sorted where it is.
    """
    rows = frame.withColumns({"_part": F.lit(1).cast("long"), "_done": F.col(value).isNull(), "_base": F.lit(0).cast("long")})
    nulls = frame.filter(F.col(value).isNull()).count()
    rows = rows.withColumn("_base", F.when(~F.col("_done"), nulls).otherwise(0).cast("long"))
    rows = rows.withColumn("_part", F.when(F.col("_done"), 0).otherwise(1).cast("long"))
    while True:
        rows = written(rows)
        sizes = rows.filter("not _done").groupBy("_part").agg(F.count("*").alias("_n"))
        large = sizes.filter(F.col("_n") > least)
        if large.isEmpty():
            break
        # An approximate middle is a pivot as good as any: which rows are left of it is exact.
        pivots = rows.filter("not _done").join(large, "_part").groupBy("_part").agg(F.percentile_approx(value, 0.5).alias("_p"))
        side = F.when(F.col("_p").isNull(), F.lit(None)).when(F.col(value) < F.col("_p"), 0).when(F.col(value) == F.col("_p"), 1).otherwise(2)
        sided = written(rows.join(pivots, "_part", "left").withColumn("_side", side).drop("_p"))
        counts = sided.filter("_side is not null").groupBy("_part").agg(F.count_if(F.col("_side") == 0).alias("_l"), F.count_if(F.col("_side") == 1).alias("_e"))
        moved = sided.join(counts, "_part", "left")
        shift = F.when(F.col("_side") == 1, F.col("_l")).when(F.col("_side") == 2, F.col("_l") + F.col("_e")).otherwise(0)
        rows = moved.withColumns(
            {"_base": F.col("_base") + shift, "_part": F.when(F.col("_side").isNull(), F.col("_part")).otherwise(F.col("_part") * 3 + F.col("_side")), "_done": F.col("_done") | F.coalesce(F.col("_side") == 1, F.lit(False))}
        ).drop("_side", "_l", "_e")
    ranked = with_position(rows, value, *ties, name="_r", by=["_base", "_part"])
    return ranked.withColumn("pos", F.col("_base") + F.col("_r")).drop("_part", "_done", "_base", "_r")


def concatenated(*frames: DataFrame, order: str) -> DataFrame:
    """Blocks one after the other: ``pos`` goes on from block to block, by ``order`` within each."""
    found = None
    for n, frame in enumerate(frames):
        block = frame.withColumn("_block", F.lit(n))
        found = block if found is None else found.unionByName(block)
    return with_position(found, "_block", order).drop("_block")


def exchange_counts(frame: DataFrame, source: str, target: str, shards: int) -> DataFrame:
    """The dense matrix of rows that go from each source to each target, and each cell's offset in its row."""
    spark = frame.sparkSession
    cells = spark.range(shards).select(F.col("id").cast("int").alias(source)).crossJoin(spark.range(shards).select(F.col("id").cast("int").alias(target)))
    counts = frame.groupBy(source, target).agg(F.count("*").alias("n"))
    full = cells.join(counts, [source, target], "left").select(source, target, F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    before = Window.partitionBy(source).orderBy(target).rowsBetween(Window.unboundedPreceding, -1)
    return full.withColumn("send_offset", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long"))


def balanced(frame: DataFrame, side: str, shard: str, order: str, shards: int) -> DataFrame:
    """Left runs of all shards, then right runs, packed into ``shards`` equal bins: ``pos``, ``bin``."""
    placed = with_position(frame.withColumn("_right", ~F.col(side)), "_right", shard, order)
    size = F.ceil(frame.agg(F.count("*").alias("n")).first()[0] / F.lit(shards))
    return placed.drop("_right").withColumn("bin", F.floor(F.col("pos") / size).cast("int"))
