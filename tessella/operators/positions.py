"""Dense global positions, ranks and running sums without a window over one partition, and medians from them."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Sequence
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session, where all run on one machine, may do without the setting. On a cluster a folder chosen here
    would be local to the driver, so that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="tessella-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def materialised(frame: DataFrame) -> DataFrame:
    """The frame, checkpointed in the folder that the executors share, without its lineage."""
    checkpoint_folder(frame.sparkSession)
    return frame.checkpoint()


def written(frame: DataFrame) -> DataFrame:
    """The frame as a Parquet table in that folder, for loops: a table has the size of its files.

    A checkpoint keeps the size that was estimated for its plan, a product over its joins. From round to round of a
    loop that number would grow to millions of digits, and planning would take ever longer.
    """
    path = f"{checkpoint_folder(frame.sparkSession)}/table-{uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def with_position(frame: DataFrame, *order: str, name: str = "pos", by: Sequence[str] = ()) -> DataFrame:
    """Adds the rank from 0 of each row in the order of the columns, within each group ``by``; ties in any order."""
    return running_sum(frame, F.lit(1), *order, name=name, by=by).withColumn(name, (F.col(name) - 1).cast("long"))


def running_sum(frame: DataFrame, value: Column, *order: str, name: str = "running", by: Sequence[str] = ()) -> DataFrame:
    """Adds the inclusive prefix sum in the order of the columns, within each group ``by``.

    Rows are dealt by ranges of group and order and summed within their range; a group's sum in a range begins where
    its sums in the ranges before end. So a large group is spread over many tasks, and only a row for each range and
    group is brought together. The columns added on the way have names that the frame has not.
    """
    tag = "_run"
    while any(c.lower().startswith(tag) for c in frame.columns):
        tag += "_"
    v, part, at, s, offset = (f"{tag}_{c}" for c in ("v", "part", "at", "sum", "offset"))
    keys = [f"{tag}_{n}" for n in range(len(by))]
    dealt = materialised(frame.withColumn(v, value).repartitionByRange(*by, *order).withColumn(part, F.spark_partition_id()))
    sums = dealt.groupBy(part, *by).agg(F.sum(v).alias(s))
    before = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        F.col(part).alias(at), *[F.col(c).alias(k) for k, c in zip(keys, by, strict=True)], F.coalesce(F.sum(s).over(before), F.lit(0)).alias(offset)
    )
    own = F.sum(v).over(Window.partitionBy(part, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    on = F.col(part) == F.col(at)
    for k, c in zip(keys, by, strict=True):
        on = on & F.col(c).eqNullSafe(F.col(k))
    joined = dealt.withColumn(name, own).join(offsets if by else F.broadcast(offsets), on)
    return joined.withColumn(name, F.col(name) + F.col(offset)).drop(part, at, offset, v, *keys)


def medians(frame: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """``median`` of a numeric column for each group, from its middle ranks; nulls take no part."""
    rows = frame.filter(F.col(value).isNotNull()).select(*by, value)
    ranked = with_position(rows, value, name="_rank", by=by)
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    if by:
        sizes = sizes.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(by)], "_n")
        on = F.lit(True)
        for i, c in enumerate(by):
            on = on & F.col(c).eqNullSafe(F.col(f"_{i}"))
        ranked = ranked.join(sizes, on)
    else:
        ranked = ranked.crossJoin(F.broadcast(sizes))  # one row
    middle = F.col("_rank").between(F.expr("(_n - 1) div 2"), F.expr("_n div 2"))
    return ranked.filter(middle).groupBy(*by).agg(F.avg(value).alias("median"))
