"""Arrays, generated data, graph text, traces and device descriptions in and out of Spark."""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import Path
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import shard_of, unravelled
from tessella.operators.graphs import parse_tasks, parse_trace, task_lines
from tessella.operators.grid import GridArray
from tessella.operators.positions import with_position


def array(spark: SparkSession, data: Any) -> GridArray:
    """A literal, sequence or numpy array from the driver; unsigned and complex values are widened and split."""
    values = np.asarray(data)
    if values.dtype.kind == "u":
        values = values.astype(np.int64)
    index = {f"i{k}": pa.array(x.ravel().astype(np.int64)) for k, x in enumerate(np.indices(values.shape))}
    flat = np.ascontiguousarray(values).ravel()
    if values.dtype.kind == "c":
        cells = pa.StructArray.from_arrays([pa.array(flat.real), pa.array(flat.imag)], ["re", "im"])
    else:
        cells = pa.array(flat)
    return GridArray(spark.createDataFrame(pa.table(index | {"v": cells})), values.shape, F.col("v"))


def arrays(spark: SparkSession, data: Any) -> Any:
    """Wraps every array in nested dictionaries, lists and tuples."""
    if isinstance(data, Mapping):
        return {k: arrays(spark, v) for k, v in data.items()}
    if isinstance(data, (list, tuple)) and any(isinstance(x, (np.ndarray, Mapping, list, tuple)) for x in data):
        return type(data)(arrays(spark, x) for x in data)
    return array(spark, data)


def collect(grid: GridArray) -> np.ndarray:
    """The dense array on the driver; for results that fit there."""
    rows = grid.frame().toPandas()
    out = np.zeros(grid.shape, rows["v"].to_numpy().dtype)
    out[tuple(rows[a].to_numpy() for a in grid.axes)] = rows["v"].to_numpy()
    return out


def load_npy(spark: SparkSession, path: str) -> GridArray:
    return array(spark, np.load(path))


def save_npy(grid: GridArray, path: str) -> None:
    np.save(path, collect(grid))


def save_raw(grid: GridArray, path: str) -> None:
    """The elements alone, row by row in the machine's format; for arrays that fit on the driver, as ``save_npy``."""
    collect(grid).tofile(path)


def load_raw(spark: SparkSession, path: str, dtype: str, shape: tuple[int, ...]) -> GridArray:
    return array(spark, np.fromfile(path, dtype).reshape(shape))


def _unit(key: Column, salt: int) -> Column:
    """A number in [0, 1) by hashing: the same under any partitioning."""
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1 << 53)) / float(1 << 53)


def _bell(key: Column, salt: int) -> Column:
    """A standard normal number by hashing."""
    return F.sqrt(-2 * F.log(1 - _unit(key, salt))) * F.cos(2 * np.pi * _unit(key, salt + 1_000_003))


def _vector(spark: SparkSession, n: int, shards: int, v: Column) -> DataFrame:
    return spark.range(n).select(shard_of(F.col("id"), n, shards).alias("part"), F.col("id").alias("i0"), v.alias("v"))


def uniform(spark: SparkSession, n: int, shards: int, salt: int = 0) -> DataFrame:
    """``part``, ``i0``, ``v``: n numbers in [0, 1)."""
    return _vector(spark, n, shards, _unit(F.col("id"), salt))


def normal(spark: SparkSession, n: int, shards: int, salt: int = 0) -> DataFrame:
    """``part``, ``i0``, ``v``: n numbers of mean 0 and deviation 1."""
    return _vector(spark, n, shards, _bell(F.col("id"), salt))


def integers(spark: SparkSession, n: int, shards: int, low: int, high: int, salt: int = 0) -> DataFrame:
    """``part``, ``i0``, ``v``: n integers from ``low`` to below ``high``."""
    return _vector(spark, n, shards, F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(high - low)) + low)


def blobs(spark: SparkSession, n: int, dim: int, centres: int, spread: float = 1.0, salt: int = 0) -> DataFrame:
    """``id``, ``label``, ``x``: n points about ``centres`` places in a cube of side 20."""
    label = F.pmod(F.xxhash64("id", F.lit(salt + 2)), F.lit(centres))
    axes = F.sequence(F.lit(0), F.lit(dim - 1))
    at = lambda j: 20 * _unit(F.struct("label", j), salt + 3) - 10 + spread * _bell(F.struct("id", j), salt)
    return spark.range(n).withColumn("label", label).withColumn("x", F.transform(axes, at))


def shuffled(frame: DataFrame, *key: str, salt: int = 0) -> DataFrame:
    """Adds ``pos``, the place of each row in an order by hashes of its key."""
    own = frame.withColumn("_h", F.xxhash64(*key, F.lit(salt)))
    return with_position(own, "_h", *key).drop("_h")


def arange(spark: SparkSession, start: int, stop: int, step: int = 1) -> GridArray:
    n = len(range(start, stop, step))
    return GridArray(spark.range(n).select(F.col("id").alias("i0")), (n,), F.lit(start) + F.col("i0") * step)


def constant(spark: SparkSession, shape: tuple[int, ...], value: float) -> GridArray:
    cells = spark.range(int(np.prod(shape))).select(
        *[i.alias(f"i{k}") for k, i in enumerate(unravelled(F.col("id"), shape))], F.lit(value).alias("v")
    )
    return GridArray(cells, tuple(shape), F.col("v"))


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``data`` (idx, size, location) of the first line and ``tasks`` of the others of a graph file."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path).filter(F.trim("value") != "")
    is_data = ~F.col("value").contains("|")
    item = F.posexplode(F.regexp_extract_all("value", F.lit(r"\{([^}]*)\}"), F.lit(1))).alias("idx", "x")
    pair = F.split("x", r"\s*:\s*")
    data = lines.filter(is_data).select(item)
    data = data.select("idx", F.trim(F.get(pair, F.lit(0))).try_cast("long").alias("size"), F.trim(F.get(pair, F.lit(1))).try_cast("int").alias("location"))
    return data, parse_tasks(lines.filter(~is_data))


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    return parse_trace(spark.read.text(path))


def write_graph(data: DataFrame, tasks: DataFrame, path: str) -> None:
    """Writes the text that ``read_graph`` reads: the line of data first, then a line for each task.

    The data of a graph are one line, and so are gathered; they are a few numbers for each array. Tasks are lines of
    as many files as they have partitions.
    """
    item = F.format_string("{%d : %d}", F.col("size"), F.col("location"))
    listed = data.agg(F.array_sort(F.collect_list(F.struct("idx", item.alias("t")))).alias("s"))
    listed.select(F.array_join("s.t", ", ").alias("value")).write.text(f"{path}/data")
    task_lines(tasks).write.text(f"{path}/tasks")


def read_devices(spark: SparkSession, path: str) -> DataFrame:
    """``devices`` of a YAML file; JSON is YAML, so that a file in it needs no further package."""
    text = Path(path).read_text()
    try:
        from yaml import safe_load
    except ImportError:
        from json import loads as safe_load
    return devices(spark, safe_load(text))


def devices(spark: SparkSession, config: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """``global_id``, ``arch``, ``dev_id``, ``memory``, ``vcus`` of a parsed description: CPU first, then each GPU."""
    rows = [(0, "cpu", 0, int(config["CPU"]["mem_sz"]), 1000 * int(config["CPU"]["num_cores"]))]
    gpus = config.get("GPU", {"num_devices": 0, "mem_sz": []})
    rows += [(k + 1, "gpu", k, int(gpus["mem_sz"][k]), 1000) for k in range(int(gpus["num_devices"]))]
    return spark.createDataFrame(rows, "global_id int, arch string, dev_id int, memory long, vcus long")
