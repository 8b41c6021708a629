"""k-means by Lloyd's iterations on vectors.

Distances are computed in Arrow batches: expressions over arrays took about nine times as long for a million points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .positions import written

#: Centres are sent to all executors; more than these would need another plan.
MAX_CENTRES = 10_000
#: Distances that a Python worker holds at a time.
HELD = 1 << 22


def _held(centres: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and places of the centres in the order of their numbers; their count is bounded."""
    rows = centres.select("k", F.col("c").cast("array<double>").alias("c")).orderBy("k").limit(MAX_CENTRES + 1).collect()
    if len(rows) > MAX_CENTRES:
        raise ValueError(f"more than {MAX_CENTRES} centres")
    if len({len(r["c"]) for r in rows}) > 1:
        raise ValueError("centres of several lengths")
    return np.array([r["k"] for r in rows]), np.array([r["c"] for r in rows], float)


def nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which centre is nearest to each point, the first on a tie, and its squared distance; NaN without one."""
    at, least = np.zeros(len(points), np.int64), np.full(len(points), np.nan)
    step = max(1, HELD // max(1, len(centres)))
    for start in range(0, len(points) if len(centres) else 0, step):
        part = points[start : start + step]
        d = np.empty((len(part), len(centres)))
        for i, c in enumerate(centres):
            d[:, i] = np.square(part - c).sum(1)
        at[start : start + step] = d.argmin(1)
        least[start : start + step] = d[np.arange(len(part)), at[start : start + step]]
    return at, least


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors that have ``dim`` numbers, and their rows. A null number is NaN."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False)
    flat = column.filter(fits).flatten().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
    return flat.astype(float).reshape(len(rows), dim), rows


def assign(points: DataFrame, centres: DataFrame) -> DataFrame:
    """``id``, ``x``, ``k``, ``d``: each point with its nearest centre, the lowest k on a tie, and the squared distance.

    A vector that is null, holds a null or NaN, or has another length than the centres has no centre: k and d are null.
    """
    numbers, held = _held(centres)
    dim = held.shape[1] if len(held) else 0
    kind = pa.int64() if dict(centres.dtypes)["k"] == "bigint" else pa.int32()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, rows = _matrix(batch.column(1), dim)
            k, d = np.zeros(batch.num_rows, np.int64), np.full(batch.num_rows, np.nan)
            at, d[rows] = nearest(vectors, held)
            k[rows] = numbers[at] if len(numbers) else 0
            none = np.isnan(d)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(k, kind, mask=none), pa.array(d, mask=none)], names=["id", "x", "k", "d"])

    own = points.select("id", F.col("x").cast("array<double>").alias("x"))
    return own.mapInArrow(run, f"id {own.schema['id'].dataType.simpleString()}, x array<double>, k {dict(centres.dtypes)['k']}, d double")


def moved(points: DataFrame, centres: DataFrame) -> DataFrame:
    """``update`` of ``assign`` in one pass: a batch of points leaves a row of sums for each centre that is near it."""
    numbers, held = _held(centres)
    if not len(held):
        return centres.select("k", "c")
    dim = held.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, _ = _matrix(batch.column(0), dim)
            at, d = nearest(vectors, held)
            at, vectors = at[~np.isnan(d)], vectors[~np.isnan(d)]
            counts = np.bincount(at, minlength=len(held))
            sums = np.stack([np.bincount(at, vectors[:, j], len(held)) for j in range(dim)], 1)
            near = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(numbers[near].astype(np.int64)), pa.array(counts[near]), pa.array(list(sums[near]), pa.list_(pa.float64()))], names=["of", "n", "s"])

    parts = points.select(F.col("x").cast("array<double>").alias("x")).mapInArrow(run, "of long, n long, s array<double>")
    means = parts.groupBy("of").agg(F.array(*[F.sum(F.get("s", F.lit(j))) / F.sum("n") for j in range(dim)]).alias("new"))
    return centres.join(means, centres["k"] == means["of"], "left").select("k", F.coalesce("new", F.col("c").cast("array<double>")).alias("c"))


def update(assigned: DataFrame, centres: DataFrame) -> DataFrame:
    """``k``, ``c``: the means of the points of each centre; a centre without points stays where it was.

    A row for each centre and task is shuffled, with all its partial sums: points never become a row for each number.
    """
    first = centres.select(F.size("c")).first()
    if first is None:
        return centres.select("k", "c")
    sums = [F.avg(F.get("x", F.lit(j)).cast("double")) for j in range(first[0])]
    means = assigned.groupBy(F.col("k").alias("of")).agg(F.array(*sums).alias("new"))
    return centres.join(means, centres["k"] == means["of"], "left").select("k", F.coalesce("new", F.col("c").cast("array<double>")).alias("c"))


def kmeans(points: DataFrame, centres: DataFrame, rounds: int = 20) -> tuple[DataFrame, DataFrame]:
    """The centres after a fixed number of rounds, and the assignment that the last round made."""
    before = centres
    for _ in range(rounds):
        before, centres = centres, written(moved(points, centres))
    return centres, assign(points, before)


def homogeneity(pairs: DataFrame) -> DataFrame:
    """1 - H(label | k) / H(label) of rows ``label``, ``k``, as ``homogeneity``; 1 for a single label."""
    cells = pairs.groupBy("label", "k").agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("t"))
    by_k, by_label = (cells.groupBy(c).agg(F.sum("n").alias("m")) for c in ("k", "label"))
    given = cells.join(by_k, "k").crossJoin(F.broadcast(total)).agg(F.sum(-F.col("n") / F.col("t") * F.log(F.col("n") / F.col("m"))).alias("given"))
    whole = by_label.crossJoin(F.broadcast(total)).agg(F.sum(-F.col("m") / F.col("t") * F.log(F.col("m") / F.col("t"))).alias("whole"))
    return given.crossJoin(whole).select(F.when(F.col("whole") == 0, 1.0).otherwise(1 - F.col("given") / F.col("whole")).alias("homogeneity"))
