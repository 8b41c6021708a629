"""Tiled linear algebra and Fourier transforms."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .positions import written


def _as(tile, nr, nc) -> np.ndarray:
    return np.asarray(tile, float).reshape(nr, nc)


def cholesky(tiles: DataFrame, blocks: int) -> DataFrame:
    """The lower factor of a symmetric positive definite matrix of ``blocks`` x ``blocks`` tiles, as tiles.

    Left-looking by block column: the products of the columns before are summed for each tile of the panel, then the
    diagonal tile is factored and the panel solved against it. ``tiles`` has ``bi``, ``bj``, ``nr``, ``nc``, ``data``.
    """
    spark = tiles.sparkSession
    schema = "bi long, bj long, nr int, nc int, data array<double>"
    factor = spark.createDataFrame([], schema)

    def product(frame: pd.DataFrame) -> pd.DataFrame:
        """C -= A @ B.T over the tiles of one position."""
        first = frame.iloc[0]
        c = _as(first["data"], first["nr"], first["nc"]).copy()
        for row in frame.itertuples():
            if row.a is not None:
                c -= _as(row.a, row.nr, row.k) @ _as(row.b, row.nc, row.k).T
        return pd.DataFrame([(first["bi"], first["bj"], first["nr"], first["nc"], c.ravel())], columns=["bi", "bj", "nr", "nc", "data"])

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        """L_ij = C_ij @ inv(L_jj).T; the diagonal tile itself is factored."""
        row = frame.iloc[0]
        diagonal = np.linalg.cholesky(_as(row["d"], row["nc"], row["nc"]))
        found = diagonal if row["bi"] == row["bj"] else np.linalg.solve(diagonal, _as(row["data"], row["nr"], row["nc"]).T).T
        return pd.DataFrame([(row["bi"], row["bj"], row["nr"], row["nc"], found.ravel())], columns=["bi", "bj", "nr", "nc", "data"])

    for j in range(blocks):
        panel = tiles.filter((F.col("bj") == j) & (F.col("bi") >= j))
        left = factor.select("bi", F.col("bj").alias("k_at"), F.col("nc").alias("k"), F.col("data").alias("a"))
        top = factor.filter(F.col("bi") == j).select(F.col("bj").alias("k_at"), F.col("data").alias("b"))
        joined = panel.join(left, "bi", "left").join(top, "k_at", "left").select("bi", "bj", "nr", "nc", "data", "k", "a", "b")
        updated = written(joined.groupBy("bi", "bj").applyInPandas(product, schema))
        diagonal = updated.filter(F.col("bi") == j).select(F.col("data").alias("d"))
        solved = updated.crossJoin(F.broadcast(diagonal)).groupBy("bi", "bj").applyInPandas(solve, schema)  # one tile
        factor = written(factor.unionByName(solved))
    return factor


def untiled(tiles: DataFrame, size: int) -> DataFrame:
    """Tiles back to a row for each element."""
    flat = tiles.select("bi", "bj", "nc", F.posexplode("data").alias("p", "v"))
    i, j = F.col("bi") * size + F.floor(F.col("p") / F.col("nc")), F.col("bj") * size + F.col("p") % F.col("nc")
    return flat.select(i.cast("long").alias("i0"), j.cast("long").alias("i1"), "v")


def fft2(cells: DataFrame, shape: tuple[int, int], inverse: bool = False) -> DataFrame:
    """The unnormalised two-dimensional transform of ``i0``, ``i1``, ``re``, ``im``: along rows, then along columns.

    Each row, then each column, is one group; absent elements count as zero.
    """
    turn = np.fft.ifft if inverse else np.fft.fft

    def along(axis: int):
        n, other = shape[axis], f"i{1 - axis}"

        def run(frame: pd.DataFrame) -> pd.DataFrame:
            line = np.zeros(n, complex)
            line[frame[f"i{axis}"].to_numpy()] = frame["re"].to_numpy() + 1j * frame["im"].to_numpy()
            out = turn(line) * (n if inverse else 1)
            return pd.DataFrame({other: frame[other].iloc[0], f"i{axis}": np.arange(n), "re": out.real, "im": out.imag})[["i0", "i1", "re", "im"]]

        return run

    schema = "i0 long, i1 long, re double, im double"
    return cells.groupBy("i0").applyInPandas(along(1), schema).groupBy("i1").applyInPandas(along(0), schema)
