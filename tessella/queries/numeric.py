"""k-means, Cholesky and Fourier transforms over ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import clusters, linalg
from tessella.operators.grid import GridArray
from tessella.session import table

from . import query
from .arrays import CELLS, matrix

K = 3
_ROUND = """d{n} AS (SELECT e.vec_id, c.k, sum((e.x - c.x) * (e.x - c.x)) AS d FROM e JOIN c{n} c USING (j) GROUP BY ALL),
a{n} AS (SELECT vec_id, arg_min(k, d) AS k FROM (SELECT * FROM d{n} ORDER BY vec_id, k) GROUP BY vec_id),
c{m} AS (SELECT k, j, coalesce(m, c.x) AS x FROM c{n} c LEFT JOIN (SELECT k, j, avg(x) AS m FROM e JOIN a{n} USING (vec_id) GROUP BY ALL) USING (k, j))"""
_START = f"{CELLS}, c0 AS (SELECT vec_id AS k, j, x FROM e WHERE vec_id < {K})"


def points(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))
    return rows, rows.filter(F.col("id") < K).select(F.col("id").alias("k"), F.col("x").alias("c"))


@query(f"WITH {_START}, {_ROUND.format(n=0, m=1)} SELECT k, count(*) AS n FROM a0 GROUP BY k")
def kmeans_assign(spark, sf_dir) -> DataFrame:
    return clusters.assign(*points(spark, sf_dir)).groupBy("k").agg(F.count("*").alias("n"))


@query(f"WITH {_START}, {_ROUND.format(n=0, m=1)} SELECT k, CAST(j AS INTEGER) AS j, round(x, 6) AS x FROM c1")
def kmeans_update(spark, sf_dir) -> DataFrame:
    rows, centres = points(spark, sf_dir)
    moved = clusters.moved(rows, centres)
    return moved.select("k", F.posexplode("c").alias("j", "x")).select("k", "j", F.round("x", 6).alias("x"))


@query(f"WITH {_START}, {', '.join(_ROUND.format(n=n, m=n + 1) for n in range(5))} SELECT k, CAST(j AS INTEGER) AS j, round(x, 6) AS x FROM c5")
def kmeans_loop5(spark, sf_dir) -> DataFrame:
    centres, _ = clusters.kmeans(*points(spark, sf_dir), rounds=5)
    return centres.select("k", F.posexplode("c").alias("j", "x")).select("k", "j", F.round("x", 6).alias("x"))


@query(f"""WITH {_START}, {_ROUND.format(n=0, m=1)}, x AS (SELECT label, k, count(*) AS n FROM a0 JOIN embeddings USING (vec_id) GROUP BY ALL),
t AS (SELECT sum(n) AS t FROM x), hk AS (SELECT sum(-n / t * ln(n / m)) AS h FROM x JOIN (SELECT k, sum(n) AS m FROM x GROUP BY k) USING (k), t),
hl AS (SELECT sum(-m / t * ln(m / t)) AS h FROM (SELECT label, sum(n) AS m FROM x GROUP BY label), t) SELECT round(1 - hk.h / hl.h, 6) AS homogeneity FROM hk, hl""")
def homogeneity(spark, sf_dir) -> DataFrame:
    rows, centres = points(spark, sf_dir)
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    found = clusters.homogeneity(clusters.assign(rows, centres).join(labels, "id").select("label", "k"))
    return found.select(F.round("homogeneity", 6).alias("homogeneity"))


def factored(spark, sf_dir) -> tuple[GridArray, GridArray]:
    """I + EᵀE and its lower factor."""
    e = matrix(spark, sf_dir)
    gram = e.transpose().matmul(e).map(lambda v: v + F.when(F.col("i0") == F.col("i1"), 1.0).otherwise(0.0))
    lower = linalg.untiled(linalg.cholesky(gram.tiles(16), 4), 16)
    return gram, GridArray(lower, (64, 64), F.col("v"))


@query("SELECT 64 AS n, true AS exact")
def cholesky_blocked(spark, sf_dir) -> DataFrame:
    """The factor of I + EᵀE, checked against it."""
    gram, factor = factored(spark, sf_dir)
    gap = factor.matmul(factor.transpose()).apply("-", gram)
    return gap.frame().agg(F.sqrt(F.count("*")).cast("int").alias("n"), (F.max(F.abs("v")) < 1e-8).alias("exact"))


@query(f"""WITH {CELLS} SELECT a.j AS i0, b.j AS i1, round(sum(a.x * b.x) + CASE WHEN a.j = b.j THEN 1 ELSE 0 END, 4) + 0 AS v, CAST(2080 AS BIGINT) AS lower
FROM e a JOIN e b USING (vec_id) GROUP BY a.j, b.j""")
def cholesky_product(spark, sf_dir) -> DataFrame:
    """The factor times its transpose, which gives the matrix again; and its 64 * 65 / 2 cells that may differ from zero."""
    _, factor = factored(spark, sf_dir)
    kept = factor.frame().filter("i0 >= i1 or v <> 0").agg(F.count("*").alias("lower"))
    product = factor.matmul(factor.transpose()).frame().crossJoin(F.broadcast(kept))  # one row
    return product.select("i0", "i1", (F.round("v", 4) + 0.0).alias("v"), "lower")


_FOLDED = "c AS (SELECT vec_id % 8 AS r, j % 8 AS c, sum(x) AS x FROM (SELECT vec_id, unnest(range(0, 64)) AS j, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY 1, 2)"


def folded(spark, sf_dir) -> DataFrame:
    """Sums of all elements by place modulo 8: 8 x 8 cells that every row feeds."""
    e = matrix(spark, sf_dir).frame()
    return e.groupBy((F.col("i0") % 8).alias("i0"), (F.col("i1") % 8).alias("i1")).agg(F.sum("v").alias("re")).withColumn("im", F.lit(0.0))


@query(f"""WITH {_FOLDED} SELECT CAST(k AS BIGINT) AS i0, CAST(l AS BIGINT) AS i1, round(sum(x * cos(-2 * pi() * (k * r + l * c) / 8)), 4) + 0 AS re, round(sum(x * sin(-2 * pi() * (k * r + l * c) / 8)), 4) + 0 AS im
FROM c, range(8) a(k), range(8) b(l) GROUP BY 1, 2""")
def fft2_small(spark, sf_dir) -> DataFrame:
    found = linalg.fft2(folded(spark, sf_dir), (8, 8))
    return found.select("i0", "i1", (F.round("re", 4) + 0.0).alias("re"), (F.round("im", 4) + 0.0).alias("im"))


@query(f"WITH {_FOLDED} SELECT CAST(r AS BIGINT) AS i0, CAST(c AS BIGINT) AS i1, round(64 * x, 4) + 0 AS re, CAST(0 AS DOUBLE) AS im FROM c")
def fft2_inverse(spark, sf_dir) -> DataFrame:
    """There and back, neither way normalised: the cells times their number."""
    found = linalg.fft2(linalg.fft2(folded(spark, sf_dir), (8, 8)), (8, 8), inverse=True)
    return found.select("i0", "i1", (F.round("re", 4) + 0.0).alias("re"), (F.round("im", 4) + 0.0).alias("im"))


@query("""WITH e AS (SELECT vec_id, unnest(range(0, 64)) AS j, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
c AS (SELECT a.j AS r, b.j AS c, sum(a.x * b.x) AS x FROM e a JOIN e b USING (vec_id) GROUP BY 1, 2)
SELECT k AS i0, l AS i1, round(sum(x * cos(-2 * pi() * (k * r + l * c) / 64)), 4) + 0 AS re, round(sum(x * sin(-2 * pi() * (k * r + l * c) / 64)), 4) + 0 AS im
FROM c, range(64) a(k), range(64) b(l) GROUP BY 1, 2""")
def fft2_gram(spark, sf_dir) -> DataFrame:
    """The transform of EᵀE, which every row feeds."""
    e = matrix(spark, sf_dir)
    cells = e.transpose().matmul(e).frame().select("i0", "i1", F.col("v").alias("re"), F.lit(0.0).alias("im"))
    found = linalg.fft2(cells, (64, 64))
    return found.select("i0", "i1", (F.round("re", 4) + 0.0).alias("re"), (F.round("im", 4) + 0.0).alias("im"))
