"""Shards of bounded size by extendible hashing.

Documents are hashed by key. The directory begins with one bucket, of no hash bits; only a bucket over the byte limit
is split on the next bit, until every bucket fits. Instead of splitting documents again and again, their bytes are
summed once per cell, a long hash prefix, and the directory is found on those sums: a cell's bucket is its shortest
prefix that fits. Cells that don't fit themselves are cut finer in further rounds, they alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import int_div
from tessella.operators.positions import running_sum

from .common import saved, text_id, unused

#: Hash bits in all, and bits that a further round adds.
BITS, STEP = 60, 10
LIMIT = 1 << 20


def hash_bits(key: Column, text: Column) -> Column:
    """60 bits of the md5 of the key as text. Rows without a key are spread by the md5 of their text in its place."""
    digest = F.md5(F.coalesce(key.cast("string"), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long")


def _directory(cells: DataFrame, above: int, depth: int, limit: int) -> DataFrame:
    """For each ``cell`` of ``depth`` bits: ``at``, the least depth over ``above`` whose bucket fits; else null.

    A bucket of one document fits in any case: it can't be split. The directory's buckets are the fitting ones below a
    bucket that doesn't fit. They share out the hash space, so one prefix of a cell at most is among them.
    """
    deeper = F.explode(F.sequence(F.lit(above), F.lit(depth)))
    spread = cells.withColumn("at", deeper).withColumn("prefix", F.expr(f"shiftright(cell, {depth} - at)"))
    totals = spread.groupBy("at", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_n"))
    totals = saved(totals.filter((F.col("shard_bytes") <= limit) | (F.col("shard_n") == 1)))
    fitting = totals.select((F.col("at") + 1).alias("at"), F.col("prefix").alias("parent"))
    buckets = totals.withColumn("parent", F.shiftright("prefix", 1)).join(fitting, ["at", "parent"], "left_anti")
    of = spread.select("cell", "at", "prefix").join(buckets.select("at", "prefix", "shard_bytes"), ["at", "prefix"])
    return cells.select("cell").join(of, "cell", "left").select("cell", "at", "prefix", "shard_bytes")


def assign(docs: DataFrame, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes``, ``shard`` (its hash bits as 0 and 1), ``depth``, ``shard_bytes``, ``fits``.

    A null text has no bytes; rows with a null key are hashed by their texts. ``fits`` is false only for a document
    that alone exceeds the limit; it is a shard by itself. Documents beyond the limit that share all hash bits
    (repeated keys) are dealt to chained shards ``bits-class-page``, filled in the order of sizes and ids: the same
    rows give the same shards, however they are partitioned. One row comes out for each row.
    """
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
    rows = saved(docs.select("doc_id", size.alias("n_bytes"), hash_bits(F.col(key), F.col(text)).alias("h")))
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    depth = min(24, max(1, (64 * total // limit + 1).bit_length()))  # cells of about a 64th of the limit
    above, rest, placed = 0, rows, []
    while True:
        celled = rest.withColumn("cell", F.shiftright("h", BITS - depth))
        cells = saved(celled.groupBy("cell").agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("n")))
        directory = saved(_directory(cells, above, depth, limit))
        done = celled.join(directory.filter("at is not null"), "cell")
        placed.append(
            done.select("doc_id", "n_bytes", F.when(F.col("at") == 0, "").otherwise(F.lpad(F.bin("prefix"), F.col("at"), "0")).alias("shard"), F.col("at").alias("depth"), "shard_bytes")
        )
        over = directory.filter("at is null").select("cell")
        if over.isEmpty():
            break
        rest = saved(celled.join(over, "cell").select("doc_id", "n_bytes", "h"))
        if depth == BITS:
            placed.append(_chained(rest, limit))
            break
        above, depth = depth + 1, min(BITS, depth + STEP)
    result = placed[0]
    for more in placed[1:]:
        result = result.unionByName(more)
    return result.withColumn("fits", F.col("shard_bytes") <= limit)


def _chained(rows: DataFrame, limit: int) -> DataFrame:
    """Pages of at most ``limit`` bytes for rows of equal hash.

    Class 0 has the rows over half the limit, a page each; class c up to 3 those of at most limit >> c bytes. A page
    holds the rows that begin in a stretch of limit - (limit >> c) bytes, so none exceeds the limit and those of small
    rows are filled to seven eighths. Sums run over ranges of rows: one hash may have any number of them.
    """
    kind = F.lit(0)
    for c in (1, 2, 3):
        kind = F.when(F.col("n_bytes") <= limit >> c, c).otherwise(kind)
    rows = running_sum(rows.withColumn("class", kind), F.col("n_bytes"), "n_bytes", "doc_id", name="bytes", by=["h", "class"])
    rows = running_sum(rows, F.lit(1), "n_bytes", "doc_id", name="rows", by=["h", "class"])
    before, page = F.col("bytes") - F.col("n_bytes"), F.col("rows") - 1
    for c in (1, 2, 3):
        page = F.when(F.col("class") == c, int_div(before, max(1, limit - (limit >> c)))).otherwise(page)
    filled = rows.withColumn("shard", F.concat_ws("-", F.lpad(F.bin("h"), BITS, "0"), F.col("class").cast("string"), page.cast("string")))
    totals = filled.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"))
    return filled.join(totals, "shard").select("doc_id", "n_bytes", "shard", F.lit(BITS).alias("depth"), "shard_bytes")


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> None:
    """Writes the documents as Parquet, one folder ``shard=...`` for each shard, each by one task.

    Rows that share a key go to the first of its chained shards, if it has several. A column called ``shard`` is
    replaced by the shard, and so must not be the key.
    """
    docs = docs.drop("shard")
    own = unused(docs, "shard_key")[0]
    # The key, or the text where there is none, is what the hash is of.
    named = F.struct(F.col(key).alias("k"), F.when(F.col(key).isNull(), text_id(text)).alias("t"))
    shards = assign(docs.select(named.alias("doc_id"), F.col(key).alias("key"), F.col(text).alias("text")), limit, "key")
    shards = shards.groupBy(F.col("doc_id").alias(own)).agg(F.min("shard").alias("shard"))
    placed = docs.join(shards, named.eqNullSafe(F.col(own))).drop(own)
    placed.repartition("shard").write.partitionBy("shard").parquet(path)
