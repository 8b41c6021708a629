"""From raw documents to token digests: quality rules, line dedup, near dedup, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the columns they came with; the last
returns a row of digests for each document left.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, decontaminate, lines, quality, simhash
from tessella.llm.common import checkpoint_folder, saved, table, text_id, unused


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the current policy rejects; null and empty texts are rejected as too short.

    Rows are judged one by one: null ids and repeated rows make no difference, and other columns are kept.
    """
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of repeated runs of lines; documents that lose their last word that way go.

    Null and empty texts stay as they are. A null id comes after all others; rows with equal id and text are one
    document and lose the same lines. ``n_chars``, if there, is counted anew where lines go; other columns are kept.
    """
    kept, removed = unused(docs, "n_lines", "n_removed")
    cut = lines.dedup_lines(docs, names=(kept, removed))
    cut = cut.filter((F.col(removed) == 0) | (F.col(removed) < F.col(kept)))
    changed = {}
    if "n_chars" in docs.columns:
        counted = F.length("text").cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(F.col(removed) > 0, counted).otherwise(F.col("n_chars"))
    return cut.withColumns(changed).select(*[F.col(f"`{c}`") for c in docs.columns])


def _rows(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """The rows of ``docs`` with, or without, an entry of their own ``doc_id`` and text in ``found``."""
    doc, text = unused(docs, "doc", "text_hash")
    keys = found.select(F.col("doc_id").alias(doc), F.col("text_id").alias(text)).distinct()
    return docs.join(keys, docs["doc_id"].eqNullSafe(F.col(doc)) & (text_id() == F.col(text)), how)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each near-duplicate component: the lowest ``doc_id`` (null last), then text hash.

    Of rows that repeat that id and text the one with the lowest hash of all its columns stays. Texts without words,
    null ones included, are near duplicates of each other. Other columns are kept, whatever their names.
    """
    found = saved(simhash.surplus(docs))
    kept = _rows(docs, found, "left_anti")
    repeated = found.filter("first")
    if repeated.isEmpty():
        return kept
    # The aggregate keeps one row per task and key before the shuffle, however often a row is repeated.
    same = _rows(docs, repeated, "left_semi").groupBy("doc_id", text_id().alias("_text_id"))
    own = [F.col(f"`{c}`") for c in docs.columns]
    one = same.agg(F.min_by(F.struct(*own), F.xxhash64(*own)).alias("_row"))
    return kept.unionByName(one.select("_row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows whose own text holds a window of a benchmark item.

    Null and empty texts hold none and stay. Other rows of the same id stay, as do all columns.
    """
    found = decontaminate.contamination_by_text(docs, table(spark, sf_dir, "benchmark"))
    return _rows(docs, found.filter("contaminated"), "left_anti")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes what is left and checks the way back: counts and digests of ids and decoded bytes."""
    return bpe.round_trip(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("tokens", tokens),
]
#: XXH64 fingerprints and BPE merges have no SQL; tests compare the run with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each on the Parquet that the one before it wrote to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
