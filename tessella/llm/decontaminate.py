"""Benchmark passages in documents, by a prefix-filtered set join.

Each benchmark item is cut into windows of consecutive words. A window occurs only where all its shingles do, so one
of them is enough to look for; the join takes the rarest in the corpus, the first in rarity order. A document's
shingles meet those needed ones with their positions: position and offset give where the window would start, which
must lie inside the document (positional and length bound). What is left is verified word by word. Hits become
intervals of words, and their union is counted by a sweep over each document's sorted starts.

Rarity is counted over all documents. It only orders the shingles; results do not depend on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, NOT_ALNUM, UPPER, saved, words_of

#: Words of a window, and of a shingle.
WINDOW, SHINGLE = 10, 3
_DOC = ("doc_id", "text_id")
#: Bytes of the tables of windows and of their shingles up to which they are sent to all executors. Larger ones are
#: shuffled, and then a document's shingles go without its words, which are fetched for what is to be verified.
BROADCAST_BYTES = 32 << 20


def _shingle(words: Column, at: Column, n: int) -> Column:
    """A hash of n lower-cased words. Full lower-casing only merges what A-Z lower-casing keeps apart."""
    return F.xxhash64(*[F.lower(F.get(words, at + i)) for i in range(n)])


def windows_of(items: DataFrame, size: int = WINDOW, text: str = "text") -> DataFrame:
    """``item_id``, ``window``: each run of ``size`` words; all the words of an item that has fewer."""
    words = items.select("item_id", words_of(F.translate(text, UPPER, LOWER), NOT_ALNUM).alias("words"))
    words = words.filter(F.size("words") > 0)
    last = F.greatest(F.size("words") - size, F.lit(0))
    starts = words.select("item_id", "words", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    return starts.select("item_id", F.slice("words", F.col("at") + 1, F.lit(size)).alias("window")).distinct()


def shingles_of(docs: DataFrame, n: int) -> DataFrame:
    """Adds ``at`` and ``shingle`` for each run of n words of ``words``."""
    at = F.explode(F.when(F.size("words") >= n, F.sequence(F.lit(0), F.size("words") - n)))
    return docs.withColumn("at", at).withColumn("shingle", _shingle(F.col("words"), F.col("at"), n))


def _frequency(texts: DataFrame, parts: DataFrame, n: int, small: bool) -> DataFrame:
    """``shingle``, ``df``: how often each shingle of the windows occurs in all documents."""
    vocabulary = parts.select("shingle").distinct()
    cut = shingles_of(texts, n).select("shingle")
    if small:
        return cut.join(F.broadcast(vocabulary), "shingle").groupBy("shingle").agg(F.count("*").alias("df"))
    return cut.groupBy("shingle").agg(F.count("*").alias("df")).join(vocabulary, "shingle")


def _verified(texts: DataFrame, needed: DataFrame, n: int, small: bool) -> DataFrame:
    """Occurrences ``doc_id``, ``text_id``, ``window_id``, ``start``, ``length`` of the windows of ``needed``."""
    start = F.col("at") - F.col("offset")
    inside = (start >= 0) & (start + F.col("length") <= F.col("n_words"))
    there = F.translate(F.array_join(F.slice("words", F.col("start") + 1, F.col("length")), " "), UPPER, LOWER) == F.col("phrase")
    cut = shingles_of(texts, n).withColumn("n_words", F.size("words"))
    if small:  # compiles into the stage that cuts the shingles: a row leaves it, without words, when verified
        found = cut.join(F.broadcast(needed), "shingle").filter(inside).withColumn("start", start).filter(there)
    else:
        # One key without nulls for rows of equal id: the words are shuffled once, for the copies and for the join.
        key = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit(""))
        met = cut.select(key.alias("key"), "text_id", "at", "shingle", "n_words").join(needed, "shingle").filter(inside)
        met = met.select("key", "text_id", "window_id", start.alias("start"), "length", "phrase").distinct()
        own = texts.withColumn("key", key).dropDuplicates(["key", "text_id"])
        found = met.join(own, ["key", "text_id"]).filter(there)
    return found.select(*_DOC, "window_id", "start", "length")


def contamination(
    docs: DataFrame, items: DataFrame, size: int = WINDOW, text: str = "text", broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated``.

    A word is hit if it lies inside an occurrence of a window. Null and wordless texts have no words and no hits;
    null and wordless items have no windows. A null ``item_id`` contaminates but is not counted or listed among the
    items. Rows that share ``doc_id`` and text have equal results; other rows never share hits.
    """
    return contamination_by_text(docs, items, size, text, broadcast_bytes).drop("text_id")


def contamination_by_text(
    docs: DataFrame, items: DataFrame, size: int = WINDOW, text: str = "text", broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """``contamination`` with ``text_id``, which tells the texts of one ``doc_id`` apart."""
    windows = windows_of(items, size)
    distinct = saved(
        windows.select("window").distinct().withColumn("window_id", F.xxhash64("window"))
    )
    whole = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select("doc_id", F.xxhash64(whole).alias("text_id"), whole.alias("whole"))
    base = keyed.select("doc_id", "text_id", F.size(words_of(F.col("whole"), NOT_ALNUM)).cast("long").alias("n_words"))
    texts = keyed.select("doc_id", "text_id", words_of(F.col("whole"), NOT_ALNUM).alias("words"))
    # A row of ``needed`` holds a window's words and a few numbers; the vocabulary has 8 bytes for each shingle.
    held = F.sum(F.octet_length(F.array_join("window", " ")) + 64 + 16 * F.size("window"))
    counts = distinct.groupBy(F.least(F.size("window"), F.lit(SHINGLE)).alias("n")).agg(held.alias("bytes")).collect()
    small = sum(row["bytes"] for row in counts) <= broadcast_bytes

    hits = None
    for n in sorted(row["n"] for row in counts):  # 3, and 1 or 2 if an item is that short
        held = distinct.filter(F.least(F.size("window"), F.lit(SHINGLE)) == n)
        parts = held.select(
            "window_id",
            "window",
            F.size("window").alias("length"),
            F.array_join("window", " ").alias("phrase"),
            F.explode(F.sequence(F.lit(0), F.size("window") - n)).alias("offset"),
        ).withColumn("shingle", _shingle(F.col("window"), F.col("offset"), n))
        frequency = _frequency(texts, parts, n, small)
        ranked = parts.join(frequency, "shingle", "left").groupBy("window_id").agg(
            F.min_by(F.struct("shingle", "offset", "length", "phrase"), F.struct(F.coalesce("df", F.lit(0)), "shingle", "offset")).alias("r")
        )
        needed = saved(ranked.select("window_id", "r.*"))
        met = _verified(texts, needed, n, small)
        hits = met if hits is None else hits.unionByName(met)
    if hits is None:
        hits = base.select("doc_id", "text_id", *[F.lit(0).alias(c) for c in ("window_id", "start", "length")]).limit(0)
    hits = saved(hits.distinct())

    before = Window.partitionBy("doc_id", "text_id").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    new = F.greatest(end - F.greatest("start", F.coalesce(F.max(end).over(before), F.lit(0))), F.lit(0))
    covered = (
        hits.select("doc_id", "text_id", "start", "length").distinct()
        .withColumn("new", new).groupBy("doc_id", "text_id").agg(F.sum("new").cast("long").alias("n_hit"))
    )
    named = windows.select("item_id", F.xxhash64("window").alias("window_id"))
    found = hits.select("doc_id", "text_id", "window_id").distinct().join(named, "window_id")
    listed = found.groupBy("doc_id", "text_id").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    result = covered.alias("c").join(
        listed.alias("l"), F.col("c.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.col("c.text_id") == F.col("l.text_id"))
    ).select(F.col("c.doc_id").alias("hit_id"), F.col("c.text_id").alias("hit_text"), "n_hit", "items")
    joined = base.join(result, base["doc_id"].eqNullSafe(F.col("hit_id")) & (base["text_id"] == F.col("hit_text")), "left")
    items_hit = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "doc_id",
        "text_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items_hit).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_hit, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
