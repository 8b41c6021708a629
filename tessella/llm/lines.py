"""Repeated runs of lines, by a suffix array over line IDs.

Lines with a word become IDs, each document a sequence of them. Only lines that occur twice or more can lie in a
repeated run; the others, like the ends of documents, break the sequence. The suffixes of what remains are ranked by
distributed prefix doubling: a suffix's rank is its line ID and its place among the suffixes that begin with it, and
round k sorts the suffixes that agree in 2^k lines by the rank 2^k lines further on.

A run of ``min_words`` words has ``min_words`` lines at most, as every line has a word; so the ranks for
log2(min_words) rounds tell all such runs apart, in any corpus. The suffixes that share their first n lines are one
longest-common-prefix interval; for n between two powers of two the ranks of two overlapping prefixes name it. For
each line the shortest run of ``min_words`` words that starts there, and the one that ends there, are looked up in
that way; every maximal repeated run of as many words is the union of such runs. In each interval the first
occurrence in the corpus stays, the lines of the later ones are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, bound, saved, text_id, unused

MIN_WORDS = 50
_DOC = ("doc_id", "text_id")


def lines_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id``, ``text_id``, ``seq`` (among the lines with a word), ``pos`` (among all), ``line`` (ID), ``w``."""
    whole = F.coalesce(F.col(text), F.lit(""))
    numbered = F.filter(
        F.transform(F.split(whole, "\n"), lambda x, i: F.struct(i.alias("pos"), x.alias("x"))),
        lambda s: s["x"].rlike(r"[^\x20\x09-\x0D]"),
    )
    rows = docs.select("doc_id", F.xxhash64(whole).alias("text_id"), F.posexplode(numbered).alias("seq", "s")).distinct()
    count = F.size(F.array_remove(F.split("s.x", SPACES), ""))
    return rows.select(*_DOC, "seq", "s.pos", F.unhex(F.md5("s.x")).alias("line"), count.alias("w"))


def active_lines(lines: DataFrame) -> DataFrame:
    """The lines that occur twice or more; ``island`` numbers the unbroken stretches of them in a document."""
    # Saved, so that both sides of the join are plain shuffles: then Spark splits the rows of a very common line.
    repeated = saved(lines.groupBy("line").agg(F.count("*").alias("n")).filter("n > 1").select("line"))
    order = Window.partitionBy(*_DOC).orderBy("seq")
    return lines.join(repeated, "line").withColumn("island", F.col("seq") - F.row_number().over(order))


def double(ranked: DataFrame, k: int) -> DataFrame:
    """Adds ``off{k+1}``: the suffixes of one rank over 2^k lines, told apart by the rank 2^k lines further on."""
    ahead = Window.partitionBy(*_DOC, "island").orderBy("seq")
    off = f"off{k}"
    paired = saved(ranked.withColumns({"next": F.lead("line", 2**k).over(ahead), "next_off": F.lead(off, 2**k).over(ahead)}))
    ended = F.col("next").isNull()  # nothing follows: this suffix comes first and keeps its rank
    groups = paired.groupBy("line", off, "next", "next_off").agg(F.count("*").alias("n"))
    before = Window.partitionBy("line", off).orderBy(F.col("next").asc_nulls_first(), "next_off").rowsBetween(Window.unboundedPreceding, -1)
    placed = groups.withColumn("new", F.col(off) + F.coalesce(F.sum("n").over(before), F.lit(0))).filter("next is not null").drop("n")
    same = paired.filter(ended).withColumn("new", F.col(off))
    moved = paired.filter(~ended).join(placed, ["line", off, "next", "next_off"])
    return same.unionByName(moved).drop("next", "next_off").withColumnRenamed("new", f"off{k + 1}")


def _shortest(counts: Column, least: int) -> Column:
    """How many leading numbers add up to ``least``; null if all of them don't."""
    found = F.aggregate(
        counts,
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n")),
        lambda done, x: F.when(done["sum"] >= least, done).otherwise(F.struct((done["sum"] + x).alias("sum"), (done["n"] + 1).alias("n"))),
    )
    return F.when(found["sum"] >= least, found["n"])


def runs_of(active: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``start`` and ``length`` of the shortest runs of ``min_words`` words from each line on, and up to each."""
    order = Window.partitionBy(*_DOC, "island").orderBy("seq")
    onward = F.collect_list("w").over(order.rowsBetween(0, min_words - 1))
    back = F.reverse(F.collect_list("w").over(order.rowsBetween(1 - min_words, 0)))
    both = active.select(*_DOC, "seq", _shortest(onward, min_words).alias("f"), _shortest(back, min_words).alias("b"))
    ways = F.array(F.struct(F.col("seq").alias("start"), F.col("f").alias("length")), F.struct((F.col("seq") - F.col("b") + 1).alias("start"), F.col("b").alias("length")))
    return both.select(*_DOC, F.explode(ways).alias("r")).select(*_DOC, "r.*").filter("length is not null").distinct()


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text") -> DataFrame:
    """``doc_id``, ``text_id``, ``gone``: the positions of the lines to delete, where there are any."""
    active = saved(active_lines(saved(lines_of(docs, text))))
    runs = saved(runs_of(active, min_words))
    longest = runs.agg(F.max("length")).first()[0] or 1
    levels = longest.bit_length()
    ranked = active.select(*_DOC, "seq", "island", "line", F.lit(0).cast("long").alias("off0"))
    for k in range(levels - 1):
        ranked = double(ranked, k)
    ranks = saved(ranked.select(*_DOC, "seq", "line", F.array(*[f"off{k}" for k in range(levels)]).alias("offs")))

    level = F.floor(F.log2("length") + 1e-9).cast("int")
    runs = runs.withColumn("level", level).withColumn("second", F.expr("start + length - shiftleft(1, level)"))
    at = lambda name, n: ranks.select(*_DOC, F.col("seq").alias(name), F.col("line").alias(f"line{n}"), F.col("offs").alias(f"offs{n}"))
    safe = lambda x, y, name: x["doc_id"].eqNullSafe(y["doc_id"]) & (x["text_id"] == y["text_id"]) & (x[name] == y[name])
    one, two = at("start", 1), at("second", 2)
    named = runs.join(one, safe(runs, one, "start")).select(runs["*"], "line1", F.get("offs1", "level").alias("rank1"))
    named = named.join(two, safe(named, two, "second")).select(named["*"], "line2", F.get("offs2", "level").alias("rank2"))
    interval = ["length", "line1", "rank1", "line2", "rank2"]
    place = F.struct(F.col("doc_id").isNull().alias("u"), *_DOC, "start")
    named = saved(named.select(*interval, *_DOC, "start", place.alias("place")))
    first = named.groupBy(*interval).agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    first = saved(first)  # as above, for an interval with very many occurrences
    later = named.join(first, interval).filter(F.col("place") != F.col("first"))
    seqs = later.select(*_DOC, F.explode(F.expr("sequence(start, start + length - 1)")).alias("seq")).distinct()
    where = active.select(*_DOC, "seq", "pos")
    lost = seqs.join(where, safe(seqs, where, "seq")).select(seqs["doc_id"], seqs["text_id"], "pos")
    return lost.groupBy(*_DOC).agg(F.collect_set("pos").alias("gone"))


def dedup_lines(
    docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text", names: tuple[str, str] = ("n_lines", "n_removed")
) -> DataFrame:
    """The rows of ``docs`` without the lines of later copies, and ``n_lines``, ``n_removed`` (lines with a word).

    A run of lines is repeated if it has ``min_words`` words or more and occurs elsewhere, earlier in its own
    document included; the occurrence in the lowest ``doc_id`` (null last) and line stays. Lines without a word are
    ignored in runs and stay. Rows with equal ``doc_id`` and text are one document and all come back alike. A text
    that loses all lines becomes empty; null stays null. Columns of the names of the counts, ``names``, are replaced;
    all others come back, whatever their names.
    """
    docs = docs.drop(*names)
    gone_doc, gone_text, gone_at, own = unused(docs, "gone_doc", "gone_text", "gone", "text_hash")
    gone = saved(later_copies(docs, min_words, text))
    gone = gone.select(F.col("doc_id").alias(gone_doc), F.col("text_id").alias(gone_text), F.col("gone").alias(gone_at))
    keyed = docs.withColumn(own, text_id(text))
    joined = keyed.join(gone, keyed["doc_id"].eqNullSafe(F.col(gone_doc)) & (F.col(own) == F.col(gone_text)), "left")
    lines = F.split(F.col(text), "\n")
    cut = bound(
        lines,
        lambda x: F.array_join(
            F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(gone_at)), lambda i: F.get(x, i)), "\n"
        ),
    )
    worded = F.size(F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    return joined.select(
        *[F.when(F.col(gone_at).isNull(), F.col(c)).otherwise(cut).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns],
        F.when(F.col(text).isNull(), 0).otherwise(worded).cast("long").alias(names[0]),
        F.coalesce(F.size(gone_at), F.lit(0)).cast("long").alias(names[1]),
    )
