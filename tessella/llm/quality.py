"""Quality rules as a ledger of failure bits.

Each document is measured once. Every rule is evaluated once on those measurements and sets its bit in ``failures``
where it fails; the ledger keeps bits and measurements. A policy is a version and a mask of rules: it keeps the
documents with no failed rule in its mask, so that another policy, or dropping a rule from one, is arithmetic on the
ledger and never reads the texts again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, words_of

SYMBOLS = r"[#*$%&|<>]"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")


def rules() -> dict[str, Column]:
    """Failure conditions by name, in the order of their bits."""
    n = {m: F.col(m) for m in MEASURES}
    return {
        "few_words": n["n_words"] < 50,
        "repeated_words": 100 * n["n_repeat_words"] > 50 * n["n_words"],
        "symbols": 20 * n["n_symbols"] > n["word_chars"],
        "repeated_lines": (n["n_lines"] >= 4) & (2 * n["n_dup_lines"] > n["n_lines"]),
        "capitals": 2 * n["n_capitals"] > n["word_chars"],
        "long_words": n["word_chars"] > 20 * n["n_words"],
        "short_words": n["word_chars"] < 2 * n["n_words"],
    }


#: Rules of each policy version. A version never changes; a new one is added.
POLICIES = {
    1: ("few_words", "repeated_words"),
    2: ("few_words", "repeated_words", "symbols", "repeated_lines", "capitals", "long_words", "short_words"),
}
BASE, CURRENT = 1, 2


def mask(version: int) -> int:
    names = list(rules())
    return sum(1 << names.index(name) for name in POLICIES[version])


def _windows(words: Column, width: int) -> Column:
    """The windows of ``width`` words as (hash of the words, position), sorted, so that equal ones are neighbours."""
    window = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)])
    last = F.size(words) - width
    starts = F.when(last >= 1, F.sequence(F.lit(0), last))
    return F.sort_array(F.transform(starts, lambda i: F.struct(window(i).alias("h"), i.alias("p"))))


def _covered(windows: Column, width: int) -> Column:
    """Words in windows that equal a neighbour: their sorted positions are walked, adding what each newly covers."""
    equals = lambda x, i: F.coalesce(x["h"] == F.get(windows, i)["h"], F.lit(False))
    again = F.filter(windows, lambda x, i: equals(x, i - 1) | equals(x, i + 1))
    return F.aggregate(
        F.sort_array(F.transform(again, lambda x: x["p"])),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda done, p: F.struct(
            (done["n"] + p + width - F.greatest(p, done["end"])).alias("n"), (p + width).alias("end")
        ),
        lambda done: done["n"],
    )


def _repeat_words(words: Column, width: int = 3) -> Column:
    """How many words lie in a window of ``width`` words that the text has twice or more."""
    found = bound(words, lambda w: bound(_windows(w, width), lambda o: _covered(o, width)))
    return F.coalesce(found, F.lit(0)).cast("long")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents' ``doc_id`` and measurements. Null texts have no words, lines or characters."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    held = docs.select(
        "doc_id",
        words_of(whole).alias("words"),
        lines.alias("lines"),
        (F.length(whole) - F.length(F.regexp_replace(whole, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length(whole) - F.length(F.regexp_replace(whole, "[A-Z]+", ""))).cast("long").alias("n_capitals"),
    )
    return held.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        "n_capitals",
    )


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id``, the measurements, and ``failures``: bit i is set where rule i fails. One row for each row."""
    bits = F.lit(0).cast("long")
    for i, failed in enumerate(rules().values()):
        bits = bits.bitwiseOR(F.when(failed, F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measured(docs, text).withColumn("failures", bits)


def passes(version: int) -> Column:
    """True where a ledger row keeps its document under a policy."""
    return F.col("failures").bitwiseAND(F.lit(mask(version))) == 0


def apply_policy(entries: DataFrame, version: int = CURRENT) -> DataFrame:
    """The ledger with ``base_failed`` (the base policy's verdict) and ``kept`` (that of ``version``)."""
    return entries.withColumns({"base_failed": ~passes(BASE), "kept": passes(BASE) & passes(version)})


def ablations(entries: DataFrame, version: int = CURRENT) -> DataFrame:
    """For each rule of a policy: ``rule``, ``failed`` documents, and those ``only_this`` rule rejects.

    One row for each pattern of failure bits is all that is shuffled, whatever the number of documents.
    """
    inside = F.col("failures").bitwiseAND(F.lit(mask(version)))
    patterns = entries.groupBy(inside.alias("bits")).agg(F.count("*").alias("n"))
    names = list(rules())
    bits = F.explode(
        F.array(*[F.struct(F.lit(x).alias("rule"), F.lit(1 << names.index(x)).cast("long").alias("bit")) for x in POLICIES[version]])
    )
    of = patterns.select("bits", "n", bits.alias("r")).select("bits", "n", "r.*")
    return of.groupBy("rule").agg(
        F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n"))), F.lit(0)).alias("failed"),
        F.coalesce(F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n"))), F.lit(0)).alias("only_this"),
    )


def keep_good(docs: DataFrame, version: int = CURRENT, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that a policy keeps, with all their columns.

    The ledger is computed beside the row itself, so nothing is joined or shuffled.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    entries = ledger(docs.select(row.alias("doc_id"), F.col(text).alias("text")))
    return apply_policy(entries, version).filter("kept").select("doc_id.*")
