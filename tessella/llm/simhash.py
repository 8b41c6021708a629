"""Near-duplicate documents by SimHash fingerprints and pivot distance tables.

1. A fingerprint for each document: of all hashes of its word shingles, repeats included, a bit is 1 if it is set in
   over half. Documents with one fingerprint become one row, so copies cost nothing from here on.
2. Fingerprints are dealt to blocks: the bits form ``k + s`` groups, so that fingerprints within k bits agree on s
   groups at least; each choice of s groups is a block key. s grows with the number of fingerprints, so that the
   expected number of chance meetings stays in proportion to it.
3. What meets another in a block gets its row of the pivot table: its Hamming distances to fixed reference
   fingerprints. By the triangle inequality two fingerprints within k bits differ by k at most in every coordinate;
   every pair below is discarded by its largest coordinate difference or else verified.
4. The member of a block with the lowest fingerprint serves as a pivot from the data: each member within k bits of it
   is linked to it. That joins dense groups without their pairs. Blocks whose members are all connected are done. In
   the others the members outside the largest connected part meet all members that aren't known to be connected.
5. A block with many members outside its largest part is dealt again first, by groups of other bits, until none is
   crowded or its bits are used up. That changes which pairs are compared, never which links are found.
6. Components of the links by minimum labels and pointer jumping, on tables that stay distributed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, saved, text_id, written

BITS, SEED = 64, 42
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Reference fingerprints: hashes of the numbers from 0 on, eight coordinates to a packed word.
PIVOTS, PACKED = 16, 8
#: Members outside a block's largest connected part from which on it is dealt again, and how often that is done. Both
#: only say how pairs are found: a block that is still crowded then is compared as it is.
CROWD, ROUNDS = 1024, 4


def pieces(raw: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text, those of about ``size`` bytes at a time."""
    start = 0
    while start < len(raw):
        space = _SPACE.search(raw, start + size)
        end = space.start() if space else len(raw)
        yield raw[start:end].split()
        start = end


def fingerprint(text: str, width: int = 4, size: int = 1 << 20) -> int:
    """The SimHash of a text's word shingles as an unsigned number; 0 without words. ``size`` bounds memory."""
    ones, count, held = np.zeros(BITS, np.int64), 0, []
    for words in pieces(text.encode().lower(), size):
        held += words
        shingles = [b" ".join(held[i : i + width]) for i in range(len(held) - width + 1)]
        held = held[len(shingles) :]
        count += len(shingles)
        ones += _ones(shingles)
    if not count and held:  # fewer words than a shingle
        count, ones = 1, _ones([b" ".join(held)])
    return sum(1 << i for i in np.flatnonzero(2 * ones > count).tolist())


def _ones(shingles: list[bytes]) -> np.ndarray:
    """How many of the shingles' hashes have each bit set."""
    hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], "<u8")
    ones = np.zeros(BITS, np.int64)
    for some in np.array_split(hashes, len(hashes) // 4096 + 1):
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return ones


def fingerprints(docs: DataFrame, width: int = 4, text: str = "text") -> DataFrame:
    """``doc_id``, ``fp``: the fingerprint as a signed long."""

    def score(texts: list[str]) -> list[list]:
        return [[f - (1 << BITS) if f >> (BITS - 1) else f for f in (fingerprint(t, width) for t in texts)]]

    return map_texts(docs, score, ["fp long"], text=text)


def pivots(n: int = PIVOTS) -> list[int]:
    found = [xxhash.xxh64_intdigest(str(i), SEED) for i in range(n)]
    return [f - (1 << BITS) if f >> (BITS - 1) else f for f in found]


def pivot_table(fps: DataFrame, fp: str = "fp", prefix: str = "", n: int = PIVOTS) -> DataFrame:
    """Adds the distances of ``fp`` to the n references, packed as bytes of the longs ``t0``, ``t1``, ..."""
    distances = [F.bit_count(F.col(fp).bitwiseXOR(F.lit(p))).cast("long") for p in pivots(n)]
    packed = {}
    for i in range(0, n, PACKED):
        word = F.lit(0).cast("long")
        for j, d in enumerate(distances[i : i + PACKED]):
            word = word.bitwiseOR(F.shiftleft(d, 8 * j))
        packed[f"{prefix}t{i // PACKED}"] = word
    return fps.withColumns(packed)


def within(a: str, b: str, k: int, n: int = PIVOTS) -> Column:
    """No coordinate differs by more than k: a necessary condition for k differing bits."""
    met = F.lit(True)
    for i in range(n):
        x, y = (
            F.shiftrightunsigned(F.col(f"{side}t{i // PACKED}"), 8 * (i % PACKED)).bitwiseAND(F.lit(127)) for side in (a, b)
        )
        met = met & (F.abs(x - y) <= k)
    return met


def agreeing_groups(n: int, k: int) -> int:
    """How many groups of bits must agree, so that n random fingerprints meet by chance about n times at most."""
    for agreed in range(1, 6):
        keys, width = comb(k + agreed, agreed), BITS * agreed // (k + agreed)
        if keys * n <= 2 << width:
            break
    return agreed


def splitting_groups(n: int, k: int, free: int, crowd: int) -> int:
    """How many groups must agree, so that n members of a block with ``free`` bits left fall to blocks of a quarter crowd."""
    return next((s for s in range(1, 5) if 4 * n >> free * s // (k + s) <= crowd), 5)


def block_keys(k: int, agreed: int, turn: int = 0) -> list[int]:
    """A mask of bits for each choice of ``agreed`` among ``k + agreed`` groups of bits; ``turn`` groups others together."""
    groups, step = k + agreed, (1, 13, 29, 43, 55)[turn % 5]  # odd, so that bit i * step of 64 is another for each i
    edges = [BITS * i // groups for i in range(groups + 1)]
    masks = [sum(1 << i * step % BITS for i in range(edges[g], edges[g + 1])) for g in range(groups)]
    found = [sum(masks[i] for i in chosen) for chosen in combinations(range(groups), agreed)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in found]


def dealt(rows: DataFrame, masks: list[int]) -> DataFrame:
    """Each row once for each of the masks, in the block that its bits under ``mask`` and those name."""
    more = F.explode(F.array(*[F.lit(m).cast("long") for m in masks]))
    at = rows.withColumn("more", more).withColumn("mask", F.col("mask").bitwiseOR(F.col("more"))).drop("more")
    return at.withColumn("part", F.col("fp").bitwiseAND(F.col("mask")))


def components(links: DataFrame) -> DataFrame:
    """The connected components of links ``a``, ``b``: each node with the smallest one in its component, as ``label``.

    Rounds of taking the lowest label among the neighbours, then the label of the label, until nothing changes. Their
    joins are merged, so that no table passes the driver once a round. What a round has heard is written, so that the
    hop joins two plain shuffles, of which a very common label is split over tasks.
    """
    both = saved(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        heard = both.join(labels.withColumnRenamed("node", "b").hint("merge"), "b").groupBy("a").agg(F.min("label").alias("heard"))
        lower = labels.join(heard.hint("merge"), labels["node"] == heard["a"])
        lower = written(lower.select("node", "label", F.least("label", "heard").alias("new")))
        hop = lower.select(F.col("node").alias("new"), F.col("new").alias("hop"))
        after = lower.join(hop.hint("merge"), "new").select("node", F.col("label").alias("old"), F.least("new", "hop").alias("label"))
        after = written(after)
        labels = after.select("node", "label")
        if after.filter("old <> label").isEmpty():
            return labels


_BLOCK = ["mask", "part"]


def _stars(shared: DataFrame, k: int) -> DataFrame:
    """Links of the members of each block to its lowest one, ``head``, where they are within k bits of it."""
    both = pivot_table(shared.select("fp", "t0", "t1", F.col("head").alias("a_fp")), "a_fp", "a_")
    near = (F.col("fp") != F.col("a_fp")) & within("", "a_", k) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("a_fp"))) <= k)
    return both.filter(near).select(F.col("fp").alias("a"), F.col("a_fp").alias("b"))


def _open(members: DataFrame, exploded: bool = False) -> DataFrame:
    """Members of blocks that hold several labels, with the block's commonest, ``major``, and how many have ``others``.

    Members that were ``exploded`` are merged: Spark takes them for as many rows as there were before, and would send
    them all through the driver.
    """
    counts = members.groupBy(*_BLOCK, "label").agg(F.count("*").alias("n"))
    blocks = counts.groupBy(*_BLOCK).agg(
        F.max_by("label", F.struct("n", "label")).alias("major"), (F.sum("n") - F.max("n")).alias("others")
    )
    blocks = blocks.filter("others > 0")
    return members.join(blocks.hint("merge") if exploded else blocks, _BLOCK)


def _pairs(opened: DataFrame, k: int) -> DataFrame:
    """Links ``a``, ``b`` between labels, from the pairs of each block within k bits of each other."""
    x = opened.select(*_BLOCK, *[F.col(c).alias(f"x_{c}") for c in ("fp", "t0", "t1", "label")])
    y = opened.filter("label <> major").select(*_BLOCK, *[F.col(c).alias(f"y_{c}") for c in ("fp", "t0", "t1", "label")])
    met = x.join(y, _BLOCK).filter(
        (F.col("x_label") != F.col("y_label")) & within("x_", "y_", k) & (F.bit_count(F.col("x_fp").bitwiseXOR(F.col("y_fp"))) <= k)
    )
    return met.select(F.col("x_label").alias("a"), F.col("y_label").alias("b")).distinct()


def linked(fps: DataFrame, k: int = 4, crowd: int = CROWD) -> DataFrame:
    """Each distinct fingerprint of ``fp`` that has a link of at most k bits, with the smallest of its component."""
    spread = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = fps.select("fp").distinct()
    keys = block_keys(k, agreeing_groups(table.count(), k))
    # As many tasks as a shuffle has: a small table would come in a few partitions, and each row becomes many here.
    rows = dealt(table.repartition(spread, "fp").withColumn("mask", F.lit(0).cast("long")), keys)
    heads = rows.groupBy(*_BLOCK).agg(F.min("fp").alias("head"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # Merged: Spark takes exploded rows for as many as the table has, and would send them all through the driver.
    shared = saved(pivot_table(rows.join(heads.hint("merge"), _BLOCK)))
    labels = components(_stars(shared, k))
    label = F.coalesce("label", "fp").alias("label")
    opened = saved(_open(shared.join(labels, shared["fp"] == labels["node"], "left").select(*_BLOCK, "fp", "t0", "t1", label)))
    found = None
    for turn in range(1, ROUNDS + 1):
        crowded = F.col("others") > crowd
        most = opened.filter(crowded).agg(F.max("others"), F.min(F.lit(BITS) - F.bit_count("mask"))).first()
        if turn == ROUNDS or most[0] is None:
            break
        quiet = _pairs(opened.filter(~crowded), k)
        found = quiet if found is None else found.unionByName(quiet)
        again = opened.filter(crowded).drop("major", "others").repartition(spread, "fp")
        opened = saved(_open(dealt(again, block_keys(k, splitting_groups(most[0], k, most[1], crowd), turn)), exploded=True))
    last = _pairs(opened, k)
    found = last if found is None else found.unionByName(last)
    spokes = labels.filter("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b"))
    return components(spokes.unionByName(found))


def _classes(first: DataFrame, k: int) -> DataFrame:
    """``fp`` with ``component_id``, the smallest ``first`` of its component, for distinct ``fp`` with ``first``."""
    groups = linked(first.select("fp"), k)
    named = first.join(groups, first["fp"] == groups["node"], "left").select(
        first["fp"], "first", F.coalesce("label", first["fp"]).alias("label")
    )
    smallest = named.groupBy("label").agg(F.min("first").alias("component_id"))
    return named.join(smallest, "label").select("fp", "component_id")


def near_duplicates(docs: DataFrame, width: int = 4, k: int = 4, text: str = "text") -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` (the smallest ``doc_id`` of its component).

    Texts without words, null ones included, have fingerprint 0 and link like any other. Repeated rows each come
    back. A null ``doc_id`` never is a ``component_id`` unless its whole component has no other.
    """
    own = saved(fingerprints(docs, width, text))
    classes = _classes(own.groupBy("fp").agg(F.min("doc_id").alias("first")), k)
    return own.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def surplus(docs: DataFrame, width: int = 4, k: int = 4, text: str = "text") -> DataFrame:
    """``doc_id``, ``text_id``, ``first``, of what has rows to lose if one row of each component is to stay.

    The rows of one ``doc_id`` and text are one entry. The lowest (``doc_id``, ``text_id``) of a component is its
    ``first``, null ids last, and listed only if it has several rows; all others are listed.
    """
    key = F.struct(F.col("doc_id").isNull().alias("u"), "doc_id", text_id(text).alias("text_id"))
    own = saved(fingerprints(docs.select(key.alias("doc_id"), F.col(text).alias("text")), width))
    entries = own.groupBy(F.col("doc_id").alias("place"), "fp").agg(F.count("*").alias("n"))
    classes = _classes(own.groupBy("fp").agg(F.min("doc_id").alias("first")), k)
    judged = entries.join(classes, "fp").withColumn("first", F.col("place") == F.col("component_id"))
    return judged.filter("n > 1 or not first").select("place.doc_id", "place.text_id", "first")
