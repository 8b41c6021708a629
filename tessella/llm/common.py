"""Small helpers that the text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessella.operators.positions import checkpoint_folder, written
from tessella.operators.positions import materialised as saved

__all__ = ["checkpoint_folder", "saved", "written"]

#: Separators of white-space words, and of alphanumeric words, as Java patterns.
SPACES = r"[\x20\x09-\x0D]+"
NOT_ALNUM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of text that a Python worker turns into strings at a time.
SLICE = 1 << 21
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column, separators: str = SPACES) -> Column:
    """The words of a text in order; an empty array for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def lower_az(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def text_id(text: str = "text") -> Column:
    """A hash of a text, null as empty: with ``doc_id`` it tells rows apart that share an id."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def unused(frame: DataFrame, *names: str) -> list[str]:
    """Names like those given that no column of the frame has, whatever the case of its letters."""
    taken, found = {c.lower() for c in frame.columns}, []
    for name in names:
        own = f"_{name}"
        while own in taken:
            own = f"_{own}"
        taken.add(own)
        found.append(own)
    return found


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once per row even where ``use`` refers to it inside a lambda.

    A plain column may be replaced by its expression when plans are merged, and so be computed for each element.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def map_texts(
    docs: DataFrame,
    score: Callable[[list[str]], list[list]],
    schema: list[str],
    text: str = "text",
) -> DataFrame:
    """Applies ``score`` to the texts of each Arrow batch: ``doc_id`` and the columns of ``schema`` come back.

    ``score`` gets a list of texts (null as "") and returns one list per column of ``schema``. Spark bounds a batch
    by rows and by bytes (``spark.sql.execution.arrow.maxBytesPerBatch``); here it is cut into slices of about
    ``SLICE`` bytes, a longer text alone, so that Python holds the strings of one slice at a time.
    """
    docs = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text"))
    out = ", ".join([f"doc_id {docs.schema['doc_id'].dataType.simpleString()}", *schema])
    types = [f.dataType for f in docs.select(*[F.lit(None).cast(c.split(" ", 1)[1]) for c in schema]).schema]
    kinds = [to_arrow_type(t) for t in types]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                columns = map(pa.array, score(part.column(1).to_pylist()), kinds)
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", *names])

    names = [column.split(" ", 1)[0] for column in schema]
    return docs.mapInArrow(run, out)


def slices(batch: pa.RecordBatch, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, in slices of about ``size`` bytes of its second column."""
    ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def by_size(texts: list[str], characters: int = 1 << 21) -> Iterator[list[str]]:
    """The texts in order, in groups of about ``characters``; a longer text is a group of its own."""
    group, held = [], 0
    for text in texts:
        if group and held + len(text) > characters:
            yield group
            group, held = [], 0
        group.append(text)
        held += len(text)
    if group:
        yield group
