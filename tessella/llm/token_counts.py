"""Token counts of whole texts by a ``tokenizers`` file, without keeping the tokens.

Texts are cut into chunks at safe boundaries, places where the tokenizer's own pre-tokenisation always cuts too:
before a space or line break that follows a character other than white space. No pre-token of a byte-level
pattern holds such a pair, and no special token holds white space, so the counts of the chunks add up to the count
of the text. Chunks that a worker hasn't met yet go to the tokenizer together, in batches of about equal bytes;
only the lengths come back.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import by_size, map_texts

FILE = public_tokenizers.path("byte_bpe_50k.json")
#: Bytes of one call to the tokenizer, and chunks whose counts a Python worker remembers. Both only bound memory.
BATCH_BYTES, MEMO = 1 << 18, 500_000
#: A chunk: white space and what follows, up to a space or line break after something else.
CHUNK = re.compile(r"\s*\S+(?:(?![ \n])\s+\S+)*|\s+")


def balanced(chunks: set[str], batch_bytes: int = BATCH_BYTES) -> Iterator[list[str]]:
    """The chunks in batches that hold about ``batch_bytes`` each; a longer chunk is a batch of its own."""
    batch, held = [], 0
    for chunk in chunks:
        n = len(chunk.encode())
        if batch and held + n > batch_bytes:
            yield batch
            batch, held = [], 0
        batch.append(chunk)
        held += n
    if batch:
        yield batch


class Counter:
    """Counts tokens with one tokenizer file."""

    def __init__(self, path: str = FILE, memo: int = MEMO):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.memo: dict[str, int] = {}
        self.bound = memo

    def counts(self, texts: list[str]) -> list[int]:
        out = []
        for group in by_size(texts):
            split = [CHUNK.findall(text) for text in group]
            unknown = {c for chunks in split for c in chunks if c not in self.memo}
            if len(self.memo) + len(unknown) > self.bound:
                self.memo.clear()
                unknown = set(chain.from_iterable(split))
            for batch in balanced(unknown):
                found = self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)
                self.memo.update(zip(batch, map(len, found), strict=True))
            out += [sum(map(self.memo.__getitem__, chunks)) for chunks in split]
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One counter for each Python worker and file; the tokenizer keeps to the worker's own thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Counter(path)


def count_tokens(docs: DataFrame, path: str = FILE, limit: int = 512, text: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes`` long (UTF-8), ``n_tokens`` long, ``over_limit`` (more than ``limit`` tokens).

    Null and empty texts have 0 bytes and 0 tokens. Texts of any length count whole; a text without a safe boundary
    is one chunk. One row comes out for each row that goes in. The file must be a byte-level tokenizer without a
    normaliser or an added prefix space, for which the boundaries are safe.
    """

    def score(texts: list[str]) -> list[list]:
        return [[len(t.encode()) for t in texts], counter(path).counts(texts)]

    counted = map_texts(docs, score, ["n_bytes long", "n_tokens long"], text=text)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
