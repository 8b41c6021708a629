"""Byte-level BPE encoding and decoding through a sentencepiece model made from a rank file.

A rank file lists byte strings by merge rank. Each becomes a piece of a sentencepiece BPE model: its bytes are
mapped to printable characters one by one, its score is minus its rank, and normalisation is the identity, so that
sentencepiece merges the adjacent pair of lowest rank first, the leftmost on a tie, as byte-level BPE does. The
model is serialised here in protobuf's wire format; nothing is trained. Pre-tokens are the matches of the pattern,
encoded one by one; decoding maps the pieces back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import public_tokenizers
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, map_texts

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Pre-tokens whose ids a Python worker remembers. A memory bound, not a limit on the texts: it forgets and goes on.
MEMO = 400_000


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable ones themselves, the others from U+0100 on."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in kept else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Byte strings by rank."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | bytes | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model whose ids are the ranks; the id after the last is its unknown piece."""
    characters, normal, unknown = byte_characters(), 1, 2
    pieces = [
        _field(1, "".join(characters[b] for b in token).encode()) + _field(2, float(-rank)) + _field(3, normal)
        for rank, token in enumerate(tokens)
    ]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown))
    bpe = 2
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(tokens))
    trainer += b"".join(_field(n, -1) for n in (41, 42, 43))  # neither begin, end nor padding
    normaliser = _field(1, b"identity") + b"".join(_field(n, 0) for n in (3, 4, 5))  # no prefix, trim or escape
    return b"".join(_field(1, piece) for piece in pieces) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encodes texts to ids and decodes ids to bytes."""

    def __init__(self, path: str = RANKS, pattern: str = public_tokenizers.PATTERN, memo: int = MEMO):
        tokens = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(tokens))
        self.pattern = regex.compile(pattern)
        self.characters = byte_characters()
        byte_of = {c: b for b, c in enumerate(self.characters)}
        self.bytes_of = [bytes(byte_of[c] for c in self.model.id_to_piece(i)) for i in range(len(tokens))]
        self.digits = [str(i) for i in range(len(tokens))]
        self.whole = {token: i for i, token in enumerate(tokens)}
        self.mapping = {i: c for i, c in enumerate(self.characters)}
        self.memo: dict[str, tuple[int, ...]] = {}
        self.bound = memo

    def _learn(self, pretokens: set[str]) -> None:
        """Adds the ids of pre-tokens to the memo; one that is a token itself gets that id, without merges."""
        merged = []
        for pretoken in pretokens:
            raw = pretoken.encode()
            if (known := self.whole.get(raw)) is not None:
                self.memo[pretoken] = (known,)
            else:
                merged.append((pretoken, raw.decode("latin-1").translate(self.mapping)))
        ids = self.model.encode([mapped for _, mapped in merged], num_threads=1) if merged else []
        self.memo.update((pretoken, tuple(got)) for (pretoken, _), got in zip(merged, ids, strict=True))

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text. New pre-tokens of many texts go to sentencepiece in one call."""
        for group in by_size(texts):
            split = [self.pattern.findall(text) for text in group]
            unknown = {p for pretokens in split for p in pretokens if p not in self.memo}
            if len(self.memo) + len(unknown) > self.bound:
                self.memo.clear()
                unknown = set(chain.from_iterable(split))
            self._learn(unknown)
            for pretokens in split:
                yield list(chain.from_iterable(map(self.memo.__getitem__, pretokens)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec for each Python worker and rank file."""
    return Codec(path, pattern)


def encode_documents(
    docs: DataFrame, path: str = RANKS, pattern: str = public_tokenizers.PATTERN, text: str = "text"
) -> DataFrame:
    """The ids of each text: ``doc_id``, ``ids`` array<int>. Null texts have no ids."""

    def score(texts: list[str]) -> list[list]:
        return [list(codec(path, pattern).encode(texts))]

    return map_texts(docs, score, ["ids array<int>"], text=text)


def decode_documents(encoded: DataFrame, path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """The bytes of each document of ids: ``doc_id``, ``bytes`` binary. Null ids give empty bytes."""

    @F.pandas_udf("binary")
    def decoded(ids):
        return ids.map(lambda x: b"" if x is None else codec(path, pattern).decode(list(x)))

    return encoded.select("doc_id", decoded("ids").alias("bytes"))


def round_trip(
    docs: DataFrame, path: str = RANKS, pattern: str = public_tokenizers.PATTERN, text: str = "text"
) -> DataFrame:
    """Encodes each whole text, decodes its ids, and returns digests of both.

    ``doc_id``, ``n_tokens`` long, ``ids_sha256`` (of decimal ids joined by commas), ``decoded_sha256`` (of the
    decoded bytes). A null or empty text has no tokens and the digests of the empty string; one row comes out for
    each row that goes in, repeated ``doc_id`` included.
    """

    def score(texts: list[str]) -> list[list]:
        tool, counts, of_ids, of_bytes = codec(path, pattern), [], [], []
        for ids in tool.encode(texts):
            counts.append(len(ids))
            of_ids.append(hashlib.sha256(",".join(map(tool.digits.__getitem__, ids)).encode()).hexdigest())
            of_bytes.append(hashlib.sha256(tool.decode(ids)).hexdigest())
        return [counts, of_ids, of_bytes]

    return map_texts(docs, score, ["n_tokens long", "ids_sha256 string", "decoded_sha256 string"], text=text)
