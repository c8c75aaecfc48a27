"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

Long texts are cut before regex splitting at places where the pattern never matches across (a space
between two letters), so that the regex engine and the merge loop see bounded pieces.

Defined results: null text counts as empty and has no tokens; special tokens are ordinary text; every
row gives one row, repeated rows too; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from glossmill.llm.common import Batches, bounded_batches, texts_of

RANKS = "byte_bpe_50k.tiktoken"
PIECE = 1 << 16
#: A space before a letter after a non-space starts a match of its own, whatever stands before it.
SAFE = re.compile(r"(?<=[^\W_])(?= [^\W\d_])")


class Codec:
    """Encodes whole texts as tiktoken does, and decodes ids to the same bytes."""

    def __init__(self, path: str, piece: int = PIECE):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("local", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.piece = piece
        self.decimal = [str(i) for i in range(max(ranks.values()) + 1)]

    def pieces(self, text: str) -> list[str]:
        if len(text) <= self.piece:
            return [text]
        out, low = [], 0
        while len(text) - low > self.piece:
            found = SAFE.search(text, low + self.piece)
            if found is None:
                break
            out.append(text[low : found.start()])
            low = found.start()
        out.append(text[low:])
        return out

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for part in self.pieces(text):
            ids += self.encoding.encode_ordinary(part)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return self.encoding.decode_bytes(ids)

    def digest(self, ids: list[int]) -> str:
        names = self.decimal
        return hashlib.sha256(" ".join([names[i] for i in ids]).encode()).hexdigest()


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the ids of its whole text."""
    path = path or public_tokenizers.path(RANKS)
    bounded_batches(spark)

    def run(batches: Batches) -> Batches:
        own = codec(path)
        for batch in batches:
            ids = [own.encode(x) for x in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(spark: SparkSession, encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the bytes that its ids stand for."""
    path = path or public_tokenizers.path(RANKS)
    bounded_batches(spark)

    def run(batches: Batches) -> Batches:
        own = codec(path)
        for batch in batches:
            data = [own.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def round_trip(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 for each row of docs(doc_id, text)."""
    path = path or public_tokenizers.path(RANKS)
    bounded_batches(spark)

    def run(batches: Batches) -> Batches:
        own = codec(path)
        for batch in batches:
            counts, of_ids, of_bytes = [], [], []
            for x in texts_of(batch.column("text")):
                ids = own.encode(x)
                counts.append(len(ids))
                of_ids.append(own.digest(ids))
                of_bytes.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
