"""Exact deduplication by composable polynomial fingerprints.

A text's fingerprint is its value as a polynomial over bytes at fixed points, modulo four primes below
2**31, with its length. Chunks are hashed side by side and joined by length-shifted arithmetic, so that a
huge text needs no pass from its start to its end. Rows with equal fingerprints are then compared chunk
by chunk; a fingerprint that proves ambiguous is split by SHA-256.

Defined results: null text counts as empty; empty texts form one group; among equal texts the smallest
doc_id stays, null after all others, and of rows with the same doc_id exactly one stays; an empty table
gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.llm.common import Batches, bounded_batches, collapse_spaces, fresh_names, join_sized, materialize, row_ids, utf8_buffers

#: Primes below 2**31 and the points at which texts are evaluated.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
POINTS = (1103515245, 1566083941, 1812433253, 69069069)
CHUNK = 256
#: Bytes that one comparison takes from each text.
COMPARED = 1 << 16


class Fingerprinter:
    def __init__(self, primes: tuple[int, ...] = PRIMES):
        self.primes = np.array(primes, np.int64)
        self.points = np.array([x % p for x, p in zip(POINTS, primes, strict=False)], np.int64)
        powers = np.ones((CHUNK, len(primes)), np.int64)
        for i in range(CHUNK - 2, -1, -1):
            powers[i] = powers[i + 1] * self.points % self.primes
        self.weights = powers.astype(np.float64)  # 256 * 2**8 * 2**31 stays below 2**53, so that products are exact
        self.shift = powers[0] * self.points % self.primes

    def power(self, exponent: int) -> np.ndarray:
        return np.array([pow(int(x), exponent, int(p)) for x, p in zip(self.points, self.primes, strict=True)], np.int64)

    def combine(self, left: np.ndarray, right: np.ndarray, right_bytes: int) -> np.ndarray:
        """The fingerprint of a text from those of its two parts."""
        return (left * self.power(right_bytes) + right) % self.primes

    def of(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A row of residues for each text."""
        sizes = np.diff(offsets)
        chunks = -(-sizes // CHUNK)
        ends = np.cumsum(chunks)
        out = np.zeros((len(sizes), len(self.primes)), np.int64)
        if not len(sizes) or not ends[-1]:
            return out
        hashed = np.empty((int(ends[-1]), len(self.primes)), np.int64)
        first, done = 0, 0
        while done < len(sizes):  # texts are laid out chunk by chunk, the first chunk of each filled up with zeros in front
            upto = max(done + 1, int(np.searchsorted(ends, first + 4096, side="right")))
            if ends[upto - 1] - first <= 8192:
                room = np.zeros(int(ends[upto - 1] - first) * CHUNK, np.uint8)
                for d in range(done, upto):
                    end = int(ends[d] - first) * CHUNK
                    room[end - sizes[d] : end] = data[offsets[d] : offsets[d + 1]]
                hashed[first : ends[upto - 1]] = self._rows(room)
            else:  # one text larger than a block
                size, base, at = int(sizes[done]), int(offsets[done]), first
                head = size - (int(chunks[done]) - 1) * CHUNK
                room = np.zeros(CHUNK, np.uint8)
                room[CHUNK - head :] = data[base : base + head]
                hashed[at : at + 1] = self._rows(room)
                for low in range(head, size, 4096 * CHUNK):
                    part = self._rows(data[base + low : base + min(size, low + 4096 * CHUNK)])
                    at_row = first + 1 + (low - head) // CHUNK
                    hashed[at_row : at_row + len(part)] = part
            first, done = int(ends[upto - 1]), upto
        after = np.repeat(ends, chunks) - 1 - np.arange(int(ends[-1]))
        shifts = np.ones((int(chunks.max()), len(self.primes)), np.int64)
        for i in range(1, len(shifts)):
            shifts[i] = shifts[i - 1] * self.shift % self.primes
        hashed = hashed * shifts[after] % self.primes
        full = np.flatnonzero(chunks)
        out[full] = np.add.reduceat(hashed, (ends - chunks)[full], axis=0) % self.primes
        return out

    def _rows(self, flat: np.ndarray) -> np.ndarray:
        return (flat.reshape(-1, CHUNK).astype(np.float64) @ self.weights).astype(np.int64) % self.primes


def _key(residues: np.ndarray, size: int) -> str:
    return "".join(f"{int(x):08x}" for x in residues) + f"-{size:x}"


def _signatures(primes: tuple[int, ...]):
    def run(batches: Batches) -> Batches:
        own = Fingerprinter(primes)
        for batch in batches:
            data, offsets = collapse_spaces(*utf8_buffers(batch.column("text")))
            residues = own.of(data, offsets)
            view = memoryview(data)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row_uid"),
                    batch.column("doc_id"),
                    pa.array([_key(r, int(n)) for r, n in zip(residues, np.diff(offsets), strict=True)], pa.string()),
                    pa.array([hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.string()),
                ],
                ["row_uid", "doc_id", "fingerprint", "text_sha256"],
            )

    return run


def _chunks(primes: tuple[int, ...]):
    """Chunks of texts; what equals a chunk of the same fingerprint and number in the batch isn't sent again."""

    def run(batches: Batches) -> Batches:
        own = Fingerprinter(primes)
        for batch in batches:
            data, offsets = collapse_spaces(*utf8_buffers(batch.column("text")))
            residues = own.of(data, offsets)
            sent: dict[tuple[str, int], set[bytes]] = {}
            rows: tuple[list, list, list] = ([], [], [])
            for d, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                key = _key(residues[d], int(b - a))
                for number, low in enumerate(range(int(a), int(b), COMPARED)):
                    part = data[low : min(int(b), low + COMPARED)].tobytes()
                    seen = sent.setdefault((key, number), set())
                    if part not in seen:
                        seen.add(part)
                        for column, x in zip(rows, (key, number, part), strict=True):
                            column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.binary())], ["fingerprint", "number", "part"])

    return run


def exact_groups(spark: SparkSession, docs: DataFrame, primes: tuple[int, ...] = PRIMES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs(doc_id, text)."""
    bounded_batches(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = materialize(spark, row_ids(source).mapInArrow(_signatures(primes), "row_uid long, doc_id long, fingerprint string, text_sha256 string"), "exact-signatures")
    total = signed.count()
    shared = materialize(spark, signed.groupBy("fingerprint").agg(F.count("*").alias("n")).filter("n > 1"), "exact-shared")
    # Only texts of shared fingerprints are compared; they are found by doc_id. Rows without one are all compared, which changes nothing.
    wanted = join_sized(signed, shared, ["fingerprint"], "n", total).filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"))
    numbered = source.filter("doc_id is not null")
    candidates = join_sized(numbered, wanted, ["doc_id"], "rows", total).select("text").unionByName(source.filter("doc_id is null").select("text"))
    parts = candidates.mapInArrow(_chunks(primes), "fingerprint string, number long, part binary")
    ambiguous = parts.groupBy("fingerprint", "number").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low <> high").select("fingerprint").distinct().withColumn("ambiguous", F.lit(True))
    told = materialize(spark, shared.hint("merge").join(ambiguous, "fingerprint", "left"), "exact-compared")
    # A text of a fingerprint of its own is its own group already.
    keyed = join_sized(signed, told, ["fingerprint"], "n", total)
    keyed = keyed.withColumn("group_key", F.when(F.col("ambiguous"), F.concat_ws("-", "fingerprint", "text_sha256")).otherwise(F.col("fingerprint"))).select("row_uid", "doc_id", "group_key", "text_sha256")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_uid")
    groups = materialize(spark, keyed.groupBy("group_key").agg(F.count("*").alias("group_size"), F.min(order).alias("first")), "exact-groups")
    several = join_sized(keyed, groups, ["group_key"], "group_size", total).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row_uid") == F.col("first.row_uid")).alias("kept"), "text_sha256"
    )
    alone = signed.join(shared.hint("merge"), "fingerprint", "left_anti").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return several.unionByName(alone)


def drop_copies(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns, whatever these are called."""
    spread, sha, same = fresh_names(docs, "spread", "sha", "same")
    known = lambda c: F.coalesce(F.col(c).cast("long").cast("string"), F.lit("null"))
    groups = exact_groups(spark, docs)
    stay = groups.groupBy(known("doc_id").alias(spread), F.col("text_sha256").alias(sha)).agg(F.max("kept").alias("kept"), F.count("*").alias(same)).filter("kept").drop("kept")
    stay = materialize(spark, stay, "exact-kept")
    total = stay.agg(F.sum(same)).first()[0] or 0
    normal = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " ")
    found = join_sized(docs.withColumns({spread: known("doc_id"), sha: F.sha2(normal, 256)}), stay, [spread, sha], same, total)
    once = found.filter(F.col(same) == 1)
    return once.unionByName(found.filter(F.col(same) > 1).dropDuplicates([spread, sha])).select(docs.columns)
