"""Tokens of each document in flat unindexed token files, by a separator scan.

Files hold 16-bit token ids, one document after another, each ended by the separator id. Tasks read
blocks of a file, find separators with numpy and report the lengths they see in full; the lengths that
cross block borders follow from a prefix scan over blocks: tokens before the block, and the place of the
last separator before it.

Defined results: null text counts as empty and has 0 tokens; two separators in a row are an empty
document; tokens after the last separator of a file are one more document without an end; an empty file
has none; repeated rows are documents of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossmill.llm.bpe import RANKS, codec
from glossmill.llm.common import Batches, bounded_batches, fresh_path, materialize, texts_of
from glossmill.llm.files import RangeFile, byte_blocks, task_file

SEPARATOR = 50256
#: Bytes of a file that one scan takes; even, as an id has two.
BLOCK = 4 << 20


def write_token_files(spark: SparkSession, docs: DataFrame, folder: str, path: str | None = None, separator: int = SEPARATOR) -> DataFrame:
    """Writes docs(doc_id, text) and returns (path, size, doc_ids): the ids of documents in a file, as they follow one another."""
    path = path or public_tokenizers.path(RANKS)
    bounded_batches(spark)

    def run(batches: Batches) -> Batches:
        own = codec(path)
        first = next(batches, None)
        if first is None:
            return
        ids: list = []
        with task_file(folder, ".tokens") as (name, out):
            size, batch = 0, first
            while batch is not None:
                for text in texts_of(batch.column("text")):
                    size += out.write(np.array([*own.encode(text), separator], "<u2").tobytes())
                ids += batch.column("doc_id").to_pylist()
                batch = next(batches, None)
        step = 100_000
        for low in range(0, max(1, len(ids)), step):
            part = ids[low : low + step]
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(part)), pa.array([size] * len(part), pa.int64()), pa.array(range(low, low + len(part)), pa.int64()), pa.array(part, pa.int64())], ["path", "size", "ordinal", "doc_id"]
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "path string, size long, ordinal long, doc_id long")


def scan_block(ids: np.ndarray, separator: int) -> tuple[int, int, int, list[int]]:
    """Separators in a block, the places of the first and the last (-1 if none), and the lengths between them."""
    at = np.flatnonzero(ids == separator)
    if not len(at):
        return 0, -1, -1, []
    return len(at), int(at[0]), int(at[-1]), (np.diff(at) - 1).tolist()


def token_counts(spark: SparkSession, files: DataFrame, separator: int = SEPARATOR, block: int = BLOCK) -> DataFrame:
    """path, ordinal and n_tokens of each document in files(path, size)."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for row in batch.to_pylist():
                file = RangeFile(row["path"], ahead=0)
                ids = np.frombuffer(file.read(row["start"], row["stop"] - row["start"]), "<u2")
                file.close()
                n, first, last, between = scan_block(ids, separator)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["path"]]), pa.array([row["block"]], pa.int64()), *(pa.array([x], pa.int64()) for x in (len(ids), n, first, last)), pa.array([between], pa.list_(pa.int64()))],
                    ["path", "block", "n_ids", "n_separators", "first", "last", "between"],
                )

    if block % 2:
        raise ValueError("a block holds whole ids, so its size is even")
    scanned = byte_blocks(spark, files, block).mapInArrow(run, "path string, block long, n_ids long, n_separators long, first long, last long, between array<long>")
    scanned = materialize(spark, scanned, "token-blocks")
    # The prefix scan sees a few numbers of each block; documents' lengths stay out of it.
    order = Window.partitionBy("path").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    place = scanned.select("path", "block", "n_ids", "n_separators", "last").withColumns({"ids_before": F.coalesce(F.sum("n_ids").over(before), F.lit(0)), "is_last": F.lead("block").over(order).isNull()})
    place = place.withColumn("last_at", F.when(F.col("last") >= 0, F.col("ids_before") + F.col("last")))
    place = place.withColumns({"ordinal_before": F.coalesce(F.sum("n_separators").over(before), F.lit(0)), "last_before": F.coalesce(F.max("last_at").over(before), F.lit(-1))})
    ends = place.filter("is_last").select(
        "path", (F.col("ordinal_before") + F.col("n_separators")).alias("ordinal"), (F.col("ids_before") + F.col("n_ids") - 1 - F.coalesce("last_at", "last_before")).alias("n_tokens")
    )
    full = scanned.filter("n_separators > 0").select("path", "block", "first", "between").join(place.select("path", "block", "ids_before", "ordinal_before", "last_before"), ["path", "block"])
    lengths = F.concat(F.array(F.col("ids_before") + F.col("first") - F.col("last_before") - 1), F.col("between"))
    found = full.select("path", "ordinal_before", F.posexplode(lengths).alias("i", "n_tokens")).select("path", (F.col("ordinal_before") + F.col("i")).alias("ordinal"), "n_tokens")
    return found.unionByName(ends.filter("n_tokens > 0"))


def document_token_counts(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and n_tokens: writes token files, then counts by scanning them."""
    written = materialize(spark, write_token_files(spark, docs, fresh_path(spark, "token-files"), path), "token-manifest")
    counted = token_counts(spark, written.select("path", "size").distinct())
    return written.select("path", "ordinal", "doc_id").join(counted, ["path", "ordinal"]).select("doc_id", "n_tokens")
