"""Flat files in the shared folder, read by ranges."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import BinaryIO

import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@contextmanager
def task_file(folder: str, suffix: str) -> Iterator[tuple[str, BinaryIO]]:
    """A file of this task's own, which takes its name only when it is whole; an attempt that runs again replaces it."""
    context = TaskContext.get()
    system, base = pafs.FileSystem.from_uri(folder)
    system.create_dir(base, recursive=True)
    name = f"part-{context.partitionId():06d}{suffix}"
    hidden = f"{base}/.{name}.{context.taskAttemptId()}"
    with system.open_output_stream(hidden) as out:
        yield f"{folder}/{name}", out
    system.move(hidden, f"{base}/{name}")


class RangeFile:
    """Reads any range of a file through a small buffer."""

    def __init__(self, path: str, ahead: int = 1 << 20):
        system, inner = pafs.FileSystem.from_uri(path)
        self.file = system.open_input_file(inner)
        self.size = self.file.size()
        self.ahead, self.low, self.held = ahead, 0, b""

    def read(self, start: int, length: int) -> bytes:
        end = min(self.size, start + length)
        if start >= end:
            return b""
        if not (self.low <= start and end <= self.low + len(self.held)):
            self.low = start
            self.held = self.file.read_at(max(end - start, min(self.ahead, self.size - start)), start)
        return self.held[start - self.low : end - self.low]

    def close(self) -> None:
        self.file.close()


def byte_blocks(spark: SparkSession, files: DataFrame, block: int) -> DataFrame:
    """path, size, block, start and stop of each block of files(path, size)."""
    blocks = files.filter("size > 0").select("path", F.col("size").cast("long").alias("size")).withColumn("block", F.explode(F.expr(f"sequence(0L, (size - 1) div {block}L)")))
    blocks = blocks.withColumns({"start": F.col("block") * block, "stop": F.least(F.col("size"), (F.col("block") + 1) * block)})
    n = files.agg(F.sum(F.ceil(F.col("size") / block))).first()[0] or 1
    return blocks.repartition(max(1, min(int(n), 20_000)), "path", "block")
