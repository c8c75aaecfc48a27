"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass handles at a time.
BLOCK = 1 << 22
#: Bytes of an Arrow batch; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20
#: A key with more than one in so many rows is hot; there are fewer hot keys than that.
HOT = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, the same for every operator: texts are long, and a Python worker shares an executor's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a temporary one only where it is unset and all run on one machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = getattr(spark.sparkContext, "_own_shared_dir", None) or "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext._own_shared_dir = found
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """Cuts the lineage by a table in the shared folder, which outlives a lost executor."""
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def crc_mod(column: str, n: int):
    return F.crc32(F.col(column).cast("string")) % n


def texts_of(array: pa.Array) -> list[str]:
    return ["" if x is None else x for x in array.to_pylist()]


def utf8_buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows one after another, and their n + 1 offsets; null counts as empty."""
    array = array.cast(pa.large_string()).fill_null("")
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def is_space_table() -> np.ndarray:
    t = np.zeros(256, bool)
    t[[32, *range(9, 14)]] = True
    return t


IS_SPACE = is_space_table()


def collapse_spaces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each run of ASCII white space inside a row becomes one space."""
    starts = np.zeros(len(data) + 1, bool)
    starts[offsets[:-1]] = True
    parts, kept_before, counts, position = [], 0, np.zeros(len(offsets), np.int64), 0
    for low in range(0, len(data), BLOCK):
        high = min(len(data), low + BLOCK)
        space = IS_SPACE[data[low:high]]
        previous = np.empty_like(space)
        previous[1:] = space[:-1]
        previous[0] = low > 0 and IS_SPACE[data[low - 1]]
        keep = ~(space & previous & ~starts[low:high])
        parts.append(np.where(space, np.uint8(32), data[low:high])[keep])
        upto = int(np.searchsorted(offsets, high, side="left"))
        if upto > position:
            running = np.concatenate(([0], np.cumsum(keep, dtype=np.int64)))
            counts[position:upto] = kept_before + running[offsets[position:upto] - low]
            position = upto
        kept_before += len(parts[-1])
    counts[position:] = kept_before
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint8)), counts


def row_ids(df: DataFrame, name: str = "row_uid") -> DataFrame:
    """Numbers rows to tell equal ones apart; materialize what is built on it before it is used twice."""
    return df.withColumn(name, F.monotonically_increasing_id())


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that df doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def join_sized(rows: DataFrame, groups: DataFrame, key: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """rows with their group's columns, how being inner or left; groups has a row a key, with the number of its rows.

    Keys of more than a thousandth of all rows are fewer than HOT, so that their groups are broadcast and their rows stay where
    they are; no key of the others is frequent in the shuffle.
    """
    is_hot = F.col(size) * HOT > total
    hot, others = groups.filter(is_hot), groups.filter(~is_hot).hint("merge")  # one way of joining at every size
    near = rows.join(F.broadcast(hot), key)
    return near.unionByName(rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(others, key, how))


Batches = Iterator[pa.RecordBatch]
