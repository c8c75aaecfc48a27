"""Tables in the folder that driver and executors share: what several operators read is made once, and outlives a lost executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where that is unset and all run on one machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = getattr(spark.sparkContext, "_own_staging_dir", None) or "file://" + tempfile.mkdtemp(prefix="staging-")
        spark.sparkContext._own_staging_dir = found
    return found.rstrip("/")


def staged(df: DataFrame, label: str = "staged") -> DataFrame:
    """The rows as a table of their own: columns are pruned at its scan, and no plan above makes them again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: What tables of chapters are dealt by: authors add nothing to it, and a literal among them would be taken out of the keys that plans compare.
DEALT = ("book_title", "chapter")


def dealt(chapters: DataFrame) -> DataFrame:
    """The rows of a chapter in one of as many parts as shuffles have: texts move, before anything longer is made of them."""
    return chapters.repartition(int(chapters.sparkSession.conf.get("spark.sql.shuffle.partitions")), *DEALT)


def staged_chapters(df: DataFrame, label: str = "staged") -> DataFrame:
    """Rows made of dealt() chapters as a table that plans know to be dealt by chapter: what groups, orders or joins its rows in a chapter moves none."""
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    # A join on more columns than the chapter's takes the table's parts as they are.
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    writer = df.write.format("parquet").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), *DEALT)
    writer.option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    return spark.table(name)
