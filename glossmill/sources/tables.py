"""Other sources: plain-text books, HTML pages, dictionaries in SQLite, word lists, and a cache of shares of names."""

from __future__ import annotations

import os
import sqlite3
import urllib.request
import uuid
from collections.abc import Iterator
from contextlib import closing

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import LongType, StructField, StructType

from glossmill.functions.text import flowing_text, strip, without_boilerplate
from glossmill.schema import BOOK, DICTIONARY

LEAST_ROWS = 100_000
# Fixed value.
HEADING = r"^(?:CHAPTER\s+[IVXLC]+\.?|[IVXLC]+\.\s+\S.*)$"
END_MARK = "*** END OF THE PROJECT GUTENBERG"


def html_texts(pages: DataFrame) -> DataFrame:
    """Adds text, the flowing text of html."""
    return pages.withColumn("text", flowing_text(F.col("html")))


def text_books(spark: SparkSession, path: str) -> DataFrame:
    """path and text of plain-text books, without a byte order mark and the project's boilerplate."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace("value", "^﻿", "").alias("text"))
    return rows.withColumn("text", without_boilerplate(F.col("text")))


def split_chapters(books: DataFrame, key: list[str], heading: str = HEADING) -> DataFrame:
    """chapter, title and text from the headings of books(key, text); what stands before the first heading goes."""
    text = F.substring_index("text", END_MARK, 1)
    lines = books.select(*key, F.posexplode(F.split(text, r"\r\n|[\n\r]")).alias("at", "line"))
    order = Window.partitionBy(*key).orderBy("at")
    is_heading = F.col("line").rlike(heading) & (F.col("line") == strip(F.col("line")))
    lines = lines.withColumn("is_heading", is_heading).withColumn("chapter", F.sum(F.when(is_heading, 1).otherwise(0)).over(order).cast("int")).filter("chapter > 0")
    listed = F.sort_array(F.collect_list(F.when(~F.col("is_heading"), F.struct("at", "line"))))
    return lines.groupBy(*key, "chapter").agg(F.max(F.when(F.col("is_heading"), F.col("line"))).alias("title"), strip(F.array_join(F.transform(listed, lambda x: x["line"]), "\n")).alias("text"))


class _Rows(InputPartition):
    def __init__(self, path: str, place: int, low: int, high: int):
        self.path, self.place, self.low, self.high = path, place, low, high


class SqliteReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path = schema, options["path"]
        self.table, self.parts = options.get("dbtable", "translation"), int(options.get("partitions", "8"))

    def _connect(self, path: str) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{path}?mode=ro", uri=True)

    def _files(self) -> list[str]:
        if os.path.isdir(self.path):
            return sorted(os.path.join(self.path, x) for x in os.listdir(self.path) if x.endswith(".sqlite3"))
        if not os.path.isfile(self.path):
            raise FileNotFoundError(self.path)
        return [self.path]

    def partitions(self) -> list[InputPartition]:
        """Ranges of rows of the file, or of each file of the folder; src_row is a row's place in its file, behind that of the file."""
        files = self._files()
        parts, out = max(1, self.parts // max(1, len(files))), []
        for place, path in enumerate(files):
            with closing(self._connect(path)) as con:
                low, high = con.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
            if low is not None:
                step = -(-(high - low + 1) // parts)
                out += [_Rows(path, place, x, min(high, x + step - 1)) for x in range(low, high + 1, step)]
        return out or [_Rows(files[0], 0, 0, -1)] if files else [_Rows("", 0, 0, -1)]

    def read(self, partition: _Rows) -> Iterator[tuple]:
        columns = ", ".join(f"{partition.place << 40} + rowid" if f.name == "src_row" else f'"{f.name}"' for f in self.schema)
        kinds = [f.dataType.typeName() for f in self.schema]

        def value(x, kind: str):
            """Columns without a type hold anything; what doesn't fit is null."""
            if x is None or kind == "string":
                return x if x is None else str(x)
            try:
                return float(x) if kind == "double" else int(x)
            except (TypeError, ValueError):
                return None

        if not partition.path:
            return
        with closing(self._connect(partition.path)) as con:
            for row in con.execute(f'SELECT {columns} FROM "{self.table}" WHERE rowid BETWEEN ? AND ?', (partition.low, partition.high)):
                yield tuple(value(x, k) for x, k in zip(row, kinds, strict=True))


class SqliteSource(DataSource):
    """A table of an SQLite file, or of all of a folder, by ranges of rows; every worker must reach them."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> StructType:
        return StructType([*DICTIONARY.fields, StructField("src_row", LongType(), False)])

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(schema, self.options)


def sqlite_dictionary(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite_table").option("path", path).load()


def checked_dictionary(dictionary: DataFrame, least: int = LEAST_ROWS) -> DataFrame:
    """The dictionary, or an error if columns are missing or it has too few rows to be whole."""
    missing = {"lexentry", "sense", "written_rep", "trans_list", "score"} - set(dictionary.columns)
    if missing:
        raise ValueError(f"no dictionary, it lacks {', '.join(sorted(missing))}")
    n = dictionary.limit(least).count()
    if n < least:
        raise ValueError(f"the dictionary has {n} rows, and {least} at least are expected")
    return dictionary


def _validated(path: str, least: int) -> None:
    """A dictionary file with its columns and enough rows, and with an index on headwords; else an error."""
    try:
        with closing(sqlite3.connect(path)) as con:
            columns = {r[1] for r in con.execute("PRAGMA table_info(translation)")}
            if missing := {"lexentry", "sense", "written_rep", "trans_list", "score"} - columns:
                raise ValueError(f"no dictionary, it lacks {', '.join(sorted(missing))}")
            (n,) = con.execute("SELECT count(*) FROM translation").fetchone()
            if n < least:
                raise ValueError(f"the dictionary has {n} rows, and {least} at least are expected")
            con.execute("CREATE INDEX IF NOT EXISTS headword ON translation (written_rep)")
            con.commit()
    except sqlite3.DatabaseError as e:
        raise ValueError(f"no dictionary: {e}") from e


def fetch_dictionary(url: str, target: str, timeout: float = 60, least: int = LEAST_ROWS) -> str:
    """Downloads a dictionary once; it gets its name only when all of it has arrived, and its columns, rows and index are there."""
    if os.path.exists(target):
        return target
    part = f"{target}.{uuid.uuid4().hex}.part"
    try:
        with urllib.request.urlopen(url, timeout=timeout) as response, open(part, "wb") as out:
            stated, got = response.headers.get("Content-Length"), 0
            while data := response.read(1 << 20):
                got += out.write(data)
        if stated is not None and got != int(stated):
            raise ValueError(f"{got} of {stated} bytes arrived")
        _validated(part, least)
        os.replace(part, target)
    finally:
        if os.path.exists(part):
            os.remove(part)
    return target


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """lemma and rank of a list, one word a line, # for comments. A list is thousands of lines, and its ranks are those of one file."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("at", "line"))
    rows = rows.withColumn("lemma", strip(F.col("line"))).filter("lemma <> '' and not startswith(lemma, '#')")
    return rows.select("lemma", F.row_number().over(Window.orderBy("at")).alias("rank"))


def ratio_key(files: DataFrame, model: str, version: str) -> DataFrame:
    """A book's key in the cache: its bytes' SHA-256 with the tagger's model and version."""
    return files.withColumn("cache_key", F.concat_ws("-", F.sha2("content", 256), F.lit(model), F.lit(version)))


def cached_ratios(spark: SparkSession, path: str, key: str, make) -> DataFrame:
    """Shares of names from the cache, made and written if they aren't there; one folder a key."""
    place = f"{path.rstrip('/')}/cache_key={key}"
    target = spark._jvm.org.apache.hadoop.fs.Path(place)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(spark._jvm.org.apache.hadoop.fs.Path(place + "/_SUCCESS")):
        make().select(*BOOK, "lemma", "ratio").write.mode("overwrite").parquet(place)
    return spark.read.parquet(place)
