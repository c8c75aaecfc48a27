"""EPUB archives as a data source: `spark.read.format("epub")`.

A partition is a group of archives of bounded bytes. Archives are read where they lie, so that of each only its
directory and what is asked for is fetched: without the column content, or with the option text set to false, no chapter
is unpacked, and with the option pushdown set to true, in a session with spark.sql.python.filterPushdown.enabled, filters
on kind leave out what they don't let through.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from glossmill.sources.epub import ENTRIES, KINDS, entries_of

#: Bytes of archives in a partition, unless the option partitionBytes says otherwise; a larger archive is one of its own.
PARTITION_BYTES = 64 << 20
_NAMES = [x.split()[0] for x in ENTRIES.split(", ")]


class Archives(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class EpubReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        unknown = set(schema.fieldNames()) - set(_NAMES)
        if unknown:
            raise ValueError(f"an EPUB has no {', '.join(sorted(unknown))}")
        self.columns = [_NAMES.index(f) for f in schema.fieldNames()]
        self.path, self.kinds = options["path"], KINDS
        self.with_text = "content" in schema.fieldNames() and options.get("text", "true") != "false"
        self.bytes = int(options.get("partitionbytes", PARTITION_BYTES))

    def partitions(self) -> list[InputPartition]:
        """Archives below the path, or the one that it names, in groups; of them only names and sizes are looked at."""
        system, root = fs.FileSystem.from_uri(self.path) if ":" in self.path else (fs.LocalFileSystem(), self.path)
        found = system.get_file_info(root)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        infos = [found] if found.is_file else system.get_file_info(fs.FileSelector(root, recursive=True))
        groups, room = [], 0
        for info in sorted((x for x in infos if x.is_file and x.path.lower().endswith(".epub")), key=lambda x: x.path):
            if not groups or info.size > room:
                groups.append([])
                room = self.bytes
            groups[-1].append(info.path)
            room -= info.size
        return [Archives(g) for g in groups] or [Archives([])]

    def read(self, partition: Archives) -> Iterator[tuple]:
        system, _ = fs.FileSystem.from_uri(self.path) if ":" in self.path else (fs.LocalFileSystem(), self.path)
        for path in partition.paths:
            with system.open_input_file(path) as archive:
                for row in entries_of(path, archive, self.with_text, self.kinds):
                    yield tuple(row[i] for i in self.columns)


class PushingEpubReader(EpubReader):
    """Takes filters on kind over; for sessions that push filters into Python sources, as others refuse such a reader."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("kind",):
                self.kinds = tuple(k for k in self.kinds if k == f.value)
            elif isinstance(f, In) and f.attribute == ("kind",):
                self.kinds = tuple(k for k in self.kinds if k in f.value)
            else:
                yield f


class EpubSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "epub"

    def schema(self) -> str:
        return ENTRIES

    def reader(self, schema: StructType) -> DataSourceReader:
        return (PushingEpubReader if self.options.get("pushdown") == "true" else EpubReader)(schema, self.options)


def read_epub(spark: SparkSession, path: str, with_text: bool = True) -> DataFrame:
    """The rows of epub.entries for the archives below a path; with_text=False leaves documents without content, as no chapter is unpacked."""
    spark.dataSource.register(EpubSource)
    pushes = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("epub").options(path=path, text=str(with_text).lower(), pushdown=pushes).load()
