from __future__ import annotations

import shutil
import zipfile
from pathlib import Path

import pytest
from pyspark.sql.datasource import EqualTo, In
from pyspark.sql.types import StructField, StructType, StringType

from glossmill.plans import books
from glossmill.sources import epub
from glossmill.sources.epub_source import EpubReader, PushingEpubReader, read_epub

FIELDS = [x.split()[0] for x in epub.ENTRIES.split(", ")]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Seven books, one of them in a folder of its own, one that isn't an archive, and a file of another kind."""
    root = tmp_path_factory.mktemp("books")
    for i in range(6):
        place = root / "more" if i == 3 else root
        place.mkdir(exist_ok=True)
        (place / f"b{i}.epub").write_bytes(books._archive(i, [f"<p>Page {k} of {i}. The end</p>" for k in range(5)]))
    (root / "bad.epub").write_bytes(b"no archive")
    (root / "notes.txt").write_text("x")
    return root


def test_the_source_has_the_rows_of_the_table_function(spark, folder):
    want = epub.entries(epub.files(spark, f"{folder}").union(epub.files(spark, f"{folder}/more")).filter("path like '%.epub'")).collect()
    key = lambda rs: sorted(repr((r["path"].rsplit("/", 1)[1], *tuple(r)[1:6], r["status"].split(":")[0], r["content"])) for r in rs)
    assert key(read_epub(spark, str(folder)).collect()) == key(want) and len({r["path"] for r in want}) == 7
    assert key(read_epub(spark, f"file://{folder}").collect()) == key(want)
    assert {r["path"].rsplit("/", 1)[1] for r in read_epub(spark, f"{folder}/b1.epub").collect()} == {"b1.epub"}


def test_structure_equals_that_of_whole_archives(spark, folder):
    good = read_epub(spark, f"{folder}/more", with_text=False)
    whole = epub.entries(epub.files(spark, f"{folder}/more"))
    drop = lambda df: [tuple(r)[1:] for r in epub.structure(df).orderBy("chapter").collect()]
    assert drop(good) == drop(whole) and len(drop(good)) > 1


def reader(folder, columns=FIELDS, kind=EpubReader, **options):
    return kind(StructType([StructField(c, StringType()) for c in columns]), {"path": str(folder), **options})


def test_no_chapter_is_unpacked_for_the_structure(folder, monkeypatch):
    opened = []
    read = zipfile.ZipFile.read
    monkeypatch.setattr(zipfile.ZipFile, "read", lambda self, name, *a: opened.append(name) or read(self, name, *a))

    def run(r):
        opened.clear()
        out = [x for p in r.partitions() for x in r.read(p)]
        return out, sum("/text/" in str(n) for n in opened)

    assert run(reader(folder))[1] == 30
    for r in (reader(folder, text="false"), reader(folder, [c for c in FIELDS if c != "content"])):
        out, unpacked = run(r)
        assert unpacked == 0 and sum(x[1] == "document" for x in out) == 30
    only = reader(folder, kind=PushingEpubReader)
    assert list(only.pushFilters([EqualTo(("kind",), "navigation"), EqualTo(("place",), 0)])) == [EqualTo(("place",), 0)]
    out, unpacked = run(only)
    assert unpacked == 0 and {x[1] for x in out} == {"navigation"}
    some = reader(folder, kind=PushingEpubReader)
    list(some.pushFilters([In(("kind",), ("book", "error"))]))
    out, unpacked = run(some)
    assert unpacked == 0 and sorted(x[1] for x in out) == ["book"] * 6 + ["error"]


def test_partitions_are_bounded_by_bytes(folder):
    size = (folder / "b0.epub").stat().st_size
    groups = [p.paths for p in reader(folder, partitionbytes=str(2 * size + 200)).partitions()]
    assert len(groups) >= 3 and sum(map(len, groups)) == 7
    assert len(reader(folder).partitions()) == 1


def test_filters_reach_the_source(spark, folder):
    old = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows = read_epub(spark, str(folder)).filter("kind = 'book'")
        assert rows.count() == 6 and {r["content"] for r in rows.collect()} == {"unbekannt", "Writer 1", "Writer 3", "Writer 5"}
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", old)


def test_missing_paths_and_columns(spark, folder, tmp_path):
    with pytest.raises(FileNotFoundError):
        reader(folder / "none").partitions()
    with pytest.raises(ValueError, match="weight"):
        reader(folder, ["path", "weight"])
    assert read_epub(spark, str(tmp_path)).count() == 0
    shutil.copy(folder / "bad.epub", tmp_path / "x.EPUB")
    assert [r["kind"] for r in read_epub(spark, str(tmp_path)).collect()] == ["error"]


def test_archive_files_are_written_where_they_are_made(spark, monkeypatch):
    monkeypatch.setattr(books, "archives", None)  # no archive leaves the task that makes it
    folder = books.archive_folder(spark, "/root/testdata/sf0.001").removeprefix("file://")
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    assert len(list(Path(folder).glob("book-*.epub"))) == pages.selectExpr(f"page_id div {books.PAGES}").distinct().count()
