"""EPUB books as tables: archive entries, navigation, chapters, and their text.

A book's archive is opened once by a table function that yields narrow rows (package facts, spine, navigation,
documents with their status); everything after that is DataFrame operations over many books at once.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Collection, Iterator
from typing import BinaryIO
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossmill.functions.text import flow, without_boilerplate, word_count
from glossmill.schema import CHAPTERS

# Fixed values.
NAVIGATION_MISSING = "Das Buch sagt nicht, wo seine Kapitel beginnen; jedes Dokument zählt hier als eines."
UNKNOWN_AUTHOR = "unbekannt"
FALLBACK_TITLE = "Kapitel "
OPF, DC, XHTML, EPUB, NCX, CONTAINER, ENC = (
    "http://www.idpf.org/2007/opf", "http://purl.org/dc/elements/1.1/", "http://www.w3.org/1999/xhtml", "http://www.idpf.org/2007/ops",
    "http://www.daisy.org/z3986/2005/ncx/", "urn:oasis:names:tc:opendocument:xmlns:container", "http://www.w3.org/2001/04/xmlenc#",
)

ENTRIES = "path string, kind string, place int, document string, label string, level int, status string, content string"


def _resolved(base: str, href: str) -> str:
    """A link's target in the archive: the fragment goes first, then the percent signs."""
    return posixpath.normpath(posixpath.join(base, unquote(href.split("#", 1)[0])))


def _squeezed(text: str) -> str:
    return " ".join(text.split())


class Package:
    """One archive's package file and what it points to."""

    def __init__(self, archive: zipfile.ZipFile):
        self.archive, self.names = archive, set(archive.namelist())
        if "META-INF/container.xml" not in self.names:
            raise ValueError("no META-INF/container.xml")
        container = ElementTree.fromstring(archive.read("META-INF/container.xml"))
        paths = [x.get("full-path") for x in container.iter(f"{{{CONTAINER}}}rootfile")]
        self.opf = next((p for p in paths if p in self.names), None)
        if self.opf is None:
            raise ValueError("no package file")
        self.root = ElementTree.fromstring(archive.read(self.opf))
        self.base = posixpath.dirname(self.opf)
        self.items = {x.get("id"): x for x in self.root.iterfind(f"{{{OPF}}}manifest/{{{OPF}}}item") if x.get("id") and x.get("href")}

    def place(self, item_id: str | None) -> str | None:
        return _resolved(self.base, self.items[item_id].get("href")) if item_id in self.items else None

    def first_text(self, tag: str) -> str | None:
        texts = ((x.text or "").strip() for x in self.root.iterfind(f"{{{OPF}}}metadata/{{{DC}}}{tag}"))
        return next((x for x in texts if x), None)

    def spine(self) -> list[str]:
        refs = (x.get("idref") for x in self.root.iterfind(f"{{{OPF}}}spine/{{{OPF}}}itemref"))
        return [p for p in map(self.place, refs) if p]

    def navigation(self) -> list[tuple[str, str, int]]:
        """(label, document, level): EPUB 3 navigation, else the NCX of EPUB 2."""
        nav = next((k for k, x in self.items.items() if "nav" in (x.get("properties") or "").split()), None)
        spine = self.root.find(f"{{{OPF}}}spine")
        out: list[tuple[str, str, int]] = []
        for place, reader in ((self.place(nav), self._nav), (self.place(spine.get("toc") if spine is not None else None), self._ncx)):
            if not out and place in self.names:
                raw = reader(ElementTree.fromstring(self.archive.read(place)))
                out = [(label, _resolved(posixpath.dirname(place), href), level) for label, href, level in raw if label and href.split("#", 1)[0]]
        return out

    @staticmethod
    def _nav(root: ElementTree.Element) -> Iterator[tuple[str, str, int]]:
        toc = next((x for x in root.iter(f"{{{XHTML}}}nav") if "toc" in (x.get(f"{{{EPUB}}}type") or "").split()), None)
        lists = (f"{{{XHTML}}}ol", f"{{{XHTML}}}ul")

        def below(node: ElementTree.Element, depth: int) -> Iterator[tuple[str, str, int]]:
            for child in node:
                if child.tag == f"{{{XHTML}}}a":
                    yield _squeezed("".join(child.itertext())), child.get("href") or "", max(0, depth - 1)
                yield from below(child, depth + (child.tag in lists))

        if toc is not None:
            yield from below(toc, 0)

    @staticmethod
    def _ncx(root: ElementTree.Element) -> Iterator[tuple[str, str, int]]:
        def below(node: ElementTree.Element | None, level: int) -> Iterator[tuple[str, str, int]]:
            for point in node.iterfind(f"{{{NCX}}}navPoint") if node is not None else ():
                label, content = point.find(f"{{{NCX}}}navLabel/{{{NCX}}}text"), point.find(f"{{{NCX}}}content")
                if label is not None and content is not None:
                    yield _squeezed(label.text or ""), content.get("src") or "", level
                yield from below(point, level + 1)

        yield from below(root.find(f"{{{NCX}}}navMap"), 0)

    def encrypted(self) -> set[str] | None:
        """Documents under copy protection; fonts may be. None if the list itself is damaged."""
        if "META-INF/encryption.xml" not in self.names:
            return set()
        try:
            root = ElementTree.fromstring(self.archive.read("META-INF/encryption.xml"))
        except ElementTree.ParseError:
            return None
        return {unquote(x.get("URI") or "") for x in root.iter(f"{{{ENC}}}CipherReference")}

    def document(self, name: str, protected: set[str] | None) -> tuple[str, str | None]:
        """Status and flowing text: ok, encrypted, missing, corrupt or not_utf8."""
        if protected is None:
            return "corrupt", None
        if name in protected:
            return "encrypted", None
        if name not in self.names:
            return "missing", None
        try:
            return "ok", flow(self.archive.read(name).decode("utf-8"))
        except RuntimeError:
            return "encrypted", None
        except zipfile.BadZipFile:
            return "corrupt", None
        except UnicodeDecodeError:
            return "not_utf8", None


KINDS = ("book", "document", "navigation", "error")


def entries_of(path: str, archive: BinaryIO, with_text: bool, kinds: Collection[str] = KINDS) -> Iterator[tuple]:
    """Rows of the given kinds; of the archive only what they need is read, and a document is unpacked for its text alone."""
    try:
        package = Package(zipfile.ZipFile(archive))
        spine, title = package.spine(), package.first_text("title")
    except (zipfile.BadZipFile, ElementTree.ParseError, ValueError) as e:
        problem = f"no EPUB: {e}"
    else:
        problem = "no spine" if not spine else "no title" if title is None else None
    if problem:
        if "error" in kinds:
            yield path, "error", 0, None, None, None, problem, None
        return
    if "book" in kinds:
        yield path, "book", 0, None, title, None, "ok", package.first_text("creator") or UNKNOWN_AUTHOR
    protected = package.encrypted() if with_text and "document" in kinds else set()
    for place, name in enumerate(spine if "document" in kinds else ()):
        status, text = package.document(name, protected) if with_text else ("ok" if name in package.names else "missing", None)
        yield path, "document", place, name, None, None, status, text
    for place, (label, name, level) in enumerate(package.navigation() if "navigation" in kinds else ()):
        yield path, "navigation", place, name, label, level, "ok" if name in package.names else "missing", None


def entries(files: DataFrame, with_text: bool = True) -> DataFrame:
    """Rows of kind book, document, navigation or error of files(path, content)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in ENTRIES.split(", ")]
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                yield pd.DataFrame(list(entries_of(path, io.BytesIO(content), with_text)), columns=names).astype({"place": "Int32", "level": "Int32"})

    return files.select("path", "content").mapInPandas(run, ENTRIES)


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def structure(rows: DataFrame) -> DataFrame:
    """path, book, chapter, title, documents, level, notice: a chapter runs from a navigation target to the next one.

    Documents before the first target belong to none. Without a target in the archive, each document there is a
    chapter, with a notice. An archive that isn't a readable book ends the job.
    """
    bad = F.raise_error(F.concat(F.col("path"), F.lit(": "), F.col("status")))
    books = rows.filter("kind in ('book', 'error')").select("path", F.when(F.col("kind") == "error", bad).otherwise(F.col("label")).alias("book_title"), F.col("content").alias("book_author"))
    targets = rows.filter("kind = 'navigation'").groupBy("path", "document").agg(F.min_by(F.struct("label", "level"), "place").alias("nav"), F.bool_or(F.col("status") == "ok").alias("there"))
    spine = rows.filter("kind = 'document'").select("path", "place", "document", (F.col("status") != "missing").alias("exists")).join(targets, ["path", "document"], "left")
    own = Window.partitionBy("path")
    order = own.orderBy("place")
    spine = spine.withColumn("navigated", F.coalesce(F.bool_or("there").over(own), F.lit(False)))
    begins = F.when(F.col("navigated"), F.col("nav").isNotNull()).otherwise(F.col("exists"))
    spine = spine.withColumn("chapter", F.sum(F.when(begins, 1).otherwise(0)).over(order).cast("int"))
    kept = spine.filter((F.col("chapter") > 0) & (F.col("navigated") | F.col("exists")))
    listed = F.sort_array(F.collect_list(F.struct("place", "document", "nav")))
    chapters = kept.groupBy("path", "chapter", "navigated").agg(listed.alias("d"))
    return books.join(chapters, "path", "left").select(
        "path", "book_title", "book_author",
        F.when(F.col("chapter").isNull(), F.raise_error(F.concat(F.col("path"), F.lit(": no chapters")))).otherwise(F.col("chapter")).alias("chapter"),
        F.when(F.col("navigated"), F.col("d")[0]["nav"]["label"]).otherwise(F.concat(F.lit(FALLBACK_TITLE), F.col("chapter").cast("string"))).alias("title"),
        F.transform("d", lambda x: x["document"]).alias("documents"),
        F.when(F.col("navigated"), F.col("d")[0]["nav"]["level"]).otherwise(F.lit(0)).alias("level"),
        F.when(~F.col("navigated"), F.lit(NAVIGATION_MISSING)).alias("notice"),
    )


def _texts(rows: DataFrame, chapters: DataFrame) -> DataFrame:
    """Adds the chapter's text without boilerplate (null if a document can't be read) and the first bad status."""
    parts = chapters.select("path", "chapter", F.posexplode("documents").alias("at", "document"))
    documents = rows.filter("kind = 'document'").select("path", "document", "status", "content").dropDuplicates(["path", "document"])
    joined = parts.join(documents, ["path", "document"], "left")
    listed = F.sort_array(F.collect_list(F.struct("at", "document", "status", "content")))
    agg = joined.groupBy("path", "chapter").agg(listed.alias("d"))
    bad = F.get(F.filter("d", lambda x: x["status"] != "ok"), F.lit(0))
    text = without_boilerplate(F.array_join(F.transform("d", lambda x: x["content"]), "\n"))
    return chapters.join(agg.select("path", "chapter", F.when(bad.isNull(), text).alias("text"), bad.alias("bad")), ["path", "chapter"], "left")


def chapter_texts(rows: DataFrame, chapters: DataFrame | None = None) -> DataFrame:
    """Chapters with their text; one that can't be read, or has no word, ends the job."""
    own = _texts(rows, chapters if chapters is not None else structure(rows))
    unreadable = F.raise_error(F.concat(F.col("path"), F.lit(": "), F.coalesce(F.concat(F.col("bad")["document"], F.lit(" is "), F.col("bad")["status"]), F.lit("no text"))))
    empty = F.raise_error(F.concat(F.col("path"), F.lit(": no text in chapter "), F.col("chapter").cast("string")))
    text = F.when(F.col("text").isNull(), unreadable).when(word_count(F.col("text")) == 0, empty).otherwise(F.col("text"))
    return own.withColumn("text", text).select(*CHAPTERS.fieldNames())


def chapter_word_counts(rows: DataFrame) -> DataFrame:
    """words of each chapter: null where it can't be read, 0 where it is empty."""
    return _texts(rows, structure(rows)).select("path", "chapter", "title", "level", word_count(F.col("text")).alias("words"))


def health(rows: DataFrame) -> DataFrame:
    """Per book: navigation entries, distinct targets, documents, and documents that can't be read."""
    return rows.groupBy("path").agg(
        F.count_if(F.col("kind") == "navigation").alias("entries"), F.count_distinct(F.when(F.col("kind") == "navigation", F.col("document"))).alias("targets"),
        F.count_if(F.col("kind") == "document").alias("documents"), F.count_if((F.col("kind") == "document") & (F.col("status") != "ok")).alias("failures"),
        F.sum(F.when(F.col("kind") == "document", word_count(F.col("content")))).alias("words"),
    )
