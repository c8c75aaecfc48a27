"""Queries over sources and the profile: EPUB archives, plain-text books, SQLite dictionaries, a learner's tables.

Archives and files are made of the driver's tables first, in the shape that the sources read.
"""

from __future__ import annotations

import io
import os
import sqlite3
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import closing

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.functions import text as T
from glossmill.operators import cards, preset, profile
from glossmill.plans import standins as S
from glossmill.plans.catalogue import FLOW_SQL, _card_parts, _word_list
from glossmill.plans.registry import ORACLE_SQL, query
from glossmill.schema import CHAPTER, SENSE, sense_key
from glossmill.sources import epub, tables
from glossmill.sources.epub_source import read_epub
from glossmill.sources.staging import shared_folder, staged

_C = "book_title, book_author, chapter"
#: Pages that make a book.
PAGES = 5


def _archive(book: int, pages: list[str], faults: bool = False) -> bytes:
    """Books of three kinds by their number: EPUB 3 navigation with nested and repeated targets, NCX, or no navigation.

    With faults, some pages by their number are locked, missing, in another encoding, or damaged.
    """
    names = [f"text/page%20{i}.xhtml" for i in range(len(pages))]
    manifest = "".join(f'<item id="p{i}" href="{n}"/>' for i, n in enumerate(names))
    spine = "".join(f'<itemref idref="p{i}"/>' for i in range(len(names)))
    kind, extra, toc = book % 3, {}, ""
    # The first page is front matter, and each second page from then on begins a chapter.
    starts = list(range(1, len(names), 2))
    if kind == 0 and starts:
        manifest += '<item id="nav" href="nav.xhtml" properties="nav"/>'
        items = "".join(f'<li><a href="{names[i]}#top"> Part\n {i} </a><ol><li><a href="{names[i]}#inner">again</a></li></ol></li>' for i in starts)
        extra["OPS/nav.xhtml"] = f'<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="toc"><ol>{items}</ol></nav></body></html>'
    elif kind == 1 and starts:
        manifest += '<item id="ncx" href="toc.ncx"/>'
        toc = ' toc="ncx"'
        points = "".join(f'<navPoint><navLabel><text>Part {i}</text></navLabel><content src="{names[i]}"/></navPoint>' for i in starts)
        extra["OPS/toc.ncx"] = f'<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap>{points}</navMap></ncx>'
    creator = f"<dc:creator>Writer {book}</dc:creator>" if book % 2 else ""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>')
        z.writestr(
            "OPS/book.opf",
            f'<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>Book {book}</dc:title>{creator}</metadata>'
            f"<manifest>{manifest}</manifest><spine{toc}>{spine}</spine></package>",
        )
        state = lambda i: FAULTS[(3 * book + i) % len(FAULTS)] if faults else "ok"
        locked = "".join(f'<enc:CipherReference URI="OPS/text/page%20{i}.xhtml"/>' for i in range(len(pages)) if state(i) == "encrypted")
        if locked:
            extra["META-INF/encryption.xml"] = f'<encryption xmlns:enc="http://www.w3.org/2001/04/xmlenc#">{locked}</encryption>'
        for i, page in enumerate(pages):
            if state(i) == "corrupt":
                page = MARK
            if state(i) != "missing":
                z.writestr(f"OPS/text/page {i}.xhtml", (page + "é").encode("latin-1", "replace") if state(i) == "not_utf8" else page)
        for name, text in extra.items():
            z.writestr(name, text)
    return out.getvalue().replace(MARK.encode(), MARK.lower().encode())  # stored without compression: its check sum is wrong then


#: What a page of an archive with faults is, by its number, and the text of a damaged one before it is damaged.
FAULTS, MARK = ("ok", "ok", "encrypted", "missing", "not_utf8", "corrupt", "ok"), "A PAGE WHOSE BYTES CHANGE AFTER ITS SUM IS TAKEN"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "pages").select(F.expr(f"page_id div {PAGES}").alias("book"), "page_id", F.coalesce("html", F.lit("")).alias("html"))


def archives(spark: SparkSession, sf_dir: str, faults: bool = False) -> DataFrame:
    """path and content of EPUB books, each of up to PAGES pages in the order of their ids."""
    def pack(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        book = int(key[0])
        return pd.DataFrame({"path": [f"book-{book:08d}"], "content": [_archive(book, own.sort_values("page_id")["html"].tolist(), faults)]})

    return _pages(spark, sf_dir).groupBy("book").applyInPandas(pack, "path string, content binary")


_PLACES = f"""{FLOW_SQL},
    placed AS (SELECT f.page_id // {PAGES} AS book, f.text, row_number() OVER (PARTITION BY f.page_id // {PAGES} ORDER BY f.page_id) - 1 AS place, count(*) OVER (PARTITION BY f.page_id // {PAGES}) AS n FROM flowing f),
    marked AS (SELECT *, book % 3 < 2 AND n > 1 AS navigated FROM placed),
    parts AS (SELECT *, CASE WHEN navigated THEN (place + 1) // 2 ELSE place + 1 END AS chapter FROM marked)"""


@query(
    f"""{_PLACES} SELECT format('book-{{:08d}}', book) AS path, concat('Book ', book) AS book_title, CASE WHEN book % 2 = 1 THEN concat('Writer ', book) ELSE 'unbekannt' END AS book_author,
    chapter::int AS chapter, CASE WHEN any_value(navigated) THEN concat('Part ', min(place)) ELSE concat('Kapitel ', chapter) END AS title,
    string_agg(concat('OPS/text/page ', place, '.xhtml'), ' | ' ORDER BY place) AS documents, 0 AS level, NOT any_value(navigated) AS has_notice FROM parts WHERE chapter > 0 GROUP BY book, chapter"""
)
def epub_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = epub.structure(epub.entries(archives(spark, sf_dir), with_text=False))
    return rows.select("path", "book_title", "book_author", "chapter", "title", F.array_join("documents", " | ").alias("documents"), "level", F.col("notice").isNotNull().alias("has_notice"))


@query(
    f"""{_PLACES} SELECT format('book-{{:08d}}', book) AS path, concat('OPS/text/page ', place, '.xhtml') AS document,
    ['{"', '".join(FAULTS)}'][(3 * book + place) % {len(FAULTS)} + 1] AS status, CASE WHEN ['{"', '".join(FAULTS)}'][(3 * book + place) % {len(FAULTS)} + 1] = 'ok' THEN len(regexp_extract_all(text, {S.WORD_SQL}))::int END AS words FROM placed"""
)
def epub_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of archives of which some are locked, missing, damaged or in another encoding."""
    rows = epub.entries(archives(spark, sf_dir, faults=True)).filter("kind = 'document'")
    return rows.select("path", "document", "status", T.word_count(F.col("content")).alias("words"))


@query("SELECT page_id::varchar AS path, concat(sha256(coalesce(html, '')), '-model-1') AS cache_key FROM pages")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of shares of names, if each page were a book's file."""
    files = S.table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.coalesce("html", F.lit("")).cast("binary").alias("content"))
    return tables.ratio_key(files, "model", "1").select("path", "cache_key")


def archive_folder(spark: SparkSession, sf_dir: str) -> str:
    """The archives as files in the shared folder, each written where it is made, so that no archive goes on; a file takes its name when it is whole."""
    folder = f"{shared_folder(spark)}/archives-{uuid.uuid4().hex}"

    def write(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        system, root = fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)
        system.create_dir(root, recursive=True)
        book = int(key[0])
        name = f"book-{book:08d}"
        hidden = f"{root}/.{name}-{uuid.uuid4().hex}"
        with system.open_output_stream(hidden) as out:
            out.write(_archive(book, own.sort_values("page_id")["html"].tolist()))
        system.move(hidden, f"{root}/{name}.epub")
        return pd.DataFrame({"n": [1]})

    _pages(spark, sf_dir).groupBy("book").applyInPandas(write, "n long").agg(F.sum("n")).collect()
    return folder


@query(ORACLE_SQL["epub_structure"])
def epub_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The structure of books that lie in files, by the data source, which unpacks no chapter for it."""
    rows = epub.structure(read_epub(spark, archive_folder(spark, sf_dir), with_text=False))
    return rows.select(F.regexp_extract("path", r"([^/]*)\.epub$", 1).alias("path"), "book_title", "book_author", "chapter", "title", F.array_join("documents", " | ").alias("documents"), "level", F.col("notice").isNotNull().alias("has_notice"))


_EPUB_TEXTS = f"""{_PLACES}, texts AS (SELECT book, chapter, regexp_replace(string_agg(text, chr(10) ORDER BY place), '^\\s+|\\s+$', '', 'g') AS text FROM parts WHERE chapter > 0 GROUP BY book, chapter)"""


@query(f"{_EPUB_TEXTS} SELECT concat('Book ', book) AS book_title, chapter::int AS chapter, text FROM texts")
def epub_chapter_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return epub.chapter_texts(staged(epub.entries(archives(spark, sf_dir)), "epub")).select("book_title", "chapter", "text")


@query(f"{_EPUB_TEXTS} SELECT format('book-{{:08d}}', book) AS path, chapter::int AS chapter, len(regexp_extract_all(text, {S.WORD_SQL}))::int AS words FROM texts")
def epub_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return epub.chapter_word_counts(staged(epub.entries(archives(spark, sf_dir)), "epub")).select("path", "chapter", "words")


@query(
    f"""{_PLACES} SELECT format('book-{{:08d}}', book) AS path, CASE WHEN NOT any_value(navigated) THEN 0 WHEN book % 3 = 0 THEN 2 * (count(*) // 2) ELSE count(*) // 2 END AS entries,
    CASE WHEN any_value(navigated) THEN count(*) // 2 ELSE 0 END AS targets, count(*) AS documents, 0 AS failures, sum(len(regexp_extract_all(text, {S.WORD_SQL})))::bigint AS words FROM parts GROUP BY book"""
)
def epub_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return epub.health(epub.entries(archives(spark, sf_dir)))


def _plain_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation as a plain-text book: a turn a chapter, with a heading of its role, between the project's marks."""
    rows = S.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    part = F.transform("t", lambda x: F.concat(F.lit("CHAPTER "), F.element_at(F.array(*map(F.lit, ("I", "V", "X"))), (F.pmod(F.length(x["role"]), F.lit(3)) + 1).cast("int")), F.lit(".\n\n"), F.coalesce(x["text"], F.lit("")), F.lit("\n")))
    text = F.concat(F.lit("*** START OF THE PROJECT GUTENBERG EBOOK X ***\nfront\n"), F.array_join(part, "\n"), F.lit("\n*** END OF THE PROJECT GUTENBERG EBOOK X ***\nlicense"))
    return rows.select("conv_id", T.without_boilerplate(F.concat(F.lit("noise\n"), text)).alias("text"))


@query(
    r"""SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text)::int AS chapter, concat('CHAPTER ', ['I', 'V', 'X'][length(role) % 3 + 1], '.') AS title,
    regexp_replace(regexp_replace(coalesce(text, ''), '\r\n|\r', chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM conversations"""
)
def plain_book_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.split_chapters(_plain_books(spark, sf_dir), ["conv_id"]).select("conv_id", "chapter", "title", "text")


def sqlite_folder(spark: SparkSession, rows: DataFrame) -> str:
    """The dictionary as SQLite files in a folder of the shared one, each with a part of the headwords and written by one task; a file takes its name when it is whole."""
    folder = shared_folder(spark)
    if not folder.startswith(("file:", "/")):
        raise ValueError("SQLite files need a shared folder that is mounted")
    path = f"{folder.removeprefix('file://').removeprefix('file:')}/dictionary-{uuid.uuid4().hex}"

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(path, exist_ok=True)
        name, n = uuid.uuid4().hex, 0
        with closing(sqlite3.connect(f"{path}/{name}.part")) as con:
            con.execute("CREATE TABLE translation (lexentry, sense_num, sense, written_rep TEXT, trans_list, score, is_good, importance)")
            for part in parts:
                rows = part.astype(object).where(part.notna(), None).itertuples(index=False, name=None)
                con.executemany("INSERT INTO translation VALUES (?, NULL, ?, ?, ?, ?, NULL, ?)", rows)
                n += len(part)
            con.commit()
        yield pd.DataFrame({"file": [name], "n": [n]})

    # A file counts only once its task has ended well, so that what a lost or repeated task leaves is not read.
    done = rows.select("lexentry", "sense", "written_rep", "trans_list", "score", "importance").repartition("written_rep").mapInPandas(write, "file string, n long").collect()
    for r in done:
        os.replace(f"{path}/{r['file']}.part", f"{path}/{r['file']}.sqlite3")
    return path


@query(f"WITH {S.DICTIONARY_SQL} SELECT lexentry, sense, written_rep, trans_list, score, importance::double AS importance FROM dictionary")
def sqlite_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables.checked_dictionary(tables.sqlite_dictionary(spark, sqlite_folder(spark, S.dictionary(spark, sf_dir))), 1)
    return found.select("lexentry", "sense", "written_rep", "trans_list", "score", "importance")


@query("SELECT page_id, url, url_decode(url) AS decoded FROM pages")
def decoded_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "pages").select("page_id", "url", T.percent_decoded(F.col("url")).alias("decoded"))


_PROPER = "content AS (SELECT * FROM tokens WHERE is_alpha AND pos NOT IN ('DET', 'PRON'))"


@query(f"WITH {S.TOKENS_SQL}, {_PROPER} SELECT book_title, book_author, lemma, avg(CASE WHEN pos = 'PROPN' THEN 1.0 ELSE 0.0 END) AS ratio FROM content GROUP BY ALL")
def ratio_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made once and read from the cache the second time."""
    from glossmill.operators import vocabulary

    folder, made = f"{shared_folder(spark)}/ratios-{uuid.uuid4().hex}", []

    def make() -> DataFrame:
        made.append(1)
        return vocabulary.proper_noun_ratios(S.tokens(spark, sf_dir))

    tables.cached_ratios(spark, folder, "key", make)
    found = tables.cached_ratios(spark, folder, "key", make)
    if len(made) != 1:
        raise ValueError("the cache was made twice")
    return found.select("book_title", "book_author", "lemma", "ratio")


@query(
    f"""WITH {S.EVENTS_SQL}, h AS (SELECT *, {S.number_sql("concat('f', event_id)")} % 12 AS h, user_id % 7 AS own FROM log)
    SELECT event_id, CASE h WHEN 0 THEN 'state' WHEN 1 THEN 'origin' WHEN 2 THEN 'time' WHEN 3 THEN 'place' WHEN 4 THEN 'place' WHEN 5 THEN 'chapter' ELSE CASE WHEN own = 6 AND h > 6 THEN 'chapter' END END AS fault FROM h"""
)
def event_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of which some break a rule, with the rule; the profile has chapters 0 to 5 of a book."""
    h = F.pmod(S.number(F.concat(F.lit("f"), F.col("event_id").cast("string"))), F.lit(12))
    own = F.pmod("user_id", F.lit(7)).cast("int")
    rows = S.events(spark, sf_dir).withColumns({
        "state": F.when(h == 0, "forgot").otherwise(F.col("state")), "origin": F.when(h == 1, F.lit(None)).otherwise(F.lit("triage")), "timestamp": F.when(h == 2, F.lit(None)).otherwise(F.col("timestamp")),
        "book_title": F.when((h == 3) | (h == 6), F.lit(None)).otherwise(F.lit("Book")), "book_author": F.lit("Writer"), "chapter": F.when((h == 4) | (h == 6), F.lit(None)).when(h == 5, 9).otherwise(own),
    })
    chapters = spark.range(6).select(F.lit("Book").alias("book_title"), F.lit("Writer").alias("book_author"), F.col("id").cast("int").alias("chapter"))
    return profile.event_faults(rows, chapters).select("event_id", "fault")


def _profile(spark: SparkSession) -> profile.Profile:
    return profile.Profile(spark, f"{shared_folder(spark)}/profile-{uuid.uuid4().hex}")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of all learners as one log, with an origin and a chapter for each third one."""
    named = F.pmod("event_id", F.lit(3)) == 0
    return S.events(spark, sf_dir).select(
        *SENSE, "state", F.lit("triage").alias("origin"), "timestamp", F.when(named, F.lit("Book")).alias("book_title"), F.when(named, F.lit("Writer")).alias("book_author"),
        F.when(named, F.pmod("user_id", F.lit(7)).cast("int")).alias("chapter"),
    )


_LOG = f"""WITH {S.EVENTS_SQL}, full_log AS (SELECT *, CASE WHEN (lexentry[7:])::int % 2 = 0 THEN '' END AS sense, event_id % 3 = 0 AS named, user_id % 7 AS chapter FROM log)"""


@query(
    f"""{_LOG} SELECT 'book' AS name, count(DISTINCT 'Book') AS n FROM full_log WHERE named UNION ALL SELECT 'chapter', count(DISTINCT chapter) FROM full_log WHERE named
    UNION ALL SELECT 'lemma', count(DISTINCT (lemma, pos)) FROM full_log UNION ALL SELECT 'sense', count(DISTINCT (lemma, pos, lexentry, coalesce(sense, ''))) FROM full_log
    UNION ALL SELECT 'occurrence', count(DISTINCT (chapter, lemma, pos)) FROM full_log WHERE named UNION ALL SELECT 'event', 2 * count(*) FROM full_log
    UNION ALL SELECT 'card', count(*) FROM (SELECT DISTINCT source, doc_id, lower(unnest(regexp_extract_all(text, {S.WORD_SQL}))) FROM documents) UNION ALL SELECT 'learner', 1"""
)
def profile_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything is written twice: what has a natural key stays as it is, and events are appended."""
    own, log = _profile(spark), staged(_log(spark, sf_dir), "log")
    # Texts are dealt by chapter, so that no card moves; chapters of one row and of several are written one after the other, as each part is dealt so.
    decks = [x.select(*CHAPTER, "lemma", "pos", "lexentry", "sense", "card_direction").withColumn("guid", cards.guid()) for x in _card_parts(spark, sf_dir, examples=False, dealt=True)]
    named = log.filter("chapter is not null")
    for _ in range(2):
        own.ensure_books(named)
        own.ensure_chapters(named)
        own.ensure_lemmas(log)
        own.ensure_senses(log)
        own.ensure_occurrences(named.select(*CHAPTER, "lemma", "pos").distinct())
        own.record_events(log)
        for deck in decks:
            own.record_cards(deck)
        own.set_cefr_level("b1")
    if own.cefr_level() != "b1":
        raise ValueError("the level isn't what was stored")
    out = None
    for name in profile.TABLES:
        rows = own.read(name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    f"""{_LOG}, known AS (SELECT lemma, pos, lexentry FROM log GROUP BY ALL HAVING arg_max(state, (ts, event_id)) = 'known')
    SELECT lemma, lexentry, coalesce(sense, '') AS sense, state, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS at, named AS in_chapter FROM full_log SEMI JOIN known USING (lemma, pos, lexentry)"""
)
def event_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events of the senses that are known now, from the profile, in order."""
    own, log = _profile(spark), _log(spark, sf_dir)
    own.ensure_chapters(log.filter("chapter is not null"))
    own.record_events(log)
    events = own.events()
    known = profile.latest_states(S.events(spark, sf_dir).withColumns(dict(zip(SENSE, sense_key(), strict=True)))).filter("state = 'known'")
    return profile.history(events, known).select("lemma", "lexentry", "sense", "state", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), F.col("chapter").isNotNull().alias("in_chapter"))


@query(
    f"""{_LOG} SELECT DISTINCT sha256(array_to_string(list_transform([lemma, pos, lexentry, coalesce(sense, ''), ''], lambda x: concat(length(x), ':', x)), '')) AS id, lemma, pos, lexentry, coalesce(sense, '') AS sense FROM full_log"""
)
def profile_senses(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _profile(spark)
    own.ensure_senses(_log(spark, sf_dir))
    return own.read("sense").select("id", "lemma", "pos", "lexentry", "sense")


@query(ORACLE_SQL["preset_counts"])
def preset_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of presets that a profile has been given, one after another; every event of it says known."""
    own, words = _profile(spark), _word_list(spark, sf_dir)
    out = None
    for level in preset.LEVEL_SIZES:
        counts = preset.write_preset(own, words, S.dictionary(spark, sf_dir), level, "2024-01-01 00:00:00").withColumn("level", F.lit(level))
        out = counts if out is None else out.unionByName(counts)
    if not own.events().filter("state <> 'known' or origin <> 'preset'").isEmpty():
        raise ValueError("a preset wrote other events")
    return out


@query(
    f"""WITH forms AS (SELECT unnest(regexp_extract_all(text, {S.WORD_SQL})) AS form FROM documents), counted AS (SELECT form, count(*) AS n FROM forms GROUP BY ALL),
    listed AS (SELECT form, row_number() OVER (ORDER BY n DESC, form) AS rank FROM counted), best AS (SELECT lower(form) AS lemma, min(rank) AS best FROM listed WHERE regexp_matches(form, '^\\p{{L}}+$') GROUP BY ALL)
    SELECT lemma, rank FROM (SELECT lemma, row_number() OVER (ORDER BY best, lemma) AS rank FROM best) WHERE rank <= 5000"""
)
def built_word_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5,000 first lemmas of a list of forms by frequency; the list's length is its feature."""
    forms = S.table(spark, sf_dir, "documents").select(F.explode(T.words(F.col("text"))).alias("form")).groupBy("form").agg(F.count("*").alias("n"))
    listed = forms.withColumn("rank", F.struct((-F.col("n")).alias("n"), "form"))
    return preset.build_word_list(listed, forms.select("form", F.lower("form").alias("lemma")), 5000).select("lemma", F.col("rank").cast("long").alias("rank"))
