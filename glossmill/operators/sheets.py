"""The printed word list of a chapter: alphabetical, at most 33 entries a sheet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmill.functions.text import casefold, escape_html
from glossmill.schema import CHAPTER

# Fixed values.
ENTRIES_PER_SHEET = 33
POS_LABELS = {"NOUN": "Subst.", "VERB": "Verb", "ADJ": "Adj.", "ADV": "Adv.", "INTJ": "Interj."}
UNCERTAIN = "unsicher"
STYLE = (
    "@page{size:A4;margin:15mm}body{font-family:sans-serif;font-size:11pt;margin:0}h1{font-size:16pt;margin:0 0 2mm}p.kapitel{margin:0 0 8mm}"
    "ul.wortliste{columns:2;column-gap:10mm;list-style:none;margin:0;padding:0}ul.wortliste li{break-inside:avoid;margin:0 0 4mm;overflow-wrap:break-word;hyphens:auto}"
    "span.wort{font-weight:bold}span.wortart,span.unsicher{font-style:italic}div.blatt{break-after:page}div.blatt:last-of-type{break-after:auto}"
)


def pos_label(pos: Column) -> Column:
    """The abbreviation of a part of speech; null for an expression, an error for what has none."""
    out = F.raise_error(F.concat(F.lit("no abbreviation for "), F.coalesce(pos, F.lit("null"))))
    for name, short in POS_LABELS.items():
        out = F.when(pos == name, F.lit(short)).otherwise(out)
    return F.when(pos == "", F.lit(None).cast("string")).otherwise(out)


def translation_html(translation: Column | None = None, uncertain: Column | None = None, lemma: Column | None = None) -> Column:
    mark = F.lit(f'<span class="unsicher">{UNCERTAIN} – kein Wörterbucheintrag</span>')
    translation, lemma = F.col("translation") if translation is None else translation, F.col("lemma") if lemma is None else lemma
    text, uncertain = escape_html(translation), F.coalesce(F.col("uncertain") if uncertain is None else uncertain, F.lit(False))
    missing = F.raise_error(F.concat(F.lit("no translation and not marked: "), lemma))
    return (
        F.when(translation.isNull() & uncertain, mark)
        .when(translation.isNull(), missing)
        .when(uncertain, F.concat(text, F.lit(f' <span class="unsicher">({UNCERTAIN})</span>')))
        .otherwise(text)
    )


def sheets(entries: DataFrame) -> DataFrame:
    """Adds sheet and place of each entry, and the chapter's number of sheets."""
    own = Window.partitionBy(*CHAPTER)
    order = own.orderBy(casefold(F.col("word_form")), "lemma", "pos")
    rows = entries.withColumn("place", F.row_number().over(order) - 1)
    rows = rows.withColumn("sheet_count", F.ceil(F.count("*").over(own) / ENTRIES_PER_SHEET).cast("int"))
    return rows.withColumns({"sheet": F.floor(F.col("place") / ENTRIES_PER_SHEET).cast("int") + 1, "place": F.col("place") % ENTRIES_PER_SHEET + 1})


def item_html(word_form: Column, pos: Column, translation: Column, uncertain: Column, lemma: Column) -> Column:
    """An entry of a sheet."""
    short = pos_label(pos)
    return F.concat(
        F.lit('<li><span class="wort">'), escape_html(word_form), F.lit("</span>"), F.coalesce(F.concat(F.lit(' <span class="wortart">('), short, F.lit(")</span>")), F.lit("")),
        F.lit(' – <span class="uebersetzung">'), translation_html(translation, uncertain, lemma), F.lit("</span></li>"),
    )


def page_html(items: Column) -> Column:
    """The printout of a chapter of the html of its entries in order: sheets are slices of the array, so that no entry is a row."""
    title, number = escape_html(F.col("book_title")), F.col("chapter").cast("string")
    count = F.ceil(F.size(items) / ENTRIES_PER_SHEET).cast("int")

    def sheet(i: Column) -> Column:
        label = F.when(count > 1, F.concat(F.lit(" – Blatt "), i.cast("string"), F.lit(" von "), count.cast("string"))).otherwise(F.lit(""))
        own = F.array_join(F.slice(items, (i - 1) * ENTRIES_PER_SHEET + 1, F.lit(ENTRIES_PER_SHEET)), "\n")
        return F.concat(F.lit('<div class="blatt">\n<h1>'), title, F.lit('</h1>\n<p class="kapitel">Kapitel '), number, label, F.lit('</p>\n<ul class="wortliste">\n'), own, F.lit("\n</ul>\n</div>"))

    head = F.concat(F.lit('<!DOCTYPE html>\n<html lang="de">\n<head>\n<meta charset="utf-8">\n<title>'), title, F.lit(" — Kapitel "), number, F.lit(f"</title>\n<style>{STYLE}</style>\n</head>\n<body>\n"))
    return F.concat(head, F.array_join(F.transform(F.sequence(F.lit(1), count), sheet), "\n"), F.lit("\n</body>\n</html>\n"))


def pages(entries: DataFrame) -> DataFrame:
    """html of each chapter's printout."""
    item = item_html(*(F.col(c) for c in ("word_form", "pos", "translation", "uncertain", "lemma")))
    listed = F.sort_array(F.collect_list(F.struct("sheet", "place", item.alias("html"))))
    joined = sheets(entries).groupBy(*CHAPTER).agg(listed.alias("_e")).withColumn("_items", F.transform("_e", lambda x: x["html"]))
    return joined.select(*CHAPTER, page_html(F.col("_items")).alias("html"))


def write_printout(entries: DataFrame, path: str) -> None:
    """One chapter's printout as a local file; no entry, or several chapters, is an error."""
    rows = pages(entries).limit(2).collect()
    if not rows:
        raise ValueError("a printout without words")
    if len(rows) > 1:
        raise ValueError("a printout is the list of one chapter")
    with open(path, "w", encoding="utf-8") as out:
        out.write(rows[0]["html"])
