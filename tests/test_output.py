from __future__ import annotations

import hashlib
import io
import json
import threading
import zipfile
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from glossmill.operators import cards, choice, sheets
from glossmill.operators.profile import Profile
from glossmill.plans import client
from glossmill.sources import epub, tables

CARD = "book_title string, book_author string, chapter int, lemma string, pos string, word_form string, example_sentence string, lexentry string, sense string, translation string, uncertain boolean, card_direction string"


def card(word="plum", sentence="Two plums, one plumber: a plum!", translation="Pflaume", uncertain=False, direction="en_de", pos="NOUN", lemma=None, chapter=1):
    return ("B & C", "An Author", chapter, lemma or word, pos, word, sentence, "e", None, translation, uncertain, direction)


def of(spark, *rows):
    return spark.createDataFrame(list(rows), CARD)


def test_cloze_needs_a_word_of_its_own(spark):
    got = cards.notes(of(spark, card(direction="cloze"))).first()
    assert got["fields"][0] == "Two plums, one plumber: a {{c1::plum}}!" and len(got["fields"]) == 6
    rows = of(spark, card("heart", "a heart-broken girl’s", direction="cloze"), card("x", "x", None, True, "de_en"), card("x", "x", "y"), card("a.b", "a.b axb", direction="cloze"))
    assert [r[0] is None for r in rows.select(cards.obstacle()).collect()] == [False, False, True, True]
    with pytest.raises(Exception, match="gap"):
        cards.notes(of(spark, card("heart", "heart-broken", direction="cloze"))).collect()


def test_translation_cases_and_tags(spark):
    got = cards.notes(of(spark, card(translation=None, uncertain=True, pos=""))).first()
    assert got["fields"][1] == cards.UNCERTAIN_TEXT and got["fields"][3] == "MWE" and got["fields"][5] == "B &amp; C"
    assert got["tags"] == ["buch::B_&_C", "autor::An_Author", "kapitel::1", "unsicher"]
    for bad in (card(translation=None), card(translation=None, uncertain=True, direction="de_en")):
        with pytest.raises(Exception, match="no translation"):
            cards.notes(of(spark, bad)).collect()


def test_guid_depends_on_identity_alone(spark):
    base, other = of(spark, card()), of(spark, card(sentence="another plum", translation="x", uncertain=True))
    guid = lambda df: df.select(cards.guid()).first()[0]
    assert guid(base) == guid(other)
    changed = [guid(base.withColumn(k, F.lit(v))) for k, v in (("lemma", "x"), ("pos", "VERB"), ("sense", "s"), ("lexentry", "f"), ("card_direction", "cloze"), ("chapter", 2), ("book_title", "T"))]
    assert len({guid(base), *changed}) == 8


def test_deck_id_is_that_of_the_name(spark):
    for name in ("Deck", "Ä – 1", ""):
        want = int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "big") % (1 << 63)
        assert spark.range(1).select(cards.deck_id(F.lit(name))).first()[0] == want


def test_sheets_break_after_33(spark):
    for n, count in ((33, 1), (34, 2), (66, 2)):
        html = sheets.pages(of(spark, *(card(f"w{i:02}") for i in range(n)))).first()["html"]
        assert html.count('<div class="blatt">') == count and ("Blatt 1 von" in html) == (count > 1)
    rows = sheets.sheets(of(spark, card("straße"), card("Strand"), card("STRASSE"))).orderBy("place").collect()
    assert rows[0]["word_form"] == "Strand"
    with pytest.raises(Exception, match="abbreviation"):
        sheets.pages(of(spark, card(pos="PROPN"))).collect()


def test_exports_take_free_names_and_leave_cards(spark, tmp_path):
    own, rows = Profile(spark, str(tmp_path / "p")), of(spark, card(), card("saw", "a saw"))
    first = client.write_exports(rows, own, tmp_path, "B: C", 1)
    second = client.write_exports(rows, own, tmp_path, "B: C", 1)
    assert [p.name for p in (*first, *second)] == ["B_C_kapitel1.json", "B_C_kapitel1.html", "B_C_kapitel1_2.json", "B_C_kapitel1_2.html"] and own.read("card").count() == 2
    with pytest.raises(ValueError, match="identity"):
        cards.export_deck(of(spark, card(), card()), str(tmp_path / "x"), "d")
    with pytest.raises(ValueError, match="without cards"):
        cards.export_deck(of(spark).limit(0), str(tmp_path / "y"), "d")
    with pytest.raises(ValueError, match="one chapter"):
        sheets.write_printout(of(spark, card(), card(chapter=2)), str(tmp_path / "z"))


def test_settings(tmp_path):
    settings, made = client.load_settings(tmp_path / "d")
    assert made and settings.order == "new_words_first" and not client.load_settings(tmp_path / "d")[1]
    (tmp_path / "d/config.toml").write_text(client.SETTINGS.replace("new_words_first", "x"))
    with pytest.raises(ValueError, match="order"):
        client.load_settings(tmp_path / "d")


CANDIDATES = "word_form string, example_sentence string, candidates array<struct<lexentry:string,sense:string,trans_list:string,uncertain:boolean>>"


def entries(spark, *lists):
    return spark.createDataFrame([(f"w{i}", f"A w{i}.", x) for i, x in enumerate(lists)], CANDIDATES)


def test_prompt_lists_meanings_and_the_way_out(spark):
    rows = entries(spark, [("eng/a__Proper_noun__1", None, "x | y", False), (None, "s", None, False), (None, None, None, True)])
    text = rows.select(choice.prompt(F.col("word_form"), F.col("example_sentence"), F.col("candidates"))).first()[0]
    assert text.startswith("You are helping a German learner of English.\nIn the sentence below, which listed meaning does the word \"w0\" have?\n\nSentence: A w0.\n\nMeanings:\n1. (Proper noun) ")
    assert "2. (?) s → ?\n3. (?) kein Wörterbucheintrag — unsicher → ?\n4. none of the listed meanings fits\n\n" in text and text.endswith('{"choice": <number>}')


@pytest.fixture
def server():
    state = {"mode": "ok", "requests": []}

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args):
            pass

        def do_GET(self):
            self.reply({"data": [{"id": "first"}, {"id": "second"}]})

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            state["requests"].append(body)
            top = body["response_format"]["json_schema"]["schema"]["properties"]["choice"]["maximum"]
            content = {"ok": '{"choice": 1}', "none": f'{{"choice": {top}}}', "range": '{"choice": 99}', "bool": '{"choice": true}', "text": "hm"}.get(state["mode"], "")
            if state["mode"] == "error":
                self.send_error(500)
            elif state["mode"] == "shape":
                self.reply([])
            else:
                self.reply({"choices": [{"message": {"content": content}, "finish_reason": "length" if state["mode"] == "length" else "stop"}]})

        def reply(self, body):
            data = json.dumps(body).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

    own = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=own.serve_forever, daemon=True).start()
    state["url"] = f"http://127.0.0.1:{own.server_port}/v1"
    yield state
    own.shutdown()


def test_model_server(spark, server):
    assert choice.first_model(server["url"]) == "first"
    rows = entries(spark, [("e", "a", "x", False), ("e", "b", "y", False)], [], [(None, None, None, True)])
    got = {r["word_form"]: r for r in choice.resolved(choice.choose(rows, choice.http_chooser(server["url"], "m"))).collect()}
    assert got["w0"]["choice"] == 1 and got["w0"]["sense_chosen"]["sense"] == "a" and got["w1"]["sense_chosen"] is None and got["w2"]["sense_chosen"]["uncertain"]
    (asked,) = server["requests"]
    assert asked["temperature"] == 0 and asked["reasoning_effort"] == "none" and asked["model"] == "m"
    server["mode"] = "none"
    assert choice.resolved(choice.choose(rows, choice.http_chooser(server["url"], "m"))).filter("word_form = 'w0'").first()["sense_chosen"] is None


@pytest.mark.parametrize("mode", ["error", "shape", "range", "bool", "text", "length"])
def test_wrong_answers_are_errors(server, mode):
    server["mode"] = mode
    with pytest.raises(ValueError):
        choice.ask(server["url"], "m", "q", 3)
    with pytest.raises(ValueError):
        choice.ask("http://127.0.0.1:9/v1", "m", "q", 3, timeout=2)


def test_too_long_questions_are_refused(spark):
    with pytest.raises(Exception, match="too long"):
        choice.choose(entries(spark, [("e", "s" * 12_000, "x", False), ("e", "b", "y", False)]), choice.first_sense).collect()


def book(nav=None, ncx=None, title="<dc:title> </dc:title><dc:title>Book</dc:title>", docs=None, extra=None, hrefs=("leaf-a.xhtml", "leaf-b.xhtml", "leaf-c.xhtml")):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>')
        items = "".join(f'<item id="c{i}" href="{h}"/>' for i, h in enumerate(hrefs))
        items += '<item id="nav" href="nav.xhtml" properties="x nav"/>' * bool(nav) + '<item id="ncx" href="toc.ncx"/>' * bool(ncx)
        spine = "".join(f'<itemref idref="c{i}"/>' for i in range(len(hrefs)))
        z.writestr("OEBPS/content.opf", f'<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata>{title}</metadata><manifest>{items}</manifest><spine{" toc='ncx'" * bool(ncx)}>{spine}</spine></package>')
        for name, text in (docs or {f"leaf-{'abc'[i - 1]}.xhtml": f"<html><head><title>t</title></head><body><p>Text {'abc'[i - 1]}.</p></body></html>" for i in (1, 2, 3)}).items():
            z.writestr(f"OEBPS/{name}", text)
        if nav:
            z.writestr("OEBPS/nav.xhtml", f'<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="landmarks"><ol><li><a href="leaf-c.xhtml">no</a></li></ol></nav><nav epub:type="bodymatter toc">{nav}</nav></body></html>')
        if ncx:
            z.writestr("OEBPS/toc.ncx", f'<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap>{ncx}</navMap></ncx>')
        for name, text in (extra or {}).items():
            z.writestr(name, text)
    return out.getvalue()


NAV = '<ol><li><a href="leaf-a.xhtml#a">One</a><div><ol><li><p><a href="leaf-a.xhtml#m">inner</a></p></li></ol></div></li><li><a href="leaf-b.xhtml#a">Two\n x</a></li></ol><ul><li><a href="leaf-b.xhtml#e">end</a></li></ul>'
POINT = '<navPoint><navLabel><text>{}</text></navLabel><content src="{}"/>{}</navPoint>'


def read(spark, *contents):
    return epub.entries(spark.createDataFrame([(f"b{i}", bytearray(c)) for i, c in enumerate(contents)], "path string, content binary"))


def test_navigation_forms_and_fallback(spark):
    deep = POINT.format("Sub", "leaf-b.xhtml", "")
    rows = read(spark, book(NAV), book(ncx=POINT.format("One", "leaf-a.xhtml#x", deep)), book(), book(NAV.replace("leaf", "gone")))
    got = {}
    for r in epub.structure(rows).orderBy("path", "chapter").collect():
        got.setdefault(r["path"], []).append((r["title"], [d[6:] for d in r["documents"]], r["level"], r["notice"] is None))
    assert got["b0"] == [("One", ["leaf-a.xhtml"], 0, True), ("Two x", ["leaf-b.xhtml", "leaf-c.xhtml"], 0, True)]
    assert got["b1"] == [("One", ["leaf-a.xhtml"], 0, True), ("Sub", ["leaf-b.xhtml", "leaf-c.xhtml"], 1, True)]
    assert got["b2"] == got["b3"] == [(f"Kapitel {i}", [f"leaf-{'abc'[i - 1]}.xhtml"], 0, False) for i in (1, 2, 3)]


def test_front_matter_missing_targets_and_encoded_names(spark):
    late = '<ol><li><a href="leaf-b.xhtml">Two</a></li><li><a href="gone%201.xhtml">Gone</a></li></ol>'
    rows = read(spark, book(late, hrefs=("leaf-a.xhtml", "leaf-b.xhtml", "gone%201.xhtml", "leaf-c.xhtml")))
    assert [(r["title"], r["documents"]) for r in epub.structure(rows).orderBy("chapter").collect()] == [("Two", ["OEBPS/leaf-b.xhtml"]), ("Gone", ["OEBPS/gone 1.xhtml", "OEBPS/leaf-c.xhtml"])]
    assert {r["title"]: r["words"] for r in epub.chapter_word_counts(rows).collect()} == {"Two": 2, "Gone": None}


def test_chapter_text_and_its_refusals(spark):
    assert [r["text"] for r in epub.chapter_texts(read(spark, book(NAV))).orderBy("chapter").collect()] == ["Text a.", "Text b.\nText c."]
    lock = '<encryption xmlns:enc="http://www.w3.org/2001/04/xmlenc#"><enc:CipherReference URI="OEBPS/leaf-a.xhtml"/></encryption>'
    for bad, message in (
        (book(NAV, extra={"META-INF/encryption.xml": lock}), "encrypted"), (book(NAV, extra={"META-INF/encryption.xml": "<x"}), "corrupt"),
        (book(NAV, docs={"leaf-a.xhtml": b"\xff\xfe", "leaf-b.xhtml": "b", "leaf-c.xhtml": "c"}), "not_utf8"), (book(NAV, docs={"leaf-a.xhtml": "<p>1</p>", "leaf-b.xhtml": "b", "leaf-c.xhtml": "c"}), "no text"),
        (b"no zip", "no EPUB"), (book(title=""), "no title"), (book(hrefs=()), "no spine"),
    ):
        with pytest.raises(Exception, match=message):
            epub.chapter_texts(read(spark, bad)).collect()
    fonts = lock.replace("leaf-a.xhtml", "font.ttf")
    assert epub.chapter_texts(read(spark, book(NAV, extra={"META-INF/encryption.xml": fonts}))).count() == 2
    assert epub.health(read(spark, book(NAV))).first()["targets"] == 2


def test_text_book_chapters(spark):
    text = "front\nI. ONE STORY\na b\n  II. not one\nCHAPTER II\nc\n*** END OF THE PROJECT GUTENBERG EBOOK\nIII. no"
    got = tables.split_chapters(spark.createDataFrame([(1, text)], "id int, text string"), ["id"]).orderBy("chapter").collect()
    assert [(r["title"], r["text"]) for r in got] == [("I. ONE STORY", "a b\n  II. not one"), ("CHAPTER II", "c")]


def test_sqlite_dictionary_and_word_list(spark, tmp_path):
    import sqlite3

    path = str(tmp_path / "d.sqlite3")
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE translation (lexentry, sense_num, sense, written_rep TEXT, trans_list, score, is_good, importance)")
        con.executemany("INSERT INTO translation VALUES (?, ?, ?, ?, ?, ?, ?, ?)", [("eng/a__Noun__1", "1", None, f"w{i}", "t", 2.5 if i else "bad", 1, 0.5) for i in range(20)])
    got = tables.sqlite_dictionary(spark, path)
    assert got.count() == 20 and got.filter("score is null").first()["written_rep"] == "w0" and {r["src_row"] for r in got.collect()} == set(range(1, 21))
    assert tables.checked_dictionary(got, 20) is got
    with pytest.raises(ValueError, match="20 rows"):
        tables.checked_dictionary(got)
    (tmp_path / "l.txt").write_text("# head\n\nthe\n of \nand")
    assert [(r["lemma"], r["rank"]) for r in tables.word_list(spark, str(tmp_path / "l.txt")).orderBy("rank").collect()] == [("the", 1), ("of", 2), ("and", 3)]


def test_cached_ratios_are_made_once(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.createDataFrame([("B", "A", "sun", 0.5)], "book_title string, book_author string, lemma string, ratio double")

    for _ in range(2):
        assert tables.cached_ratios(spark, str(tmp_path), "k", make).first()["ratio"] == 0.5
    assert len(made) == 1


def test_too_long_questions_are_marked_where_a_corpus_goes_on(spark):
    rows = entries(spark, [("e", "s" * 12_000, "x", False), ("e", "b", "y", False)], [("e", "a", "x", False), ("e", "b", "y", False)], [("e", "s" * 12_000, "x", False)])
    got = {r["word_form"]: r for r in choice.resolved(choice.choose(rows, choice.first_sense, "mark")).collect()}
    assert [got[f"w{i}"]["choice_obstacle"] for i in range(3)] == [choice.TOO_LONG, None, choice.TOO_LONG]
    assert got["w1"]["choice"] == 1 and got["w0"]["sense_chosen"] is None and got["w2"]["sense_chosen"] is None


def sqlite_rows(path, names, columns="lexentry, sense_num, sense, written_rep TEXT, trans_list, score, is_good, importance"):
    import sqlite3

    with sqlite3.connect(path) as con:
        con.execute(f"CREATE TABLE translation ({columns})")
        con.executemany(f"INSERT INTO translation (written_rep) VALUES (?)", [(n,) for n in names])
    con.close()


def test_a_folder_of_sqlite_files_is_one_dictionary(spark, tmp_path):
    for name, words in (("b", ["x", "y"]), ("a", ["z"]), ("c", [])):
        sqlite_rows(tmp_path / f"{name}.sqlite3", words)
    (tmp_path / "d.part").write_text("left behind")
    got = tables.sqlite_dictionary(spark, str(tmp_path))
    assert {(r["written_rep"], r["src_row"]) for r in got.collect()} == {("z", 1), ("x", (1 << 40) + 1), ("y", (1 << 40) + 2)}
    (tmp_path / "none").mkdir()
    assert tables.sqlite_dictionary(spark, str(tmp_path / "none")).count() == 0


def test_a_fetched_dictionary_is_checked_before_it_has_its_name(tmp_path):
    import sqlite3

    sqlite_rows(tmp_path / "good", [f"w{i}" for i in range(30)])
    sqlite_rows(tmp_path / "columns", ["w"], "written_rep TEXT, score")
    (tmp_path / "page").write_text("<html>not found</html>" * 99)
    target = str(tmp_path / "d.sqlite3")
    for name, least, says in (("columns", 1, "lacks lexentry"), ("page", 1, "no dictionary"), ("good", 31, "30 rows")):
        with pytest.raises(ValueError, match=says):
            tables.fetch_dictionary((tmp_path / name).as_uri(), target, least=least)
        assert sorted(x.name for x in tmp_path.iterdir()) == ["columns", "good", "page"]
    assert tables.fetch_dictionary((tmp_path / "good").as_uri(), target, least=30) == target
    con = sqlite3.connect(target)
    assert "headword" in con.execute("EXPLAIN QUERY PLAN SELECT * FROM translation WHERE written_rep = 'w1'").fetchone()[3]
    con.close()
    assert tables.fetch_dictionary("file:///nowhere", target) == target
