"""Queries over measures, choices and cards, and the chain from tokens to dispositions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.operators import cards, choice, lookup, measures, sheets, triage, vocabulary
from glossmill.plans import catalogue as C
from glossmill.plans import chapters as chain
from glossmill.plans import standins as S
from glossmill.plans.registry import ORACLE_SQL, query
from glossmill.schema import CHAPTER
from glossmill.sources.staging import staged

_C = "book_title, book_author, chapter"
_SAME = "{0}.book_title = {1}.book_title AND {0}.book_author = {1}.book_author AND {0}.chapter = {1}.chapter"
_SURE_KEYS = f"keys AS (SELECT DISTINCT written_rep FROM entries WHERE {C._SURE} AND contains(written_rep, ' '))"


@query(
    f"""{C._GRAMS}, {_SURE_KEYS}, raw AS (SELECT lemma FROM grams WHERE lemma IN (SELECT written_rep FROM dictionary)), kept AS (SELECT lemma FROM grams WHERE lemma IN (SELECT written_rep FROM keys)),
    r AS (SELECT count(*) AS raw_occurrences, count(DISTINCT lemma) AS raw_distinct FROM raw), k AS (SELECT count(*) AS kept_occurrences, count(DISTINCT lemma) AS kept_distinct FROM kept)
    SELECT *, 1 - kept_occurrences / raw_occurrences AS removed_share FROM r, k"""
)
def filter_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    dictionary = S.dictionary(spark, sf_dir)
    every = dictionary.select(F.col("written_rep").alias("expression")).distinct()
    sure = lookup.expression_entries(dictionary).select(F.col("written_key").alias("expression")).distinct()
    either = staged(every.unionByName(sure).distinct(), "expressions")
    # Runs grow from pairs that begin an expression, and what is found is made once for both counts.
    pairs = either.select(F.substring_index("expression", " ", 2).alias("pair"))
    grams = vocabulary.ngrams(S.tokens(spark, sf_dir), beginnings=pairs).select(F.col("lemma").alias("expression"))
    grams = staged(grams.join(either, "expression", "left_semi"), "grams")
    return measures.filter_effect(grams.join(every, "expression", "left_semi"), grams.join(sure, "expression", "left_semi"))


@query(
    f"""WITH {S.TOKENS_SQL}, {S.DICTIONARY_SQL}, forms AS (SELECT lower(text) AS word, lemma, count(*) AS n FROM tokens WHERE is_alpha AND pos <> 'PROPN' GROUP BY ALL),
    vocab AS (SELECT DISTINCT word FROM forms), cands AS (SELECT word, unnest({C._SUFFIX}) AS c FROM vocab), reached AS (SELECT DISTINCT word FROM cands WHERE c IN (SELECT written_rep FROM heads)),
    flags AS (SELECT *, word IN (SELECT written_rep FROM heads) AS r, word IN (SELECT word FROM reached) AS s, lemma IN (SELECT written_rep FROM heads) AS l FROM forms)
    SELECT sum(n)::bigint AS tokens, count(DISTINCT word) AS types, count(DISTINCT lemma) AS lemmas, count(DISTINCT word) FILTER (WHERE r) AS raw_types, coalesce(sum(n) FILTER (WHERE r), 0)::bigint AS raw_tokens,
    count(DISTINCT word) FILTER (WHERE s) AS suffix_types, coalesce(sum(n) FILTER (WHERE s), 0)::bigint AS suffix_tokens, count(DISTINCT word) FILTER (WHERE l) AS lemma_types,
    coalesce(sum(n) FILTER (WHERE l), 0)::bigint AS lemma_tokens FROM flags"""
)
def lemma_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.lemma_gap(S.tokens(spark, sf_dir), lookup.headwords(S.dictionary(spark, sf_dir)))


@query(
    f"""WITH {S.TOKENS_SQL}, alphabetic AS (SELECT *, row_number() OVER (PARTITION BY {_C}, sent_id ORDER BY tok_id) = 1 AS first FROM tokens WHERE is_alpha),
    forms AS (SELECT lower(text) AS form, count(*) AS total, count(*) FILTER (WHERE regexp_matches(text, '^\\p{{Lu}}') AND NOT first) AS capitalized, count(*) FILTER (WHERE pos = 'PROPN') AS proper,
              count(*) FILTER (WHERE pos IN ('NOUN', 'VERB', 'ADJ', 'ADV', 'INTJ')) AS content FROM alphabetic GROUP BY ALL),
    judged AS (SELECT *, CASE WHEN proper = 0 AND content > 0 AND total >= 3 AND capitalized / total > 0.85 THEN 'missed' WHEN proper > 0 AND proper < total AND capitalized / total < 0.85 THEN 'overreach' END AS error FROM forms)
    SELECT form, error, total, proper, capitalized FROM judged WHERE error IS NOT NULL"""
)
def proper_noun_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.proper_noun_errors(S.tokens(spark, sf_dir))


@query(
    f"""WITH {S.TOKENS_SQL}, {S.DICTIONARY_SQL}, pairs AS (SELECT concat(v.lemma, ' ', lower(p.text)) AS key, p.tok_id - p.head_id AS distance FROM tokens p JOIN tokens v ON {_SAME.format("p", "v")}
        AND p.sent_id = v.sent_id AND p.head_id = v.tok_id WHERE p.dep = 'prt'),
    kinds AS (SELECT key, CASE WHEN key NOT IN (SELECT written_rep FROM heads WHERE contains(written_rep, ' ')) THEN 'unknown' WHEN distance <= 1 THEN 'contiguous' ELSE 'separated' END AS kind FROM pairs)
    SELECT kind, count(*) AS occurrences, count(DISTINCT key) AS verbs FROM kinds GROUP BY ALL"""
)
def phrasal_verb_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.phrasal_verb_gap(S.token_table(spark, sf_dir), lookup.best_expressions(S.dictionary(spark, sf_dir)))


@query(
    f"""{C._COUNTS}, forms AS (SELECT unnest(regexp_extract_all(lower(text), {S.WORD_SQL})) AS lemma FROM chapters), often AS (SELECT lemma, count(*) AS frequency FROM forms GROUP BY ALL)
    SELECT lemma, pos, frequency, n AS senses FROM counts JOIN often USING (lemma) WHERE n > 1 ORDER BY frequency DESC, lemma, pos LIMIT 40"""
)
def ambiguous_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 40 most frequent lemmas with several senses; the number is the sample's feature."""
    often = measures.word_frequencies(S.chapters(spark, sf_dir), list(CHAPTER)).groupBy(F.col("word").alias("lemma")).agg(F.sum("frequency").alias("frequency"))
    return measures.ambiguous_sample(S.lemmas(spark, sf_dir).join(often, "lemma"), C._sense_counts(spark, sf_dir), 40).select("lemma", "pos", "frequency", "senses")


@query(
    f"""WITH {S.DICTIONARY_SQL}, middle AS (SELECT median(length(written_rep)) AS m FROM heads) SELECT written_rep FROM heads, middle ORDER BY abs(length(written_rep) - m), lower(written_rep), written_rep LIMIT 33"""
)
def typical_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many headwords as a sheet has entries, of the most usual length."""
    return measures.typical_words(S.dictionary(spark, sf_dir), 33)


@query(f"WITH {S.LEMMAS_SQL}, {S.DICTIONARY_SQL}, named AS (SELECT written_rep AS lemma, count(*) AS n FROM dictionary WHERE lexentry IS NOT NULL GROUP BY ALL) SELECT lemma, pos, coalesce(n, 0) AS n FROM lemmas LEFT JOIN named USING (lemma)")
def unfiltered_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.unfiltered_counts(S.lemmas(spark, sf_dir), S.dictionary(spark, sf_dir)).select("lemma", "pos", "n")


@query(
    r"""WITH RECURSIVE cut AS (SELECT doc_id, unnest(range(len(regexp_split_to_array(text, '\n\s*\n')))) AS i, unnest(regexp_split_to_array(text, '\n\s*\n')) AS raw FROM documents),
    parts AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, trim(raw, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS part FROM cut
              WHERE trim(raw, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''),
    filled AS (SELECT doc_id, i, length(part) AS n, 0 AS chunk, part FROM parts WHERE i = 1
               UNION ALL SELECT p.doc_id, p.i, CASE WHEN f.n >= 2000 THEN length(p.part) ELSE f.n + length(p.part) END, f.chunk + (f.n >= 2000)::int, p.part FROM filled f JOIN parts p ON p.doc_id = f.doc_id AND p.i = f.i + 1)
    SELECT doc_id, chunk::int AS chunk, string_agg(part, chr(10) || chr(10) ORDER BY i) AS text FROM filled GROUP BY doc_id, chunk"""
)
def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents in pieces of about 2,000 characters."""
    return measures.chunks(S.table(spark, sf_dir, "documents"), ["doc_id"], 2000).select("doc_id", "chunk", "text")


@query(
    f"""{C._CANDIDATES}, best AS (SELECT lemma, pos, arg_min(trans_list, (-score, src_row)) AS offered FROM cand WHERE src_row IS NOT NULL GROUP BY ALL)
    SELECT count(*) AS n, count(*) FILTER (WHERE list_contains(string_split(offered, ' | '), concat('t', {S.number_sql("lemma")} % 50))) AS right FROM best"""
)
def sense_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sense of each lemma against a made-up key."""
    lists = lookup.candidate_lists(S.lemmas(spark, sf_dir), S.dictionary(spark, sf_dir)).filter("size(candidates) > 0")
    key = F.array(F.concat(F.lit("t"), F.pmod(S.number(F.col("lemma")), F.lit(50)).cast("string")))
    return choice.accuracy(lists.select(F.get("candidates", F.lit(0))["trans_list"].alias("offered"), key.alias("expected")))


_H = S.number_sql("concat('a', lemma)")


@query(
    f"""WITH {S.LEMMAS_SQL}, h AS (SELECT lemma, {_H} AS h FROM lemmas), one AS (SELECT lemma, h % 3 AS a FROM h WHERE h % 7 > 0), other AS (SELECT lemma, h % 4 AS b FROM h WHERE h % 5 > 0)
    SELECT count(*) FILTER (WHERE a = b) AS same, count(*) FILTER (WHERE a <> b) AS different, count(*) FILTER (WHERE b IS NULL) AS missing, count(*) FILTER (WHERE a IS NULL) AS unknown FROM one FULL JOIN other USING (lemma)"""
)
def choice_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two choosers' answers, of which each lacks some."""
    h = S.lemmas(spark, sf_dir).select("lemma", S.number(F.concat(F.lit("a"), F.col("lemma"))).alias("h"))
    return choice.agreement(h.filter("h % 7 > 0").select("lemma", (F.col("h") % 3).alias("choice")), h.filter("h % 5 > 0").select("lemma", (F.col("h") % 4).alias("choice")), ["lemma"])


_K = S.number_sql("concat('b', lemma)")


@query(
    f"""{C._COUNTS}, asked AS (SELECT lemma, pos, n + 1 AS options, row_number() OVER (PARTITION BY pos ORDER BY lemma) - 1 AS nth, {_K} AS h FROM counts WHERE n > 0)
    SELECT pos, (nth // 8)::int AS bundle, (nth % 8 + 1)::int AS place, lemma, CASE WHEN h % 10 > 3 THEN 1 + h % options ELSE 0 END::int AS choice,
    CASE h % 10 WHEN 0 THEN 'missing' WHEN 1 THEN 'duplicate' WHEN 2 THEN 'echo' WHEN 3 THEN 'range' END AS fault FROM asked"""
)
def bundled_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions in bundles of eight, and answers of which some are missing, twice there, of another word or out of range."""
    lists = lookup.candidate_lists(S.lemmas(spark, sf_dir), S.dictionary(spark, sf_dir))
    rows = lists.withColumns({"candidates": F.transform("candidates", lambda x: F.struct(x["lexentry"].alias("lexentry"), F.lit(False).alias("uncertain"))), "word_form": F.col("lemma")})
    asked = choice.bundles(rows, 8, ["pos"])
    h = S.number(F.concat(F.lit("b"), F.col("lemma")))
    said = asked.withColumn("h", h).withColumn("times", F.when(F.col("h") % 10 == 0, 0).when(F.col("h") % 10 == 1, 2).otherwise(1))
    said = said.withColumn("each", F.explode(F.array_repeat(F.lit(1), F.col("times"))))
    number = F.when(F.col("h") % 10 == 3, F.lit(99)).otherwise((1 + F.col("h") % F.col("options")).cast("int"))
    answers = said.select("pos", "bundle", "place", F.when(F.col("h") % 10 == 2, F.lit("?")).otherwise(F.col("lemma")).alias("echo"), number.alias("choice"))
    return choice.checked_bundle(answers, asked, ["pos"]).withColumn("choice", F.coalesce("choice", F.lit(0)))


@query(f"""{ORACLE_SQL["chapter_comparison"].split("SELECT m.user_id")[0]}, compared AS (SELECT m.user_id{ORACLE_SQL["chapter_comparison"].split("SELECT m.user_id")[1]})
    SELECT user_id, lemma, bool_and(status = 'known') AS all_known, NOT bool_or(status = 'known') AS none_known FROM compared GROUP BY ALL""")
def candidate_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage.candidate_flags(C.chapter_comparison(spark, sf_dir), ["user_id", "lemma"])


_RUN = "[\\p{L}\\p{N}''’-]+"
_FIRST_FORMS = f"""WITH {S.CHAPTERS_SQL}, cut AS (SELECT {_C}, regexp_extract_all(text, '[^.!?]*[.!?]|[^.!?]+') AS p FROM chapters),
    pieces AS (SELECT {_C}, unnest(range(len(p))) AS nth, unnest(p) AS piece FROM cut), listed AS (SELECT {_C}, nth, piece, regexp_extract_all(piece, {S.WORD_SQL}) AS w FROM pieces),
    forms AS (SELECT {_C}, nth, piece, unnest(range(len(w))) AS i, unnest(w) AS word_form FROM listed),
    first AS (SELECT {_C}, lower(word_form) AS lemma, arg_min(word_form, (nth, i)) AS word_form, arg_min(piece, (nth, i)) AS piece FROM forms GROUP BY ALL),
    placed AS (SELECT {_C}, lemma, word_form, trim(regexp_replace(piece, '\\s+', ' ', 'g')) AS example_sentence FROM first),
    runs AS (SELECT *, regexp_extract_all(example_sentence, '{_RUN}') AS r, regexp_split_to_array(example_sentence, '{_RUN}') AS g FROM placed), seen AS (SELECT *, coalesce(list_position(r, word_form), 0) AS k FROM runs),
    found AS (SELECT {_C}, lemma, word_form, example_sentence, CASE WHEN k = 0 THEN 0 ELSE 1 + length(array_to_string(g[1:k], '')) + length(array_to_string(r[1 : k - 1], '')) END AS place FROM seen)"""
ORACLE_SQL["card_obstacles"] = f"""{_FIRST_FORMS} SELECT {_C}, word_form, place::int AS place,
    CASE WHEN place = 0 THEN concat('„', word_form, '“ kommt im Belegsatz an keiner Wortgrenze wortwörtlich vor — daraus ist kein Lückentext zu bilden.') END AS obstacle FROM found"""


def _escaped(text: str) -> str:
    return f"replace(replace(replace({text}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(
    f"""{_FIRST_FORMS} SELECT {_C}, word_form, concat({_escaped("example_sentence[1 : place - 1]")}, '{{{{c1::', {_escaped("word_form")}, '}}}}', {_escaped("example_sentence[place + length(word_form) :]")}) AS cloze FROM found WHERE place > 0"""
)
def cloze_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gap text of each word of each chapter that can have one."""
    rows = C._placed_cards(spark, sf_dir).filter("place > 0")
    return rows.select(*CHAPTER, "word_form", cards.cloze(F.col("example_sentence"), F.col("word_form"), F.col("place")).alias("cloze"))


_GAP = f"""concat({_escaped("example_sentence[1 : place - 1]")}, '{{{{c1::', {_escaped("word_form")}, '}}}}', {_escaped("example_sentence[place + length(word_form) :]")})"""
ORACLE_SQL["card_notes"] = f"""{_FIRST_FORMS}, directed AS (SELECT *, unnest(['en_de', 'de_en', 'cloze']) AS card_direction FROM found),
    free AS (SELECT *, [book_title, book_author, chapter::varchar, lemma, 'NOUN', '', '', card_direction] AS k FROM directed WHERE card_direction <> 'cloze' OR place > 0)
    SELECT sha256(array_to_string(list_transform(k, lambda x: concat(length(x), ':', x)), '')) AS guid, card_direction,
           CASE WHEN card_direction = 'cloze' THEN concat_ws('|', {_GAP}, concat('&lt;', lemma, '&gt;'), {_escaped("lemma")}, 'NOUN', {_escaped("book_title")}, chapter)
                ELSE concat_ws('|', {_escaped("word_form")}, concat('&lt;', lemma, '&gt;'), {_escaped("lemma")}, 'NOUN', {_escaped("example_sentence")}, {_escaped("book_title")}, chapter) END AS fields,
           concat_ws('|', concat('buch::', book_title), 'autor::unbekannt', concat('kapitel::', chapter), 'unsicher') AS tags FROM free"""

ORACLE_SQL["printed_pages"] = f"""{_FIRST_FORMS},
    entries AS (SELECT {_C}, row_number() OVER (PARTITION BY {_C} ORDER BY replace(lower(word_form), 'ß', 'ss'), lemma) - 1 AS i, (count(*) OVER (PARTITION BY {_C})) AS n,
        concat('<li><span class="wort">', {_escaped("word_form")}, '</span> <span class="wortart">(Subst.)</span> – <span class="uebersetzung">', {_escaped("concat('<', lemma, '>')")},
               ' <span class="unsicher">({sheets.UNCERTAIN})</span></span></li>') AS item FROM placed),
    dealt AS (SELECT *, i // 33 AS s FROM entries),
    sheets AS (SELECT {_C}, s, concat('<div class="blatt">', chr(10), '<h1>', {_escaped("book_title")}, '</h1>', chr(10), '<p class="kapitel">Kapitel ', chapter,
        CASE WHEN any_value(n) > 33 THEN concat(' – Blatt ', s + 1, ' von ', ((any_value(n) + 32) // 33)) ELSE '' END, '</p>', chr(10), '<ul class="wortliste">', chr(10),
        string_agg(item, chr(10) ORDER BY i), chr(10), '</ul>', chr(10), '</div>') AS html FROM dealt GROUP BY {_C}, s)
    SELECT {_C}, concat('<!DOCTYPE html>', chr(10), '<html lang="de">', chr(10), '<head>', chr(10), '<meta charset="utf-8">', chr(10), '<title>', {_escaped("book_title")}, ' — Kapitel ', chapter, '</title>', chr(10),
        '<style>{sheets.STYLE}</style>', chr(10), '</head>', chr(10), '<body>', chr(10), string_agg(html, chr(10) ORDER BY s), chr(10), '</body>', chr(10), '</html>', chr(10)) AS html FROM sheets GROUP BY {_C}"""

_QUESTION = choice.QUESTION.replace("'", "''").split("%s")
ORACLE_SQL["sense_prompts"] = f"""{_FIRST_FORMS}, lemmas AS{S.LEMMAS_SQL.split("lemmas AS", 1)[1]}, {S.DICTIONARY_SQL},
    examples AS (SELECT lemma, arg_min(word_form, ({_C})) AS word_form, arg_min(example_sentence, ({_C})) AS example_sentence FROM placed GROUP BY lemma),
    cand AS (SELECT lemma, pos, lexentry, sense, trans_list, score, src_row FROM lemmas LEFT JOIN entries ON lemma = written_rep AND lexentry IS NOT NULL AND entry_pos = {C._POS_MAP}),
    numbered AS (SELECT lemma, pos, row_number() OVER (PARTITION BY lemma, pos ORDER BY -score, src_row, lexentry, sense NULLS FIRST, trans_list) AS i, lexentry, sense, trans_list FROM cand WHERE src_row IS NOT NULL),
    lines AS (SELECT lemma, pos, count(*) + 1 AS last, string_agg(concat(i, '. (', coalesce(replace(string_split(lexentry, '__')[2], '_', ' '), '?'), ') ',
        coalesce(nullif(sense, ''), '{lookup.NO_SENSE_LABEL}'), ' → ', coalesce(nullif(trans_list, ''), '?')), chr(10) ORDER BY i) AS lines FROM numbered GROUP BY ALL),
    prompts AS (SELECT lemma, pos, concat('{_QUESTION[0]}', word_form, '{_QUESTION[1]}', example_sentence, '{_QUESTION[2]}', lines, chr(10), last, '. none of the listed meanings fits', '{_QUESTION[3]}', last, '{_QUESTION[4]}') AS prompt FROM lines JOIN examples USING (lemma))
    SELECT lemma, pos, prompt, ceil(length(prompt) / 4)::bigint AS tokens FROM prompts"""

_LONGEST = f"""expressions AS (SELECT DISTINCT lower(written_rep) AS key, len(string_split(written_rep, ' ')) AS words FROM dictionary WHERE contains(written_rep, ' ')),
    w AS (SELECT {_C}, list_transform(regexp_extract_all(text, {S.WORD_SQL}), lambda x: lower(x)) AS w FROM chapters), sizes AS (SELECT DISTINCT words FROM expressions),
    spans AS (SELECT {_C}, words, unnest(range(len(w) - words + 1)) AS "at", unnest(list_transform(range(len(w) - words + 1), lambda i: array_to_string(w[i + 1 : i + words], ' '))) AS key FROM w, sizes WHERE len(w) >= words),
    longest AS (SELECT {_C}, "at", max(words) AS words, arg_max(key, words) AS expression FROM spans SEMI JOIN expressions USING (key, words) GROUP BY ALL)"""
ORACLE_SQL["greedy_expressions"] = f"""WITH RECURSIVE {S.CHAPTERS_SQL}, {S.DICTIONARY_SQL}, {_LONGEST},
    linked AS (SELECT l.*, n."at" AS next_at FROM longest l ASOF LEFT JOIN longest n ON {_SAME.format("l", "n")} AND l."at" + l.words <= n."at"),
    taken AS (SELECT * FROM linked l WHERE "at" = (SELECT min("at") FROM longest m WHERE {_SAME.format("l", "m")})
              UNION ALL SELECT l.* FROM taken t JOIN linked l ON {_SAME.format("t", "l")} AND l."at" = t.next_at)
    SELECT {_C}, expression, "at" FROM taken"""


def _sense_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event of each sense of a single word, with a state by its hash."""
    rows = lookup.prepared(S.dictionary(spark, sf_dir)).filter("lexentry is not null and entry_pos <> 'Proper_noun' and not contains(written_rep, ' ')")
    names = F.create_map(*(F.lit(x) for tag, name in lookup.DICTIONARY_POS.items() for x in (name, tag)))
    state = F.element_at(F.array(*map(F.lit, ("known", "learning", "deferred", "known"))), (F.pmod(S.number(F.concat(F.lit("s"), F.col("lexentry"))), F.lit(4)) + 1).cast("int"))
    return rows.select(F.col("written_rep").alias("lemma"), names[F.col("entry_pos")].alias("pos"), "lexentry", "sense", "trans_list", state.alias("state"), F.lit("2024-01-01").cast("timestamp").alias("timestamp"), F.lit(0).cast("long").alias("event_id"))


_LEMMAS_CTE = ORACLE_SQL["chapter_lemmas"].rsplit("SELECT k.book_title", 1)
_CHAIN = f"""{_LEMMAS_CTE[0].rstrip()}, {S.DICTIONARY_SQL},
    vocab AS (SELECT {_C}, lemma, chosen.p AS pos, chosen.w AS word_form, total - proper_noun_frequency AS frequency FROM kept),
    {C._PARTICLES.split(",", 1)[1].split("pairs AS", 1)[1].join(["pairs AS", ""])},
    spoken AS (SELECT v.book_title, v.book_author, v.chapter, v.lemma, v.frequency, string_agg(t.text, ' ' ORDER BY t.tok_id) AS word_form FROM verbs v JOIN tokens t ON {_SAME.format("v", "t")} AND t.tok_id BETWEEN low AND high GROUP BY ALL),
    {C._GRAMS.split("led AS", 1)[1].join(["led AS", ""])},
    sure AS (SELECT * FROM entries WHERE {C._SURE}),
    counted AS (SELECT {_C}, lemma, count(*) AS frequency, min(tok_id) AS low FROM grams WHERE lemma IN (SELECT written_rep FROM sure) GROUP BY ALL),
    plain AS (SELECT c.* FROM counted c ANTI JOIN verbs USING ({_C}, lemma)),
    shown AS (SELECT p.book_title, p.book_author, p.chapter, p.lemma, p.frequency, string_agg(t.text, ' ' ORDER BY t.tok_id) AS word_form FROM plain p
              JOIN tokens t ON {_SAME.format("p", "t")} AND t.tok_id BETWEEN p.low AND p.low + len(string_split(p.lemma, ' ')) - 1 GROUP BY ALL),
    both_routes AS (SELECT *, 'VERB' AS pos, true AS particle FROM spoken UNION ALL SELECT *, '' AS pos, false AS particle FROM shown),
    beginnings AS (SELECT DISTINCT {_C}, frequency, unnest(list_transform(range(1, len(string_split(lemma, ' '))), lambda k: array_to_string(string_split(lemma, ' ')[1:k], ' '))) AS lemma FROM both_routes),
    ruling AS (SELECT b.* FROM both_routes b ANTI JOIN beginnings USING ({_C}, lemma, frequency)),
    candidates AS (
        SELECT {_C}, 'word' AS kind, lemma, pos, word_form, frequency, lexentry, sense, trans_list, score, src_row FROM vocab LEFT JOIN entries ON lemma = written_rep AND lexentry IS NOT NULL AND entry_pos = {C._POS_MAP}
        UNION ALL SELECT {_C}, 'expression', lemma, pos, word_form, frequency, lexentry, sense, trans_list, score, src_row FROM ruling LEFT JOIN sure ON lemma = written_rep WHERE particle OR src_row IS NOT NULL),
    events_of AS (SELECT written_rep AS lemma, CASE entry_pos WHEN 'Noun' THEN 'NOUN' WHEN 'Verb' THEN 'VERB' WHEN 'Adjective' THEN 'ADJ' WHEN 'Adverb' THEN 'ADV' ELSE 'INTJ' END AS pos, lexentry, coalesce(sense, '') AS sense, trans_list
                  FROM entries WHERE lexentry IS NOT NULL AND entry_pos <> 'Proper_noun' AND NOT contains(written_rep, ' ') AND {S.number_sql("concat('s', lexentry)")} % 4 IN (0, 3)),
    known_lemmas AS (SELECT DISTINCT lemma, pos FROM events_of),
    compared AS (SELECT c.*, CASE WHEN e.lemma IS NOT NULL THEN 'known' WHEN k.lemma IS NOT NULL THEN 'new_meaning_of_known_word' ELSE 'unknown' END AS status FROM candidates c
        LEFT JOIN events_of e ON c.lemma = e.lemma AND c.pos = e.pos AND c.lexentry = e.lexentry AND coalesce(c.sense, '') = e.sense AND c.trans_list = e.trans_list LEFT JOIN known_lemmas k ON c.lemma = k.lemma AND c.pos = k.pos),
    listed_entries AS (SELECT {_C}, kind, lemma, pos, any_value(word_form) AS word_form, any_value(frequency) AS frequency, bool_and(status = 'known') AS all_known, NOT bool_or(status = 'known') AS none_known,
        arg_min(status, (-coalesce(score, '-inf'::double), src_row, lexentry, sense, trans_list)) AS chosen_status FROM compared GROUP BY ALL),
    counted_entries AS (SELECT *, coalesce(sum(CASE WHEN chosen_status <> 'known' THEN 1 ELSE 0 END) OVER (PARTITION BY {_C}, kind, all_known ORDER BY CASE WHEN none_known THEN 0 ELSE 1 END, frequency DESC, lemma, pos
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM listed_entries)"""


@query(
    f"""{_CHAIN} SELECT {_C}, kind, lemma, pos, word_form, frequency, CASE WHEN all_known THEN 'known' WHEN before >= 25 THEN 'remaining' WHEN chosen_status = 'known' THEN 'resolved_known' ELSE 'kept' END AS disposition FROM counted_entries"""
)
def token_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain from tokens on: vocabulary and expressions, candidates, comparison, sense choice, dispositions."""
    found = chain.chapter_entries(S.token_table(spark, sf_dir), S.dictionary(spark, sf_dir), _sense_events(spark, sf_dir))
    return chain.triaged_entries(found, choice.first_sense, 25).select(*chain.KEY, "word_form", "frequency", "disposition")


@query(ORACLE_SQL["token_chain"])
def chapter_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain from texts on, by an analyzer in Python that says of a text what the stand-in's token table says."""
    found = chain.run_entries(S.chapters(spark, sf_dir), S.dictionary(spark, sf_dir), _sense_events(spark, sf_dir), S.StandInAnalyzer)
    return chain.triaged_entries(found, choice.first_sense, 25).select(*chain.KEY, "word_form", "frequency", "disposition")
