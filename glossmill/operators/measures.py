"""Measurements around a vocabulary: coverage, expressions, gaps, names, phrasal verbs, ambiguity, print samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossmill.functions.text import strip, suffix_candidates, word_count, words
from glossmill.operators.vocabulary import CONTENT_POS, PROPER_NOUN
from glossmill.schema import CHAPTER
from glossmill.sources.staging import staged

# Fixed values.
CAPITAL_RATIO = 0.85
CONTRACTIONS = tuple("ll ve re t s d m n didn don isn wasn couldn wouldn shouldn doesn hadn hasn haven aren weren ain mustn needn shan".split())
PARTICLES = tuple("up down out off on in away back over through along around about apart aside forward".split())
PARTICLE_DEPS = ("prt", "compound:prt")
MAX_GAP = 4
BUCKETS = ((0, 0, "0"), (1, 1, "1"), (2, 2, "2"), (3, 5, "3-5"), (6, 10, "6-10"))
BUCKET_TAIL = ">10"


def word_frequencies(texts: DataFrame, key: list[str]) -> DataFrame:
    """frequency and capitalized of each lower-case word form."""
    rows = texts.select(*key, F.explode(words(F.col("text"))).alias("form"))
    first = F.substring("form", 1, 1)
    return rows.groupBy(*key, F.lower("form").alias("word")).agg(F.count("*").alias("frequency"), F.count_if((first != F.lower(first)) & first.rlike(r"^\p{Lu}")).alias("capitalized"))


def coverage(frequencies: DataFrame, headwords: DataFrame, irregular: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """Adds cause to each word: hit, if any suffix candidate is a headword; else contraction, irregular, proper or gap, the first that holds.

    irregular(form): forms that no suffix leads back, with or without their hyphens and apostrophes. vocabulary(word), if the
    caller has it as a table: the distinct words, which are judged once, so that frequencies are made for their own rows alone.
    """
    distinct = staged(frequencies.select("word").distinct(), "vocabulary") if vocabulary is None else vocabulary
    hits = distinct.select("word", F.explode(suffix_candidates(F.col("word"))).alias("headword")).join(headwords, "headword", "left_semi").select("word").distinct()
    forms = irregular.select(F.col("form").alias("_form")).distinct()
    odd = distinct.select("word", F.explode(F.array("word", F.translate("word", "-'", ""))).alias("_form")).join(forms, "_form", "left_semi").select("word").distinct()
    cause = (
        F.when(F.col("_hit"), "hit")
        .when(F.col("word").isin(*CONTRACTIONS), "contraction")
        .when(F.col("_odd"), "irregular")
        .when(F.col("capitalized") / F.col("frequency") > CAPITAL_RATIO, "proper")
        .otherwise("gap")
    )
    # As a table, its size is known to the plan of the join that all frequencies go through.
    known = staged(hits.withColumn("_hit", F.lit(True)).join(odd.withColumn("_odd", F.lit(True)), "word", "full"), "judged")
    return frequencies.join(known, "word", "left").withColumn("cause", cause).drop("_hit", "_odd")


def coverage_rates(covered: DataFrame, key: list[str]) -> DataFrame:
    """types, tokens, and the shares of both that are hits and that stay a gap."""
    def share(cause: str, what):
        return F.sum(F.when(F.col("cause") == cause, what).otherwise(0)) / F.sum(what)

    one, n = F.lit(1), F.col("frequency")
    return covered.groupBy(*key).agg(F.count("*").alias("types"), F.sum(n).alias("tokens"), share("hit", one).alias("type_rate"), share("hit", n).alias("token_rate"), share("gap", n).alias("gap_rate"))


def greedy_matches(texts: DataFrame, expressions: DataFrame, key: list[str]) -> DataFrame:
    """Occurrences of expressions(key) in lower-case words: the longest match wins, and the search goes on behind it.

    Which runs of words are expressions at all comes from joins, by their first two words before any length is tried; only the choice among overlapping ones, which
    depends on order, is a loop over a text's few hits. Texts without a hit never leave the JVM.
    """
    known = staged(expressions.select(F.col("key").alias("expression"), F.size(F.split("key", " ")).alias("words")).filter("words > 1").distinct(), "expressions")
    lengths = [r[0] for r in known.select("words").distinct().collect()]
    if not lengths:
        return texts.select(*key, F.lit("").alias("expression"), F.lit(0).cast("long").alias("at")).limit(0)
    tokens = texts.select(*key, F.transform(words(F.col("text")), F.lower).alias("w")).filter("size(w) > 1")
    # A run as long as the longest expression from each place; only those whose first two words begin an expression are cut to its lengths.
    runs = tokens.select(*key, F.posexplode(F.expr(f"transform(sequence(1, size(w) - 1), i -> array_join(slice(w, i, {max(lengths)}), ' '))")).alias("at", "run"))
    pairs = known.select(F.substring_index("expression", " ", 2).alias("pair")).distinct()
    begun = runs.withColumn("pair", F.substring_index("run", " ", 2)).join(pairs, "pair", "left_semi")
    cut = begun.select(*key, "at", "run", F.explode(F.array(*(F.lit(n) for n in sorted(lengths)))).alias("words")).filter(F.size(F.split("run", " ")) >= F.col("words"))
    cut = cut.select(*key, "at", "words", F.expr("substring_index(run, ' ', words)").alias("expression"))
    hits = cut.join(known.select("expression"), "expression").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("at", (-F.col("words")).alias("turn"), "words", "expression"))).alias("hits"))
    start = F.expr("named_struct('end', 0, 'kept', cast(array() as array<struct<at:int,expression:string>>))")

    def step(state, hit):
        taken = F.struct((hit["at"] + hit["words"]).cast("int").alias("end"), F.concat(state["kept"], F.array(F.struct(hit["at"].cast("int").alias("at"), hit["expression"].alias("expression")))).alias("kept"))
        return F.when(hit["at"] >= state["end"], taken).otherwise(state)

    kept = hits.select(*key, F.explode(F.aggregate("hits", start, step)["kept"]).alias("k"))
    return kept.select(*key, "k.expression", F.col("k.at").cast("long").alias("at"))


def separated_verbs(texts: DataFrame, expressions: DataFrame, key: list[str], max_gap: int = MAX_GAP) -> DataFrame:
    """Verbs of two words whose particle stands apart: the first one at a distance of 2 to max_gap + 1. One row an occurrence.

    The distance is bounded, so that a verb's following words are an array of its row, where a range join would pair positions.
    """
    parts = F.split("key", " ")
    pairs = expressions.filter((F.size(parts) == 2) & (F.col("entry_pos") == "Verb")).select(F.get(parts, F.lit(0)).alias("verb"), F.get(parts, F.lit(1)).alias("particle"))
    pairs = pairs.filter(F.col("particle").isin(*PARTICLES)).groupBy("verb").agg(F.collect_set("particle").alias("particles"))
    tokens = texts.select(*key, F.transform(words(F.col("text")), F.lower).alias("w"))
    rows = tokens.select(*key, "w", F.posexplode("w").alias("at", "verb")).select(*key, "at", "verb", F.slice("w", F.col("at") + 3, F.lit(max_gap)).alias("following"))
    found = rows.join(pairs, "verb").withColumn("particle", F.get(F.filter("following", lambda x: F.array_contains(F.col("particles"), x)), F.lit(0)))
    return found.filter("particle is not null").select(*key, F.col("at").cast("long").alias("at"), "verb", "particle")


def filter_effect(raw: DataFrame, kept: DataFrame) -> DataFrame:
    """Occurrences and distinct expressions before and after a filter."""
    def count(rows: DataFrame, name: str) -> DataFrame:
        return rows.agg(F.count("*").alias(f"{name}_occurrences"), F.count_distinct("expression").alias(f"{name}_distinct"))

    both = count(raw, "raw").join(F.broadcast(count(kept, "kept")), F.lit(True))
    return both.withColumn("removed_share", 1 - F.col("kept_occurrences") / F.col("raw_occurrences"))


def lemma_gap(tokens: DataFrame, headwords: DataFrame) -> DataFrame:
    """Types and tokens that reach a headword by the form itself, by suffixes, and by the lemma; names left out."""
    rows = tokens.filter(F.col("is_alpha") & (F.col("pos") != PROPER_NOUN)).groupBy(F.lower("text").alias("word"), F.lower("lemma").alias("lemma")).agg(F.count("*").alias("n"))
    # Words and lemmas are counted by grouping, each once: distinct counts side by side would take every row six times.
    rows = staged(rows, "forms")
    heads = staged(headwords.select("headword").distinct().withColumn("_h", F.lit(True)), "heads")
    by_lemma = heads.select(F.col("headword").alias("lemma"), F.col("_h").alias("_lemma"))
    hit = F.coalesce(F.col("_lemma"), F.lit(False))
    own = staged(rows.join(by_lemma, "lemma", "left").groupBy("word").agg(F.sum("n").alias("n"), F.max(hit).alias("_lemma"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("_n_lemma")), "words")
    suffix = own.select("word", F.explode(suffix_candidates(F.col("word"))).alias("headword")).join(heads, "headword", "left_semi").select("word").distinct()
    suffix = staged(suffix.withColumn("_suffix", F.lit(True)), "suffix")
    joined = own.join(heads.select(F.col("headword").alias("word"), F.col("_h").alias("_raw")), "word", "left").join(suffix, "word", "left")
    out = [F.sum("n").alias("tokens"), F.count("word").alias("types")]
    for name, n in (("raw", "n"), ("suffix", "n"), ("lemma", "_n_lemma")):
        out += [F.count_if(F.coalesce(F.col(f"_{name}"), F.lit(False))).alias(f"{name}_types"), F.sum(F.when(F.col(f"_{name}"), F.col(n)).otherwise(0)).alias(f"{name}_tokens")]
    lemmas = rows.groupBy("lemma").agg(F.lit(1).alias("_one")).agg(F.count("lemma").alias("lemmas"))
    return joined.agg(*out).join(F.broadcast(lemmas), F.lit(True)).select("tokens", "types", "lemmas", *(f"{x}_{k}" for x in ("raw", "suffix", "lemma") for k in ("types", "tokens")))


def proper_noun_errors(tokens: DataFrame) -> DataFrame:
    """Forms that were never taken for a name but look like one (missed), or were and don't (overreach)."""
    order = Window.partitionBy(*CHAPTER, "sent_id").orderBy("tok_id")
    rows = tokens.filter("is_alpha").withColumn("first", F.row_number().over(order) == 1)
    own = rows.groupBy(F.lower("text").alias("form")).agg(
        F.count("*").alias("total"), F.count_if(F.col("text").rlike(r"^\p{Lu}") & ~F.col("first")).alias("capitalized"),
        F.count_if(F.col("pos") == PROPER_NOUN).alias("proper"), F.count_if(F.col("pos").isin(*CONTENT_POS)).alias("content"),
    )
    share = F.col("capitalized") / F.col("total")
    missed = (F.col("proper") == 0) & (F.col("content") > 0) & (F.col("total") >= 3) & (share > CAPITAL_RATIO)
    overreach = (F.col("proper") > 0) & (F.col("proper") < F.col("total")) & (share < CAPITAL_RATIO)
    return own.withColumn("error", F.when(missed, "missed").when(overreach, "overreach")).filter("error is not null").select("form", "error", "total", "proper", "capitalized")


def phrasal_verb_gap(tokens: DataFrame, expressions: DataFrame) -> DataFrame:
    """Particle verbs by how they stand: contiguous, separated, or unknown to expressions(key)."""
    verb = tokens.select(*CHAPTER, "sent_id", F.col("tok_id").alias("head_id"), F.lower("lemma").alias("verb"))
    rows = tokens.filter(F.col("dep").isin(*PARTICLE_DEPS)).select(*CHAPTER, "sent_id", "tok_id", "head_id", F.lower("text").alias("particle")).join(verb, [*CHAPTER, "sent_id", "head_id"])
    rows = rows.withColumn("key", F.concat_ws(" ", "verb", "particle")).join(expressions.select("key").distinct().withColumn("_known", F.lit(True)), "key", "left")
    kind = F.when(F.col("_known").isNull(), "unknown").when(F.col("tok_id") - F.col("head_id") <= 1, "contiguous").otherwise("separated")
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("occurrences"), F.count_distinct("key").alias("verbs"))


def bucket(n):
    out = F.lit(BUCKET_TAIL)
    for low, high, name in reversed(BUCKETS):
        out = F.when((n >= low) & (n <= high), F.lit(name)).otherwise(out)
    return out


def ambiguity_histogram(counts: DataFrame) -> DataFrame:
    """counts(lemma, pos, n): lemmas a bucket of their number of senses."""
    return counts.groupBy(bucket(F.col("n")).alias("bucket")).agg(F.count("*").alias("lemmas"))


def ambiguity_summary(counts: DataFrame) -> DataFrame:
    some, several = F.when(F.col("n") > 0, F.col("n")), F.when(F.col("n") > 1, F.col("n"))
    return counts.agg(
        F.count("*").alias("lemmas"), F.count(some).alias("with_entry"), F.count(several).alias("ambiguous"), F.percentile(some, F.lit(0.5)).alias("median_senses"),
        F.percentile(several, F.lit(0.5)).alias("median_ambiguous"), F.sum("n").alias("senses"),
    )


def longest_lists(counts: DataFrame, k: int) -> DataFrame:
    return counts.orderBy(F.col("n").desc(), "lemma", "pos").limit(k)


def ambiguous_sample(occurrences: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """The k most frequent lemmas with several senses."""
    rows = occurrences.join(counts.filter("n > 1").select("lemma", "pos", F.col("n").alias("senses")), ["lemma", "pos"])
    return rows.orderBy(F.col("frequency").desc(), "lemma", "pos").limit(k)


def typical_words(dictionary: DataFrame, k: int) -> DataFrame:
    """The k headwords whose length is nearest to the median length."""
    rows = dictionary.select("written_rep").filter("written_rep is not null").distinct().withColumn("n", F.length("written_rep"))
    median = rows.agg(F.percentile("n", F.lit(0.5)).alias("median"))
    return rows.join(F.broadcast(median), F.lit(True)).orderBy(F.abs(F.col("n") - F.col("median")), F.lower("written_rep"), "written_rep").limit(k).select("written_rep")


def nearest_length(texts: DataFrame, column: str, target: int, k: int) -> DataFrame:
    """The k distinct texts whose length is nearest to the target."""
    return texts.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(F.abs(F.length(column) - target), column).limit(k)


def chunks(texts: DataFrame, key: list[str], size: int = 40_000, limit_words: int = 0) -> DataFrame:
    """Texts cut at paragraphs into pieces of about size characters; limit_words ends a text at the first paragraph past it."""
    rows = texts.select(*key, F.posexplode(F.split("text", r"\n\s*\n")).alias("at", "part")).withColumn("part", strip(F.col("part"))).filter("part <> ''")
    order = Window.partitionBy(*key).orderBy("at")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    if limit_words:
        rows = rows.withColumn("_words", F.coalesce(F.sum(word_count(F.col("part"))).over(before), F.lit(0))).filter(F.col("_words") < limit_words).drop("_words")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"])
    start = F.expr("named_struct('n', 0, 'done', cast(array() as array<string>), 'held', cast(array() as array<string>))")

    def step(state, part):
        n, held = (state["n"] + F.length(part)).cast("int"), F.concat(state["held"], F.array(part))
        none = F.expr("cast(array() as array<string>)")
        full = F.struct(F.lit(0).alias("n"), F.concat(state["done"], F.array(F.array_join(held, "\n\n"))).alias("done"), none.alias("held"))
        return F.when(n >= size, full).otherwise(F.struct(n.alias("n"), state["done"].alias("done"), held.alias("held")))

    def end(state):
        rest = F.when(F.size(state["held"]) > 0, F.array(F.array_join(state["held"], "\n\n"))).otherwise(F.expr("cast(array() as array<string>)"))
        return F.concat(state["done"], rest)

    return rows.groupBy(*key).agg(listed.alias("parts")).select(*key, F.posexplode(F.aggregate("parts", start, step, end)).alias("chunk", "text"))


def analyzer_traps(analyzed: DataFrame, expected: DataFrame) -> DataFrame:
    """Labelled tokens(sentence, word, pos, lemma) against an analysis of the same columns: how many agree."""
    both = expected.alias("e").join(analyzed.alias("a"), ["sentence", "word"], "left")
    right = (F.col("a.pos") == F.col("e.pos")) & (F.lower(F.col("a.lemma")) == F.lower(F.col("e.lemma")))
    return both.agg(F.count("*").alias("n"), F.count_if(F.coalesce(right, F.lit(False))).alias("right"))
