"""Spelling variant grouping by a symmetric-delete join.

Every word emits itself and its distinct single deletions; words that share a key are joined, and a pair counts if one
inserted, deleted or replaced code point is all that tells its words apart. A pair of near words shares just one
key: the shorter word itself, or what is left of both without the place where they differ. So no pair is met twice.
A key is shared by no more words than there are letters to put into its places, whatever the size of the corpus.

A word's form is its near word of largest count, if that is at least ten times its own; roots follow the forms by joins
that double the step. Counts grow by ten with each form, so that a root is at most as many forms away as the largest
count has digits, and there are no circles.

Defined results: null and empty texts have no words; a null doc_id counts as an empty one; repeated rows count again;
ties in count go to the smallest word in code-point order; an empty table gives an empty result. Very long texts are
cut between words into pieces, so that no list holds all words of one. Very long words emit fingerprints of what they
would emit, so that their keys grow with their length and not with its square. Other columns are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from glossmill.llm.common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters of a word, once A-Z are lower-cased.
LETTER = r"[a-z\u00C0-\u00FF]"
#: Characters of a piece of text, which goes on to the end of its last word.
PIECE = 1 << 16
#: Code points that a word has at least, and occurrences.
SHORTEST, RAREST = 7, 2
#: Words of more code points emit fingerprints.
LONG = 64
#: One in so many (document, word) loses a code point.
MISSPELT = 31
#: So many times as frequent as a word its form is at least.
RATIO = 10


def without(word: Column, place: Column) -> Column:
    """The word without its code point at a place from 0."""
    return F.concat(F.substring(word, F.lit(1), place), F.substring(word, place + 2, F.length(word)))


def words_of(docs: DataFrame, shortest: int = SHORTEST, misspelt: int | None = MISSPELT) -> DataFrame:
    """Each occurrence of a word that is long enough, from doc_id and text."""
    folded = F.translate("text", UPPER, LOWER)
    pieces = docs.select("doc_id", F.explode(F.regexp_extract_all(folded, F.lit(f"(?s).{{1,{PIECE}}}{LETTER}*+"), F.lit(0))).alias("piece"))
    rows = pieces.select("doc_id", F.explode(F.regexp_extract_all("piece", F.lit(f"{LETTER}{{{shortest},}}"), F.lit(0))).alias("word"))
    if misspelt:
        rows = rows.withColumn("_hash", F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "word")))
        place = (F.col("_hash") % F.length("word")).cast("int")
        rows = rows.withColumn("word", F.when(F.col("_hash") % misspelt == 0, without(F.col("word"), place)).otherwise(F.col("word")))
    return rows.select("word").filter(F.length("word") >= shortest)


@F.pandas_udf(ArrayType(LongType()))
def fingerprints(words: pd.Series) -> pd.Series:
    """Fingerprints of a word and of its distinct single deletions, from residues of what stands before and behind each place."""
    moduli, base = (2147483629, 2147483587), 1_000_003  # two primes below 2^31

    def of(word: str) -> list[int]:
        codes, n, parts = [ord(c) for c in word], len(word), []
        for m in moduli:
            before, behind, power = [0], [0], [1]
            for c in codes:
                before.append((before[-1] * base + c) % m)
                power.append(power[-1] * base % m)
            for i, c in enumerate(reversed(codes)):
                behind.append((c * power[i] + behind[-1]) % m)
            places = [i for i in range(n) if i == 0 or codes[i] != codes[i - 1]]
            parts.append([before[n], *((before[i] * power[n - 1 - i] + behind[n - 1 - i]) % m for i in places)])
        return [a << 31 | b for a, b in zip(*parts, strict=True)]

    return words.map(of)


def _long_pairs(words: DataFrame) -> DataFrame:
    """The pairs with a word of more than LONG code points: keys meet by fingerprint, words come back to what has met."""
    longer = words.filter(F.length("word") >= LONG).withColumn("id", F.sha2("word", 256))
    keys = longer.select("id", F.explode(fingerprints("word")).alias("key"))
    met = keys.alias("l").join(keys.alias("r"), (F.col("l.key") == F.col("r.key")) & (F.col("l.id") != F.col("r.id"))).select(F.col("l.id").alias("id"), F.col("r.id").alias("other_id")).distinct()
    others = longer.select(F.col("id").alias("other_id"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    pairs = met.join(longer, "id").join(others, "other_id")
    return pairs.filter((F.greatest(F.length("word"), F.length("other")) > LONG) & (F.levenshtein("word", "other", 1) == 1)).select("word", "n", "other", "other_n")


def near_pairs(words: DataFrame) -> DataFrame:
    """word, n, other, other_n: each word beside each near one, in both directions. words has word and n, a row a word."""
    deletions = F.array_distinct(F.transform(F.sequence(F.lit(0), F.length("word") - 1), lambda i: without(F.col("word"), i)))
    keys = words.filter(F.length("word") <= LONG).select("word", "n", F.explode(F.concat(F.array("word"), deletions)).alias("key"))
    near = (F.col("l.key") == F.col("r.key")) & (F.col("l.word") != F.col("r.word")) & (F.levenshtein("l.word", "r.word", 1) == 1)
    pairs = keys.alias("l").join(keys.alias("r").hint("merge"), near).select("l.word", "l.n", F.col("r.word").alias("other"), F.col("r.n").alias("other_n"))
    return pairs.unionByName(_long_pairs(words))


def forms(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n of each word."""
    alone = words.select("word", "n", F.lit(None).cast("string").alias("other"), F.lit(None).cast("long").alias("other_n"))
    best = F.min(F.when(F.col("other").isNotNull(), F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("form"))))
    found = near_pairs(words).unionByName(alone).groupBy("word", "n").agg(F.count("other").alias("n_near"), best.alias("_best"))
    enough = -F.col("_best.minus") >= F.col("n") * ratio
    return found.select("word", "n", "n_near", F.when(enough, F.col("_best.form")).alias("form"), F.when(enough, -F.col("_best.minus")).alias("form_n"))


def roots(spark: SparkSession, links: DataFrame) -> DataFrame:
    """word and root for each word that has a form; links has word and form.

    Each step joins the words that are on their way to where their targets point, which doubles the way.
    """
    done, pending = [], materialize(spark, links.select("word", F.col("form").alias("root")), "links")
    while True:
        known = pending
        for part in done:
            known = known.unionByName(part)
        onward = known.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = materialize(spark, pending.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNull().alias("_ended")), "roots")
        done.append(step.filter("_ended").drop("_ended"))
        pending = step.filter("not _ended").drop("_ended")
        if pending.isEmpty():
            out = done[0]
            for part in done[1:]:
                out = out.unionByName(part)
            return out


def spelling_groups(spark: SparkSession, docs: DataFrame, shortest: int = SHORTEST, rarest: int = RAREST, misspelt: int | None = MISSPELT, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row a word of the corpus."""
    counted = words_of(docs, shortest, misspelt).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= rarest)
    found = materialize(spark, forms(materialize(spark, counted, "words"), ratio), "forms")
    rooted = roots(spark, found.filter("form is not null"))
    rows = found.join(rooted, "word", "left").withColumn("root", F.coalesce("root", "word"))
    return rows.select("word", "form", "root", "n", "n_near", "form_n")
