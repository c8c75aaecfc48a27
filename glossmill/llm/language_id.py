"""Language identification by compression.

For each language a raw-content zstandard dictionary is made from a bounded sample of labelled rows: up to ROWS distinct
texts, of up to BYTES together, each of them whole. A text is cut into chunks that cover all of it; each
chunk is compressed with each dictionary, and the language with the smallest sum of sizes wins. A text
whose runner-up is too near is rejected.

Defined results: null text and text without a letter give `und` with score 0; without any labelled row
every text is `und`; more than LANGUAGES labels are an error; ties go to the first language by name; every row gives one row; an empty table
gives an empty result; columns other than doc_id, text and lang are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossmill.llm.common import Batches, bounded_batches, crc_mod, join_sized, materialize, texts_of

#: The bound of the training sample: distinct texts a language, their bytes, the bytes of all languages, and languages. A
#: dictionary of all its texts fits the window; a text that would pass the bound is left out as a whole.
ROWS, BYTES, ALL_BYTES, LANGUAGES = 150, 480_000, 120_000_000, 1000
#: Bytes of text that one compression takes.
CHUNK = 4096
PARAMETERS = {"window_log": 19, "chain_log": 19, "hash_log": 17, "search_log": 3, "min_match": 4, "target_length": 16, "strategy": zstandard.STRATEGY_LAZY2}
#: A text is rejected under this score.
NARROW = 0.55
LETTER = re.compile(r"[^\W\d_]")
#: ASCII bytes that are no letters become spaces; they tell no language apart.
WORDS_ONLY = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
#: Fills short chunks up, as zstandard stores what it can't shorten by some bytes without any match.
BALLAST = b" " * 1024


def letters(text: str) -> bytes:
    """Lower-case words in UTF-8, a space between them."""
    return b" ".join(text.lower().encode().translate(WORDS_ONLY).split())


def sample(labelled: DataFrame) -> list[tuple[str, str]]:
    """Up to ROWS distinct texts of each language, chosen by a digest of theirs, as (lang, whole text)."""
    spark = labelled.sparkSession
    keyed = labelled.filter("text <> ''").withColumn("digest", F.md5("text"))
    distinct = materialize(spark, keyed.groupBy("lang", "digest").agg(F.min(F.octet_length("text")).alias("size")), "language-texts")
    counts = materialize(spark, distinct.groupBy("lang").agg(F.count("*").alias("n")), "language-counts")
    total, languages = counts.agg(F.sum("n"), F.count("*")).first()
    if not languages:
        return []
    if languages > LANGUAGES:
        raise ValueError(f"{languages} languages are labelled, and {LANGUAGES} is the most that a worker holds dictionaries of")
    # Enough of each language, by the digest, so that a language's texts are never all in one task; then the first by digest.
    at = F.conv(F.substring("digest", 1, 7), 16, 10).cast("double") / float(16**7)
    drawn = join_sized(distinct, counts, ["lang"], "n", total).filter(at < (2.0 * ROWS + 50) / F.col("n"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("digest"))
    rows = drawn.withColumn("turn", first).filter(F.col("turn") <= ROWS).select("lang", "digest", "size").collect()
    most, left, chosen = min(BYTES, ALL_BYTES // languages), {}, []
    for r in sorted(rows, key=lambda r: (r["lang"], r["digest"])):
        if r["size"] <= left.setdefault(r["lang"], most):
            left[r["lang"]] -= r["size"]
            chosen.append((r["lang"], r["digest"]))
    if not chosen:
        return []
    wanted = spark.createDataFrame(chosen, "lang string, digest string")  # ROWS a language at most
    texts = keyed.join(F.broadcast(wanted), ["lang", "digest"]).groupBy("lang", "digest").agg(F.min("text").alias("text")).collect()
    return [(r["lang"], r["text"]) for r in sorted(texts, key=lambda r: (r["lang"], r["digest"]))]


def dictionaries(pairs: list[tuple[str, str]]) -> dict[str, bytes]:
    """The letters of each language's rows one after another, all of them."""
    found: dict[str, bytes] = {}
    for lang in sorted({k for k, _ in pairs}):
        joined = b" ".join(letters(x) for k, x in pairs if k == lang)
        if joined.strip():
            found[lang] = joined
    return found


class Identifier:
    def __init__(self, found: dict[str, bytes]):
        self.languages = sorted(found)
        self.compressors = []
        for k in self.languages:
            d = zstandard.ZstdCompressionDict(found[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own = zstandard.ZstdCompressionParameters(write_checksum=False, write_content_size=False, write_dict_id=False, **PARAMETERS)
            d.precompute_compress(compression_params=own)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=d, compression_params=own))

    def sizes(self, words: bytes) -> np.ndarray:
        total = np.zeros(len(self.languages), np.int64)
        for low in range(0, len(words), CHUNK):
            part = words[low : low + CHUNK]
            if len(part) < len(BALLAST):
                part += BALLAST
            total += [len(c.compress(part)) for c in self.compressors]
        return total

    def predict(self, text: str) -> tuple[str, float, float]:
        """Language, score from 0 to 1, and the margin: bytes saved against the runner-up, by the best size."""
        if not self.languages or not LETTER.search(text):
            return "und", 0.0, 0.0
        sizes = self.sizes(letters(text))
        best = int(sizes.argmin())
        if len(sizes) == 1:
            return self.languages[0], 1.0, 1.0
        saved = np.delete(sizes, best) - sizes[best]
        return self.languages[best], float(1 / (1 + np.exp(-0.5 * np.minimum(saved, 80)).sum())), float(saved.min() / max(1, sizes[best]))


def learn(labelled: DataFrame) -> dict[str, bytes]:
    """Dictionaries from labelled(text, lang)."""
    return dictionaries(sample(labelled.select("text", F.col("lang").cast("string").alias("lang")).filter("lang is not null")))


def language_of(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin; rows whose crc32 modulo 4 is 2 teach nothing."""
    bounded_batches(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"))
    found = learn(source.filter("not held_out"))

    def run(batches: Batches) -> Batches:
        own = Identifier(found)
        for batch in batches:
            out = [own.predict(x) for x in texts_of(batch.column("text"))]
            columns = [pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *columns], ["doc_id", "held_out", "lang_pred", "score", "margin"])

    return source.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, margin double")


def drop_rejected(spark: SparkSession, docs: DataFrame, narrow: float = NARROW) -> DataFrame:
    """The rows of docs whose language is clear, with all their columns; learns as language_of does."""
    bounded_batches(spark)
    found = learn(docs.filter(F.coalesce(crc_mod("doc_id", 4) != 2, F.lit(True))))

    def run(batches: Batches) -> Batches:
        own = Identifier(found)
        for batch in batches:
            out = [own.predict(x) for x in texts_of(batch.column("text"))]
            yield batch.filter(pa.array([x[0] != "und" and x[1] >= narrow for x in out], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
