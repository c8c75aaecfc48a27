"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.llm import bpe, decontaminate, exact_dedup, language_id, lm_score, mixing, near_dup, quality, spelling, substring_dedup, token_counts, warc, whitening
from glossmill.llm.common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_of(spark, table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(spark, table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(spark, table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(spark, table(spark, sf_dir, "documents"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_scores(spark, table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.document_token_counts(spark, table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.jaccard_join(spark, table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(spark, table(spark, sf_dir, "pages"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(spark, table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(spark, table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(spark, table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_language_id, op2_substring_dedup, op3_exact_dedup, op4_decontamination, op5_quality, op6_bpe, op7_lm_score, op8_token_counts, op9_jaccard_join, op10_warc, op11_mixing, op12_spelling, op13_whitening)
}

ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, text_sha256
        FROM t WINDOW g AS (PARTITION BY text_sha256)""",
    "op10_warc": """
        WITH t AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
        d AS (
            SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   ((('0x' || substr(h, (5 * (i // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), '') AS payload_digest FROM t)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN page_id = max(page_id) OVER g THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> max(page_id) OVER g THEN max(page_id) OVER g END AS refers_to
        FROM d WINDOW g AS (PARTITION BY payload_digest)""",
    "op11_mixing": r"""
        WITH docs AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint AS size,
                   ('0x' || substr(md5('0:' || coalesce(doc_id::varchar, '')), 1, 15))::bigint AS key FROM documents),
        sources AS (SELECT source, sum(size)::bigint AS source_size FROM docs GROUP BY source),
        ranked AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, 3 * source_size AS cap,
                          row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sources),
        before AS (SELECT *, coalesce(sum(cap) OVER o, 0) AS capped, coalesce(sum(weight) OVER o, 0) AS spent, sum(source_size) OVER () AS whole, sum(weight) OVER () AS weights
                   FROM ranked WINDOW o AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        free AS (SELECT *, whole - capped AS left_over, weights - spent AS share, (whole - capped) * weight <= cap * (weights - spent) AS free FROM before),
        level AS (SELECT arg_min(left_over, (cap / weight, rank)) AS l, arg_min(share, (cap / weight, rank)) AS s FROM free WHERE free),
        targets AS (SELECT source, source_size, CASE WHEN free THEN l::double * weight / s::double ELSE cap::double END AS target FROM free, level),
        placed AS (SELECT d.doc_id, size, source_size, target, round(target)::bigint AS budget,
                          coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
                   FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
               CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size * size + least(greatest(budget % source_size - place, 0), size) END::bigint AS taken FROM placed""",
    "op12_spelling": r"""
        WITH table_256 AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
        runs AS (SELECT coalesce(doc_id::varchar, '') || ':' AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
        counted AS (SELECT id, run, count(*) AS n, hex(encode(id || run)) AS h FROM runs WHERE length(run) >= 7 GROUP BY ALL),
        hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint)),
                              lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM counted, table_256),
        spelt AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
        words AS (SELECT word, sum(n)::bigint AS n FROM spelt WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
        cuts AS (SELECT word, n, unnest(range(length(word))) AS i FROM words),
        gaps AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS gap FROM cuts),
        pairs AS (
            SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM gaps a JOIN gaps b ON a.i = b.i AND a.gap = b.gap AND a.word <> b.word
            UNION SELECT w.word, w.n, g.word, g.n FROM words w JOIN gaps g ON w.word = g.gap
            UNION SELECT g.word, g.n, w.word, w.n FROM words w JOIN gaps g ON w.word = g.gap),
        best AS (SELECT word, count(*) AS n_near, min((-other_n, other)) AS b FROM pairs GROUP BY word),
        formed AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b[1] >= 10 * w.n THEN b[2] END AS form, CASE WHEN -b[1] >= 10 * w.n THEN -b[1] END AS form_n
                   FROM words w LEFT JOIN best USING (word)),
        followed AS (
            WITH RECURSIVE f AS (SELECT word, word AS reached, 0 AS step FROM formed UNION ALL SELECT f.word, x.form, step + 1 FROM f JOIN formed x ON f.reached = x.word WHERE x.form IS NOT NULL)
            SELECT word, arg_max(reached, step) AS root FROM f GROUP BY word)
        SELECT word, form, root, n, n_near, form_n FROM formed JOIN followed USING (word)""",
}
