"""WARC archives and token files."""

from __future__ import annotations

import base64
import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossmill.llm import bpe, token_counts, warc
from glossmill.llm.common import fresh_path, materialize, shared_dir

PAGES = "page_id long, url string, html string, digest string, row_uid int"


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h, "d", 1) for i, u, h in rows], PAGES)


def brute(rows):
    groups = defaultdict(list)
    for i, _, h in rows:
        groups[h or ""].append(i)
    out = []
    for i, _, h in rows:
        top = max(groups[h or ""])
        data = (h or "").encode()
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if i == top else "revisit", None if i == top else top))
    return sorted(out, key=str)


def nested():
    """Payloads with whole records, magic and gzip headers inside."""
    inner = warc.record(1, "http://x", b"inner", warc.base32_sha1(b"inner"), 5, None).decode()
    return [f"<p>{inner}</p>", inner, inner * 3, "WARC/1.1\r\n" * 20, "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" + inner, "\x1f\x8b\x08 x", "\r\n\r\n", inner + "x" * 3000]


COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@pytest.mark.parametrize("zipped", [False, True])
@pytest.mark.parametrize("block", [97, 1 << 22])
def test_round_trip_rejects_what_is_inside_payloads(spark, zipped, block):
    rows = [(i, f"http://h/{i}", h) for i, h in enumerate(nested() + ["<p>ä</p>", "<p>ä</p>", None, "", "z" * 40_000, "<p>ä</p>"])] + [(50, None, "u\r\nv"), (51, "http://a\r\nX: y", "w")]
    files = materialize(spark, warc.write_archives(spark, pages_of(spark, rows).repartition(2), fresh_path(spark, "t"), zipped), "t")
    got = warc.read_archives(spark, files, block).filter("record_type <> 'warcinfo'")
    got = got.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to")).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


@pytest.mark.parametrize("zipped", [False, True])
def test_headers_and_payloads_of_any_length_lose_no_record(spark, zipped):
    r = random.Random(5)
    noise = "".join(chr(r.randrange(33, 126)) for _ in range(1_000_000))
    rows = [(1, "http://h/1", "first"), (2, "http://h/" + noise, "second"), (3, "http://h/3", "WARC/1.1\r\n" * 300_000), (4, "http://h/4", "WARC/1.1\r\nContent-Length: 4\r\n" * 50_000 + "\r\nabcd\r\n\r\n"), (5, "u", "x" * 5_000_000), (6, "u", "last")]
    files = materialize(spark, warc.write_archives(spark, pages_of(spark, rows).repartition(1), fresh_path(spark, "t"), zipped), "t")
    got = warc.read_archives(spark, files, 1 << 20).filter("record_type <> 'warcinfo'")
    got = got.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to")).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_query_form_ties_and_nulls(spark):
    rows = [(None, None, "a"), (3, "u", "a"), (3, "u", "a"), (None, None, "b"), (None, None, "b"), (4, "u", "c")]
    got = [tuple(r[c] for c in COLUMNS) for r in warc.archive_round_trip(spark, pages_of(spark, rows)).collect()]
    assert sorted(((r[0], r[3], r[4]) for r in got), key=str) == sorted([(None, "revisit", 3), (3, "response", None), (3, "revisit", 3), (None, "response", None), (None, "revisit", None), (4, "response", None)], key=str)
    assert warc.archive_round_trip(spark, pages_of(spark, []).limit(0)).isEmpty()


def test_small_payloads_may_all_be_responses(spark):
    rows = [(1, "u", "same"), (2, "u", "same"), (3, "u", "longer one"), (4, "u", "longer one")]
    files = materialize(spark, warc.write_archives(spark, pages_of(spark, rows), fresh_path(spark, "t"), True, least=5), "t")
    got = {r["page_id"]: r["record_type"] for r in warc.read_archives(spark, files).collect()}
    assert [got[str(i)] for i in (1, 2, 3, 4)] == ["response", "response", "revisit", "response"]


def test_a_cut_archive_ends_at_the_damage(spark, tmp_path):
    parts = [warc.info_record()] + [warc.record(i, "u", b"x" * 50, warc.base32_sha1(b"x" * 50), 50, None) for i in range(6)]
    whole = b"".join(parts)
    at = len(b"".join(parts[:4]))
    broken = whole[:at] + b"?" * 8 + whole[at + 8 :]
    (tmp_path / "a.warc").write_bytes(broken)
    files = spark.createDataFrame([(f"file://{tmp_path}/a.warc", len(broken))], "path string, size long")
    assert sorted(r["page_id"] for r in warc.read_archives(spark, files, 200).filter("record_type = 'response'").collect()) == ["0", "1", "2"]


def test_token_counts_equal_the_encoder(spark, documents, prose):
    texts = [prose(i, i % 50) for i in range(80)] + ["", None, "x", prose(1, 3000), prose(1, 20), prose(1, 20)]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(None, "null id"), (0, texts[0])]
    import public_tokenizers

    own = bpe.codec(public_tokenizers.path(bpe.RANKS))
    got = token_counts.document_token_counts(spark, documents(rows).repartition(3)).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(((i, len(own.encode(t or ""))) for i, t in rows), key=str)
    assert token_counts.document_token_counts(spark, documents([])).isEmpty()


@pytest.mark.parametrize("block", [2, 6, 14, 1 << 20])
def test_lengths_over_block_borders(spark, tmp_path, block):
    r = random.Random(block)
    files, want = [], []
    for k, lengths in enumerate([[r.choice([0, 0, 1, 2, 5, 30]) for _ in range(40)], [100], [0], [], [3, 3]]):
        ids = [x for n in lengths for x in ([1] * n + [9])] + ([1] * 7 if k in (1, 3) else [])
        path = tmp_path / f"{k}.tokens"
        path.write_bytes(np.array(ids, "<u2").tobytes())
        files.append((f"file://{path}", 2 * len(ids)))
        want += [(f"file://{path}", i, n) for i, n in enumerate(lengths + ([7] if k in (1, 3) else []))]
    got = token_counts.token_counts(spark, spark.createDataFrame(files, "path string, size long"), separator=9, block=block)
    assert sorted(tuple(x) for x in got.select("path", "ordinal", "n_tokens").collect()) == sorted(want)


def test_shared_folder_is_that_of_the_session(spark):
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert shared_dir(spark) == (configured.rstrip("/") if configured else shared_dir(spark))


def test_pages_of_a_hot_payload_are_not_shuffled(spark, monkeypatch):
    rows = [(i, f"u{i}", "error page" if i % 3 else f"own {i}") for i in range(1500)] + [(5000, "u", None), (5001, "u", "")]
    seen = []
    joined = warc.join_sized
    monkeypatch.setattr(warc, "join_sized", lambda *a, **k: seen.append(joined(*a, **k)) or seen[-1])
    files = materialize(spark, warc.write_archives(spark, pages_of(spark, rows).repartition(3), fresh_path(spark, "t")), "t")
    got = warc.read_archives(spark, files).filter("record_type <> 'warcinfo'")
    got = got.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to")).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") >= 2  # hot digests come to their pages; only the others' pages are moved
    assert files.count() > 1
