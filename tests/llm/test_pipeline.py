"""The corpus pipeline against plain Python, stage after stage."""

from __future__ import annotations

import hashlib
import random
import re
from itertools import combinations

import corpus_pipeline
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken

from glossmill.llm import bpe, language_id
from glossmill.llm.common import crc_mod

WORDS = {"aa": "the and of to is in that house river walking stone green", "bb": "der und die ist nicht das haus fluss gehen strasse stein grün"}


def text_of(r, language, n):
    return " ".join(r.choice(WORDS[language].split()) for _ in range(n))


def corpus():
    r = random.Random(17)
    items = [text_of(r, "aa", 25), text_of(r, "bb", 25), None, ""]
    rows = [(i, text_of(r, "aa" if i % 2 else "bb", r.randint(40, 80)), "aa" if i % 2 else "bb") for i in range(60)]
    base = text_of(r, "aa", 150).split()
    for i in range(100, 108):  # near copies: one word of 150 differs
        at = r.randrange(150)
        rows.append((i, " ".join([*base[:at], "lamp", *base[at + 1 :]]), "aa"))
    rows += [(200, rows[0][1].replace(" ", "\n\t "), "bb"), (200, rows[0][1], "bb"), (201, rows[1][1], None)]
    rows += [(300, f"{text_of(r, 'aa', 30)} {items[0]} {text_of(r, 'aa', 30)}", "aa"), (301, f"{text_of(r, 'bb', 30)} {items[1].replace('haus', 'hans', 1)}", "bb")]
    rows += [(400, None, "aa"), (401, "", "bb"), (402, "12 34 !!", "aa"), (403, "the the", "aa"), (404, text_of(r, "bb", 20_000), None)]
    return rows, items


@pytest.fixture
def folder(tmp_path):
    def write(rows, items):
        columns = {"doc_id": pa.int64(), "text": pa.string(), "lang": pa.string(), "source": pa.string(), "n_chars": pa.int64(), "_uid": pa.int64(), "sig": pa.string()}
        whole = [(i, t, k, "s", None if t is None else len(t), 77, "g") for i, t, k in rows]
        pq.write_table(pa.table({name: pa.array([x[k] for x in whole], kind) for k, (name, kind) in enumerate(columns.items())}), tmp_path / "documents.parquet")
        pq.write_table(pa.table({"item_id": pa.array(range(len(items)), pa.int64()), "text": pa.array(items, pa.string())}), tmp_path / "benchmark.parquet")
        return str(tmp_path)

    return write


def shingles(text):
    w = text.split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))


def distance(item, text):
    """The smallest edit distance of item to any substring."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for j, d in enumerate(item, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
        best = min(best, row[-1])
    return best


def brute(rows, items, found):
    own = language_id.Identifier(found)
    kept = [(i, t) for i, t, _ in rows for name, score, _ in [own.predict(t or "")] if name != "und" and score >= language_id.NARROW]
    first = {}
    for i, t in sorted(kept):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), (i, t))
    kept = sorted(first.values())
    sets, part = [shingles(t) for _, t in kept], list(range(len(kept)))
    for a, b in combinations(range(len(kept)), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            low, high = sorted((part[a], part[b]))
            part = [low if x == high else x for x in part]
    kept = [x for k, x in enumerate(kept) if part[k] == k]
    return [(i, t) for i, t in kept if len(t) > 50_000 or not any(x and distance(x, t) <= len(x) // 10 for x in items)]


def test_rows_equal_brute_force(spark, folder):
    rows, items = corpus()
    sf_dir = folder(rows, items)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = language_id.learn(docs.filter(crc_mod("doc_id", 4) != 2))
    want = brute(rows, items, found)
    assert {i for i, _ in want} >= set(range(40, 60)) and len({i for i, _ in want} & set(range(100, 108))) == 1 and not {i for i, _ in want} & {200, 201, 300, 301, 400, 401, 402}
    ranks = language_ranks()
    sha = lambda x: hashlib.sha256(x).hexdigest()
    ids = {i: ranks.encode_ordinary(t) for i, t in want}
    got = corpus_pipeline.run(spark, sf_dir).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert sorted(map(tuple, got.collect())) == sorted((i, len(ids[i]), sha(" ".join(map(str, ids[i])).encode()), sha(t.encode())) for i, t in want)


def language_ranks():
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(bpe.RANKS), "rb"))}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_stages_keep_the_columns_of_documents_and_their_values(spark, folder):
    rows, items = corpus()
    sf_dir = folder(rows, items)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs_after = stage(spark, docs, sf_dir)
        assert docs_after.schema == docs.schema and docs_after.filter("_uid <> 77 or sig <> 'g' or source <> 's'").isEmpty() and not docs_after.isEmpty()


def test_empty_tables(spark, folder):
    assert corpus_pipeline.run(spark, folder([], [])).isEmpty()
