"""Queries against their SQL on the smallest tables, and the driver's contract without the training-data subpackage."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from glossmill.plans import catalogue, registry

DATA = "/root/testdata/sf0.001"


def plain(value):
    if value is None or value is pd.NA or value != value:
        return None
    return round(float(value), 6) if isinstance(value, (int, float)) and not isinstance(value, bool) or hasattr(value, "dtype") and value.dtype.kind in "if" else str(value)


def rows_of(frame):
    columns = sorted(frame.columns)
    return columns, sorted(repr([plain(v) for v in r]) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "events", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    assert rows_of(catalogue.QUERIES[name](spark, DATA).toPandas()) == rows_of(con.execute(catalogue.ORACLE_SQL[name]).df())


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("pipeline", [True, False])
def test_contract_on_a_copy_without_the_training_data_folders(tmp_path, pipeline):
    root = Path(__spark_entry__.__file__).parent
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *([] if pipeline else ["corpus_pipeline.py"])))
    assert not (copy / "glossmill" / "llm").exists() and (copy / "corpus_pipeline.py").exists() == (pipeline and (root / "corpus_pipeline.py").exists())
    code = (
        "import __spark_entry__ as e, sys; q = e.queries(); assert q and e.oracle_sql() and set(e.oracle_sql()) <= set(q);"
        "assert not any(n.startswith('op') or n == 'pipeline' for n in q) and not any('llm' in m for m in sys.modules)"
    )
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], check=True, cwd=copy, env=environment)


def test_pages_and_obstacles_have_every_word_of_each_chapter(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    sql = con.execute(catalogue.ORACLE_SQL["sheets_of_33"]).df()
    want = {k: (len(x), x["sheet_count"].iloc[0]) for k, x in sql.groupby(["book_title", "chapter"])}
    pages = catalogue.QUERIES["printed_pages"](spark, DATA).collect()
    assert {(r["book_title"], r["chapter"]): (r["html"].count("<li>"), r["html"].count('<div class="blatt">')) for r in pages} == want
    assert max(n for _, n in want.values()) > 1
    cards = catalogue.QUERIES["card_obstacles"](spark, DATA).collect()
    assert sorted((r["book_title"], r["chapter"], r["word_form"].lower()) for r in cards) == sorted(sql[["book_title", "chapter", "lemma"]].itertuples(index=False, name=None))
    assert all((r["place"] > 0) == (r["obstacle"] is None) for r in cards)
    assert sum(r["place"] > 0 for r in cards) > 0.9 * len(cards)
