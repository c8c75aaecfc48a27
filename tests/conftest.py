from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [str(ROOT), os.environ.get("PYTHONPATH")]))
os.environ.setdefault("OMP_NUM_THREADS", "1")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


#: Invented entries: several senses and parts of speech of one word, equal scores, missing senses, entries and scores, a name, an expression of no use.
DICTIONARY_ROWS = [
    ("eng/plum__Noun__1", None, "plum", "Zwetschge | Pflaumenbaum", 90.5),
    ("eng/plum__Verb__1", None, "plum", "ausloten", 88.0),
    ("eng/plum__Noun__1", "well paid post", "plum", "Pöstchen", 71.25),
    ("eng/row__Noun__1", "line of seats", "row", "Reihe", 200.0),
    ("eng/row__Verb__1", "move a boat", "row", "rudern", 150.5),
    ("eng/row__Noun__2", "loud quarrel", "row", "Krach | Zank", 60.75),
    ("eng/lamp__Noun__1", "thing that gives light", "lamp", "Leuchte", 77.0),
    ("eng/pack_in__Verb__1", "end a habit", "pack in", "aufhören", 64.0),
    ("eng/pack_in__Verb__1", "draw a crowd", "pack in", "anlocken", 64.0),
    (None, None, "by the", "beim", 2.5),
    ("eng/Blue_Harbour__Proper_noun__1", "a town", "Blue Harbour", "Blauhafen", 140.0),
    (None, None, "by heart", "auswendig", 55.5),
    ("eng/then__Adverb__1", None, "then", "dann", None),
    ("eng/then__Adverb__1", "after that", "then", "danach", 1.5),
]


@pytest.fixture(scope="session")
def dictionary(spark):
    from pyspark.sql import functions as F

    rows = [(*r, i) for i, r in enumerate(DICTIONARY_ROWS)]
    return spark.createDataFrame(rows, "lexentry string, sense string, written_rep string, trans_list string, score double, src_row long").withColumn("importance", F.col("score") / 10)


def token_rows(chapter: int, *sentences: str) -> list[tuple]:
    """Sentences as word/lemma/POS/dep/head; the head is a place in the sentence, or missing for the root."""
    rows, at = [], 0
    for sent_id, sentence in enumerate(sentences):
        first = at
        for piece in sentence.split():
            text, lemma, pos, dep, head = (piece.split("/") + ["", ""])[:5]
            rows.append(("B", "A", chapter, sent_id, at, text, lemma, " ", pos, dep or "dep", first + int(head) if head else at, text.isalpha()))
            at += 1
    return rows


@pytest.fixture(scope="session")
def tokens_of(spark):
    from glossmill.schema import TOKENS

    return lambda *sentences, chapter=1: spark.createDataFrame(token_rows(chapter, *sentences), TOKENS)
