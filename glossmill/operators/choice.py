"""Sense choice: the question for a model, its answer's check, and choosers that a plan can call."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from glossmill.operators.lookup import NO_SENSE_LABEL, UNCERTAIN_LABEL, entry_pos

# What a model reads.
CHARS_PER_TOKEN, MOST_TOKENS = 4, 3000
TOO_LONG = "question too long"
QUESTION = (
    "You are helping a German learner of English.\n"
    'In the sentence below, which listed meaning does the word "%s" have?\n\nSentence: %s\n\nMeanings:\n%s\n\n'
    "If none of the meanings above truly matches how the word is used in this sentence, answer %s. That is the correct answer in that case, "
    "not a fallback — do not pick the closest meaning if it does not actually fit.\n\n"
    'Answer with JSON only: {"choice": <number>}'
)


def entry_label(lexentry: Column) -> Column:
    return F.coalesce(F.replace(entry_pos(lexentry), F.lit("_"), F.lit(" ")), F.lit("?"))


def prompt(word_form: Column, sentence: Column, candidates: Column) -> Column:
    """The question over an array of candidates; the number after the last one means that none fits."""
    none_fits = (F.size(candidates) + 1).cast("string")

    def line(x: Column, i: Column) -> Column:
        uncertain = F.coalesce(x["uncertain"], F.lit(False))
        text = F.when(uncertain, F.lit(UNCERTAIN_LABEL)).when(F.coalesce(x["sense"], F.lit("")) == "", F.lit(NO_SENSE_LABEL)).otherwise(x["sense"])
        translations = F.when(F.coalesce(x["trans_list"], F.lit("")) == "", F.lit("?")).otherwise(x["trans_list"])
        return F.concat((i + 1).cast("string"), F.lit(". ("), entry_label(x["lexentry"]), F.lit(") "), text, F.lit(" → "), translations)

    lines = F.array_join(F.concat(F.transform(candidates, line), F.array(F.concat(none_fits, F.lit(". none of the listed meanings fits")))), "\n")
    return F.format_string(QUESTION, word_form, sentence, lines, none_fits)


def estimated_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / CHARS_PER_TOKEN)


def too_long(text: Column, most_tokens: int) -> Column:
    """Whether a server might cut the prompt without a word."""
    return estimated_tokens(text) > most_tokens


def request_body(model: str, question: str, options: int) -> dict:
    """No reasoning, temperature 0, and a number from 1 to options as the only form of an answer."""
    choice = {"type": "integer", "minimum": 1, "maximum": options}
    schema = {"type": "object", "properties": {"choice": choice}, "required": ["choice"], "additionalProperties": False}
    return {
        "model": model, "messages": [{"role": "user", "content": question}], "reasoning_effort": "none", "temperature": 0,
        "response_format": {"type": "json_schema", "json_schema": {"name": "sense_choice", "strict": True, "schema": schema}},
    }


def checked_answer(raw: bytes, options: int) -> int:
    """The number in a server's answer; whatever else it says is an error."""
    try:
        first = json.loads(raw)["choices"][0]
        content, reason = first["message"]["content"], first.get("finish_reason")
    except (ValueError, KeyError, IndexError, TypeError, AttributeError) as e:
        raise ValueError("the answer has not the expected form") from e
    if not content and reason == "length":
        raise ValueError("the model used its tokens up without an answer")
    try:
        number = json.loads(content)["choice"]
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError(f"the answer is no choice: {content!r}") from e
    if isinstance(number, bool) or not isinstance(number, int) or not 1 <= number <= options:
        raise ValueError(f"the choice {number!r} is none from 1 to {options}")
    return number


def ask(url: str, model: str, question: str, options: int, timeout: float = 120) -> int:
    data = json.dumps(request_body(model, question, options)).encode()
    request = urllib.request.Request(f"{url.rstrip('/')}/chat/completions", data, {"Content-Type": "application/json"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as response:
            raw = response.read()
    except urllib.error.HTTPError as e:
        raise ValueError(f"the model server answers {e.code}") from e
    except (OSError, ValueError) as e:
        raise ValueError(f"the model server can't be reached: {e}") from e
    return checked_answer(raw, options)


def first_model(url: str, timeout: float = 10) -> str:
    """The name of the first model that a server lists."""
    try:
        with urllib.request.urlopen(f"{url.rstrip('/')}/models", timeout=timeout) as response:
            return json.loads(response.read())["data"][0]["id"]
    except (OSError, ValueError, KeyError, IndexError, TypeError) as e:
        raise ValueError(f"the model server at {url} lists no model") from e


Chooser = Callable[[str, int], int]


class HttpChooser:
    """Asks a model server, which takes questions of up to most_tokens."""

    def __init__(self, url: str, model: str, timeout: float = 120, most_tokens: int = MOST_TOKENS):
        self.ask, self.most_tokens = partial(ask, url, model, timeout=timeout), most_tokens

    def __call__(self, question: str, options: int) -> int:
        return self.ask(question, options)


def http_chooser(url: str, model: str, timeout: float = 120) -> Chooser:
    return HttpChooser(url, model, timeout)


def first_sense(question: str, options: int) -> int:
    """A deterministic chooser: the entry with the best score."""
    return 1


def choose(entries: DataFrame, chooser: Chooser, overlong: str = "refuse", where: Column | None = None) -> DataFrame:
    """Adds choice (1 to N, N + 1: none fits; null: nothing was asked) and choice_obstacle to entries(word_form, example_sentence, candidates).

    An empty list and a single uncertain placeholder need no question, nor do rows that where leaves out; of the others, the question
    and its number of options alone go to a worker. A question over the chooser's most_tokens (MOST_TOKENS if it states none) is
    never shortened: refuse ends the job, and with mark the row isn't asked and its obstacle is "question too long". A wrong answer ends the job.
    """
    if overlong not in ("refuse", "mark"):
        raise ValueError(f"overlong {overlong!r} is neither refuse nor mark")
    asked = (F.size("candidates") > 0) & ~((F.size("candidates") == 1) & F.coalesce(F.get("candidates", F.lit(0))["uncertain"], F.lit(False)))
    asked = asked if where is None else where & asked
    rows = entries.withColumn("_question", F.when(asked, prompt(F.col("word_form"), F.col("example_sentence"), F.col("candidates"))))
    long = F.coalesce(too_long(F.col("_question"), getattr(chooser, "most_tokens", MOST_TOKENS)), F.lit(False))
    state = F.raise_error(F.lit("the question is too long for a model")) if overlong == "refuse" else F.lit(TOO_LONG)
    rows = rows.withColumn("choice_obstacle", F.when(long, state).cast("string"))

    def run(questions: pd.Series, options: pd.Series) -> pd.Series:
        return pd.Series([chooser(q, int(n)) if isinstance(q, str) else None for q, n in zip(questions, options, strict=True)], dtype="Int32")

    # A chooser may be dear, and no plan may ask it twice.
    ask_each = F.pandas_udf(run, IntegerType()).asNondeterministic()
    return rows.withColumn("choice", ask_each(F.when(F.col("choice_obstacle").isNull(), F.col("_question")), F.size("candidates") + 1)).drop("_question")


def resolved(chosen: DataFrame) -> DataFrame:
    """Adds sense_chosen: the candidate of the choice with its translation; the lone placeholder itself; null where none fits or nothing could be asked."""
    n = F.size("candidates")
    lone = F.col("choice").isNull() & (n == 1) & F.col("choice_obstacle").isNull()
    picked = F.when(lone, F.get("candidates", F.lit(0))).when(F.col("choice") <= n, F.get("candidates", F.col("choice") - 1))
    return chosen.withColumn("sense_chosen", picked)


def bundles(entries: DataFrame, size: int, key: list[str]) -> DataFrame:
    """Entries with a question, size of them to one request: bundle, place in it, and the question without its heading.

    Within a chapter entries follow one another by lemma and part of speech, so that a request is about one text.
    """
    asked = (F.size("candidates") > 0) & ~((F.size("candidates") == 1) & F.coalesce(F.get("candidates", F.lit(0))["uncertain"], F.lit(False)))
    order = Window.partitionBy(*key).orderBy("lemma", "pos", "word_form")
    rows = entries.filter(asked).withColumn("_at", F.row_number().over(order) - 1)
    place = (F.col("_at") % size + 1).cast("int")
    return rows.withColumns({"bundle": F.floor(F.col("_at") / size).cast("int"), "place": place, "options": F.size("candidates") + 1}).drop("_at")


def checked_bundle(answers: DataFrame, asked: DataFrame, key: list[str]) -> DataFrame:
    """Each asked place(key, bundle, place, lemma, options) with its answer(key, bundle, place, echo, choice), and what is wrong with it.

    missing: no answer has the place; duplicate: several have; echo: the answer repeats another word than the one asked
    for; range: the choice is none of the options; null where the answer holds. Answers to places never asked are unknown.
    """
    whole = [*key, "bundle", "place"]
    own = answers.groupBy(*whole).agg(F.count("*").alias("_n"), F.min("echo").alias("_echo"), F.min("choice").alias("choice"))
    both = asked.select(*whole, "lemma", "options").join(own, whole, "full")
    fault = (
        F.when(F.col("lemma").isNull(), "unknown").when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "duplicate").when(~F.col("_echo").eqNullSafe(F.col("lemma")), "echo")
        .when(~F.coalesce(F.col("choice").between(1, F.col("options")), F.lit(False)), "range")
    )
    return both.select(*whole, "lemma", F.when(fault.isNull(), F.col("choice")).alias("choice"), fault.alias("fault"))


def agreement(one: DataFrame, other: DataFrame, key: list[str]) -> DataFrame:
    """How often two tables of choices agree, and what each lacks."""
    both = one.select(*key, F.col("choice").alias("a")).join(other.select(*key, F.col("choice").alias("b")), key, "full")
    return both.agg(
        F.count_if(F.col("a") == F.col("b")).alias("same"), F.count_if(F.col("a") != F.col("b")).alias("different"), F.count_if(F.col("b").isNull()).alias("missing"), F.count_if(F.col("a").isNull()).alias("unknown")
    )


def accuracy(choices: DataFrame) -> DataFrame:
    """Labelled sentences(offered: chosen translations separated by |, expected: array): how many overlap."""
    offered = F.transform(F.split("offered", r"\|"), lambda x: F.trim(x))
    return choices.agg(F.count("*").alias("n"), F.count_if(F.arrays_overlap(offered, F.col("expected"))).alias("right"))
