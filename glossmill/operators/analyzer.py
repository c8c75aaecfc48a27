"""Linguistic analysis: chapters to tokens, once for all operators, by any analyzer.

An analyzer turns a text into sentences of tokens. It is made anew in each Python worker by a factory, so that a
model is loaded once a worker and never shipped. The rule-based one needs nothing installed; its word lists are
small on purpose.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame

from glossmill.schema import TOKENS


class Token(NamedTuple):
    text: str
    lemma: str
    ws: str
    pos: str
    dep: str
    head: int  # place in the text; its own for the root of a sentence


class Analyzer(Protocol):
    def sentences(self, text: str) -> Iterator[list[Token]]: ...


Factory = Callable[[], Analyzer]

CLOSED = {
    "DET": "the a an this that these those every each some any no".split(),
    "PRON": "i you he she it we they me him her us them who whom which what myself himself herself itself themselves one".split(),
    "ADP": "of in to for with on at from by about into over after under between through during without within against among".split(),
    "CCONJ": "and or but nor".split(),
    "SCONJ": "if because although while when since unless that".split(),
    "AUX": "am is are was were be been being has have had do does did will would shall should can could may might must".split(),
    "INTJ": "oh ah alas hello yes".split(),
}
CLOSED_POS = {word: pos for pos, own in CLOSED.items() for word in own}
PARTICLES = frozenset("up down out off away back over along apart aside".split())
PIECE = re.compile(r"[^\W\d_]+|['’][^\W\d_]+|\d+(?:[.,]\d+)*|\s*\n\s*|[^\w\s]|_+")
ENDINGS = (("ly", "ADV"), ("ing", "VERB"), ("ed", "VERB"), ("ous", "ADJ"), ("ful", "ADJ"), ("able", "ADJ"), ("ive", "ADJ"), ("al", "ADJ"))


def base_form(word: str, pos: str) -> str:
    """A plain guess: regular endings off."""
    if pos in ("NOUN", "VERB"):
        if word.endswith("ies") and len(word) > 4:
            return word[:-3] + "y"
        if re.search(r"(?:s|x|z|ch|sh)es$", word):
            return word[:-2]
        if word.endswith("s") and not word.endswith(("ss", "us", "is")) and len(word) > 3:
            return word[:-1]
    if pos == "VERB":
        for ending in ("ing", "ed"):
            stem = word.removesuffix(ending)
            if stem != word and len(stem) > 2:
                return stem[:-1] if stem[-1] == stem[-2] and stem[-1] not in "lsz" else stem
    return word


class RuleAnalyzer:
    """Lists of closed classes, endings, capitals inside a sentence, and a particle after its verb."""

    def sentences(self, text: str) -> Iterator[list[Token]]:
        pieces = [(m.group(), m.end()) for m in PIECE.finditer(text)]
        starts = [m.start() for m in PIECE.finditer(text)] + [len(text)]
        held: list[tuple[str, str, int]] = []
        for i, (piece, end) in enumerate(pieces):
            held.append((piece, text[end : starts[i + 1]], i))
            closed = piece in ".!?" and not (i + 1 < len(pieces) and pieces[i + 1][0] in ".!?\"'’”")
            if closed or piece in "\"'’”" and i and pieces[i - 1][0] in ".!?" or "\n" in piece and piece.count("\n") > 1:
                yield self._tagged(held)
                held = []
        if held:
            yield self._tagged(held)

    def _tagged(self, held: list[tuple[str, str, int]]) -> list[Token]:
        out: list[Token] = []
        root, verb, seen = held[0][2], None, False
        for k, (piece, ws, place) in enumerate(held):
            low = piece.lower()
            before = out[k - 1] if k else None
            if not piece[0].isalpha():
                pos = "SPACE" if piece.isspace() else "NUM" if piece[0].isdigit() else "PART" if piece[0] in "'’" and len(piece) > 1 else "PUNCT"
            elif low in CLOSED_POS:
                pos = CLOSED_POS[low]
            elif piece[0].isupper() and seen:
                pos = "PROPN"
            elif before and before.pos == "DET":
                pos = "NOUN"
            elif before and before.pos in ("PRON", "AUX") or before and before.text.lower() == "to":
                pos = "VERB"
            else:
                pos = next((p for ending, p in ENDINGS if low.endswith(ending) and len(low) > len(ending) + 2), "NOUN")
            dep, head = "dep", root
            if low in PARTICLES and verb is not None and (before is None or before.pos in ("VERB", "NOUN", "PRON")):
                pos, dep, head = "ADP", "prt", verb
            elif pos == "NOUN" and before and before.pos == "VERB":
                dep, head = "dobj", verb if verb is not None else root
            if pos == "VERB":
                verb = place
            seen = seen or piece[0].isalpha()
            out.append(Token(piece, base_form(low, pos) if pos != "PROPN" else piece, ws, pos, dep, head))
        return out


class SpacyAnalyzer:
    """An adapter for a spaCy pipeline with a lemmatizer; imported where it runs."""

    def __init__(self, model: str = "en_core_web_md"):
        import spacy

        self.nlp = spacy.load(model)
        if "lemmatizer" not in self.nlp.pipe_names:
            raise ValueError(f"{model} has no lemmatizer")

    def sentences(self, text: str) -> Iterator[list[Token]]:
        for sentence in self.nlp(text).sents:
            yield [Token(t.text, t.lemma_, t.whitespace_, t.pos_, t.dep_, t.head.i) for t in sentence]


#: Tokens that go on together; a text is never cut for it.
BATCH_TOKENS = 20_000


def analyzed(chapters: DataFrame, factory: Factory = RuleAnalyzer) -> DataFrame:
    """Tokens of chapters(book_title, book_author, chapter, text); tok_id counts through a chapter, from 0."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        analyzer = factory()
        schema = pa.schema([(f.name, {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}[f.dataType.simpleString()]) for f in TOKENS])
        key, held = ([], [], [], [], []), []

        def flushed() -> pa.RecordBatch:
            text, lemma, ws, pos, dep, head = zip(*held, strict=True)
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((*key, text, lemma, ws, pos, dep, head, [t.isalpha() for t in text]), schema, strict=True)], schema=schema)
            for c in (*key, held):
                c.clear()
            return batch

        for part in parts:
            for title, author, chapter, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                before = len(held)
                for sent_id, sentence in enumerate(analyzer.sentences(text or "")):
                    held.extend(sentence)
                    key[3].extend([sent_id] * len(sentence))
                n = len(held) - before
                for c, value in zip(key, (title, author, chapter), strict=False):
                    c.extend([value] * n)
                key[4].extend(range(n))
                if len(held) >= BATCH_TOKENS:
                    yield flushed()
        if held:
            yield flushed()

    return chapters.select("book_title", "book_author", "chapter", "text").mapInArrow(run, TOKENS)
