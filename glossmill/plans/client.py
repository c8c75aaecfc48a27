"""The thin part on the driver: settings, export paths, and the order in which an export is written."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.operators import cards, sheets
from glossmill.operators.profile import Profile
from glossmill.schema import TRIAGE_ORDERS

SETTINGS = 'model.url = "http://localhost:11434/v1"\nmodel.name = ""\npaths.dictionary = ""\npaths.profile = ""\ntriage.order = "new_words_first"\n'


@dataclass(frozen=True)
class Settings:
    url: str
    model: str
    dictionary: Path
    profile: Path
    order: str


def load_settings(folder: Path) -> tuple[Settings, bool]:
    """The settings, and whether their file has just been made. Empty paths mean files beside it."""
    file = folder / "config.toml"
    made = not file.exists()
    if made:
        folder.mkdir(parents=True, exist_ok=True)
        file.write_text(SETTINGS, encoding="utf-8")
    read = tomllib.loads(file.read_text(encoding="utf-8"))

    def text(section: str, key: str) -> str:
        value = read.get(section, {}).get(key)
        if not isinstance(value, str):
            raise ValueError(f"{file}: {section}.{key} has to be a text")
        return value

    order = text("triage", "order")
    if order not in TRIAGE_ORDERS:
        raise ValueError(f"{file}: triage.order is none of {', '.join(TRIAGE_ORDERS)}")
    if not text("model", "url"):
        raise ValueError(f"{file}: model.url is empty")
    where = lambda key, name: Path(text("paths", key)) if text("paths", key) else folder / name
    return Settings(text("model", "url"), text("model", "name"), where("dictionary", "en-de.sqlite3"), where("profile", "profile"), order), made


def file_stem(text: str) -> str:
    return re.sub(r"[^\w-]+", "_", text).strip("_") or "kapitel"


def export_paths(folder: Path, title: str, chapter: int, partial: bool = False) -> tuple[Path, Path]:
    """Free names for a deck and its printout, with one number for both."""
    stem = f"{file_stem(title)}_kapitel{chapter}" + "_teilexport" * partial
    n = 1
    while True:
        own = stem + (f"_{n}" if n > 1 else "")
        deck, page = folder / f"{own}.json", folder / f"{own}.html"
        if not deck.exists() and not page.exists():
            return deck, page
        n += 1


def write_exports(rows: DataFrame, profile: Profile, folder: Path, title: str, chapter: int, partial: bool = False) -> tuple[Path, Path]:
    """Deck first, then the cards in the profile, then the printout: what fails leaves nothing that claims to be exported."""
    deck, page = export_paths(folder, title, chapter, partial)
    cards.export_deck(rows, str(deck), f"{title} – Kapitel {chapter}")
    profile.record_cards(rows.withColumn("guid", cards.guid()))
    sheets.write_printout(rows, str(page))
    return deck, page


def events_of_decisions(decisions: DataFrame) -> DataFrame:
    """decisions(..., decision, timestamp): bulk and k mean known, l learning, s deferred; q leaves no event."""
    state = F.when(F.col("decision").isin("bulk", "k"), "known").when(F.col("decision") == "l", "learning").when(F.col("decision") == "s", "deferred")
    origin = F.when(F.col("decision") == "bulk", "bulk_mark").otherwise("triage")
    return decisions.withColumns({"state": state, "origin": origin}).filter("state is not null").drop("decision")
