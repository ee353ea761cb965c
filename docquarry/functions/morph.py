"""The surface for morphological analysers, which this engine doesn't bring along.

An analyser gives a text's morphemes; without one the morphological field stays empty and everything
else works on bigrams.
"""

from __future__ import annotations

import functools
import importlib
import os
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

# --- fixed values: tags of content words (nouns, verbs, modifiers, roots, foreign words, numbers)
CONTENT_TAGS = ("NNG", "NNP", "NNB", "NR", "NP", "VV", "VA", "VX", "MM", "MAG", "MAJ", "IC", "XR", "XPN", "SL", "SH", "SN")


@dataclass(frozen=True)
class Morpheme:
    form: str
    tag: str
    start: int
    length: int
    word: int


class Analyser(Protocol):
    def morphemes(self, text: str) -> list[Morpheme]: ...


class Synonyms(Protocol):
    """A hook for dictionaries of synonyms; none is used by default."""

    def synonyms(self, term: str) -> list[str]: ...


class Morphology:
    """Content words, and where a word form stands, by an analyser; problems mean no words."""

    def __init__(self, analyser: Analyser):
        self.analyser = analyser

    def words(self, text: str) -> list[str]:
        try:
            return [m.form for m in self.analyser.morphemes(text) if m.tag.startswith(CONTENT_TAGS)]
        except Exception:  # an analyser's failure on one text is not the index's
            return []

    def locate(self, text: str, forms: Iterable[str]) -> tuple[int, int] | None:
        """Start and length of the word around the first morpheme with one of the forms."""
        forms, found = set(forms), self.analyser.morphemes(text)
        hit = next((m for m in found if m.form in forms), None)
        if hit is None:
            return None
        own = [m for m in found if m.word == hit.word]
        start = min(m.start for m in own)
        return start, max(m.start + m.length for m in own) - start


def from_environment(make: Callable[[str, str], Analyser], variables: tuple[str, str]) -> Morphology | None:
    """An analyser made from two settings; None if either is unset or it can't be made."""
    values = [os.environ.get(v) for v in variables]
    if not all(values):
        return None
    try:
        return Morphology(make(*values))
    except Exception as problem:
        import logging

        logging.getLogger(__name__).warning("no morphological analyser: %s", problem)
        return None


#: Settings of the command line's analyser: ``module:callable``, and the folder of its model, which the callable gets.
VARIABLES = ("DOCQUARRY_ANALYSER", "DOCQUARRY_ANALYSER_MODEL")


def load(name: str, model: str) -> Analyser:
    module, _, call = name.partition(":")
    return getattr(importlib.import_module(module), call)(model)


def loaded(name: str, model: str) -> Morphology:
    return Morphology(load(name, model))


def configured() -> Callable[[], Morphology] | None:
    """What makes the analyser of the settings on any executor; None where there is none or it fails here."""
    return functools.partial(loaded, *(os.environ[v] for v in VARIABLES)) if from_environment(load, VARIABLES) else None


def with_morph_field(bodies: DataFrame, make: Callable[[], Morphology] | None, column: str = "morph_kiwi") -> DataFrame:
    """Adds the joined content words of ``body``; empty without an analyser.

    ``make`` is called once a task, so that an analyser with a large model is never shipped.
    """
    from pyspark.sql import functions as F

    if make is None:
        return bodies.withColumn(column, F.lit(""))
    schema = StructType([*bodies.schema.fields, StructField(column, StringType())])
    at = bodies.columns.index("body")

    def work(batches):
        morphology = make()
        for batch in batches:
            words = pa.array([" ".join(morphology.words(t or "")) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, words], names=schema.names)

    return bodies.mapInArrow(work, schema)
