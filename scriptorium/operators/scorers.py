"""Pluggable models: what embeds texts and what scores (question, text) pairs, with deterministic defaults."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions import text as T


class Reranker(Protocol):
    def score(self, question: Column, text: Column) -> Column:
        """A raw score; its sigmoid is the relevance."""


class Embedder(Protocol):
    def embed(self, text: Column) -> Column:
        """An array of floats."""


class ChatModel(Protocol):
    def answer(self, messages: list[dict[str, str]]) -> str:
        """The reply to a conversation; raises ``Refused`` if it is too long or the provider is busy."""


class Refused(RuntimeError):
    pass


def answer_or_retry(model: ChatModel, full: Callable[[], list[dict[str, str]]], reduced: Callable[[], list[dict[str, str]]]) -> str:
    """Ask with the whole context; if the model refuses, once more with the reduced one."""
    try:
        return model.answer(full())
    except Refused:
        return model.answer(reduced())


class CoverageReranker:
    """Share of the question's content terms that the text has, spread so that none gives -4 and all give 4."""

    def score(self, question: Column, text: Column) -> Column:
        asked = T.content_terms(question)
        share = F.size(F.array_intersect(asked, T.tokens(text))) / F.greatest(F.size(asked), F.lit(1))
        return 8 * share - 4


class HashedTerms:
    """Counts of content tokens in ``width`` hashed places."""

    def __init__(self, width: int = 64) -> None:
        self.width = width

    def embed(self, text: Column) -> Column:
        places = F.transform(T.tokens(text), lambda t: F.pmod(F.xxhash64(t), F.lit(self.width)))
        return T.bind(places, lambda p: F.transform(F.sequence(F.lit(0), F.lit(self.width - 1)), lambda i: F.size(F.filter(p, lambda x: x == i)).cast("float")))
