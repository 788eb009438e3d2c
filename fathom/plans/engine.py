"""The engine: a knowledge table with a ranking strategy, asked with batches of queries."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame

from fathom.operators import answer, rank
from fathom.streaming.session import session_turns


class KnowledgeSource(Protocol):
    def documents(self) -> DataFrame:
        """The knowledge table: path, title, body, source_sha256, language, tags, priority, metadata."""


class Strategy(Protocol):
    def search(self, queries: DataFrame, kb: DataFrame, top_k: int, language: str | None, stored: DataFrame | None) -> DataFrame:
        """Ranked results of (qid, query)."""


@dataclass(frozen=True)
class Ranked:
    """A strategy of this library, by the name of its score."""

    score: str

    def search(self, queries: DataFrame, kb: DataFrame, top_k: int, language: str | None, stored: DataFrame | None) -> DataFrame:
        return rank.search(queries, kb, self.score, top_k, language, stored=stored)


#: c-lexical is lexical: its prefilter is the join on tokens.
STRATEGIES: dict[str, Strategy] = {"lexical": Ranked("lexical"), "bm25": Ranked("bm25"), "c-lexical": Ranked("lexical")}


@dataclass
class Engine:
    """strategy: a name of STRATEGIES (lexical for any other) or an object that searches."""

    kb: DataFrame
    strategy: str | Strategy = "lexical"
    language: str | None = None
    _stored: DataFrame | None = field(default=None, repr=False)

    def stored(self) -> DataFrame:
        """The postings of the whole table, written at first use; worth it for several searches."""
        if self._stored is None:
            self._stored = rank.postings(rank.of_language(self.kb, self.language))
        return self._stored

    def search(self, queries: DataFrame, top_k: int = 3) -> DataFrame:
        """Ranked results of (qid, query)."""
        own = STRATEGIES.get(self.strategy, STRATEGIES["lexical"]) if isinstance(self.strategy, str) else self.strategy
        return own.search(queries, self.kb, top_k, self.language, self._stored)

    def answer(self, queries: DataFrame, top_k: int = 3, triage: bool = True) -> DataFrame:
        return answer.answers(queries, self.search(queries, top_k), triage)

    def synthesize(self, queries: DataFrame, top_k: int = 3) -> DataFrame:
        return answer.answers(queries, self.search(queries, top_k), triage=False, synthesis=True)

    def converse(self, turns: DataFrame) -> DataFrame:
        self.stored()
        return session_turns(turns, self.search)[0]
