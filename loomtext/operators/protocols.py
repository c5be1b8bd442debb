"""What can be plugged in: anything with these methods. Data goes in and out as DataFrames."""

from __future__ import annotations

from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame


@runtime_checkable
class Searcher(Protocol):
    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, doc_id, score, rank) for queries (query_id, query)."""
        ...


@runtime_checkable
class Repository(Protocol):
    def scan(self) -> DataFrame: ...

    def upsert(self, delta: DataFrame) -> None: ...

    def delete(self, ids: DataFrame) -> None: ...


@runtime_checkable
class Embedder(Protocol):
    def embed(self, texts: DataFrame, text: str) -> DataFrame:
        """The rows with `embedding` (array<float>)."""
        ...


@runtime_checkable
class WebClient(Protocol):
    def results(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, title, url, content, score, raw)."""
        ...


@runtime_checkable
class RetrievalService(Protocol):
    def retrieve(self, questions: DataFrame) -> DataFrame:
        """Ranked documents (question_id, query_idx, rank, content, score)."""
        ...
