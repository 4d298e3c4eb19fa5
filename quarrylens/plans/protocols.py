"""What an extractor, a search engine and an overview must offer, for other implementations to plug in."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame


class Extractor(Protocol):
    def extract(self, files: DataFrame) -> DataFrame:
        """One row a file (file_id, file_path, content) with symbols, literals, docstrings, calls, imports and edges."""


class SearchEngine(Protocol):
    def search(self, text: str, limit: int) -> DataFrame:
        """The best files of a query, best first."""


class Overview(Protocol):
    def directories(self, repo: str) -> DataFrame:
        """Directories with the files and symbols below each."""
