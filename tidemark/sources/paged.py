"""Paged services as a data source for batches and streams, behind an injected client.

A client tells how many pages there are now and fetches one as a list of rows. Runs of pages are
partitions, so tasks fetch side by side; each fetch has a time-out and is tried again after pauses that
double. Rows leave in the order of pages. On a stream the offset is the number of pages, so pages that
appear later come in later batches, and a restarted query goes on after the last page it has committed.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType


class Client(Protocol):
    def pages(self) -> int: ...

    def fetch(self, page: int) -> list[dict]: ...


class SourceFailed(RuntimeError):
    """All attempts at a page have failed."""


@dataclass(frozen=True)
class Patience:
    attempts: int = 3
    seconds: float = 30.0
    pause: float = 0.5

    def fetch(self, client: Client, page: int) -> list[dict]:
        """A page's rows; what takes longer than ``seconds`` counts as failed and is left to itself."""
        for n in range(self.attempts):
            pool = ThreadPoolExecutor(1)
            try:
                return pool.submit(client.fetch, page).result(self.seconds)
            except (OSError, TimeoutError, Late) as e:
                if n + 1 == self.attempts:
                    raise SourceFailed(f"page {page}: {type(e).__name__} in {self.attempts} attempts") from e
                time.sleep(self.pause * 2**n)
            finally:
                pool.shutdown(wait=False)
        raise SourceFailed(f"page {page}: no attempts")


class _Pages(InputPartition):
    def __init__(self, first: int, end: int) -> None:
        super().__init__((first, end))
        self.first, self.end = first, end


def _runs(first: int, end: int, size: int) -> list[InputPartition]:
    return [_Pages(p, min(p + size, end)) for p in range(first, end, size)]


class _Reading:
    """What readers of batches and of streams share."""

    def __init__(self, client: Client, patience: Patience, columns: list[str], size: int) -> None:
        self.client, self.patience, self.columns, self.size = client, patience, columns, size

    def read(self, partition: _Pages) -> Iterator[tuple]:
        for page in range(partition.first, partition.end):
            for row in self.patience.fetch(self.client, page):
                yield (page, *(row.get(c) for c in self.columns))


def paged_source(name: str, schema: str, client: Client, patience: Patience = Patience()) -> type[DataSource]:
    """A data source whose rows are ``page`` and the columns of ``schema``; the option ``pages`` is the number of
    pages of a partition, 10 if not given. Register it with ``spark.dataSource.register``."""

    class Reader(_Reading, DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return _runs(0, self.client.pages(), self.size)

    class StreamReader(_Reading, DataSourceStreamReader):
        def initialOffset(self) -> dict:
            return {"page": 0}

        def latestOffset(self) -> dict:
            return {"page": self.client.pages()}

        def partitions(self, start: dict, end: dict) -> list[InputPartition]:
            return _runs(start["page"], end["page"], self.size)

        def commit(self, end: dict) -> None:
            pass

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return f"page long, {schema}"

        def _reading(self, kind: type, schema_: StructType):
            return kind(client, patience, schema_.names[1:], int(self.options.get("pages", "10")))

        def reader(self, schema: StructType) -> DataSourceReader:
            return self._reading(Reader, schema)

        def streamReader(self, schema: StructType) -> DataSourceStreamReader:
            return self._reading(StreamReader, schema)

    return Source
