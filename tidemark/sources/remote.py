"""Remote row sources behind an injected fetch function (S20, N22, N27, N29). No network is used here."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

Fetch = Callable[[str], list[dict]]


def with_retry(fetch: Fetch, attempts: int = 3, pause: float = 1.0) -> Fetch:
    """The last failure is raised after all attempts; pauses double."""

    def call(key: str) -> list[dict]:
        for n in range(attempts):
            try:
                return fetch(key)
            except (OSError, TimeoutError):
                if n + 1 == attempts:
                    raise
                time.sleep(pause * 2**n)
        return []

    return call


class _Key(InputPartition):
    def __init__(self, key: str) -> None:
        super().__init__(key)
        self.key = key


def remote_source(name: str, schema: str | StructType, fetch: Fetch) -> type[DataSource]:
    """A data source whose option ``keys`` (a JSON list) becomes one task per key."""

    class Reader(DataSourceReader):
        def __init__(self, keys: list[str], columns: list[str]) -> None:
            self.keys, self.columns = keys, columns

        def partitions(self) -> list[InputPartition]:
            return [_Key(k) for k in self.keys]

        def read(self, partition: _Key) -> Iterator[tuple]:
            for row in fetch(partition.key):
                yield tuple(row.get(c) for c in self.columns)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str | StructType:
            return schema

        def reader(self, schema: StructType) -> DataSourceReader:
            return Reader(json.loads(self.options.get("keys", "[]")), schema.names)

    return Source


def extract_each(docs: DataFrame, client: Callable[[str], str], attempts: int = 2) -> DataFrame:
    """(report_id, answer, error) of every row's text under an injected client; a row whose attempts
    are exhausted carries the error and no answer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.column("report_id").to_pylist(), batch.column("text").to_pylist()):
                answer = error = None
                for _ in range(attempts):
                    try:
                        answer, error = client(text or ""), None
                        break
                    except Exception as e:  # noqa: BLE001
                        error = f"{type(e).__name__}: {e}"
                rows.append((key, answer, error))
            columns = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["report_id", "answer", "error"])

    return docs.select(F.col("report_id").cast("string").alias("report_id"), "text").mapInArrow(run, "report_id string, answer string, error string")


def api_dimension(spark: SparkSession, entries: list[tuple[str, str, str, str]]) -> DataFrame:
    """(api, api_group, title, parameters) of a catalogue, with the family that events belong to."""
    df = spark.createDataFrame(entries, "api string, api_group string, title string, parameters string")
    return df.withColumn("is_event", F.col("api_group") == "DS005")
