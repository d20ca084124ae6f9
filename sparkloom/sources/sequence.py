"""A source written in Python: numbers in order, in as many partitions as asked for."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


class _Span(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.start, self.end = int(options.get("start", 0)), int(options["end"])
        self.parts = max(1, int(options.get("partitions", 1)))

    def partitions(self) -> list[_Span]:
        n = max(0, self.end - self.start)
        edges = [self.start + n * k // self.parts for k in range(self.parts + 1)]
        return [_Span(a, b) for a, b in zip(edges, edges[1:], strict=False)]

    def read(self, span: _Span) -> Iterator[tuple[int]]:
        return ((i,) for i in range(span.first, span.last))


class SequenceSource(DataSource):
    """Options: start (0), end (exclusive), partitions (1)."""

    @classmethod
    def name(cls) -> str:
        return "sequence"

    def schema(self) -> str:
        return "id long"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    """Make spark.read.format("sequence") known."""
    spark.dataSource.register(SequenceSource)
