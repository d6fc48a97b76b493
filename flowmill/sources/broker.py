"""Messages of a broker as a stream, through the Python data source interface.

The client is named by the option `client` as "module:name". It has two functions: end(options) gives the offset after the last message,
and fetch(options, start, end) an iterable of (offset, topic, payload) with start <= offset < end. Offsets are whole numbers that grow. The driver
asks for the end only; messages are fetched in tasks, `rows` offsets each (default 100,000), and those of other topics
than the option `topic` are left out there. A log that can be read again from an offset makes the stream exactly-once after a restart.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

Message = tuple[int, str, bytes]


@dataclass
class Offsets(InputPartition):
    start: int
    end: int


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.options = dict(options)

    def _client(self):
        module, _, name = self.options["client"].partition(":")
        return getattr(importlib.import_module(module), name)

    def initialOffset(self) -> dict:
        return {"at": int(self.options.get("startoffset", 0))}

    def latestOffset(self) -> dict:
        return {"at": max(int(self.options.get("startoffset", 0)), self._client().end(self.options))}

    def partitions(self, start: dict, end: dict) -> list[Offsets]:
        size = int(self.options.get("rows", 100_000))
        return [Offsets(at, min(at + size, end["at"])) for at in range(start["at"], end["at"], size)]

    def read(self, partition: Offsets) -> Iterator[Message]:
        topic = self.options.get("topic")
        return (m for m in self._client().fetch(self.options, partition.start, partition.end) if not topic or m[1].startswith(topic))


class BrokerSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "broker"

    def schema(self) -> str:
        return "offset long, topic string, payload binary"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BrokerSource)


class LogFile:
    """A client for tests and replays: lines `topic<TAB>text` of the file in option `path`, numbered from 0."""

    @staticmethod
    def end(options: dict[str, str]) -> int:
        with open(options["path"], "rb") as lines:
            return sum(1 for _ in lines)

    @staticmethod
    def fetch(options: dict[str, str], start: int, end: int) -> Iterator[Message]:
        with open(options["path"], "rb") as lines:
            for i, line in enumerate(lines):
                if start <= i < end:
                    topic, payload = line.rstrip(b"\n").split(b"\t", 1)
                    yield i, topic.decode(), payload
