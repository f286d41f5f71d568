"""Messages that a service gives page by page, as a stream: the greatest message id of each channel is the offset.

The calls themselves are the caller's functions, which must be picklable: newest(channel) tells the greatest id that
there is, or None; page(channel, after) gives the messages after an id (None: from the start) in order of id, an empty list
at the end. Ids are compared as strings. Each channel is a partition, so tasks call the service, and the query's
checkpoint keeps the ids: a query that is started again goes on after what it has given.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "channel string, value string"


@dataclass
class Channel(InputPartition):
    channel: str
    after: str | None
    upto: str


class PageReader(DataSourceStreamReader):
    def __init__(self, channels: list[str], newest: Callable[[str], str | None], page: Callable[[str, str | None], list[dict]]):
        self.channels, self.newest, self.page = channels, newest, page

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        return {c: str(n) for c in self.channels if (n := self.newest(c)) is not None}

    def partitions(self, start: dict, end: dict):
        return [Channel(c, start.get(c), upto) for c, upto in sorted(end.items()) if c not in start or upto > start[c]]

    def read(self, partition: Channel):
        """A row per page, without messages that came after the offset was taken."""
        after = partition.after
        while after is None or after < partition.upto:
            found = [m for m in self.page(partition.channel, after) if after is None or str(m["id"]) > after]
            if not found:
                return
            after = max(str(m["id"]) for m in found)
            yield (partition.channel, json.dumps({"ok": True, "data": [m for m in found if str(m["id"]) <= partition.upto]}, ensure_ascii=False))


def stream_pages(spark: SparkSession, channels: list[str], newest: Callable[[str], str | None], page: Callable[[str, str | None], list[dict]], name: str = "paged") -> DataFrame:
    """channel, value (a page as logs.relay_messages takes it): a stream of each channel's messages, each once."""

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def streamReader(self, schema) -> PageReader:  # noqa: N802
            return PageReader(channels, newest, page)

    spark.dataSource.register(Paged)
    return spark.readStream.format(name).load()
