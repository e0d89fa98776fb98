"""A source that fetches pages, as from a search service: pages are tasks, failures are tried again with growing pauses.

spark.dataSource.register(PagedSource); spark.read.format("pages").option("fetch", "module:function").option("pages", 4).schema(...)
The function takes a page number from 0 and returns rows as dicts, none beyond the last page.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


def with_retry(call: Callable, attempts: int = 4, pause: float = 1.0):
    """The call's result; after a failure it is made again, after pauses that double, and the last failure is raised."""
    for i in range(attempts):
        try:
            return call()
        except Exception:
            if i == attempts - 1:
                raise
            time.sleep(pause * 2**i)


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(self.options, schema)


class PagedReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.fetch, self.names = options["fetch"], schema.names
        self.pages, self.attempts, self.pause = int(options["pages"]), int(options.get("attempts", 4)), float(options.get("pause", 1.0))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(self.pages)]

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        if partition is None:  # what Spark asks for where there are no pages
            return
        module, function = self.fetch.split(":")
        fetch = getattr(importlib.import_module(module), function)
        for row in with_retry(lambda: fetch(partition.value), self.attempts, self.pause):
            yield tuple(row.get(n) for n in self.names)
