"""Paged endpoint as a Python data source: one partition a page, with retries.

``fetch(offset, limit)`` is any callable that returns lines; a page may be read
again by another executor, so it must give the same answer each time.
"""

from __future__ import annotations

import importlib
import time

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Page size, pause between pages in seconds, retries.
PAGE_SIZE, PAUSE, RETRIES = 10_000, 2.0, 10


class Page(InputPartition):
    def __init__(self, offset: int, limit: int):
        self.offset, self.limit = offset, limit


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.module, _, self.name = options["fetch"].partition(":")
        self.total = int(options["total"])
        self.start = int(options.get("offset", 0))
        self.size = int(options.get("pageSize", PAGE_SIZE))
        self.pause, self.retries = float(options.get("pause", PAUSE)), int(options.get("retries", RETRIES))

    def partitions(self) -> list[InputPartition]:
        return [Page(o, min(self.size, self.total - o)) for o in range(self.start, self.total, self.size)]

    def read(self, partition: Page):
        fetch = getattr(importlib.import_module(self.module), self.name)
        for attempt in range(self.retries + 1):
            try:
                rows = list(fetch(partition.offset, partition.limit))
                break
            except OSError:
                if attempt == self.retries:
                    raise
                time.sleep(self.pause)
        for k, row in enumerate(rows):
            yield partition.offset + k, row


class PagedSource(DataSource):
    """``spark.read.format("paged").option("fetch", "module:function")
    .option("total", n).load()``: ``place, value`` of all pages."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "place bigint, value string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)


SEARCH_HIT = "ns int, title string, snippet string, size bigint, wordcount bigint, timestamp string"


def search_hits(df, column: str = "value"):
    """``title, snippet, size`` of JSON search hits; rows that lack a field are
    left out."""
    from pyspark.sql import functions as F

    hit = F.from_json(F.col(column), SEARCH_HIT)
    rows = df.select(hit.alias("h")).where("h.title is not null and h.snippet is not null and h.size is not null and h.ns is not null and h.timestamp is not null")
    return rows.select("h.title", "h.snippet", "h.size")
