"""A Python data source over a paged service, with an incremental cursor; batch and streaming.

The service is anything importable that has pages(stream) -> int and page(stream, number) -> list of dicts; one class
serves public catalogues, industry indexes, library and campus systems alike, which differ in their field mappings.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType


def _service(options: dict):
    module, _, name = options["service"].partition(":")
    return getattr(importlib.import_module(module), name)


class Page(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)
        self.number = number


class _Rows:
    def __init__(self, schema: StructType, options: dict):
        self.fields = schema.names
        self.options = dict(options)

    def rows(self, number: int) -> Iterator[tuple]:
        cursor, after = self.options.get("cursor"), self.options.get("after")
        for record in _service(self.options).page(self.options["stream"], number):
            if cursor and after is not None and not str(record.get(cursor, "")) > after:
                continue
            yield tuple(record.get(f) for f in self.fields)


class PagedReader(_Rows, DataSourceReader):
    """A task a page."""

    def partitions(self):
        return [Page(i) for i in range(_service(self.options).pages(self.options["stream"]))] or [Page(-1)]

    def read(self, partition: Page):
        return iter(()) if partition.number < 0 else self.rows(partition.number)


class PagedStreamReader(_Rows, DataSourceStreamReader):
    """Offsets count pages: a page is read once it is there."""

    def initialOffset(self) -> dict:
        return {"page": 0}

    def latestOffset(self) -> dict:
        return {"page": _service(self.options).pages(self.options["stream"])}

    def partitions(self, start: dict, end: dict):
        return [Page(i) for i in range(start["page"], end["page"])]

    def read(self, partition: Page):
        return self.rows(partition.number)


class PagedSource(DataSource):
    """Options: service ("module:object"), stream, cursor and after (rows whose cursor is greater, as strings)."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return _service(self.options).schema(self.options["stream"])

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(schema, self.options)

    def streamReader(self, schema: StructType) -> PagedStreamReader:
        return PagedStreamReader(schema, self.options)
