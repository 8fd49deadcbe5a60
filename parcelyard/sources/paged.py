"""A paged service as a Spark data source: a partition for each window of days, pages of it until a short one."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Records that a page holds unless said otherwise, and pages of a window that are asked for at most.
PAGE, MOST_PAGES = 500, 10_000

#: What answers a request: parameters (limit, offset, first and last day, and the source's own) to the records of a page.
Transport = Callable[[Mapping[str, Any]], Sequence[Any]]


def windows(first: dt.date, last: dt.date, days: int) -> list[tuple[dt.date, dt.date]]:
    """Successive windows of so many days from first to last, the last one cut short."""
    if days < 1:
        raise ValueError("a window has at least a day")
    starts = [first + dt.timedelta(i) for i in range(0, (last - first).days + 1, days)]
    return [(s, min(s + dt.timedelta(days - 1), last)) for s in starts]


class Window(InputPartition):
    def __init__(self, first: dt.date, last: dt.date):
        super().__init__((first.isoformat(), last.isoformat()))
        self.first, self.last = first, last


def paged_source(transport: Transport, name: str = "paged") -> type[DataSource]:
    """A data source class around a transport, which goes to the tasks with it; to be registered with a session.

    Options: first, last (days), days (of a window), limit (of a page), pages (at
    most, of a window; more is an error rather than a loss), and any others,
    which go to the transport. Rows: first, last, page and value, the record's
    JSON, which `files.map_record` reads. Records that aren't objects are left
    out. A window stops at a page that is short or empty. A task that fails is
    asked again from its window's first page.
    """

    class Reader(DataSourceReader):
        def __init__(self, options: Mapping[str, str]):
            self.options = dict(options)
            for k in ("first", "last"):
                if k not in self.options:
                    raise ValueError(f"the option {k} is missing")

        def partitions(self) -> list[InputPartition]:
            first, last = (dt.date.fromisoformat(self.options[k]) for k in ("first", "last"))
            return [Window(a, b) for a, b in windows(first, last, int(self.options.get("days", 7)))]

        def read(self, partition: Window) -> Iterator[tuple]:
            own = {k: v for k, v in self.options.items() if k not in ("first", "last", "days", "limit", "pages")}
            limit, most = int(self.options.get("limit", PAGE)), int(self.options.get("pages", MOST_PAGES))
            for page in range(most + 1):
                asked = {**own, "first": partition.first.isoformat(), "last": partition.last.isoformat(), "limit": limit, "offset": page * limit}
                records = transport(asked)
                if not isinstance(records, list | tuple):
                    raise ValueError(f"page {page} of {partition.first} isn't a list")
                if page == most and records:
                    raise ValueError(f"more than {most} pages from {partition.first} to {partition.last}: use shorter windows")
                for r in records:
                    if isinstance(r, Mapping):
                        yield partition.first, partition.last, page, json.dumps(r, ensure_ascii=False)
                if len(records) < limit:
                    return

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "first date, last date, page int, value string"

        def reader(self, schema) -> DataSourceReader:
            return Reader(self.options)

    return Paged


def read_paged(spark: SparkSession, transport: Transport, first: dt.date, last: dt.date, days: int = 7, limit: int = PAGE, name: str = "paged", **options: Any) -> DataFrame:
    """The rows of `paged_source` between two days."""
    spark.dataSource.register(paged_source(transport, name))
    return spark.read.format(name).options(first=first.isoformat(), last=last.isoformat(), days=days, limit=limit, **options).load()
