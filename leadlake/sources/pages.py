"""Sources that hand out records page by page, as Spark data sources with a resumable cursor.

A page reader answers ``fetch(cursor, limit)`` with records, the cursor after them, and
whether there are more. ``register_pages`` makes it a Python data source for batch reads and
streams. The offset of a stream is the cursor itself, so Spark's checkpoint resumes where the
last run stopped. Finding the cursors is sequential by nature and happens where Spark plans a batch;
the pages are then fetched again by the tasks, one partition a page, and records never pass the driver.

A walk takes at most ``pages`` pages of at most ``limit`` records, and stops where a source says
there is no more, gives no cursor, or repeats the one it was asked with, so a bad cursor cannot loop for ever.
"""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any, Protocol

import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

MOST_RECORDS, MOST_PAGES = 1_000, 100


@dataclass(frozen=True)
class Page:
    records: list[Mapping[str, Any]] = field(default_factory=list)
    cursor: str | None = None
    has_more: bool = False


class PageReader(Protocol):
    def fetch(self, cursor: str | None, limit: int) -> Page: ...


def walk(reader: PageReader, cursor: str | None, limit: int = MOST_RECORDS, pages: int = MOST_PAGES,
         until: str | None = None) -> list[tuple[str | None, str | None]]:
    """(asked, answered) cursors of the pages with records from ``cursor`` on, up to ``until`` if given."""
    steps: list[tuple[str | None, str | None]] = []
    for _ in range(pages):
        if until is not None and cursor == until:
            break
        page = reader.fetch(cursor, limit)
        after = page.cursor or cursor
        if page.records:
            steps.append((cursor, after))
        if not page.has_more or not page.cursor or page.cursor == cursor:
            break
        cursor = after
    return steps


class LandedPages:
    """Pages of JSON lines that land in a folder as files, oldest name first.

    The cursor names a file and the place in it, ``name|byte``; files that land later need later names.
    """

    def __init__(self, options: Mapping[str, str]) -> None:
        path = options["path"]
        self.files, self.root = pyarrow.fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")

    def _names(self) -> list[str]:
        found = self.files.get_file_info(pyarrow.fs.FileSelector(self.root, allow_not_found=True))
        return sorted(f.base_name for f in found if f.is_file and f.size and not f.base_name.startswith(("_", ".")))

    def fetch(self, cursor: str | None, limit: int) -> Page:
        name, _, byte = (cursor or "").rpartition("|")
        names = [n for n in self._names() if n >= name]
        records: list[dict] = []
        for at, own in enumerate(names):
            start = int(byte) if own == name else 0
            with self.files.open_input_file(f"{self.root}/{own}") as file:
                size = file.size()
                if start >= size:
                    continue
                file.seek(start)
                buffered = io.BufferedReader(file, 1 << 16)
                while len(records) < limit and start < size:
                    line = buffered.readline()
                    start += len(line)
                    if line.strip():
                        records.append(json.loads(line))
            return Page(records, f"{own}|{start}", start < size or at + 1 < len(names))
        return Page(records, cursor, False)


@dataclass
class _Asked(InputPartition):
    cursor: str | None
    limit: int


class _Records:
    """What batch and stream readers share."""

    def __init__(self, made: Callable[[Mapping[str, str]], PageReader], schema: StructType, options: Mapping[str, str]) -> None:
        self.made, self.names, self.options = made, schema.names, dict(options)
        self.limit = min(int(options.get("limit", MOST_RECORDS)), MOST_RECORDS)
        self.most = int(options.get("pages", MOST_PAGES))

    def read(self, partition: _Asked) -> Iterator[tuple]:
        """The page's records, every value as text; columns that a record lacks are null."""
        for record in self.made(self.options).fetch(partition.cursor, partition.limit).records:
            values = (record.get(n) for n in self.names)
            yield tuple(None if v is None else v if isinstance(v, str) else json.dumps(v) for v in values)


class _Batch(_Records, DataSourceReader):
    def partitions(self) -> list[_Asked]:
        return [_Asked(asked, self.limit) for asked, _ in walk(self.made(self.options), None, self.limit, self.most)]


class _Stream(_Records, DataSourceStreamReader):
    def initialOffset(self) -> dict:  # noqa: N802  names of the interface
        self.at = ""
        return {"cursor": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        """The cursor after the next pages; where nothing is new, the one before."""
        steps = walk(self.made(self.options), getattr(self, "at", "") or None, self.limit, self.most)
        if steps:
            self.at = steps[-1][1]
        return {"cursor": getattr(self, "at", "")}

    def partitions(self, start: dict, end: dict) -> list[_Asked]:
        self.at = end["cursor"]
        steps = walk(self.made(self.options), start["cursor"] or None, self.limit, 1 << 31, until=end["cursor"])
        return [_Asked(asked, self.limit) for asked, _ in steps]

    def commit(self, end: dict) -> None:
        self.at = end["cursor"]


def register_pages(spark: SparkSession, kind: str, made: Callable[[Mapping[str, str]], PageReader] = LandedPages) -> None:
    """Registers ``spark.read.format(kind)`` and ``spark.readStream.format(kind)``.

    ``made`` builds the page reader from the options. The schema is the caller's, all columns text. Options: what
    the reader needs, ``limit`` (records a page, 1,000 at most), ``pages`` (pages a batch).
    """
    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return kind

        def reader(self, schema: StructType) -> DataSourceReader:
            return _Batch(made, schema, self.options)

        def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
            return _Stream(made, schema, self.options)

    spark.dataSource.register(Paged)
