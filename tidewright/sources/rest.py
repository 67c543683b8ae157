"""Pages of a REST source as a Spark data source."""

from __future__ import annotations

import csv
import io
import json
import re
import sys
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


def fetch(url: str) -> tuple[str, str | None]:
    """A body, and the next address that its Link header names."""
    from urllib.parse import urljoin
    from urllib.request import urlopen

    with urlopen(url) as r:
        named = re.search(r'<([^>]*)>[^,]*;\s*rel="?next\b', r.headers.get("Link") or "")
        return r.read().decode(), urljoin(url, named[1]) if named else None


def rows_of(body: str, kind: str, path: str | None) -> list:
    """The rows of a body: json (at a path), ndjson (an object a line) or csv (objects by the names in the first line; empty fields are null)."""
    if kind == "json":
        return rows_at(body, path)
    if kind == "ndjson":
        return [json.loads(x) for x in body.splitlines() if x.strip()]
    if kind == "csv":
        return [{k: v or None for k, v in row.items()} for row in csv.DictReader(io.StringIO(body))]
    raise ValueError(f"no such body format: {kind}")


def rows_at(body: str, path: str | None) -> list:
    """The rows at a dotted or pointer path; a single object is one row."""
    value = json.loads(body)
    for part in filter(None, (path or "").replace("/", ".").split(".")):
        value = value[int(part)] if isinstance(value, list) else value[part]
    return value if isinstance(value, list) else [value]


class Rows(InputPartition):
    """The rows from `start` up to `end` of an address (an open end: all that follow); at most `pages` pages."""

    def __init__(self, url: str, start: int, end: int | None, pages: int = sys.maxsize) -> None:
        self.url, self.start, self.end, self.pages = url, start, end, pages


class RestSource(DataSource):
    """Rows of JSON pages as text, with the page they came in. Options: url (with {offset} and {limit}, or several separated by
    blanks), limit, max_pages (none: all pages), rows_per_task, body (json, ndjson or csv), data_path, next_path (cursor
    pagination: the next address stands there; `link`: in the Link header).

    An offset is a number of rows: it grows by the rows received, so pages of any size are read once each, also if the
    server sends more or fewer rows than asked for. A page shorter than the limit, or the lack of a next address, ends the
    read. Without rows_per_task each address is one task. With it, rows are counted first, by asking for single rows at growing
    and then at halved distances, and tasks read ranges of rows; then short pages end nothing. An error is raised if
    max_pages ends a read that has more rows.

    As a stream (one address with {offset}) each batch has the rows that came since the last one, in ranges of rows_per_task. Its
    position is the number of rows, which the checkpoint keeps, so a restart goes on behind the last row. Rows must only be
    added at the end.
    """

    @classmethod
    def name(cls) -> str:
        return "rest_pages"

    def schema(self) -> str:
        return "page int, row string"

    def reader(self, schema) -> DataSourceReader:
        return RestReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return RestStreamReader(self.options)


class RestReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = dict(options)

    def partitions(self) -> list[Rows]:
        pages, step = int(self.options.get("max_pages", sys.maxsize)), int(self.options.get("rows_per_task", 0))
        urls = self.options["url"].split()
        if not step or self.options.get("next_path") or "max_pages" in self.options:
            return [Rows(u, 0, None, pages) for u in urls]
        return [r for u in urls for r in self.ranges(u, 0, self.count(u), step)] or [Rows(urls[0], 0, 0)]  # Spark wants a partition

    def ranges(self, url: str, start: int, end: int, step: int) -> list[Rows]:
        return [Rows(url, a, min(a + step, end)) for a in range(start, end, step)]

    def page(self, url: str, offset: int, limit: int) -> tuple[str | None, list]:
        """The next address, if pages name it, and the rows of a page."""
        body, link = fetch(url.replace("{offset}", str(offset)).replace("{limit}", str(limit)))
        rows, at = rows_of(body, self.options.get("body", "json"), self.options.get("data_path")), self.options.get("next_path")
        if at is None or at == "link":
            return link if at else None, rows
        try:
            return rows_at(body, at)[0], rows
        except (KeyError, IndexError):
            return None, rows

    def count(self, url: str, known: int = 0) -> int:
        """The rows of an address, of which `known` are there for sure, in about twice the logarithm of the new ones requests."""
        least, step = known, 1
        while self.more(url, least + step - 1, 1):
            least, step = least + step, step * 2
        most = least + step - 1  # there is no row at this offset or after
        while least < most:
            middle = (least + most) // 2
            least, most = (middle + 1, most) if self.more(url, middle, 1) else (least, middle)
        return least

    def read(self, partition: Rows) -> Iterator[tuple]:
        limit, url, offset, page = int(self.options.get("limit", 100)), partition.url, partition.start, 0
        cursor = self.options.get("next_path")
        while page < partition.pages and (partition.end is None or offset < partition.end):
            after, rows = self.page(url, offset, limit)
            for r in rows if partition.end is None else rows[: partition.end - offset]:
                yield page, json.dumps(r)
            offset, page = offset + len(rows), page + 1
            if cursor:
                if not after:
                    return
                url = after
            elif "{offset}" not in url or (len(rows) < limit and partition.end is None):
                return
            elif not rows:
                raise ValueError(f"{partition.url} has no row {offset}, of {partition.end} that were there")
        if partition.end is None and (cursor or self.more(url, offset, limit)):
            raise ValueError(f"max_pages = {page} ends the read of {partition.url}, which has more rows")

    def more(self, url: str, offset: int, limit: int) -> bool:
        """Whether a page there has rows; one that isn't found has none."""
        from urllib.error import HTTPError, URLError

        try:
            return bool(self.page(url, offset, limit)[1])
        except HTTPError as e:
            if e.code != 404:
                raise
        except URLError as e:
            if not isinstance(e.reason, FileNotFoundError):
                raise
        return False


class RestStreamReader(RestReader, DataSourceStreamReader):
    """Offsets are {"rows": rows of the address that are before}."""

    def __init__(self, options: dict) -> None:
        super().__init__(options)
        self.known = 0
        if "{offset}" not in self.options["url"] or len(self.options["url"].split()) > 1 or self.options.get("next_path"):
            raise ValueError("a stream needs one address with {offset}")

    def initialOffset(self) -> dict:
        return {"rows": 0}

    def latestOffset(self) -> dict:
        self.known = self.count(self.options["url"], self.known)
        return {"rows": self.known}

    def partitions(self, start: dict, end: dict) -> list[Rows]:
        return self.ranges(self.options["url"], start["rows"], end["rows"], int(self.options.get("rows_per_task", 10_000)))

    def commit(self, end: dict) -> None:
        self.known = max(self.known, end["rows"])
