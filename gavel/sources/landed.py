"""Feeds that are landed as JSON files, as sources of Spark: articles by search, and an id space that grows.

``articles`` is a batch source. Files are dealt out to partitions by number and bytes; equality filters on the entity and bounds on
the time are pushed into the reader, and an option keeps only the newest rows of each file. A file that
can't be read becomes one row with an error, and the others are read on. Both read through Spark's file
systems only where that is possible: a folder must be one that driver and executors share.

``id_space`` is a stream. Its offset is the highest id that was handed out. Every batch begins a few ids
below this high-water mark, since pages may come late, but gives only ids that weren't given yet.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
)

#: Fields of an article, and the form of the time it was seen.
FIELDS = ("url", "title", "domain", "language", "sourcecountry", "seendate")
SEEN = "%Y%m%dT%H%M%SZ"
ARTICLES = "file string, position int, entity_id string, url string, title string, domain string, language string, sourcecountry string, seendate string, seen_at timestamp, error string"

#: Parts of one batch of ids, beyond which each takes more record batches: a task and a file for every few rows cost more than the rows.
MOST_PARTS = 256


def local(path: str) -> str:
    """The path of a ``file:`` address or of a plain path."""
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"{path}: these sources read folders that are mounted on every machine")
    return unquote(parts.path)


def seen_at(text: str | None) -> datetime | None:
    try:
        return datetime.strptime(text or "", SEEN).replace(tzinfo=timezone.utc)
    except ValueError:
        return None


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)


class _ArticleReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.newest = local(options["path"]), int(options.get("newest", 0))
        self.most_files, self.most_bytes = int(options.get("filesPerPartition", 64)), int(options.get("bytesPerPartition", 16 << 20))
        self.entities: set[str] | None = None
        self.bounds: list[tuple[str, datetime]] = []
        self.present: set[str] = set()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Equality on the entity, bounds on the time and the presence of either are done here; the others stay with Spark."""
        sides = {GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("entity_id",):
                self.entities = {f.value} if self.entities is None else self.entities & {f.value}
            elif type(f) in sides and f.attribute == ("seen_at",):
                at = f.value if f.value.tzinfo else f.value.replace(tzinfo=timezone.utc)
                self.bounds.append((sides[type(f)], at))
            elif isinstance(f, IsNotNull) and f.attribute in (("entity_id",), ("seen_at",)):
                self.present.add(f.attribute[0])
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        out: list[list[str]] = []
        size = 0
        for entry in sorted((e for e in os.scandir(self.folder) if e.name.endswith(".json")), key=lambda e: e.name):
            size += entry.stat().st_size
            if not out or len(out[-1]) >= self.most_files or size > self.most_bytes:
                out.append([])
                size = entry.stat().st_size
            out[-1].append(entry.path)
        return [_Files(paths) for paths in out]

    def _fits(self, at: datetime | None) -> bool:
        tests = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}
        return all(at is not None and tests[side](at, bound) for side, bound in self.bounds)

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for path in partition.value:
            yield from self._rows(path)

    def _rows(self, path: str) -> Iterator[tuple]:
        name = os.path.basename(path)
        try:
            with open(path, encoding="utf-8") as f:
                payload = json.load(f)
            entity, articles = payload["entity_id"], payload.get("articles") or []
            rows = [(name, k, entity, *[a.get(c) for c in FIELDS], seen_at(a.get("seendate")), None) for k, a in enumerate(articles)]
        except (OSError, ValueError, KeyError, TypeError, AttributeError) as problem:
            if self.entities is None and not self.bounds and not self.present:  # an error has no entity and no time
                yield (name, None, None, *[None] * len(FIELDS), None, f"{type(problem).__name__}: {problem}")
            return
        rows = [r for r in rows if (self.entities is None or r[2] in self.entities) and self._fits(r[-2])]
        rows = [r for r in rows if not ("entity_id" in self.present and r[2] is None or "seen_at" in self.present and r[-2] is None)]
        if self.newest:
            rows = sorted(rows, key=lambda r: (r[-2] is not None, r[-2] or 0, -r[1]), reverse=True)[: self.newest]
        yield from rows


class Articles(DataSource):
    """``spark.read.format("articles").option("newest", k).load(folder)``: landed searches, one file for each entity.

    A file holds ``{"entity_id": ..., "articles": [...]}``. ``newest`` keeps so many rows of each file, those
    without a time last.
    """

    @classmethod
    def name(cls) -> str:
        return "articles"

    def schema(self) -> str:
        return ARTICLES

    def reader(self, schema) -> DataSourceReader:
        return _ArticleReader(self.options)


class _Ids(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)


def ranges(ids: Iterable[int]) -> list[list[int]]:
    """Rising whole numbers as [first, last] of each stretch without a gap."""
    found: list[list[int]] = []
    for k in ids:
        if found and found[-1][1] == k - 1:
            found[-1][1] = k
        else:
            found.append([k, k])
    return found


class _IdReader(DataSourceStreamReader):
    """An offset holds the high-water mark and the stretches of ids that were there when it was made, from a few below
    the mark before it on. What a batch holds follows from its two offsets alone, so a replayed batch is the same."""

    def __init__(self, options: dict):
        self.folder, self.start, self.back = local(options["path"]), int(options.get("start", 1)), int(options.get("back", 5))
        self.grouped = int(options.get("idsPerFolder", 0))
        self.split, self.mark = int(options.get("rowsPerPartition", 1000)), int(options.get("start", 1)) - 1

    def initialOffset(self) -> dict:  # noqa: N802
        return {"mark": self.start - 1, "there": []}

    def latestOffset(self) -> dict:  # noqa: N802
        least = max(self.start, self.mark - self.back + 1)
        names = (re.fullmatch(r"(\d+)\.html", n) for folder in self._folders(least) for n in os.listdir(folder))
        here = sorted(k for m in names if m and (k := int(m[1])) >= least)
        return {"mark": max([self.mark, *here]), "there": ranges(here)}

    def _folders(self, least: int) -> list[str]:
        """Where pages from the id ``least`` on may lie; folders of lower ids aren't listed again."""
        if not self.grouped:
            return [self.folder]
        return [os.path.join(self.folder, n) for n in os.listdir(self.folder) if n.isdecimal() and int(n) >= least // self.grouped]

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.mark = end["mark"]
        given = {k for a, b in start["there"] for k in range(max(a, start["mark"] - self.back + 1), b + 1)}
        new = [k for a, b in end["there"] for k in range(max(a, start["mark"] - self.back + 1), b + 1) if k not in given]
        size = -(-max(len(new), 1) // (self.split * MOST_PARTS)) * self.split  # whole record batches
        return [_Ids([str(k) for k in new[n : n + size]]) for n in range(0, len(new), size)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        for n in range(0, len(partition.value), self.split):
            ids = [int(k) for k in partition.value[n : n + self.split]]
            pages = []
            for k in ids:
                with open(os.path.join(self.folder, str(k // self.grouped) if self.grouped else "", f"{k}.html"), encoding="utf-8", errors="replace") as f:
                    pages.append(f.read())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pages, pa.string())], names=["page_id", "html"])

    def commit(self, end: dict) -> None:
        pass


class IdSpace(DataSource):
    """``spark.readStream.format("id_space").option("start", k).load(folder)``: pages named by their id, ``<id>.html``.

    With ``idsPerFolder`` n, page k lies in the folder k // n: files of one folder are made one after the other, whoever makes them.
    """

    @classmethod
    def name(cls) -> str:
        return "id_space"

    def schema(self) -> str:
        return "page_id bigint, html string"

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _IdReader(self.options)


def register(spark: SparkSession) -> None:
    """Make both sources known to a session, and let it push filters into them."""
    spark.dataSource.register(Articles)
    spark.dataSource.register(IdSpace)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
