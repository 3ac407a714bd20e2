"""Files that are landed whole: boundaries, jurisdiction lists, shapefile attributes and shapes."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gavel.functions.scalars import as_multipolygon, natural_id
from gavel.schemas import FEATURES, JURISDICTIONS


def jurisdictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(JURISDICTIONS).option("multiLine", True).json(path)


def boundaries(spark: SparkSession, path: str, origin: str) -> DataFrame:
    """Rows of spatial contexts from a GeoJSON FeatureCollection."""
    whole = spark.read.schema(FEATURES).option("multiLine", True).json(path)
    each = whole.select(F.explode("features").alias("f")).select("f.properties.*", F.from_json("f.geometry", "type string, coordinates string").alias("g"))
    return each.select(
        natural_id(F.col("scope_type"), F.col("scope_name")).alias("id"), F.lit(None).cast("string").alias("entity_id"), F.lit(None).cast("string").alias("event_id"),
        "scope_type", "scope_name", F.lit(origin).alias("geom_source"), as_multipolygon(F.col("g.type"), F.col("g.coordinates")).alias("geom"),
    )


def dbf_layout(data: bytes) -> tuple[int, int, int, list[tuple[str, int]]]:
    """Rows, bytes before the first, bytes of each, and (name, width) of the fields of a dBASE table."""
    n, head, size = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode("latin-1"), data[at + 16]))
        at += 32
    return n, head, size, fields


def dbf_rows(data: bytes, layout: tuple[int, int, int, list[tuple[str, int]]] | None = None) -> Iterator[dict[str, str] | None]:
    """Rows of a dBASE attribute table as texts; None for a deleted one. With a ``layout``, ``data`` are rows without a head."""
    n, head, size, fields = layout or dbf_layout(data)
    if layout:
        n, head = len(data) // size, 0
    for k in range(n):
        row, place = {}, head + k * size + 1
        if data[place - 1 : place] == b"*":
            yield None
            continue
        for name, width in fields:
            row[name] = data[place : place + width].decode("utf-8", "replace").strip()
            place += width
        yield row


def _area(ring: list) -> float:
    """Twice the signed area; negative for a ring that runs clockwise."""
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False))


def _inside(point: list, ring: list) -> bool:
    x, y = point
    crossed = [(a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(ring, ring[1:], strict=False)]
    return sum(crossed) % 2 == 1


def polygons(rings: list) -> list:
    """Polygons of rings: one that runs clockwise begins a polygon, any other is a hole of the one around it."""
    made = [[r] for r in rings if _area(r) <= 0]
    if not made:
        return [[r] for r in rings]
    for hole in (r for r in rings if _area(r) > 0):
        around = [p for p in made if _inside(hole[0], p[0])]
        (around[-1] if around else made[-1]).append(hole)
    return made


#: Shape types of polygons, plain and with heights or measures, which lie behind the points; and of no shape.
POLYGONS, NO_SHAPE = (5, 15, 25), 0


def shapes(data: bytes, at: int = 100) -> Iterator[list]:
    """MultiPolygon coordinates of each record of a shapefile from byte ``at`` on; an empty list for a record without a shape."""
    while at + 8 <= len(data):
        (words,) = struct.unpack_from(">I", data, at + 4)
        kind, body = struct.unpack_from("<i", data, at + 8)[0], at + 12
        if kind in POLYGONS:
            n_parts, n_points = struct.unpack_from("<ii", data, body + 32)
            starts = [*struct.unpack_from(f"<{n_parts}i", data, body + 40), n_points]
            points = struct.unpack_from(f"<{2 * n_points}d", data, body + 40 + 4 * n_parts)
            ring = lambda a, b: [[points[2 * k], points[2 * k + 1]] for k in range(a, b)]
            yield polygons([ring(a, b) for a, b in zip(starts, starts[1:], strict=False)])
        elif kind == NO_SHAPE:
            yield []
        else:
            raise ValueError(f"shape type {kind} is no polygon")
        at += 8 + 2 * words


#: Bytes of the index before its records and of each record, and bytes of shapes that a task reads at most, about.
INDEX_HEAD, INDEX_RECORD, RANGE_BYTES = 100, 8, 16 << 20


class _Records(InputPartition):
    def __init__(self, stem: str, first: int, last: int):
        super().__init__((stem, first, last))


class _ShapeReader(DataSourceReader):
    """Deals the records of each shapefile out by ranges, which its index names."""

    def __init__(self, options: dict):
        from gavel.sources.landed import local

        self.folder, self.most = local(options["path"]), int(options.get("bytesPerPartition", RANGE_BYTES))

    def partitions(self) -> list[InputPartition]:
        out = []
        for name in sorted(n for n in os.listdir(self.folder) if n.endswith(".shp")):
            stem = os.path.join(self.folder, name[:-4])
            for kind in ("shx", "dbf"):
                if not os.path.exists(f"{stem}.{kind}"):
                    raise ValueError(f"{name[:-4]} lacks its .{kind} file")
            n = (os.path.getsize(f"{stem}.shx") - INDEX_HEAD) // INDEX_RECORD
            with open(f"{stem}.dbf", "rb") as f:
                if struct.unpack_from("<I", f.read(12), 4)[0] != n:
                    raise ValueError(f"{name[:-4]}: its files differ in length")
            each = max(1, min(n, n * self.most // max(1, os.path.getsize(f"{stem}.shp"))))
            out += [_Records(stem, k, min(k + each, n)) for k in range(0, n, each)]
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        stem, first, last = partition.value
        with open(f"{stem}.shx", "rb") as f:
            f.seek(INDEX_HEAD + first * INDEX_RECORD)
            places = struct.unpack(f">{2 * (last - first)}I", f.read((last - first) * INDEX_RECORD))
        with open(f"{stem}.dbf", "rb") as f:
            head = f.read(struct.unpack_from("<IHH", f.read(12), 4)[1] - 12)  # after the 12 bytes that tell the length
            f.seek(0)
            layout = dbf_layout(f.read(12) + head)
            f.seek(layout[1] + first * layout[2])
            rows = list(dbf_rows(f.read((last - first) * layout[2]), layout))
        with open(f"{stem}.shp", "rb") as f:
            for k, row in enumerate(rows):  # offsets and lengths count words of two bytes
                f.seek(2 * places[2 * k])
                if row is not None:
                    yield os.path.basename(stem), first + k, row, next(shapes(f.read(8 + 2 * places[2 * k + 1]), 0))


class Shapefiles(DataSource):
    """``spark.read.format("shapefiles").load(folder)``: (file, record, attributes, geom) of every record that isn't deleted.

    A file is read by as many tasks as ranges of ``bytesPerPartition`` make; its index (.shx) says where they begin.
    The folder must be mounted on every machine.
    """

    @classmethod
    def name(cls) -> str:
        return "shapefiles"

    def schema(self) -> str:
        return "file string, record bigint, attributes map<string,string>, geom array<array<array<array<double>>>>"

    def reader(self, schema) -> DataSourceReader:
        return _ShapeReader(self.options)


def shape_records(spark: SparkSession, folder: str) -> DataFrame:
    """(file, attributes, geom) of the shapefiles of a folder (NAME.shp beside NAME.dbf).

    With an index (NAME.shx) beside each in a mounted folder, files are dealt out by ranges of records; else Spark
    reads them whole, one pair of files to a task.
    """
    kinds = {os.path.splitext(p)[1] for p in os.listdir(folder)} if os.path.isdir(folder) else set()
    if ".shx" in kinds:
        spark.dataSource.register(Shapefiles)
        return spark.read.format("shapefiles").load(folder).drop("record")
    files = spark.read.format("binaryFile").load(f"{folder}/*.{{shp,dbf}}").select(
        F.regexp_replace("path", r"\.(shp|dbf)$", "").alias("stem"), F.regexp_extract("path", r"([^/]+)\.\w+$", 1).alias("file"),
        F.regexp_extract("path", r"\.(\w+)$", 1).alias("kind"), "content",
    )
    pairs = files.groupBy("stem", "file").agg(F.max(F.when(F.col("kind") == "shp", F.col("content"))).alias("shp"), F.max(F.when(F.col("kind") == "dbf", F.col("content"))).alias("dbf"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for _, pair in part.iterrows():
                if pair["shp"] is None or pair["dbf"] is None:
                    raise ValueError(f"{pair['file']} lacks its .shp or .dbf file")
                rows = zip(dbf_rows(pair["dbf"]), shapes(pair["shp"]), strict=True)  # a file of another length is broken
                kept = [(r, g) for r, g in rows if r is not None]
                yield pd.DataFrame({"file": [pair["file"]] * len(kept), "attributes": [r for r, _ in kept], "geom": [g for _, g in kept]})

    return pairs.mapInPandas(run, "file string, attributes map<string,string>, geom array<array<array<array<double>>>>")


def shapefile_boundaries(
    spark: SparkSession, folder: str, *, scope_type: str, name_field: str, state: str = "12", state_field: str = "STATEFP",
    names: Sequence[str] | None = None, origin: str = "US Census TIGER/Line",
) -> DataFrame:
    """Rows of spatial contexts from the shapefiles of a folder.

    A record of another state (where the field is there), without a name, or with a name that isn't asked for is skipped.
    """
    own = F.coalesce(F.col("attributes")[state_field] == state, F.lit(True))
    named = F.trim(F.coalesce(F.col("attributes")[name_field], F.lit("")))
    found = shape_records(spark, folder).where(own).withColumn("scope_name", named).where(F.col("scope_name") != "")
    if names:
        found = found.where(F.col("scope_name").isin(*names))
    return found.select(
        natural_id(F.lit(scope_type), F.col("scope_name")).alias("id"), F.lit(None).cast("string").alias("entity_id"), F.lit(None).cast("string").alias("event_id"),
        F.lit(scope_type).alias("scope_type"), "scope_name", F.concat(F.lit(f"{origin} ("), "file", F.lit(".shp)")).alias("geom_source"), "geom",
    )
