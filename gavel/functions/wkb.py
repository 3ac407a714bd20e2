"""Polygons as well-known binary: the bytes that spatial stores exchange, and back.

Coordinates are those of a GeoJSON MultiPolygon: polygons of rings of points. Encoding and decoding run over
Arrow batches. A decoded value may be in either byte order, also one that changes between its parts, a Polygon or
a MultiPolygon, with an SRID before it and with heights or measures behind the points, which are left out.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the format: kinds of geometry, and bits that tell of heights, measures and an SRID.
POLYGON, MULTIPOLYGON = 3, 6
HAS_Z, HAS_M, HAS_SRID = 0x80000000, 0x40000000, 0x20000000
RING = "array<array<array<array<double>>>>"


def encoded(polygons: list, big: bool = False, srid: int | None = None) -> bytes:
    order, mark = (">", b"\0") if big else ("<", b"\1")
    whole = srid is not None
    out = [mark, struct.pack(f"{order}I", MULTIPOLYGON | (HAS_SRID if whole else 0)), struct.pack(f"{order}I", srid) if whole else b"", struct.pack(f"{order}I", len(polygons))]
    for rings in polygons:
        out += [mark, struct.pack(f"{order}II", POLYGON, len(rings))]
        for ring in rings:
            points = np.array([list(p)[:2] for p in ring], np.float64).reshape(-1, 2)
            out += [struct.pack(f"{order}I", len(points)), points.astype(f"{order}f8").tobytes()]
    return b"".join(out)


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def count(self, order: str) -> int:
        (n,) = struct.unpack_from(f"{order}I", self.data, self.at)
        self.at += 4
        return n

    def head(self) -> tuple[str, int, int]:
        """Byte order, kind and numbers of a point."""
        if self.at >= len(self.data) or self.data[self.at] > 1:
            raise ValueError("no well-known binary")
        order = "<" if self.data[self.at] else ">"
        self.at += 1
        kind = self.count(order)
        if kind & HAS_SRID:
            self.at += 4
        width = 2 + bool(kind & HAS_Z) + bool(kind & HAS_M)
        base = kind & 0x0FFFFFFF
        return order, base % 1000, width + (0, 1, 1, 2)[base // 1000 % 4]

    def polygon(self, order: str, width: int) -> list:
        rings = []
        for _ in range(self.count(order)):
            n = self.count(order)
            if 8 * width * n > len(self.data) - self.at:
                raise ValueError("well-known binary ends within a ring")
            points = np.frombuffer(self.data, f"{order}f8", n * width, self.at).reshape(n, width)[:, :2]
            self.at += 8 * width * n
            rings.append(points.tolist())
        return rings


def decoded(data: bytes) -> list:
    """MultiPolygon coordinates; ``ValueError`` for anything but one whole polygon or multipolygon."""
    reader = _Reader(data)
    try:
        order, kind, width = reader.head()
        if kind == POLYGON:
            found = [reader.polygon(order, width)]
        elif kind == MULTIPOLYGON:
            found = []
            for _ in range(reader.count(order)):
                inner = reader.head()
                if inner[1] != POLYGON:
                    raise ValueError(f"kind {inner[1]} inside a multipolygon")
                found.append(reader.polygon(inner[0], inner[2]))
        else:
            raise ValueError(f"kind {kind} is no polygon")
    except struct.error:
        raise ValueError("well-known binary ends early") from None
    if reader.at != len(data):
        raise ValueError("bytes follow the geometry")
    return found


def to_wkb(geom: Column | str, big: bool = False, srid: int | None = None) -> Column:
    """The coordinates as bytes; a null stays null."""

    @F.pandas_udf("binary")
    def encode(shapes: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else encoded(x, big, srid) for x in shapes], dtype=object)

    return encode(geom)


def from_wkb(data: Column | str) -> Column:
    """The bytes as coordinates; a null stays null, bytes that aren't a polygon fail the job."""

    @F.pandas_udf(RING)
    def decode(values: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else decoded(bytes(x)) for x in values], dtype=object)

    return decode(data)
