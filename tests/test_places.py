"""Places in texts, polygons as bytes, and gaps between ids, against plain versions."""

from __future__ import annotations

import random
import struct
import time

import pytest
from pyspark.sql import functions as F

from gavel.functions import scalars as X
from gavel.functions import wkb
from gavel.functions.geotags import NameIndex, places
from gavel.operators import upsert

NAMES = ["Miami-Dade", "St. Johns", "Polk", "Bay", "Bay County", "Ávila", "O'Neil", "Lake Worth Beach", "42nd", "...", "Key West", "polk"]


def test_index_finds_what_patterns_find(spark):
    rng = random.Random(6)
    pieces = [*NAMES, "miami", "DADE", "bay", "COUNTY", "st", ".", " ", "-", "_", "x", "é", "ÁVILA", "42ND", "\n", ", "]
    texts = ["".join(rng.choice([*pieces, " "]) for _ in range(rng.randrange(30))) for _ in range(400)] + ["", None, "İ Polk", "Bay_", "_Bay", "bayBay Bay"]
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "id int, text string")
    index = NameIndex(NAMES)
    want = {r.id: r.names for r in docs.select("id", X.tagged_names(F.col("text"), NAMES).alias("names")).collect()}
    assert {k: index.found(x) for k, x in enumerate(texts)} == want
    assert sum(map(bool, want.values())) > 150
    tagged = {r.id: (r.s.scope_type, r.s.scope_names) for r in docs.select("id", places(NAMES[:3], NAMES[3:], "statewide", ["FL"])(F.col("text")).alias("s")).collect()}
    plain = {r.id: (r.s.scope_type, r.s.scope_names) for r in docs.select("id", X.geo_scope(F.col("text"), NAMES[:3], NAMES[3:], "statewide", ["FL"]).alias("s")).collect()}
    assert tagged == plain


def test_many_names_cost_about_what_few_do():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    texts = [" ".join(word() for _ in range(400)) for _ in range(150)]
    names = [word().title() for _ in range(5000)]

    def seconds(n):
        index = NameIndex(names[:n])
        began = time.process_time()
        for x in texts:
            index.found(x)
        return time.process_time() - began

    few, many = min(seconds(50) for _ in range(3)), min(seconds(5000) for _ in range(3))
    assert many < 3 * few


def brute_wkb(polygons, order):
    mark = b"\1" if order == "<" else b"\0"
    out = mark + struct.pack(order + "II", 6, len(polygons))
    for rings in polygons:
        out += mark + struct.pack(order + "II", 3, len(rings))
        for ring in rings:
            out += struct.pack(order + "I", len(ring)) + b"".join(struct.pack(order + "dd", *p) for p in ring)
    return out


def test_wkb_round_trip(spark):
    rng = random.Random(9)
    ring = lambda n: [[rng.uniform(-180, 180), rng.uniform(-90, 90)] for _ in range(n)]
    shapes = [[[ring(4)]], [[ring(5), ring(4), ring(7)], [ring(4)]], [], [[]], [[[]]], None]
    for x in shapes[:-1]:
        assert wkb.encoded(x) == brute_wkb(x, "<") and wkb.encoded(x, big=True) == brute_wkb(x, ">")
        assert wkb.decoded(wkb.encoded(x)) == wkb.decoded(wkb.encoded(x, big=True, srid=4326)) == x
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(shapes)], f"k int, geom {wkb.RING}")
    back = rows.select("k", wkb.from_wkb(wkb.to_wkb("geom")).alias("geom"))
    assert sorted(map(tuple, back.collect()), key=lambda r: r[0]) == list(enumerate(shapes))


def test_wkb_of_other_writers():
    square = [[0.0, 0.0], [0.0, 1.0], [1.0, 1.0], [0.0, 0.0]]
    plain = b"\1" + struct.pack("<III", 3, 1, 4) + b"".join(struct.pack("<dd", *p) for p in square)
    high = b"\0" + struct.pack(">III", 1003, 1, 4) + b"".join(struct.pack(">ddd", *p, 7) for p in square)
    both = b"\1" + struct.pack("<IIII", 3 | wkb.HAS_Z | wkb.HAS_M | wkb.HAS_SRID, 4326, 1, 4) + b"".join(struct.pack("<dddd", *p, 7, 8) for p in square)
    assert wkb.decoded(plain) == wkb.decoded(high) == wkb.decoded(both) == [[square]]
    assert wkb.decoded(b"\0" + struct.pack(">II", 6, 2) + plain + high) == [[square], [square]]  # byte orders may change
    for broken in (b"", b"\2" + plain[1:], plain[:-1], plain + b"x", b"\1" + struct.pack("<Idd", 1, 0, 0), plain[:9] + struct.pack("<I", 1 << 30) + plain[13:], b"\1" + struct.pack("<II", 6, 1) + b"\1" + struct.pack("<Idd", 1, 0, 0)):
        with pytest.raises(ValueError):
            wkb.decoded(broken)


def test_gaps_without_a_window_over_the_table(spark):
    rng = random.Random(12)
    near = [rng.randrange(5000) for _ in range(700)]
    far = [rng.randrange(-(1 << 62), 1 << 62) for _ in range(300)] + [10_000 * k for k in range(60)] + [(1 << 20) - 1, 1 << 20, (1 << 40) - 1, 1 << 40, -1, 0, (1 << 60) + 5, -(1 << 63), (1 << 63) - 1]
    ids = sorted({*near, *far})
    want = [(a, b, b - a - 1) for a, b in zip(ids, ids[1:], strict=False) if b - a > 1 and b - a - 1 < 1 << 63]
    table = spark.createDataFrame([(x,) for x in [*near, *far, *near[:9]]] + [(None,)], "id bigint").where("id IS NULL OR id BETWEEN -4611686018427387903 AND 4611686018427387903")
    kept = [x for x in ids if abs(x) < 1 << 62]
    want = [(a, b, b - a - 1) for a, b in zip(kept, kept[1:], strict=False) if b - a > 1]
    found = upsert.miss_runs(table, "id")
    assert sorted(map(tuple, found.collect())) == want
    assert "SinglePartition" not in found._jdf.queryExecution().executedPlan().toString()
    assert upsert.miss_runs(table.where("false"), "id").count() == 0
