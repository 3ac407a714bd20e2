"""Queries over files and payloads that are landed first, from fixture columns, and then read by the sources."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel.functions import scalars as X
from gavel.operators import browse
from gavel.plans.catalogue import query, t
from gavel.plans.storage import landed_files, scratch
from gavel.sources import feeds, files
from gavel.streaming import batches


@query("SELECT o_custkey, o_orderkey AS bill_id, 'H ' || o_orderkey AS number, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderstatus END AS status FROM orders WHERE o_orderkey % 4 <> 0 ")
def state_listing(spark: SparkSession, d: str) -> DataFrame:
    """Listings of one customer's orders each, as an object of objects beside its session; those that don't say OK are set aside first."""
    k = F.col("o_orderkey")
    row = F.struct(k.alias("bill_id"), F.concat(F.lit("H "), k.cast("string")).alias("number"), F.when(k % 9 != 0, F.col("o_orderstatus")).alias("status"))
    ok = (k % 4 != 0).alias("ok")
    entries = t(spark, d, "orders").select("o_custkey", ok, F.concat(F.lit('"'), k.cast("string"), F.lit('":'), F.to_json(row)).alias("entry"))
    listed = F.concat(F.lit('{"session":{"session_id":1},'), F.array_join(F.collect_list("entry"), ","), F.lit("}"))
    payloads = entries.groupBy("o_custkey", "ok").agg(listed.alias("masterlist")).withColumn("status", F.when(F.col("ok"), "OK").otherwise("ERROR"))
    good = feeds.landed_ok(payloads.where("ok"))
    rows = good.select("o_custkey", F.explode(feeds.listing_rows(F.col("masterlist"), "struct<bill_id:bigint,number:string,status:string>")).alias("r"))
    return rows.select("o_custkey", "r.*")


@query("""SELECT n_name AS scope_name, 'county' AS scope_type, CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 2 END AS polygons, CAST(n_nationkey AS DOUBLE) AS west FROM nation""")
def geojson_boundaries(spark: SparkSession, d: str) -> DataFrame:
    """Collections of a region's nations, as polygons and multipolygons, landed as GeoJSON files."""
    x = F.col("n_nationkey").cast("double")
    ring = lambda x: F.array(F.array(x, F.lit(0.0)), F.array(x, F.lit(1.0)), F.array(x + 1, F.lit(1.0)), F.array(x, F.lit(0.0)))
    one = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring(x)).alias("coordinates")))
    two = F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), F.array(F.array(ring(x)), F.array(ring(x + 5))).alias("coordinates")))
    about = F.to_json(F.struct(F.lit("county").alias("scope_type"), F.col("n_name").alias("scope_name"), F.lit("FL").alias("jurisdiction_name")))
    feature = F.concat(F.lit('{"type":"Feature","properties":'), about, F.lit(',"geometry":'), F.when(F.col("n_nationkey") % 2 == 0, one).otherwise(two), F.lit("}"))
    whole = t(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.collect_list(feature), ",").alias("features"))
    folder = scratch(spark, "geojson")
    landed_files(whole.select(F.concat(F.col("n_regionkey").cast("string"), F.lit(".geojson")).alias("name"), F.concat(F.lit('{"type":"FeatureCollection","features":['), "features", F.lit("]}")).alias("body")), folder)
    made = files.boundaries(spark, folder, "drawn")
    return made.select("scope_name", "scope_type", F.size("geom").alias("polygons"), F.col("geom")[0][0][0][0].alias("west"))


def _shapefile(rows: pd.DataFrame) -> Iterator[tuple[str, bytes]]:
    """A shapefile, its index and its attributes for rows of (number, state, name)."""
    shp, shx, dbf, at = [], [], [], 50
    for n, r in enumerate(rows.itertuples(index=False), 1):
        x = float(r.number)
        points = [(x, 0.0), (x, 1.0), (x + 1, 1.0), (x, 0.0)]
        body = struct.pack("<i4d2i", 5, x, 0, x + 1, 1, 1, 4) + struct.pack("<i", 0) + b"".join(struct.pack("<2d", *p) for p in points)
        shp.append(struct.pack(">2i", n, len(body) // 2) + body)
        shx.append(struct.pack(">2i", at, len(body) // 2))
        dbf.append(b" " + r.state.ljust(2).encode() + r.name.ljust(30).encode())
        at += 4 + len(body) // 2
    field = lambda name, width: name.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([width]) + b"\0" * 15
    head = struct.pack("<B3BIHH", 3, 26, 1, 1, len(rows), 32 + 64 + 1, 33).ljust(32, b"\0") + field("STATEFP", 2) + field("NAME", 30) + b"\r"
    yield from (("shp", b"\0" * 100 + b"".join(shp)), ("shx", b"\0" * 100 + b"".join(shx)), ("dbf", head + b"".join(dbf)))


@query("""SELECT 'Place ' || s_suppkey AS scope_name, 'US Census TIGER/Line (n' || s_nationkey || '.shp)' AS geom_source, CAST(s_suppkey AS DOUBLE) AS west FROM supplier
WHERE s_suppkey % 3 <> 0 AND s_suppkey % 5 <> 0""")
def shapefile_scan(spark: SparkSession, d: str) -> DataFrame:
    """Shapefiles, one for each nation, read by ranges of their records; other states and places without a name are left out."""
    k = F.col("s_suppkey")
    rows = t(spark, d, "supplier").select("s_nationkey", k.alias("number"), F.when(k % 3 == 0, "13").otherwise("12").alias("state"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("Place "), k.cast("string"))).alias("name"))

    def make(part: pd.DataFrame) -> pd.DataFrame:
        stem = f"n{part['s_nationkey'].iloc[0]}"
        return pd.DataFrame([(f"{stem}.{kind}", body) for kind, body in _shapefile(part.sort_values("number"))], columns=["name", "body"])

    folder = scratch(spark, "shapes")
    landed_files(rows.groupBy("s_nationkey").applyInPandas(make, "name string, body binary"), folder)
    made = files.shapefile_boundaries(spark, folder.removeprefix("file://"), scope_type="county", name_field="NAME")
    return made.select("scope_name", "geom_source", F.col("geom")[0][0][0][0].alias("west"))


@query("SELECT r_name AS state, n_name AS county FROM nation JOIN region ON n_regionkey = r_regionkey")
def jurisdiction_lists(spark: SparkSession, d: str) -> DataFrame:
    """Lists of a region's nations, landed as one JSON file each."""
    names = t(spark, d, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.collect_list("n_name").alias("counties")).join(t(spark, d, "region"), "r_regionkey")
    folder = scratch(spark, "jurisdictions")
    body = F.to_json(F.struct(F.col("r_name").alias("state"), "counties", F.array().cast("array<string>").alias("cities")), {"pretty": "true"})
    landed_files(names.select(F.concat("r_name", F.lit(".json")).alias("name"), body.alias("body")), folder)
    return files.jurisdictions(spark, folder).select("state", F.explode("counties").alias("county"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def first_seen_stream(spark: SparkSession, d: str) -> DataFrame:
    """The first row of each user and kind of event, by state that keeps what was seen; a second run of the same stream adds nothing."""
    source, out, state = f"{d}/events.parquet", scratch(spark, "seen"), scratch(spark, "state")
    for _ in range(2):
        stream = batches.read_stream(spark, source, t(spark, d, "events").schema)
        batches.run_available(batches.first_seen(stream.select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", "400 days"), out, state)
    return spark.read.schema("user_id bigint, event_type string, ts timestamp").parquet(out).select("user_id", "event_type")


@query("SELECT event_id FROM events ORDER BY ts, event_id LIMIT 500")
def feed_prefix(spark: SparkSession, d: str) -> DataFrame:
    """The first 500 rows of a feed by their place in it."""
    rows = t(spark, d, "events").withColumn("position", F.struct("ts", "event_id"))
    return feeds.first_rows(rows, "position", 500).select("event_id")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name || ' (x)' ELSE c_name END AS name, CASE WHEN c_custkey % 3 = 0 THEN 'current' ELSE '1995' END AS session,
CASE WHEN length(c_name || c_name || c_name || c_name) <= 50 THEN c_name || c_name || c_name || c_name ELSE left(c_name || c_name || c_name || c_name, 49) || '…' END AS chamber FROM customer""")
def shown_fields(spark: SparkSession, d: str) -> DataFrame:
    """Names without their demo mark, sessions of years, departments cut to fit."""
    k = F.col("c_custkey")
    name = F.when(k % 2 == 0, F.concat("c_name", F.lit(" (DEMO) (x)"))).otherwise(F.concat("c_name", F.lit(" (DEMO)")))
    year = F.when(k % 3 != 0, F.lit("1995-03-05").cast("date"))
    return t(spark, d, "customer").select("c_custkey", X.without_demo_mark(name).alias("name"), X.year_session(year).alias("session"), X.shortened(F.repeat("c_name", 4), 50).alias("chamber"))


@query("""SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_orderkey, l_linenumber) IN (SELECT o_orderkey, 1 + o_custkey % 3 FROM orders WHERE o_orderkey % 10 = 0)
ORDER BY l_quantity DESC NULLS LAST, l_orderkey, l_linenumber LIMIT 100 OFFSET 25""")
def composite_key_page(spark: SparkSession, d: str) -> DataFrame:
    """Lines that two keys name together; the largest page, after one of the usual size."""
    browse.checked_page(100, 25)
    wanted = t(spark, d, "orders").where("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("l_orderkey"), (1 + F.col("o_custkey") % 3).alias("l_linenumber")).distinct()
    lines = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").join(wanted, ["l_orderkey", "l_linenumber"], "left_semi")
    return lines.orderBy(F.col("l_quantity").desc_nulls_last(), "l_orderkey", "l_linenumber").offset(25).limit(100)
