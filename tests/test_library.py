"""Feeds, files, flags, claims, upserts and streams on hand-written rows."""

from __future__ import annotations

import json
import struct
from datetime import date

import pytest
from pyspark.sql import functions as F

from gavel import schemas
from gavel.functions.scalars import natural_id
from gavel.operators import browse, claims, flags, geo, upsert
from gavel.operators.commits import Store
from gavel.sources import feeds, files, html
from gavel.streaming import batches

def run_at():
    return F.lit("2026-03-05 10:00:00").cast("timestamp")


def pairs(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


PAGE = """<html><body><span id="ContentPlaceholder1_lblLegiFileTitle"> A <b>title</b><br> here </span>
<span id="ContentPlaceholder1_lblResNum">R-1</span><a id="ContentPlaceholder1_lnkDate">Mar 5, 2026 9:00 AM</a>
<table id="tblLegiFileInfo"><tr><th>Department:</th><td>Public works &amp; parks, and a name that goes well over fifty characters</td></tr>
<tr><th>Sponsors:</th><td>Ann Lee; Commissioner, District Four Bo Ray;</td></tr></table></body></html>"""


def test_pages_become_records():
    record = html.record_of(PAGE, 7)
    assert record["number"] == "R-1" and record["status"] == "Unknown" and record["title"] == "Atitlehere"
    assert record["sponsors"].startswith("Ann Lee") and record["department"].startswith("Public works & parks")
    assert html.record_of("<p id=x>no title", 7) is None and html.record_of(None, 7) is None
    only = '<i id="ContentPlaceholder1_lblLegiFileTitle">T</i>'
    assert html.record_of(only, 9) == {"number": "9", "type": None, "status": "Unknown", "date_text": None, "title": "T", "department": None, "sponsors": ""}


def test_only_the_first_element_of_an_id_and_cells_of_one_row_count():
    title = '<b id="ContentPlaceholder1_lblLegiFileTitle">'
    page = f'<img id="ContentPlaceholder1_lblResNum">{title}T</b>{title}U</b><table id="tblLegiFileInfo"><tr><th>Department</th></tr><tr><td>stray</td><th>Sponsors<td>Ann</table>'
    record = html.record_of(page, 3)
    assert record["title"] == "T" and record["number"] == "" and record["department"] is None and record["sponsors"] == "Ann"


def test_holes_stay_holes_and_broken_files_fail():
    outer = [[0.0, 0.0], [0.0, 9.0], [9.0, 9.0], [9.0, 0.0], [0.0, 0.0]]
    hole = [[1.0, 1.0], [2.0, 1.0], [2.0, 2.0], [1.0, 2.0], [1.0, 1.0]]
    other = [[20.0, 0.0], [20.0, 1.0], [21.0, 1.0], [20.0, 0.0]]
    assert files.polygons([outer, other, hole]) == [[outer, hole], [other]] and files.polygons([hole]) == [[hole]]
    body = struct.pack("<i4d2i", 15, 0, 0, 1, 1, 1, 4) + struct.pack("<i", 0) + b"".join(struct.pack("<2d", *p) for p in other) + b"\0" * 48
    record = struct.pack(">2i", 1, len(body) // 2) + body
    assert list(files.shapes(b"\0" * 100 + record)) == [[[other]]]
    with pytest.raises(ValueError, match="polygon"):
        list(files.shapes(b"\0" * 100 + struct.pack(">2i", 1, 2) + struct.pack("<i", 3)))


def test_a_second_run_of_the_same_feed_writes_nothing(spark):
    from gavel.operators import ingest

    listing = spark.createDataFrame([(1, "S 1", "t1", "h1", "9", None, "2026-3-5", "u1"), (2, "H 2", "t2", None, None, "la", "bad", "")], schemas.STATE_LISTING)
    detail = [(k, f"T{k}", None, None, f"h{k}", 4, None, "x", "2026-02-03", "acted", None, [(5, "Ann", 1)]) for k in (1, 2)]
    rows = spark.createDataFrame(detail, schemas.STATE_DETAIL)
    later = F.lit("2026-04-05 10:00:00").cast("timestamp")
    first = ingest.ingested(ingest.none_stored(spark), feeds.state_bills(listing, rows, "FL", run_at()), "legiscan_change_hash")
    first["entities"] = first["entities"].withColumn("external_ids", F.map_concat("external_ids", F.create_map(F.lit("other"), F.lit("x"))))
    second = ingest.ingested(first, feeds.state_bills(listing, rows, "FL", later), "legiscan_change_hash")
    counts = lambda tables: {name: df.count() for name, df in tables.items()}
    assert counts(first) == {"entities": 3, "bills": 2, "sources": 2, "relationships": 2}
    # the second bill has no hash, so it is written again, with a source of its own
    assert counts(second) == {"entities": 3, "bills": 2, "sources": 3, "relationships": 2}
    assert {r.external_ids.get("other") for r in second["entities"].where("entity_type = 'bill'").collect()} == {"x"}


def test_stored_repeats_multiply_nothing(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, h string")
    stored = spark.createDataFrame([(1, "a"), (1, "a"), (2, "x"), (2, "y"), (3, None)], "k int, h string")
    assert pairs(upsert.changed(rows, stored, ["k"], "h"), "k", "h") == [(2, "b"), (3, None)]


def test_scraped_bills(spark):
    pages = spark.createDataFrame([(7, PAGE), (8, "<p>nothing"), (9, None)], "page_id long, html string")
    made = feeds.scraped_bills(pages, "https://x.example", "Miami", "Miami-Dade County", run_at())
    bill = made["bills"].collect()
    assert len(bill) == 1 and bill[0].session == "2026" and bill[0].introduced_date is None and bill[0].last_action_date == date(2026, 3, 5)
    assert len(bill[0].chamber) == 50 and bill[0].chamber.endswith("…") and bill[0].geo_scope_names == ["Miami-Dade County"]
    assert pairs(made["people"], "name") == [("Ann Lee",), ("Commissioner, District Four Bo Ray",)]
    assert made["relationships"].count() == 2


def test_state_bills(spark):
    listing = spark.createDataFrame([(1, "S 1", "t1", "h1", "9", None, "2026-3-5", "u1"), (2, "H 2", "t2", None, None, "la", "bad", "")], schemas.STATE_LISTING)
    detail = [
        (1, "", "s 1", None, "h1", 9, ("2026 Session",), "2026-01-02", "", "", "d", [(5, "Ann", 1), (5, "Ann", 1), (None, "Bo", 2), (None, "Cy", 2)]),
        (2, "T2", None, "link", "h2", 4, None, "x", "2026-02-03", "acted", None, None),
    ]
    made = feeds.state_bills(listing, spark.createDataFrame(detail, schemas.STATE_DETAIL), "FL", run_at())
    got = {r.bill_number: r for r in made["bills"].collect()}
    assert got["s 1"].chamber == "Senate" and got["s 1"].status == "9" and got["s 1"].last_action_date == date(2026, 3, 5)
    assert got["H 2"].chamber == "House" and got["H 2"].status == "Passed" and got["H 2"].introduced_date is None and got["H 2"].session == ""
    assert pairs(made["entities"], "name") == [("T2",), ("t1",)]
    assert pairs(made["people"], "name") == [("Ann",), ("Bo",), ("Cy",)]
    assert pairs(made["relationships"], "relationship_type") == [("co_sponsor",), ("co_sponsor",), ("sponsor",)]


def test_city_bills(spark):
    long = "x" * 500
    rows = [(1, None, long, "F1", "type", None, "2026-01-05T00:00:00", None, "Board", None), (2, "Name", None, None, None, "2025-07-01T00:00:00", None, "2026-02-01T00:00:00", None, "Adopted"), (3, "y" * 490, "t", "F3", None, "", "bad", "", None, "")]
    sponsors = spark.createDataFrame([(1, "Ann"), (1, "Ann"), (1, ""), (2, None), (2, "Bo")], "MatterId long, MatterSponsorName string")
    made = feeds.city_bills(spark.createDataFrame(rows, schemas.CITY_MATTER), sponsors, "client", "Miami", "Miami-Dade County", run_at())
    got = {r.bill_number: r for r in made["bills"].collect()}
    assert got["F1"].session == "current" and got["F1"].status == "Introduced" and got["F1"].last_action_date == got["F1"].introduced_date == date(2026, 1, 5)
    assert got["2"].session == "2025" and got["2"].last_action_date == date(2026, 2, 1) and got["F3"].session == "current"
    names = {len(r.name) for r in made["entities"].collect()}
    assert names == {490, 4} and made["relationships"].count() == 2


def test_news_is_new_once_per_bill(spark):
    rows = [("b1", "u1", "t" * 600, "d", None, None, "20260301T000000Z"), ("b1", "u1", "t", "d", None, None, None), ("b2", "u1", None, None, None, None, "bad"), ("b1", "u0", "t", "d", None, None, None), ("b1", None, "t", "d", None, None, None), ("b1", "", "t", "d", None, None, None)]
    articles = spark.createDataFrame(rows, "entity_id string, url string, title string, domain string, language string, sourcecountry string, seendate string")
    stored = spark.createDataFrame([("b1", "u0")], "entity_id string, url string")
    made = feeds.news(articles, stored, run_at())
    got = {r.entity_id: r for r in made["events"].collect()}
    assert set(got) == {"b1", "b2"} and len(got["b1"].title) <= 500 and got["b2"].title == "" and got["b2"].event_date == date(2026, 3, 5)
    assert made["sources"].count() == 2


def test_listing_and_payload_checks(spark):
    payload = json.dumps({"session": {"x": 1}, "0": {"bill_id": 1}, "1": {"bill_id": 2}})
    rows = spark.createDataFrame([(payload, "OK")], "p string, status string")
    assert rows.select(F.explode(feeds.listing_rows(F.col("p"), "struct<bill_id:bigint>")).alias("r")).select("r.bill_id").count() == 2
    assert feeds.landed_ok(rows).count() == 1
    with pytest.raises(Exception, match="the feed answered ERROR"):
        feeds.landed_ok(rows.withColumn("status", F.lit("ERROR"))).collect()
    assert feeds.first_rows(spark.range(9), "id", 2).count() == 2 and feeds.first_rows(spark.range(9), "id", None).count() == 9
    with pytest.raises(ValueError, match="positive"):
        feeds.first_rows(spark.range(9), "id", 0)


def test_boundaries(spark, tmp_path):
    square = [[0.0, 0.0], [0.0, 1.0], [1.0, 1.0], [0.0, 0.0]]
    whole = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"scope_type": "county", "scope_name": "A", "jurisdiction_name": "FL"}, "geometry": {"type": "Polygon", "coordinates": [square]}},
        {"type": "Feature", "properties": {"scope_type": "county", "scope_name": "B", "jurisdiction_name": "FL"}, "geometry": {"type": "MultiPolygon", "coordinates": [[square], [square]]}},
    ]}
    (tmp_path / "x.geojson").write_text(json.dumps(whole))
    made = files.boundaries(spark, str(tmp_path / "x.geojson"), "test")
    assert {r.scope_name: len(r.geom) for r in made.collect()} == {"A": 1, "B": 2}
    counts = spark.createDataFrame([("A", 2)], "scope_name string, bill_count long")
    shaded = geo.shaded(made, counts, "scope_name")
    assert pairs(shaded, "scope_name", "bill_count", "bucket") == [("A", 2, "2-3"), ("B", 0, "0")]
    assert json.loads(geo.features(shaded).where("scope_name = 'A'").first().feature)["geometry"]["coordinates"] == [[square]]
    again = geo.replaced(made, made.where("scope_name = 'B'").withColumn("geom_source", F.lit("new")), ["scope_type", "scope_name"])
    assert pairs(again, "scope_name", "geom_source") == [("A", "test"), ("B", "new")]


def test_shapefiles(spark, tmp_path):
    points = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.0, 0.0)]
    body = struct.pack("<i4d2i", 5, 0, 0, 1, 1, 1, 4) + struct.pack("<i", 0) + b"".join(struct.pack("<2d", *p) for p in points)
    (tmp_path / "c.shp").write_bytes(b"\0" * 100 + b"".join(struct.pack(">2i", n, len(body) // 2) + body for n in (1, 2, 3, 4)))
    field = lambda name, width: name.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([width]) + b"\0" * 15
    rows = [("12", "Duval County"), ("13", "Other County"), ("12", ""), ("12", "Lake County")]
    table = b"".join(b" " + a.ljust(2).encode() + b.ljust(20).encode() for a, b in rows)
    head = struct.pack("<B3BIHH", 3, 26, 1, 1, 4, 32 + 64 + 1, 23).ljust(32, b"\0")
    (tmp_path / "c.dbf").write_bytes(head + field("STATEFP", 2) + field("NAMELSAD", 20) + b"\r" + table)
    made = files.shapefile_boundaries(spark, str(tmp_path), scope_type="county", name_field="NAMELSAD")
    assert pairs(made, "scope_name", "geom_source") == [("Duval County", "US Census TIGER/Line (c.shp)"), ("Lake County", "US Census TIGER/Line (c.shp)")]
    assert made.first().geom == [[[list(p) for p in points]]]
    assert files.shapefile_boundaries(spark, str(tmp_path), scope_type="county", name_field="NAMELSAD", names=["Lake County"]).count() == 1


def test_flags(spark):
    bills = spark.createDataFrame([("b1", "HB 1")], "entity_id string, bill_number string")
    known = spark.createDataFrame([("c1", "b1", "text"), ("c2", "b9", "text")], "id string, bill_entity_id string, claim_text string")
    rows = [("b1", None, "wrong number", None), ("b1", "c1", "wrong text", "a@b.co"), ("b1", "c2", "not its claim", None), ("b1", None, "no", None), ("b9", None, "unknown bill", None), ("b1", None, "bad mail", "x"), ("b1", None, None, None)]
    asked = spark.createDataFrame(rows, "bill_entity_id string, claim_id string, reason_text string, reporter_email string").withColumn("created_at", run_at())
    made = flags.created(asked, bills, known)
    assert pairs(made, "reason_text", "status") == [("wrong number", "pending"), ("wrong text", "pending")]
    assert pairs(flags.queue(flags.with_status(made), bills, known), "bill_number", "claim_text") == [("HB 1", "text"), ("HB 1", None)]
    done = flags.status_changed(made, made.select("id", F.lit("reviewed").alias("new_status")))
    assert flags.with_status(done).count() == 0 and flags.with_status(done, "all").count() == 2
    with pytest.raises(ValueError, match="status"):
        flags.with_status(done, "lost")


def test_claims(spark):
    bills = spark.createDataFrame([("b1", "HB 1", "T", "about roads " * 2000), ("b2", "HB 2", "U", "fails"), ("b3", "HB 3", "V", ""), ("b4", "HB 4", "W", "has one")], "entity_id string, bill_number string, title string, description string")
    old = spark.createDataFrame([("b4",)], "bill_entity_id string")
    todo = claims.unclaimed(bills, old)
    assert pairs(todo, "entity_id") == [("b1",), ("b2",)]
    asked = claims.prompts(todo, {"what_it_does": "{bill_number} {title}: {bill_text}", "who_it_affects": "Who? {bill_text}"})
    assert max(len(r.prompt) for r in asked.collect()) == 12_000 + len("HB 1 T: ")

    def make():
        def generator(prompt):
            if "fails" in prompt and prompt.startswith("Who"):
                raise RuntimeError("no answer")
            return prompt[:10]

        return generator

    made = claims.generated(asked, make)
    assert tuple(claims.outcome(made).first()) == (1, 1)
    sources = spark.createDataFrame([("b1", "s1"), ("b2", "s2")], "entity_id string, source_id string")
    rows, links = claims.stored(made, sources, "stub")
    assert pairs(rows, "bill_entity_id", "claim_type", "generated_by") == [("b1", "what_it_does", "llm:stub"), ("b1", "who_it_affects", "llm:stub")]
    assert links.join(rows, links["claim_id"] == rows["id"]).count() == 2
    report = {r.bill_number: r.report for r in claims.review_lines(bills.withColumnRenamed("description", "bill_text"), made).collect()}
    assert "..." in report["HB 1"] and "..." not in report["HB 2"] and "error: RuntimeError" in report["HB 2"]


def test_browse_and_detail(spark):
    bills = spark.createDataFrame([("b1", "HB 1", ["Miami-Dade County"], date(2026, 2, 1)), ("b2", "HB 2", ["FL"], None), ("b3", "HB 3", None, date(2026, 2, 1))], "entity_id string, bill_number string, names array<string>, at date")
    assert pairs(browse.filtered(bills, {"bill_number": None}, member=("names", "FL")), "entity_id") == [("b2",)]
    assert [r.entity_id for r in browse.page(bills, "at", "entity_id").collect()] == ["b1", "b3", "b2"]
    assert [r.entity_id for r in browse.page(bills, "at", "entity_id", 1, 2).collect()] == ["b2"]
    for limit, offset in ((0, 0), (101, 0), (5, -1)):
        with pytest.raises(ValueError, match="must"):
            browse.page(bills, "at", "entity_id", limit, offset)
    said = spark.createDataFrame([("b1", "c1", "what_it_does", "x")], "entity_id string, claim_id string, claim_type string, claim_text string")
    linked = spark.createDataFrame([("c1", "s1"), ("c1", "s2")], "claim_id string, source_id string")
    sources = spark.createDataFrame([("s1", "u1"), ("s2", "u2")], "source_id string, url string")
    people = spark.createDataFrame([("b1", "Ann", "sponsor")], "entity_id string, name string, relationship_type string")
    news = spark.createDataFrame([("b2", date(2026, 1, 1), "n", "u")], "entity_id string, event_date date, title string, url string")
    got = {r.entity_id: r for r in browse.detail(bills, "entity_id", said, linked, sources, people, news).collect()}
    assert len(got["b1"].claims[0].sources) == 2 and got["b1"].sponsors[0].name == "Ann" and got["b1"].news == []
    assert got["b3"].claims == [] and len(got["b2"].news) == 1


def test_upserts_and_snapshots(spark, tmp_path):
    base = spark.createDataFrame([("a", "h1", "n1"), ("b", "h2", "n2"), ("c", None, "n3")], "id string, digest string, name string")
    come = spark.createDataFrame([("a", "h1", "x"), ("b", "h9", "y"), ("c", None, "z"), ("d", "", "w")], "id string, digest string, name string")
    fresh = upsert.changed(come, base, ["id"], "digest")
    assert pairs(fresh, "id") == [("b",), ("c",), ("d",)]
    assert pairs(upsert.overlay(base, fresh, ["id"], keep_old=["name"]), "id", "name") == [("a", "n1"), ("b", "n2"), ("c", "n3"), ("d", "w")]
    store = Store(spark, str(tmp_path / "t"))
    store.commit({"t": base}, 0)
    store.update(lambda tables: {"t": upsert.overlay(tables["t"], fresh, ["id"])})
    assert store.read("t").count() == 4 and store.read("t", 1).count() == 3 and store.version() == 2
    assert spark.range(0).agg(upsert.high_water_mark(F.col("id"), 19_550).alias("v")).first().v == 19_545


def test_frontier_and_gaps(spark):
    ids = spark.createDataFrame([(i,) for i in (100, 101, 120, 146, 147, 173)], "id long")
    assert upsert.frontier(ids, "id", 100).first().highest == 120
    assert upsert.frontier(ids, "id", 100, misses=26).first().highest == 173
    assert upsert.frontier(ids, "id", 100, misses=10).first().highest == 101
    assert upsert.frontier(ids, "id", 500).first().highest == 500
    wide = spark.createDataFrame([(i,) for i in (5, 9_999, 10_001, 35_000)], "id long")
    assert pairs(upsert.miss_runs(wide, "id"), "before", "after", "misses") == [(10_001, 35_000, 24_998), (5, 9_999, 9_993), (9_999, 10_001, 1)]


def test_streams(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:10", "a"), (2, "2024-01-01 10:00:00", "a"), (3, "2024-01-03 00:00:00", "b"), (1, "2024-01-01 00:00:11", "a")]
    frame = spark.createDataFrame(rows, "id long, at string, kind string").withColumn("at", F.col("at").cast("timestamp"))
    frame.write.parquet(str(tmp_path / "in/events.parquet"))
    stream = lambda: batches.read_stream(spark, str(tmp_path / "in/events.parquet"), frame.schema)
    batches.run_available(batches.window_counts(stream(), "at", "kind"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert pairs(spark.read.parquet(str(tmp_path / "out")), "kind", "n") == [("a", 3)]
    seen = []
    batches.each_batch(batches.first_seen(stream(), ["id"], "at", "5 days"), lambda df, n: seen.extend(r.id for r in df.collect()), str(tmp_path / "state2"))
    assert sorted(seen) == [1, 2, 3]


def test_cascades(spark):
    a = spark.createDataFrame([(1,), (2,)], "a long")
    b = spark.createDataFrame([(10, 1), (20, 2)], "b long, a long")
    c = spark.createDataFrame([(100, 10), (200, 20)], "c long, b long")
    edges = [("a", "a", "b", "a", "cascade"), ("b", "b", "c", "b", "null")]
    left = upsert.cascaded({"a": a, "b": b, "c": c}, edges, a.where("a = 1"), "a", "a")
    assert pairs(left["b"], "b") == [(20,)] and pairs(left["c"], "c", "b") == [(100, None), (200, 20)]


def test_ids_come_from_natural_keys(spark):
    rows = spark.createDataFrame([("a", "bc"), ("ab", "c"), (None, "abc"), ("", "abc")], "x string, y string")
    assert rows.select(natural_id(F.col("x"), F.col("y")).alias("i")).distinct().count() == 4


def test_schemas_hold_every_table(spark):
    assert len(schemas.TABLES) == 9
    for schema in schemas.TABLES.values():
        assert spark.createDataFrame([], schema).count() == 0
