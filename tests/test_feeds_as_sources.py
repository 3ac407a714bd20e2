"""Landed feeds as Spark sources, keyed change state, attempts that fail, shapefiles by ranges."""

from __future__ import annotations

import json
import os
import struct

import pytest
from pyspark.sql import functions as F

from gavel.operators import attempts, upsert
from gavel.operators.commits import Store
from gavel.plans.storage import landed_files
from gavel.sources import files, landed
from gavel.streaming import changes
from gavel.streaming.batches import run_available


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


@pytest.fixture(scope="module", autouse=True)
def sources(spark):
    landed.register(spark)


def land(folder, name, payload):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}.json", "w") as f:
        f.write(payload if isinstance(payload, str) else json.dumps(payload))


def article(url, seen):
    return {"url": url, "title": f"t {url}", "seendate": seen}


def test_articles_are_filtered_in_the_reader(spark, tmp_path):
    folder = str(tmp_path)
    land(folder, "a", {"entity_id": "b1", "articles": [article("u1", "20260301T000000Z"), article("u2", "20260305T120000Z"), article("u3", "bad"), article("u4", "20260305T120000Z")]})
    land(folder, "b", {"entity_id": "b2", "articles": [article("u5", "20260306T000000Z")]})
    land(folder, "c", {"entity_id": "b3", "articles": None})
    land(folder, "d", "{")
    land(folder, "e", {"articles": []})
    found = spark.read.format("articles").load(folder)
    assert rows(found.where("error IS NULL"), "entity_id", "url", "position") == [("b1", "u1", 0), ("b1", "u2", 1), ("b1", "u3", 2), ("b1", "u4", 3), ("b2", "u5", 0)]
    assert rows(found.where("error IS NOT NULL"), "file") == [("d.json",), ("e.json",)]
    since = found.where(F.col("seen_at") >= F.lit("2026-03-05 00:00:00").cast("timestamp")).where("entity_id = 'b1'")
    formatted = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = since._jdf.queryExecution().explainString(formatted)
    assert "GreaterThanOrEqual(seen_at," in plan and "EqualTo(entity_id,b1)" in plan
    assert "Filter (" not in plan  # none of them is left to Spark
    assert rows(since, "url") == [("u2",), ("u4",)]
    assert rows(spark.read.format("articles").option("newest", 2).load(folder).where("error IS NULL"), "url") == [("u2",), ("u4",), ("u5",)]
    # the newest within a span are those of the rows that fit it
    assert rows(spark.read.format("articles").option("newest", 1).load(folder).where(F.col("seen_at") < F.lit("2026-03-05 00:00:00").cast("timestamp")), "url") == [("u1",)]
    assert found.rdd.getNumPartitions() == 1
    assert spark.read.format("articles").option("filesPerPartition", 1).load(folder).rdd.getNumPartitions() == 5
    assert spark.read.format("articles").option("bytesPerPartition", 1).load(folder).rdd.getNumPartitions() == 5
    with pytest.raises(ValueError, match="mounted"):
        landed.local("s3://bucket/x")


def put(folder, *ids):
    os.makedirs(folder, exist_ok=True)
    for k in ids:
        with open(f"{folder}/{k}.html", "w") as f:
            f.write(f"<p>{k}")


def test_id_stream_loses_none_and_gives_none_twice(spark, tmp_path):
    folder, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    run = lambda: run_available(spark.readStream.format("id_space").option("start", 10).option("rowsPerPartition", 3).load(folder), out, state)
    got = lambda: rows(spark.read.parquet(out), "page_id")
    put(folder, 5, 10, 11, 14, 20)
    run()
    assert got() == [(10,), (11,), (14,), (20,)]
    put(folder, 17, 18, 12)  # 12 is too far below the mark, as the feed's rule has it
    run()
    assert got() == [(10,), (11,), (14,), (17,), (18,), (20,)]
    run()
    put(folder, *range(21, 40))
    run()
    assert [k for (k,) in got()] == [10, 11, 14, 17, 18, 20, *range(21, 40)]


def test_a_replayed_batch_of_ids_is_the_same(tmp_path):
    folder = str(tmp_path)
    put(folder, 1, 2, 5)
    reader = landed._IdReader({"path": folder})
    start, end = reader.initialOffset(), reader.latestOffset()
    ids = lambda parts: [k for p in parts for k in p.value]
    first = ids(reader.partitions(start, end))
    put(folder, 3, 4)
    again = landed._IdReader({"path": folder})
    assert ids(again.partitions(start, end)) == first == ["1", "2", "5"]
    later = again.latestOffset()
    assert ids(again.partitions(end, later)) == ["3", "4"]
    assert ids(again.partitions(later, again.latestOffset())) == []


def test_many_ids_make_few_parts_of_bounded_record_batches(tmp_path, monkeypatch):
    monkeypatch.setattr(landed, "MOST_PARTS", 3)
    put(str(tmp_path), *range(1, 21))
    reader = landed._IdReader({"path": str(tmp_path), "rowsPerPartition": "2"})
    parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
    assert [len(p.value) for p in parts] == [8, 8, 4]
    batches = [b for p in parts for b in reader.read(p)]
    assert {b.num_rows for b in batches} == {2} and [k for b in batches for k in b.column(0).to_pylist()] == list(range(1, 21))


def test_pages_in_folders_by_id_are_listed_from_the_mark_on(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def land_pages(*ids):
        landed_files(spark.createDataFrame([(f"{k // 10}/{k}.html", f"<p>{k}") for k in ids], "name string, body string"), folder)

    def run():
        run_available(spark.readStream.format("id_space").option("idsPerFolder", 10).load(folder), out, state)
        return rows(spark.read.parquet(out), "page_id", "html")

    want = lambda *ids: sorted([(k, f"<p>{k}") for k in ids], key=str)
    land_pages(1, 9, 10, 31)
    assert run() == want(1, 9, 10, 31)
    land_pages(12, 28, 30, 40)  # 12 is too far below the mark
    assert run() == want(1, 9, 10, 31, 28, 30, 40)
    reader = landed._IdReader({"path": folder, "idsPerFolder": "10"})
    assert sorted(os.path.basename(f) for f in reader._folders(30)) == ["3", "4"]


@pytest.fixture
def rocks(spark):
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, changes.ROCKS)
    yield
    spark.conf.set(provider, before)


def test_change_state_agrees_with_the_batch_form(spark, tmp_path, rocks):
    stored = spark.createDataFrame([("a", "h1", 1), ("b", "h2", 1), ("c", None, 1), ("d", "", 1)], "id string, digest string, version long")
    schema = "id string, digest string, version long, name string"
    come = [("a", "h1", 2, "same"), ("b", "h9", 2, "other"), ("c", None, 2, "no digest"), ("d", "h", 2, "first digest"), ("e", "h5", 2, "new")]
    path, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    spark.createDataFrame(come, schema).coalesce(1).write.parquet(path)
    run = lambda: run_available(changes.changed_in_stream(spark.readStream.schema(schema).parquet(path), ["id"], "digest", "version", stored), out, state)
    run()
    got = lambda: rows(spark.read.parquet(out), "id", "name")
    want = rows(upsert.changed(spark.createDataFrame(come, schema), stored, ["id"], "digest"), "id", "name")
    assert got() == want == [("b", "other"), ("c", "no digest"), ("d", "first digest"), ("e", "new")]
    more = [("a", "h0", 1, "late"), ("e", "h6", 4, "fourth"), ("e", "h5", 3, "third"), ("b", "h9", 3, "same again"), ("a", "h7", 3, "changed")]
    spark.createDataFrame(more, schema).coalesce(1).write.mode("append").parquet(path)
    run()
    assert got() == sorted([*want, ("e", "fourth"), ("a", "changed")], key=str)


def test_forgotten_keys_count_as_new():
    from types import SimpleNamespace

    import pandas as pd

    class Value:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, x):
            self.held = x

        def clear(self):
            self.held = None

    timers: list[int] = []
    handle = SimpleNamespace(getValueState=lambda *_: Value(), listTimers=lambda: [(x,) for x in timers], deleteTimer=timers.remove, registerTimer=timers.append)
    work = changes._Changes(["id"], "digest", "version", ["id", "digest", "version"], 1000)
    work.init(handle)
    clock = lambda now: SimpleNamespace(getCurrentProcessingTimeInMs=lambda: now)
    batch = lambda version: iter([pd.DataFrame({"id": ["a"], "digest": ["h"], "version": [version]})])
    seen = lambda version, now: sum(len(x) for x in work.handleInputRows(("a",), batch(version), clock(now)))
    assert (seen(1, 0), seen(2, 500), timers) == (1, 0, [1500])
    assert sum(len(x) for x in work.handleExpiredTimer(("a",), clock(1500), None)) == 0
    assert seen(3, 1600) == 1


def test_failed_keys_come_first_in_the_next_run(spark, tmp_path):
    todo = spark.createDataFrame([(k, f"p{k}") for k in range(12)], "k long, prompt string")
    store, log = Store(spark, str(tmp_path / "s")), tmp_path / "calls"
    log.mkdir()

    def service(down):
        def make():
            def work(row):
                with open(log / f"{row['k']}-{down}", "a") as f:
                    f.write("x")
                if row["k"] % 4 == down:
                    raise RuntimeError("down")
                return [] if row["k"] == 8 else [{"text": row["prompt"].upper()}]

            return work

        return make

    run = lambda n, down, **given: attempts.run_attempts(store, "texts", todo, "k", service(down), "text string", str(tmp_path / f"came{n}"), **given)
    run(0, 1)
    assert rows(store.read("texts_failed"), "k", "tries", "error") == [(k, 1, "RuntimeError: down") for k in (1, 5, 9)]
    assert len(rows(store.read("texts"), "k")) == 8 and len(rows(store.read("texts_done"), "k")) == 9
    run(1, 7, retries_only=True)
    assert sorted(p.name for p in log.iterdir() if p.name.endswith("-7")) == ["1-7", "5-7", "9-7"]  # the second run takes only these
    assert rows(store.read("texts_failed"), "k") == [] and len(rows(store.read("texts"), "k")) == 11
    run(2, 7)
    assert sorted(p.name for p in log.iterdir() if p.name.endswith("-7")) == ["1-7", "5-7", "9-7"]  # all are done
    assert store.version() == 3


def test_tries_end(spark, tmp_path):
    todo = spark.createDataFrame([(1,)], "k long")
    store = Store(spark, str(tmp_path / "s"))

    def make():
        def work(row):
            raise KeyError(row["k"])

        return work

    for n in range(4):
        attempts.run_attempts(store, "t", todo, "k", make, "x long", str(tmp_path / f"c{n}"), most_tries=2)
    assert rows(store.read("t_failed"), "k", "tries") == [(1, 2)]


def test_shapefiles_are_read_by_ranges(spark, tmp_path):
    square = lambda k: [(k, 0.0), (k, 1.0), (k + 1.0, 1.0), (k, 0.0)]
    n, shp, shx, at = 40, b"", b"", 50
    for k in range(n):
        points = square(float(k)) if k % 9 else []
        body = struct.pack("<i4d2i", 5, 0, 0, 1, 1, 1, 4) + struct.pack("<i", 0) + b"".join(struct.pack("<2d", *p) for p in points) if points else struct.pack("<i", 0)
        shp += struct.pack(">2i", k + 1, len(body) // 2) + body
        shx += struct.pack(">2i", at, len(body) // 2)
        at += 4 + len(body) // 2
    field = lambda name, width: name.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([width]) + b"\0" * 15
    head = struct.pack("<B3BIHH", 3, 26, 1, 1, n, 32 + 64 + 1, 23).ljust(32, b"\0") + field("STATEFP", 2) + field("NAME", 20) + b"\r"
    table = b"".join((b"*" if k % 13 == 0 else b" ") + b"12" + f"Place {k}".ljust(20).encode() for k in range(n))
    whole, ranged = tmp_path / "whole", tmp_path / "ranged"
    for folder in (whole, ranged):
        folder.mkdir()
        (folder / "c.shp").write_bytes(b"\0" * 100 + shp)
        (folder / "c.dbf").write_bytes(head + table)
    (ranged / "c.shx").write_bytes(b"\0" * 100 + shx)
    spark.dataSource.register(files.Shapefiles)
    found = spark.read.format("shapefiles").option("bytesPerPartition", 600).load(str(ranged))
    assert found.rdd.getNumPartitions() > 5
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 5
    assert [r[0] for r in rows(found, "record")] == sorted((k for k in range(n) if k % 13), key=lambda k: str((k,)))
    made = [rows(files.shapefile_boundaries(spark, str(f), scope_type="county", name_field="NAME"), "scope_name", "geom_source", "geom") for f in (whole, ranged)]
    assert made[0] == made[1] and len(made[0]) == 36
    (ranged / "c.dbf").unlink()
    with pytest.raises(Exception, match="lacks its .dbf"):
        spark.read.format("shapefiles").load(str(ranged)).count()
