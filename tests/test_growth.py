"""Work that is done once: pages, commits, runs of a feed."""

from __future__ import annotations

from gavel.plans import records
from gavel.sources import html


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_page_is_parsed_once_and_by_many_tasks(spark, sf_dir):
    found = records.page_records(spark, sf_dir)
    assert plan(found).count("ArrowEvalPython") == 1
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    pages = spark.createDataFrame([(1, f'<span id="{html.FIELD_IDS["title"]}">a</span>'), (2, "")], "page_id long, html string")
    read = pages.select("page_id", html.page_record("html", "page_id").alias("r")).where("r.title IS NOT NULL")
    assert plan(read).count("ArrowEvalPython") == 1 and [r.page_id for r in read.collect()] == [1]


def test_rows_that_are_added_leave_the_stored_folders(spark, tmp_path, monkeypatch):
    from gavel.operators import commits

    monkeypatch.setattr(commits, "MOST_FOLDERS", 3)
    store, written = commits.Store(spark, str(tmp_path / "s")), []
    for k in range(5):
        made = store.commit({"a": commits.Added(spark.createDataFrame([(k, f"x{k}")], "k long, x string"))}, k)
        written.append(made.tables["a"]["folder"])
        assert sorted(r.k for r in store.read("a").collect()) == list(range(k + 1)) and made.tables["a"]["rows"] == k + 1
    assert store.log(3).tables["a"]["more"] == written[:2][::-1] and "more" not in store.log(4).tables["a"]
    assert [r.k for r in store.read("a", 1).collect()] == [0]
    assert set(store.retain(1)) == set(written[:3]) and store.read("a").count() == 5


def test_absent_keeps_null_keys_and_drops_stored_ones(spark):
    from gavel.operators.upsert import absent

    rows = spark.createDataFrame([("a", "b", 1), ("a", None, 2), (None, None, 3), ("c", "d", 4)], "x string, y string, n int")
    stored = spark.createDataFrame([("a", "b"), ("a", None), (None, None)], "x string, y string")
    assert sorted(r.n for r in absent(rows, stored, ["x", "y"]).collect()) == [2, 3, 4]


def test_a_second_run_writes_only_new_sources_and_edges(spark, tmp_path):
    from pyspark.sql import functions as F

    from gavel.operators import ingest
    from gavel.operators.commits import Store
    from gavel.sources import feeds

    fields = ("MatterName", "MatterTitle", "MatterFile", "MatterTypeName", "MatterAgendaDate", "MatterIntroDate", "MatterPassedDate", "MatterBodyName", "MatterStatusName")
    matters = spark.range(4).select(F.col("id").alias("MatterId"), *[F.lit(None).cast("string").alias(c) for c in fields])
    by = matters.select("MatterId", F.lit("Ann").alias("MatterSponsorName"))
    store = Store(spark, str(tmp_path / "s"))
    for day in ("2026-03-01", "2026-03-02"):
        made = ingest.ingest_into(store, feeds.city_bills(matters, by, "town", "Town", "County", F.lit(day).cast("timestamp")))
    assert {n: made.tables[n]["rows"] for n in made.tables} == {"entities": 5, "bills": 4, "sources": 8, "relationships": 4}
    rows = lambda n: spark.read.parquet(f"{store.path}/{made.tables[n]['folder']}").count()
    assert (rows("sources"), rows("relationships")) == (4, 0)


def test_records_that_are_kept_are_not_parsed_again(spark):
    from pyspark.sql import functions as F

    from gavel.sources import feeds

    page = f'<span id="{html.FIELD_IDS["title"]}">a</span><span id="{html.FIELD_IDS["number"]}">R-1</span>'
    pages = spark.createDataFrame([(1, page, 0), (1, page.replace("R-1", "R-2"), 1), (2, "", 0)], "page_id long, html string, position int")
    at, about = F.lit("2026-03-01").cast("timestamp"), ("https://x.example", "Miami", "Miami-Dade County")
    kept = spark.createDataFrame(feeds.page_records(pages).collect(), feeds.page_records(pages).schema)
    ours, plain = feeds.scraped_bills(kept, *about, at), feeds.scraped_bills(pages, *about, at)
    for name in plain:
        assert "ArrowEvalPython" not in plan(ours[name])
        assert sorted(map(str, ours[name].collect())) == sorted(map(str, plain[name].collect()))


def test_records_of_a_run_are_shuffled_once(spark):
    from pyspark.sql import functions as F

    from gavel.operators import ingest
    from gavel.plans.storage import kept
    from gavel.sources import feeds

    fields = ("MatterName", "MatterTitle", "MatterFile", "MatterTypeName", "MatterAgendaDate", "MatterIntroDate", "MatterPassedDate", "MatterBodyName", "MatterStatusName")
    matters = spark.range(4).select(F.col("id").alias("MatterId"), *[F.lit(None).cast("string").alias(c) for c in fields])
    by = spark.createDataFrame([(0, "Ann"), (0, "Ann"), (0, "Bo"), (1, None), (2, ""), (None, "Cy"), (9, "Di")], "MatterId long, MatterSponsorName string")
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as large tables have it
    try:
        with kept(feeds.city_records(matters, by, "town"), feeds.city_records(matters.union(matters), by, "town")) as found:
            stored = ingest.none_stored(spark)
            for records, day in zip(found, ("2026-03-01", "2026-03-02"), strict=True):
                stored = ingest.ingested(stored, feeds.city_tables(records, "town", "Town", "County", F.lit(day).cast("timestamp")))
            for name in ("bills", "relationships"):
                first, second = (plan(df.select("entity_id")).count("Exchange hashpartitioning") for df in found)
                assert plan(stored[name]).count("Exchange hashpartitioning") <= 2 * (first + second) + 1
            assert {n: df.count() for n, df in stored.items()} == {"entities": 6, "bills": 4, "sources": 8, "relationships": 2}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_absent_rows_by_a_column_that_they_lie_by(spark):
    from gavel.operators.upsert import absent

    rows = spark.createDataFrame([("a", "x", 1), ("b", "x", 2), (None, "x", 3), ("c", "y", 4)], "id string, place string, n int")
    stored = spark.createDataFrame([("a", "x"), (None, "x"), ("d", "y")], "id string, place string")
    assert sorted(r.n for r in absent(rows, stored, ["id"], near="place").collect()) == [2, 3, 4]


def test_a_repeated_bill_has_the_sponsors_of_all_its_rows(spark):
    from pyspark.sql import functions as F

    from gavel import schemas
    from gavel.sources import feeds

    listing = spark.createDataFrame([(k, "S", "t", "h", "9", None, None, "u") for k in (1, 2, None)], schemas.STATE_LISTING)
    details = spark.createDataFrame([(k, "T", None, None, "h", 4, None, None, None, None, None, s) for k, s in ((1, [(5, "Ann", 1)]), (1, [(6, "Bo", 1)]), (2, None), (None, [(7, "Cy", 1)]))], schemas.STATE_DETAIL)
    made = feeds.state_bills(listing, details, "FL", F.lit("2026-03-01").cast("timestamp"))
    assert (made["bills"].count(), sorted(r.name for r in made["people"].collect()), made["relationships"].count()) == (2, ["Ann", "Bo"], 2)
