"""Queries that run feeds and streams against a store of tables, and read what the runs left.

The tables lie in a new folder under the shared one; feeds are composed of fixture columns.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel.functions import wkb
from gavel.operators import attempts, claims, ingest, samples
from gavel.operators.commits import Store
from gavel.plans.catalogue import CHANGED_SQL, CITIES, COUNTIES, _digests, _tag_sql, query, t
from gavel.plans.storage import dealt_out, kept, landed_files, scratch
from gavel.sources import feeds, html, landed
from gavel.streaming import changes, upserts
from gavel.streaming.batches import run_available

#: Ids of one folder of landed pages.
PAGES_PER_FOLDER = 1000
EARLY, LATE = "2026-03-01 10:00:00", "2026-03-05 10:00:00"


def _at(text: str):
    return F.lit(text).cast("timestamp")


def _city_run(store: Store, matters: DataFrame, sponsors: DataFrame, at: str) -> None:
    with kept(feeds.city_records(matters, sponsors, "town")) as (records,):  # every table reads them
        ingest.ingest_into(store, feeds.city_tables(records, "town", "Town", "County", _at(at)))


def _by_bill(store: Store) -> DataFrame:
    """Bill number, status and name with the numbers of sources and sponsors, of the newest version."""
    _, tables = store.snapshot()
    cited = tables["sources"].groupBy(F.col("url").alias("full_text_url")).agg(F.count("*").alias("n_sources"))
    backed = tables["relationships"].groupBy(F.col("to_entity_id").alias("entity_id")).agg(F.count("*").alias("n_sponsors"))
    names = tables["entities"].where("entity_type = 'bill'").select(F.col("id").alias("entity_id"), "name")
    rows = tables["bills"].join(names, "entity_id").join(cited, "full_text_url", "left").join(backed, "entity_id", "left")
    return rows.select("bill_number", "status", "name", F.coalesce("n_sources", F.lit(0)).alias("n_sources"), F.coalesce("n_sponsors", F.lit(0)).alias("n_sponsors"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS bill_number, o_orderstatus AS status, o_orderpriority AS name, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS n_sources,
CASE WHEN o_custkey % 7 = 3 THEN 1 ELSE 2 END AS n_sponsors FROM orders""")
def ingest_city(spark: SparkSession, d: str) -> DataFrame:
    """Two runs of the city feed. The second one has every matter twice: the later row stays, and nothing doubles."""
    k = F.col("o_orderkey")
    nothing = F.lit(None).cast("string")

    def matters(rows: DataFrame, status, position: int) -> DataFrame:
        return rows.select(
            k.alias("MatterId"), nothing.alias("MatterName"), F.col("o_orderpriority").alias("MatterTitle"), nothing.alias("MatterFile"), F.lit("type").alias("MatterTypeName"),
            nothing.alias("MatterAgendaDate"), nothing.alias("MatterIntroDate"), nothing.alias("MatterPassedDate"), F.lit("Board").alias("MatterBodyName"), status.alias("MatterStatusName"),
            F.lit(position).alias("position"),
        )

    rows = t(spark, d, "orders")
    clerk = F.concat(F.lit("Clerk "), (F.col("o_custkey") % 7).cast("string"))
    by = rows.select(k.alias("MatterId"), clerk.alias("MatterSponsorName"))
    by = by.union(by).union(by.withColumn("MatterSponsorName", F.lit("Clerk 3"))).union(by.withColumn("MatterSponsorName", F.lit("")))
    store = Store(spark, scratch(spark, "city"))
    first = matters(rows.where("o_orderkey % 2 = 0"), F.lit("old"), 0)
    _city_run(store, first, by, EARLY)
    again = matters(rows, F.lit("early"), 0).union(matters(rows, F.col("o_orderstatus"), 1))
    _city_run(store, again, by, LATE)
    return _by_bill(store)


@query("""SELECT 'R-' || p_partkey AS bill_number, 'Adopted' AS status, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END AS n_sources,
CASE WHEN p_name = p_brand THEN 1 ELSE 2 END AS n_sponsors FROM part WHERE p_partkey % 7 <> 0""")
def ingest_pages(spark: SparkSession, d: str) -> DataFrame:
    """Two runs of the scraped pages, of which some have no title and all of the second come twice."""
    k = F.col("p_partkey")

    def pages(rows: DataFrame, status: str, position: int) -> DataFrame:
        element = lambda field, body: F.concat(F.lit(f'<span id="{html.FIELD_IDS[field]}">'), body, F.lit("</span>"))
        page = F.concat(
            F.when(k % 7 != 0, element("title", F.col("p_name"))).otherwise(""), element("number", F.concat(F.lit("R-"), k.cast("string"))), element("status", F.lit(status)),
            F.lit(f'<table id="{html.INFO_TABLE}"><tr><th>Sponsors:</th><td>'), F.concat("p_name", F.lit("; "), "p_brand"), F.lit("</td></tr></table>"),
        )
        return rows.select(k.alias("page_id"), page.alias("html"), F.lit(position).alias("position"))

    rows = dealt_out(t(spark, d, "part").select("p_partkey", "p_name", "p_brand"), "p_partkey")
    store = Store(spark, scratch(spark, "pages"))

    def run(pages: DataFrame, at: str) -> None:
        records = feeds.page_records(pages).persist(StorageLevel.DISK_ONLY)  # every table reads them
        try:
            ingest.ingest_into(store, feeds.scraped_bills(records, "https://x.example", "Miami", "Miami-Dade County", _at(at)))
        finally:
            records.unpersist()

    run(pages(rows.where("p_partkey % 3 = 0"), "Filed", 0), EARLY)
    run(pages(rows, "Filed", 0).union(pages(rows, "Adopted", 1)), LATE)
    return _by_bill(store)


@query("""WITH o AS (SELECT o_orderkey, o_custkey % 7 AS clerk FROM orders)
SELECT 1 AS version, 'bills' AS name, count(*) AS rows FROM o WHERE o_orderkey % 2 = 0 UNION ALL SELECT 2, 'bills', count(*) FROM o
UNION ALL SELECT 1, 'entities', count(*) + count(DISTINCT clerk) FROM o WHERE o_orderkey % 2 = 0 UNION ALL SELECT 2, 'entities', count(*) + count(DISTINCT clerk) FROM o
UNION ALL SELECT 1, 'sources', count(*) FROM o WHERE o_orderkey % 2 = 0 UNION ALL SELECT 2, 'sources', count(*) + count(*) FILTER (WHERE o_orderkey % 2 = 0) FROM o
UNION ALL SELECT 1, 'relationships', count(*) FROM o WHERE o_orderkey % 2 = 0 UNION ALL SELECT 2, 'relationships', count(*) FROM o""")
def run_history(spark: SparkSession, d: str) -> DataFrame:
    """Rows that each commit wrote to each table, counted while they were written."""
    k = F.col("o_orderkey")
    nothing = F.lit(None).cast("string")
    rows = t(spark, d, "orders")
    fields = ("MatterName", "MatterTitle", "MatterFile", "MatterTypeName", "MatterAgendaDate", "MatterIntroDate", "MatterPassedDate", "MatterBodyName", "MatterStatusName")
    matters = rows.select(k.alias("MatterId"), *[nothing.alias(c) for c in fields])
    by = rows.select(k.alias("MatterId"), F.concat(F.lit("Clerk "), (F.col("o_custkey") % 7).cast("string")).alias("MatterSponsorName"))
    store = Store(spark, scratch(spark, "history"))
    for part, at in ((matters.where("MatterId % 2 = 0"), EARLY), (matters, LATE)):
        _city_run(store, part, by, at)
    return store.history().select("version", "name", "rows")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(props, event_id) AS props FROM events GROUP BY user_id")
def stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Events as a stream of several batches; the store keeps the last event of each user."""
    landed, users = scratch(spark, "landed"), Store(spark, scratch(spark, "users"))
    rows = t(spark, d, "events").select("user_id", "event_id", "event_type", "props")
    rows.repartition(4, "event_id").write.parquet(landed)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(landed)
    upserts.stream_into(stream, users, "events", upserts.upsert_latest("users", ["user_id"], ["event_id"]), scratch(spark, "progress"))
    return users.read("users")


BITS_SQL = "CASE WHEN {0} = 0 THEN 0 ELSE ((1023 + CAST(floor(log2({0})) AS BIGINT)) << 52) + CAST(({0} / pow(2, floor(log2({0}))) - 1) * pow(2, 52) AS BIGINT) END"


def _hex_sql(x: str) -> str:
    return f"upper(printf('%016x', {BITS_SQL.format(x)}))"


@query(f"""SELECT s_suppkey, '000000000600000001' || '000000000300000001' || '00000004' || {_hex_sql('s_nationkey')} || {_hex_sql('s_suppkey')} || {_hex_sql('s_nationkey')} || {_hex_sql('(s_suppkey + 1)')}
|| {_hex_sql('(s_nationkey + 1)')} || {_hex_sql('(s_suppkey + 1)')} || {_hex_sql('s_nationkey')} || {_hex_sql('s_suppkey')} AS wkb, 4 AS n_points FROM supplier""")
def boundary_wkb(spark: SparkSession, d: str) -> DataFrame:
    """A triangle for each supplier as well-known binary, most significant byte first; read back, its points are the same."""
    x, y = F.col("s_nationkey").cast("double"), F.col("s_suppkey").cast("double")
    ring = F.array(F.array(x, y), F.array(x, y + 1), F.array(x + 1, y + 1), F.array(x, y))
    shapes = t(spark, d, "supplier").select("s_suppkey", F.array(F.array(ring)).alias("geom"))
    coded = shapes.withColumn("wkb", wkb.to_wkb("geom", big=True))
    back = coded.withColumn("back", wkb.from_wkb(wkb.to_wkb(wkb.from_wkb("wkb"), srid=4326)))
    points = F.when(F.col("back") == F.col("geom"), F.size(F.col("back")[0][0]))
    return back.select("s_suppkey", F.hex("wkb").alias("wkb"), points.alias("n_points"))


@query(CHANGED_SQL + "SELECT k AS o_orderkey, digest FROM changed")
def change_stream(spark: SparkSession, d: str) -> DataFrame:
    """``change_hash_skip`` as a stream whose state begins with the stored digests; older and repeated rows come along and change nothing."""
    incoming, stored = _digests(spark, d)
    come = incoming.withColumn("version", F.lit(2))
    late = incoming.where("o_orderkey % 7 <> 0").withColumn("digest", F.lit("older")).withColumn("version", F.lit(0))
    path = scratch(spark, "digests")
    come.unionByName(late).repartition(3, "o_orderkey").write.parquet(path)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, changes.ROCKS)
    try:
        stream = spark.readStream.schema(come.schema).parquet(path)
        fresh = changes.changed_in_stream(stream, ["o_orderkey"], "digest", "version", stored.withColumn("version", F.lit(1)))
        run_available(fresh, out := scratch(spark, "fresh"), scratch(spark, "state"))
    finally:
        spark.conf.set(provider, before)
    return spark.read.schema(come.schema).parquet(out).select("o_orderkey", "digest")


@query("""SELECT entity_id, url, seen FROM (SELECT user_id AS entity_id, 'u' || event_id AS url, strftime(ts, '%Y-%m-%d %H:%M:%S') AS seen, date_trunc('second', ts) AS s,
row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('second', ts) DESC, event_id) AS n FROM events WHERE date_trunc('second', ts) >= TIMESTAMP '2024-01-10') WHERE n <= 5""")
def landed_articles(spark: SparkSession, d: str) -> DataFrame:
    """Searches landed as a JSON file for each bill, of which one is broken: the newest five of each since a time."""
    rows = t(spark, d, "events").withColumn("entity_id", F.col("user_id").cast("string"))
    article = F.struct("event_id", F.concat(F.lit("u"), F.col("event_id").cast("string")).alias("url"), F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'").alias("seendate"))
    whole = rows.groupBy("entity_id").agg(F.sort_array(F.collect_list(article)).alias("articles"))
    folder = scratch(spark, "articles")
    landed_files(whole.select(F.concat("entity_id", F.lit(".json")).alias("name"), F.to_json(F.struct("entity_id", "articles")).alias("body")), folder)
    landed_files(t(spark, d, "region").limit(1).select(F.lit("broken.json").alias("name"), F.lit("{").alias("body")), folder)
    landed.register(spark)
    found = spark.read.format("articles").option("newest", 5).load(folder).where(F.col("seen_at") >= F.lit("2024-01-10 00:00:00").cast("timestamp"))
    return found.select(F.col("entity_id").cast("bigint").alias("entity_id"), "url", F.date_format("seen_at", "yyyy-MM-dd HH:mm:ss").alias("seen"))


@query("SELECT o_orderkey AS page_id, '<p>' || o_orderstatus AS html FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey >= 5")
def id_stream(spark: SparkSession, d: str) -> DataFrame:
    """Pages named by id, landed in three steps, each read by a stream that goes on where it ended; some come late, just below the newest."""
    folder, out, state = (scratch(spark, n) for n in ("pages", "out", "state"))
    k = F.col("o_orderkey")
    rows = t(spark, d, "orders").where(k % 3 != 0).select(k, F.floor(k / PAGES_PER_FOLDER).alias("folder"), F.concat(F.lit("<p>"), "o_orderstatus").alias("body"))
    top = rows.agg(F.max("o_orderkey")).first()[0]
    late = (k <= top // 2) & (k > top // 2 - 4) & (k % 3 == 1)
    rows = rows.withColumn("name", F.concat(F.col("folder").cast("string"), F.lit("/"), k.cast("string"), F.lit(".html")))
    landed.register(spark)
    for step in ((k <= top // 2) & ~late, late | (k == top // 2 + 1), k > top // 2):
        landed_files(dealt_out(rows.where(step), "folder"), folder)  # each folder is one task's
        run_available(spark.readStream.format("id_space").option("start", 5).option("idsPerFolder", PAGES_PER_FOLDER).load(folder), out, state)
    return spark.read.schema("page_id bigint, html string").parquet(out)


@query("""SELECT p_partkey AS k, CASE WHEN p_partkey % 5 <> 2 THEN p_size * 2 END AS value, CASE WHEN p_partkey % 5 = 2 THEN 3 WHEN p_partkey % 7 = 3 THEN 1 ELSE 0 END AS tries,
CASE WHEN p_partkey % 5 = 2 THEN 'ValueError: never' END AS error FROM part""")
def retry_runs(spark: SparkSession, d: str) -> DataFrame:
    """Four runs over rows of which some fail once, while a service is down, and some always, until their three tries are spent."""
    rows = t(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_size")
    store = Store(spark, scratch(spark, "attempts"))

    def service(down: bool):
        def make():
            def work(row: dict) -> list[dict]:
                if row["k"] % 5 == 2:
                    raise ValueError("never")
                if down and row["k"] % 7 == 3:
                    raise TimeoutError("down")
                return [{"value": 2 * row["p_size"], "tries": 1 if row["k"] % 7 == 3 else 0}]

            return work

        return make

    for run in range(4):
        attempts.run_attempts(store, "sizes", rows, "k", service(run == 0), "value bigint, tries int", scratch(spark, "came"), most_tries=3)
    _, tables = store.snapshot()
    failed = tables["sizes_failed"].select("k", F.lit(None).cast("bigint").alias("value"), "tries", "error")
    return tables["sizes"].select("k", "value", "tries", F.lit(None).cast("string").alias("error")).unionByName(failed)


@query("""WITH o AS (SELECT o_orderkey AS k, o_custkey % 9 AS who, o_orderstatus AS s FROM orders)
SELECT 'entities' AS name, count(*) + (SELECT count(DISTINCT who || s) FROM o) AS n FROM o UNION ALL SELECT 'bills', count(*) FROM o UNION ALL SELECT 'sources', count(*) FROM o
UNION ALL SELECT 'relationships', count(*) FROM o UNION ALL SELECT 'claims', 2 * count(*) FROM o UNION ALL SELECT 'claim_sources', 2 * count(*) FROM o
UNION ALL SELECT 'claims with their source', 2 * count(*) FROM o""")
def sample_rows(spark: SparkSession, d: str) -> DataFrame:
    """Sample bills entered in two overlapping runs: every row is there once, and each claim has its source."""
    k = F.col("o_orderkey").cast("string")
    nothing = F.lit(None)
    rows = t(spark, d, "orders").select(
        "o_orderkey", F.concat(F.lit("HB "), k).alias("bill_number"), F.col("o_orderpriority").alias("title"), F.lit("state").alias("jurisdiction_level"), F.col("o_orderstatus").alias("jurisdiction_name"),
        F.lit("2026").alias("session"), F.lit("House").alias("chamber"), F.lit("Passed").alias("status"), F.to_date("o_orderdate").alias("introduced_date"), nothing.cast("date").alias("last_action_date"),
        nothing.cast("string").alias("last_action"), F.concat(F.lit("https://x.example/"), k).alias("source_url"), F.lit("legiscan").alias("source_system"), F.lit("statewide").alias("geo_scope_type"),
        F.array(F.lit("FL")).alias("geo_scope_names"), F.concat(F.lit("Rep. "), (F.col("o_custkey") % 9).cast("string")).alias("sponsor"),
        F.create_map(F.lit("what_it_does"), k, F.lit("who_it_affects"), F.col("o_orderpriority")).alias("claims"),
    )
    store = Store(spark, scratch(spark, "samples"))
    for part in (rows.where("o_orderkey % 3 <> 0"), rows.where("o_orderkey % 2 = 0"), rows):
        samples.enter(store, samples.sample_tables(part.drop("o_orderkey"), _at(EARLY)))
    _, tables = store.snapshot()
    linked = tables["claims"].select(F.col("id").alias("claim_id")).join(tables["claim_sources"], "claim_id").join(tables["sources"].select(F.col("id").alias("source_id")), "source_id")
    found = linked.agg(F.count("*").alias("n")).select(F.lit("claims with their source").alias("name"), "n")
    for name, df in tables.items():
        found = found.union(df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n"))
    return found


@query(f"""WITH tagged AS (SELECT doc_id, text, {_tag_sql(COUNTIES)} AS a, {_tag_sql(CITIES)} AS b FROM documents)
SELECT 'D ' || doc_id AS bill_number, 'D ' || doc_id || ' - ' || coalesce(source, '') || chr(10) || 'status: Filed, ' || CASE WHEN len(a) > 0 THEN 'county: ' || array_to_string(a, ', ') WHEN len(b) > 0 THEN 'city: ' || array_to_string(b, ', ') ELSE 'statewide: FL' END
|| CASE WHEN doc_id % 10 = 3 THEN '' ELSE chr(10) || 'what_it_does: ' || least(length(coalesce(text, '')), 12000) || chr(10) || 'sources: https://x.example/' || doc_id END AS card
FROM (SELECT t.*, source FROM tagged t JOIN documents USING (doc_id))""")
def by_hand(spark: SparkSession, d: str) -> DataFrame:
    """Documents as bills that are entered by hand: place, claim and source of each as one card; some prompts fail."""
    key = F.col("doc_id").cast("string")
    nothing = F.lit(None)
    rows = t(spark, d, "documents").select(
        F.concat(F.lit("D "), key).alias("bill_number"), F.col("source").alias("title"), F.lit("state").alias("jurisdiction_level"), F.lit("FL").alias("jurisdiction_name"), F.lit("2026").alias("session"),
        F.lit("House").alias("chamber"), F.lit("Filed").alias("status"), nothing.cast("date").alias("introduced_date"), nothing.cast("date").alias("last_action_date"), nothing.cast("string").alias("last_action"),
        F.concat(F.lit("https://x.example/"), key).alias("source_url"), F.lit("legiscan").alias("source_system"), nothing.cast("string").alias("sponsor"), F.col("text").alias("bill_text"),
    )

    def make():
        def tell(prompt: str) -> str:
            number, _, text = prompt.partition("|")
            if number.endswith("3"):
                raise TimeoutError("no answer")
            return str(len(text))

        return tell

    made = samples.by_hand(rows, _at(EARLY), {"what_it_does": "{bill_number}|{bill_text}"}, make, "stub", COUNTIES, CITIES)
    store = Store(spark, scratch(spark, "hand"))
    samples.enter(store, made)
    return samples.shown(store.snapshot()[1])


@query("""WITH asked AS (SELECT p_partkey, p_brand || '-' || p_partkey AS bill_number, p_name AS title, p_type AS body FROM part)
SELECT 0 AS place, '' AS bill_number, '# Review of summaries' || chr(10) || chr(10) || 'Model: stub' || chr(10) || 'Bills: ' || count(*) || chr(10) || chr(10) || 'Compare each answer with its text: invented facts, missing provisions, judgements of value.' AS report FROM asked
UNION ALL SELECT 1, bill_number, '## ' || bill_number || ': ' || title || chr(10) || chr(10) || '> ' || body || chr(10) || chr(10) || '**what_it_does:** ' || CASE WHEN contains(body, 'ring') THEN 'error: ValueError: no answer' ELSE CAST(length(body) AS VARCHAR) END
|| chr(10) || chr(10) || '**Verdict:** [ ] accurate  [ ] change the prompt  [ ] reject' FROM asked""")
def review_report(spark: SparkSession, d: str) -> DataFrame:
    """Bills landed as JSON, answered, and written as a report; here its rows."""
    from gavel.plans.records import _count_words

    folder = scratch(spark, "review")
    rows = t(spark, d, "part").select(F.concat("p_brand", F.lit("-"), F.col("p_partkey").cast("string")).alias("bill_number"), F.col("p_name").alias("title"), F.col("p_type").alias("bill_text"))
    rows.write.json(folder)
    bills = claims.review_bills(spark, folder, lines=True)
    return claims.review_report(bills, claims.generated(claims.prompts(bills, {"what_it_does": "{bill_text}"}, text="bill_text"), _count_words), "stub")
