"""Queries over payloads that are built from the fixture tables: details, feeds, flags, claims, boundaries.

The payloads (feed rows, scraped pages, requests, prompts) are composed of fixture columns, run
through the sources and operators, and compared with the columns they came from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel.functions import scalars as X
from gavel.operators import browse, claims, flags, geo, ingest
from gavel.plans.catalogue import bills, links, query, t
from gavel.plans.storage import dealt_out, kept
from gavel.sources import feeds, html

RUN_AT = "2026-03-05 10:00:00"


def _run_at():
    return F.lit(RUN_AT).cast("timestamp")


# details


def _detail(spark: SparkSession, d: str, rows: DataFrame) -> DataFrame:
    line = t(spark, d, "lineitem").withColumn("claim_id", F.col("l_orderkey") * 100_000 + F.col("l_linenumber") * 10_000 + F.col("l_partkey") % 10_000)
    told = line.select(F.col("l_orderkey").alias("o_orderkey"), "claim_id", F.col("l_linestatus").alias("claim_type"), F.col("l_quantity").cast("bigint").cast("string").alias("claim_text"))
    linked = line.select("claim_id", F.col("l_partkey").alias("source_id")).distinct()
    urls = t(spark, d, "part").select(F.col("p_partkey").alias("source_id"), F.col("p_brand").alias("url"))
    names = t(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("name"))
    backing = line.where(F.col("l_returnflag").isin("R", "A")).join(names, "l_suppkey").select(F.col("l_orderkey").alias("o_orderkey"), "name", F.col("l_returnflag").alias("relationship_type"))
    seen = t(spark, d, "events").where("event_type = 'view'").select(F.col("event_id").alias("o_orderkey"), F.to_date("ts").alias("event_date"), F.col("event_type").alias("title"), F.col("props").alias("url"))
    whole = browse.detail(rows, "o_orderkey", told.distinct(), linked, urls, backing, seen)
    text = lambda c: c.cast("string")
    joined = lambda c, f, by: F.array_join(F.transform(c, f), by)
    return whole.select(
        "o_orderkey",
        joined("claims", lambda c: F.concat(text(c["claim_id"]), F.lit(":"), c["claim_type"], F.lit(":"), c["claim_text"], F.lit("="), joined(c["sources"], lambda s: F.concat(text(s["source_id"]), F.lit("/"), s["url"]), "+")), ",").alias("claims"),
        joined("sponsors", lambda s: F.concat(s["name"], F.lit("/"), s["relationship_type"]), ",").alias("sponsors"),
        joined("news", lambda n: F.concat(text(n["event_date"]), F.lit(" "), n["title"], F.lit(" "), n["url"]), ",").alias("news"),
    )


def _detail_sql(where: str) -> str:
    return f"""
WITH wanted AS (SELECT o_orderkey FROM orders {where}),
line AS (SELECT *, l_orderkey * 100000 + l_linenumber * 10000 + l_partkey % 10000 AS claim_id FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM wanted)),
told AS (SELECT DISTINCT l_orderkey, claim_id, l_linestatus AS kind, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS body FROM line),
cited AS (SELECT claim_id, string_agg(p_partkey || '/' || p_brand, '+' ORDER BY p_partkey, p_brand) AS cited
  FROM (SELECT DISTINCT claim_id, l_partkey FROM line) JOIN part ON l_partkey = p_partkey GROUP BY claim_id),
c AS (SELECT l_orderkey AS k, string_agg(claim_id || ':' || kind || ':' || body || '=' || coalesce(cited, ''), ',' ORDER BY claim_id, kind, body) AS claims
  FROM told LEFT JOIN cited USING (claim_id) GROUP BY k),
s AS (SELECT l_orderkey AS k, string_agg(s_name || '/' || l_returnflag, ',' ORDER BY s_name, l_returnflag) AS sponsors
  FROM line JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag IN ('R', 'A') GROUP BY k),
n AS (SELECT event_id AS k, string_agg(CAST(CAST(ts AS DATE) AS VARCHAR) || ' ' || event_type || ' ' || props, ',' ORDER BY ts, props) AS news FROM events WHERE event_type = 'view' GROUP BY k)
SELECT o_orderkey, coalesce(claims, '') AS claims, coalesce(sponsors, '') AS sponsors, coalesce(news, '') AS news
FROM wanted LEFT JOIN c ON o_orderkey = c.k LEFT JOIN s ON o_orderkey = s.k LEFT JOIN n ON o_orderkey = n.k"""


@query(_detail_sql("WHERE o_orderkey = 7"))
def bill_detail(spark: SparkSession, d: str) -> DataFrame:
    return _detail(spark, d, t(spark, d, "orders").where("o_orderkey = 7").select("o_orderkey"))


@query(_detail_sql(""))
def detail_nested(spark: SparkSession, d: str) -> DataFrame:
    return _detail(spark, d, t(spark, d, "orders").select("o_orderkey"))


@query("""SELECT o_orderkey, c_name AS name, o_orderstatus AS status, coalesce(n_name, 'Statewide') AS place, coalesce(strftime(o_orderdate, '%b %-d, %Y'), 'No date') AS shown
FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")
def json_records(spark: SparkSession, d: str) -> DataFrame:
    """Rows as JSON records and back: nothing is lost on the way."""
    rows = bills(spark, d).select("o_orderkey", F.col("c_name").alias("name"), F.col("o_orderstatus").alias("status"), X.displayed(F.col("n_name"), "Statewide").alias("place"), X.displayed_date(F.col("o_orderdate"), "No date").alias("shown"))
    return browse.json_records(rows).select(F.from_json("record", rows.schema).alias("r")).select("r.*")


# scraped pages


@query("""SELECT p_partkey AS page_id, CASE WHEN p_partkey % 5 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE 'R-' || p_partkey END AS number, p_brand AS type,
CASE WHEN p_partkey % 3 = 0 THEN 'Unknown' ELSE 'Adopted' END AS status, replace(p_name, ' ', '') AS title, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS department,
CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_name || '; ' || p_brand END AS sponsors FROM part WHERE p_partkey % 7 <> 0""")
def page_records(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    key = k.cast("string")
    element = lambda field, body: F.concat(F.lit(f'<span id="{html.FIELD_IDS[field]}">'), body, F.lit("</span>"))
    row = lambda name, body: F.concat(F.lit(f"<tr><th>{name}:</th><td>"), body, F.lit("</td></tr>"))
    page = F.concat(
        F.lit("<html><body><br>"), F.when(k % 7 != 0, element("title", F.replace("p_name", F.lit(" "), F.lit("<i> </i>")))).otherwise(""),
        F.when(k % 7 != 0, element("title", F.lit("a later one"))).otherwise(""), F.when(k % 5 != 0, element("number", F.concat(F.lit("R-"), key))).otherwise(""),
        element("type", F.col("p_brand")), F.when(k % 3 != 0, element("status", F.lit("Adopted"))).otherwise(""),
        F.lit(f'<table id="{html.INFO_TABLE}">'), F.when(k % 2 == 0, row("Department", F.col("p_type"))).otherwise("<tr><th>Department:</th></tr>"),
        F.when(k % 4 != 0, row("Sponsors", F.concat("p_name", F.lit("; "), "p_brand"))).otherwise(""), F.lit("</table></body></html>"),
    )
    rows = dealt_out(t(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type"), "p_partkey")
    found = rows.select(k.alias("page_id"), html.page_record(page, key).alias("r")).where("r.title IS NOT NULL")
    return found.select("page_id", "r.number", "r.type", "r.status", "r.title", "r.department", "r.sponsors")


@query("SELECT o_orderkey AS id FROM (SELECT o_orderkey FROM orders WHERE o_orderkey <= (SELECT max(o_orderkey) FROM orders) ORDER BY o_orderkey DESC LIMIT 50) WHERE o_orderkey % 3 <> 0 ORDER BY o_orderkey DESC LIMIT 20")
def recent_ids(spark: SparkSession, d: str) -> DataFrame:
    """The newest 20 pages that hold a record, tried downwards among twice as many and some more."""
    present = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 3 != 0).alias("ok"))
    return feeds.newest_successes(present, "id", "ok", 20, tried=50).select("id")


# feeds


def _state_records(spark: SparkSession, d: str, rows: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    owned = rows.join(t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
    listing = owned.select(
        k.alias("bill_id"), F.concat(F.lit("H "), k.cast("string")).alias("number"), F.col("c_name").alias("title"), F.md5("o_orderstatus").alias("change_hash"),
        F.col("o_orderpriority").alias("status"), F.lit("listed").alias("last_action"), F.date_format("o_orderdate", "yyyy-M-d").alias("last_action_date"), F.lit("").alias("url"),
    )
    details = owned.select(
        k.alias("bill_id"), F.when(k % 3 == 0, "").otherwise(F.col("c_name")).alias("title"), F.when(k % 2 == 0, F.concat(F.lit("s "), k.cast("string"))).alias("bill_number"),
        F.concat(F.lit("https://x.example/"), k.cast("string")).alias("state_link"), F.md5("o_orderstatus").alias("change_hash"),
        F.when(k % 5 == 0, 4).when(k % 5 == 1, 99).cast("int").alias("status"), F.struct(F.lit("2026 Session").alias("session_name")).alias("session"),
        F.when(k % 4 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("bad").alias("introduced"), F.lit("").alias("status_date"), F.lit("").alias("last_action"),
        F.lit("text").alias("description"),
        F.array(
            F.struct((k % 10).alias("people_id"), F.concat(F.lit("P"), (k % 10).cast("string")).alias("name"), F.lit(1).alias("sponsor_type_id")),
            F.struct((k % 10).alias("people_id"), F.concat(F.lit("P"), (k % 10).cast("string")).alias("name"), F.lit(1).alias("sponsor_type_id")),
            F.struct(F.lit(None).cast("bigint").alias("people_id"), F.col("c_name").alias("name"), F.lit(2).alias("sponsor_type_id")),
        ).alias("sponsors"),
    )
    return feeds.state_records(listing, details)


def _state(spark: SparkSession, d: str) -> feeds.Tables:
    return feeds.state_tables(_state_records(spark, d, t(spark, d, "orders")), "FL", _run_at())


@query("""SELECT CASE WHEN o_orderkey % 2 = 0 THEN 's ' ELSE 'H ' END || o_orderkey AS bill_number, CASE WHEN o_orderkey % 2 = 0 THEN 'Senate' ELSE 'House' END AS chamber,
CASE WHEN o_orderkey % 5 = 0 THEN 'Passed' ELSE o_orderpriority END AS status, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS introduced,
CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS last_action_date, 'listed' AS last_action, 'https://x.example/' || o_orderkey AS full_text_url FROM orders JOIN customer ON o_custkey = c_custkey""")
def state_feed(spark: SparkSession, d: str) -> DataFrame:
    made = _state(spark, d)["bills"]
    return made.select("bill_number", "chamber", "status", F.col("introduced_date").cast("string").alias("introduced"), F.col("last_action_date").cast("string").alias("last_action_date"), "last_action", "full_text_url")


@query("""SELECT relationship_type, count(*) AS n, count(DISTINCT person) AS people FROM (
SELECT DISTINCT o_orderkey, 'sponsor' AS relationship_type, 'P' || o_orderkey % 10 AS person FROM orders JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT o_orderkey, 'co_sponsor', c_name FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY relationship_type""")
def state_feed_sponsors(spark: SparkSession, d: str) -> DataFrame:
    edges = _state(spark, d)["relationships"]
    return edges.groupBy("relationship_type").agg(F.count("*").alias("n"), F.count_distinct("from_entity_id").alias("people"))


@query("""WITH o AS (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT 'bills' AS name, count(*) AS n FROM o UNION ALL SELECT 'entities', count(*) + 10 + count(DISTINCT c_name) FROM o
UNION ALL SELECT 'sources', count(*) FILTER (WHERE o_orderkey % 2 = 0) + count(*) FILTER (WHERE o_orderkey % 2 <> 0 OR o_orderkey % 6 = 0) FROM o
UNION ALL SELECT 'relationships', 2 * count(*) FROM o UNION ALL SELECT 'bills of the second run', count(*) FILTER (WHERE o_orderkey % 2 <> 0 OR o_orderkey % 6 = 0) FROM o""")
def ingest_state(spark: SparkSession, d: str) -> DataFrame:
    """Half the bills are stored, a third of these changed since; the second run has all of them."""
    rows = t(spark, d, "orders")
    before = rows.where("o_orderkey % 2 = 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 6 == 0, "old").otherwise(F.col("o_orderstatus")))
    early = F.lit("2026-03-01 10:00:00").cast("timestamp")
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    with kept(*[_state_records(spark, d, r) for r in (before, rows)]) as (first, second):  # every table of both runs reads them
        stored = ingest.ingested(ingest.none_stored(spark), feeds.state_tables(first, "FL", early), "legiscan_change_hash")
        after = ingest.ingested(stored, feeds.state_tables(second, "FL", _run_at()), "legiscan_change_hash")
        late = after["sources"].where(F.col("retrieved_at") == _run_at())
        found = count(late, "bills of the second run")
        for name in ("bills", "entities", "sources", "relationships"):
            found = found.union(count(after[name], name))
        return spark.createDataFrame(found.collect(), found.schema)


@query("""SELECT CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey AS VARCHAR) ELSE 'F' || o_orderkey END AS bill_number, CASE WHEN o_orderkey % 4 = 0 THEN 'current' ELSE strftime(o_orderdate, '%Y') END AS session,
CASE WHEN o_orderkey % 5 = 0 THEN 'Introduced' ELSE o_orderstatus END AS status, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS introduced,
'https://town.legistar.com/LegislationDetail.aspx?ID=' || o_orderkey AS full_text_url, 'Clerk ' || o_custkey % 7 AS sponsor FROM orders""")
def city_feed(spark: SparkSession, d: str) -> DataFrame:
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00:00")
    matters = t(spark, d, "orders").select(
        k.alias("MatterId"), F.lit(None).cast("string").alias("MatterName"), F.col("o_orderpriority").alias("MatterTitle"), F.when(k % 3 != 0, F.concat(F.lit("F"), k.cast("string"))).alias("MatterFile"),
        F.lit("type").alias("MatterTypeName"), F.when(k % 4 != 0, day).alias("MatterAgendaDate"), day.alias("MatterIntroDate"), F.lit(None).cast("string").alias("MatterPassedDate"),
        F.lit("Board").alias("MatterBodyName"), F.when(k % 5 != 0, F.col("o_orderstatus")).alias("MatterStatusName"),
    )
    by = t(spark, d, "orders").select(k.alias("MatterId"), F.concat(F.lit("Clerk "), (F.col("o_custkey") % 7).cast("string")).alias("MatterSponsorName"))
    made = feeds.city_bills(matters, by.union(by).union(by.withColumn("MatterSponsorName", F.lit(""))), "town", "Town", "County", _run_at())
    people = made["people"].select(F.col("id").alias("from_entity_id"), F.col("name").alias("sponsor"))
    named = made["relationships"].join(people, "from_entity_id").select(F.col("to_entity_id").alias("entity_id"), "sponsor")
    return made["bills"].join(named, "entity_id").select("bill_number", "session", "status", F.col("introduced_date").cast("string").alias("introduced"), "full_text_url", "sponsor")


@query("""SELECT user_id % 50 AS bill, arg_min(event_type, event_id) AS title, props AS url FROM events
WHERE NOT EXISTS (SELECT 1 FROM events s WHERE s.event_id % 4 = 0 AND s.user_id % 50 = events.user_id % 50 AND s.props = events.props) GROUP BY ALL""")
def news_feed(spark: SparkSession, d: str) -> DataFrame:
    """The first article of the feed for each bill and address that isn't stored yet."""
    rows = t(spark, d, "events").withColumn("entity_id", (F.col("user_id") % 50).cast("string"))
    nothing = F.lit(None).cast("string")
    articles = rows.select("entity_id", F.col("props").alias("url"), F.col("event_type").alias("title"), nothing.alias("domain"), nothing.alias("language"), nothing.alias("sourcecountry"), nothing.alias("seendate"), F.col("event_id").alias("position"))
    stored = rows.where("event_id % 4 = 0").select("entity_id", F.col("props").alias("url"))
    made = feeds.news(articles, stored, _run_at())
    urls = made["sources"].select(F.col("id").alias("source_id"), "url")
    return made["events"].join(urls, "source_id").select(F.col("entity_id").cast("bigint").alias("bill"), "title", "url")


@query("""SELECT count(*) AS articles, count(DISTINCT bill) AS bills, (SELECT count(DISTINCT user_id % 50) FROM events WHERE user_id % 50 = 13) AS failed
FROM (SELECT DISTINCT user_id % 50 AS bill, user_id || props AS url FROM events WHERE user_id % 50 <> 13 AND lower(event_type) LIKE '%error%')""")
def news_batch(spark: SparkSession, d: str) -> DataFrame:
    """Answers of a search for a batch of bills, those of one bill cut off in transit; articles with a keyword are counted."""
    rows = t(spark, d, "events").select((F.col("user_id") % 50).alias("bill"), "user_id", F.to_date("ts").alias("day"), F.struct(F.concat("user_id", "props").alias("url"), F.col("event_type").alias("title")).alias("a"))
    whole = rows.groupBy("bill", "user_id", "day").agg(F.to_json(F.struct(F.collect_list("a").alias("articles"))).alias("payload"))
    cut = F.when(F.col("bill") == 13, F.left("payload", F.length("payload") - 2)).otherwise(F.col("payload"))
    return feeds.batch_outcome(feeds.searches(whole.withColumn("payload", cut), "bill", ["error"]), "bill")


@query("""SELECT o_orderkey AS matter, CAST(o_orderdate AS DATE) AS introduced FROM orders ORDER BY CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END DESC NULLS LAST, o_orderkey DESC LIMIT 50""")
def newest_matters(spark: SparkSession, d: str) -> DataFrame:
    """The 50 matters that were introduced last; some have no date."""
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00:00")
    matters = t(spark, d, "orders").select(k.alias("MatterId"), F.when(k % 4 != 0, day).alias("MatterIntroDate"), F.to_date("o_orderdate").alias("introduced"))
    return feeds.newest_matters(matters, 50).select(F.col("MatterId").alias("matter"), "introduced")


@query("SELECT doc_id FROM documents WHERE regexp_matches(lower(text), 'energ|budget|the')")
def keyword_search(spark: SparkSession, d: str) -> DataFrame:
    return feeds.with_keywords(t(spark, d, "documents"), "text", ["energ", "budget", "the"]).select("doc_id")


# flags


def _requests(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    k = F.col("event_id")
    known = t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("entity_id"), F.col("c_name").alias("bill_number"))
    told = t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), (F.col("p_partkey") % 200).cast("string").alias("bill_entity_id"), F.col("p_name").alias("claim_text"))
    asked = t(spark, d, "events").select(
        F.col("user_id").cast("string").alias("bill_entity_id"), F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, (F.col("user_id") + 200).cast("string")).alias("claim_id"),
        F.when(k % 5 == 0, "no").otherwise(F.concat(F.lit("wrong "), k.cast("string"))).alias("reason_text"), F.when(k % 7 == 0, "nobody").when(k % 7 == 1, "a@b.co").alias("reporter_email"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )
    return asked, known, told


FLAGS_SQL = """
WITH asked AS (SELECT event_id, user_id, CASE event_id % 3 WHEN 0 THEN event_id WHEN 1 THEN user_id + 200 END AS claim FROM events WHERE event_id % 5 <> 0 AND event_id % 7 <> 0),
made AS (SELECT 'wrong ' || event_id AS reason_text, CAST(claim AS VARCHAR) AS claim_id, event_id FROM asked WHERE user_id IN (SELECT c_custkey FROM customer)
  AND (claim IS NULL OR EXISTS (SELECT 1 FROM part WHERE p_partkey = claim AND p_partkey % 200 = user_id)))
"""


@query(FLAGS_SQL + "SELECT reason_text, claim_id, 'pending' AS status FROM made")
def flag_created(spark: SparkSession, d: str) -> DataFrame:
    return flags.created(*_requests(spark, d)).select("reason_text", "claim_id", "status")


@query(FLAGS_SQL + "SELECT CASE WHEN event_id % 2 = 0 THEN 'dismissed' ELSE 'pending' END AS status, count(*) AS n FROM made GROUP BY ALL")
def flag_status(spark: SparkSession, d: str) -> DataFrame:
    """Of two changes of one flag the later one stays; a status that doesn't exist changes nothing."""
    made = flags.created(*_requests(spark, d))
    even = made.where(F.substring("reason_text", 7, 20).cast("bigint") % 2 == 0).select("id")
    change = lambda status, hour: even.select("id", F.lit(status).alias("new_status"), F.lit(f"2026-01-01 {hour}:00:00").cast("timestamp").alias("changed_at"))
    changes = change("dismissed", "11").union(change("reviewed", "10")).union(change("lost", "12"))
    return flags.status_changed(made, changes).groupBy("status").agg(F.count("*").alias("n"))


# claims


def _count_words():
    def make(prompt: str) -> str:
        if "ring" in prompt:
            raise ValueError("no answer")
        return str(len(prompt))

    return make


def _made(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("p_partkey")
    rows = t(spark, d, "part").select(k.cast("string").alias("entity_id"), F.col("p_brand").alias("bill_number"), F.col("p_name").alias("title"), F.when(k % 6 != 0, F.col("p_type")).alias("description"))
    todo = claims.unclaimed(rows, t(spark, d, "part").where("p_partkey % 10 = 0").select(k.cast("string").alias("bill_entity_id")))
    asked = claims.prompts(todo, {"what_it_does": "{bill_number}: {title}. {bill_text}", "key_provision": "{bill_text}"})
    return claims.generated(asked, _count_words), todo


CLAIMS_SQL = """
WITH todo AS (SELECT * FROM part WHERE p_partkey % 6 <> 0 AND p_partkey % 10 <> 0 AND p_type <> ''),
good AS (SELECT * FROM todo WHERE NOT contains(p_brand || ': ' || p_name || '. ' || p_type, 'ring') AND NOT contains(p_type, 'ring'))
"""


@query(CLAIMS_SQL + """SELECT CAST(p_partkey AS VARCHAR) AS bill, 'what_it_does' AS claim_type, CAST(length(p_brand || ': ' || p_name || '. ' || p_type) AS VARCHAR) AS claim_text, 's' || p_partkey AS source_id FROM good
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'key_provision', CAST(length(p_type) AS VARCHAR), 's' || p_partkey FROM good""")
def claims_stored(spark: SparkSession, d: str) -> DataFrame:
    made, todo = _made(spark, d)
    told, linked = claims.stored(made, todo.select("entity_id", F.concat(F.lit("s"), "entity_id").alias("source_id")), "stub")
    return told.join(linked, told["id"] == linked["claim_id"]).select(F.col("bill_entity_id").alias("bill"), "claim_type", "claim_text", "source_id")


@query(CLAIMS_SQL + "SELECT (SELECT count(*) FROM good) AS succeeded, (SELECT count(*) FROM todo) - (SELECT count(*) FROM good) AS failed")
def claims_outcome(spark: SparkSession, d: str) -> DataFrame:
    return claims.outcome(_made(spark, d)[0])


# boundaries


@query("""SELECT n_name AS scope_name, count(s_suppkey) AS bill_count, CAST(n_nationkey AS DOUBLE) AS west
FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY n_name, n_nationkey""")
def boundary_features(spark: SparkSession, d: str) -> DataFrame:
    """GeoJSON features and back, and their collection in one text."""
    k = F.col("n_nationkey").cast("double")
    square = F.array(F.array(F.array(F.array(k, F.lit(0.0)), F.array(k, F.lit(1.0)), F.array(k + 1, F.lit(1.0)), F.array(k, F.lit(0.0)))))
    places = t(spark, d, "nation").select("n_nationkey", F.lit("nation").alias("scope_type"), F.col("n_name").alias("scope_name"), F.lit("drawn").alias("geom_source"), square.alias("geom"))
    counts = t(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("bill_count"))
    whole = geo.collection(geo.features(geo.shaded(places, counts, "n_nationkey")))
    feature = "array<struct<geometry:struct<coordinates:array<array<array<array<double>>>>>,properties:struct<scope_name:string,bill_count:bigint>>>"
    read = whole.select(F.explode(F.from_json("collection", f"struct<type:string,features:{feature}>")["features"]).alias("f"))
    return read.select("f.properties.scope_name", "f.properties.bill_count", F.get(F.get(F.get(F.get("f.geometry.coordinates", F.lit(0)), F.lit(0)), F.lit(0)), F.lit(0)).cast("double").alias("west"))


# what requests and pages show


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'r' || user_id WHEN event_id % 3 = 1 THEN 'f' || user_id END AS address FROM events""")
def client_address(spark: SparkSession, d: str) -> DataFrame:
    k, who = F.col("event_id"), F.col("user_id").cast("string")
    real = F.when(k % 3 == 0, F.concat(F.lit("r"), who)).when(k % 3 == 1, "")
    forwarded = F.when(k % 3 != 2, F.concat(F.lit(" f"), who, F.lit(" , 10.0.0.1")))
    return t(spark, d, "events").select("event_id", X.client_address(real, forwarded).alias("address"))


@query("""SELECT l_orderkey, string_agg(s_name || CASE WHEN l_returnflag = 'A' THEN ' (co-sponsor)' ELSE '' END, ', ' ORDER BY s_name, l_returnflag = 'R', l_linenumber) AS line
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag IN ('R', 'A') GROUP BY l_orderkey""")
def sponsor_line(spark: SparkSession, d: str) -> DataFrame:
    names = t(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("name"))
    kind = F.when(F.col("l_returnflag") == "A", "co_sponsor").otherwise("sponsor").alias("relationship_type")
    rows = t(spark, d, "lineitem").where(F.col("l_returnflag").isin("R", "A")).join(names, "l_suppkey").select("l_orderkey", "name", kind)
    return rows.groupBy("l_orderkey").agg(X.sponsor_line(F.sort_array(F.collect_list(F.struct("name", "relationship_type")))).alias("line"))


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'plain' END AS style, o_orderkey > 0 AS has_previous, o_orderkey + 50 < 1000 AS has_next,
strftime(o_orderdate, '%Y') AS session FROM orders""")
def bill_card(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    style = X.lookup(F.col("o_orderstatus"), {"F": "done", "O": "open"}, F.lit("plain"))
    around = X.page_links(k, F.lit(1000), 50)
    return t(spark, d, "orders").select("o_orderkey", style.alias("style"), around["has_previous"].alias("has_previous"), around["has_next"].alias("has_next"), X.agenda_session(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("session"))


@query("SELECT o_orderkey, count(DISTINCT l_partkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey HAVING count(DISTINCT l_partkey) BETWEEN 2 AND 3")
def source_range(spark: SparkSession, d: str) -> DataFrame:
    counts = browse.distinct_counts(links(spark, d), "o_orderkey", "l_partkey", "n")
    return counts.where(F.col("n").between(2, 3))
