"""All fixture queries by name, and the DuckDB SQL that returns the same rows.

Roles of the fixture tables: ``orders`` are bills (status, date of the last action), ``customer`` with
``nation`` and ``region`` their owners and jurisdictions, ``lineitem`` the links to sources (part key)
and sponsors (supplier key, return flag as relation), ``part`` sources with a list of words,
``supplier`` people, ``events`` events and flags, ``documents`` texts, ``pages`` scraped pages and
``conversations`` claims by type and turn.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel.functions import scalars as X
from gavel.functions.geotags import places
from gavel.operators import browse, flags, geo, upsert
from gavel.sources import feeds, html

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bills(spark: SparkSession, d: str) -> DataFrame:
    """Orders with their owner and jurisdiction. Customer and nation stay with the optimizer, which
    broadcasts them while they are small."""
    owner = t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment", "c_nationkey")
    place = t(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")
    return t(spark, d, "orders").join(owner, "o_custkey").join(place, "c_nationkey")


def sponsors(spark: SparkSession, d: str, *kinds: str) -> DataFrame:
    lines = t(spark, d, "lineitem").where(F.col("l_returnflag").isin(*kinds))
    names = t(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return lines.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_suppkey", "l_returnflag").join(names, "l_suppkey")


def links(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")


BILLS_SQL = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"


def _browse(spark: SparkSession, d: str, offset: int, **equal: str | None) -> DataFrame:
    rows = browse.filtered(bills(spark, d), equal, q=None, search_in=("c_name",))
    rows = browse.page(rows.select("o_orderkey", "c_name", "o_orderstatus", "n_name", "o_orderdate"), "o_orderdate", "o_orderkey", 25, offset)
    items = browse.list_items(rows, "o_orderkey", links(spark, d), "l_partkey", sponsors(spark, d, "R"), ["l_linenumber", "l_suppkey"], "s_name")
    return items.select(
        F.col("o_orderkey").alias("entity_id"), F.col("c_name").alias("name"), F.col("o_orderstatus").alias("status"),
        F.col("n_name").alias("jurisdiction_name"), F.col("o_orderdate").alias("last_action_date"), "source_count", "primary_sponsor",
    )


def _browse_sql(where: str, offset: int) -> str:
    return f"""
WITH page AS (
  SELECT o_orderkey, c_name, o_orderstatus, n_name, o_orderdate FROM {BILLS_SQL} {where}
  ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 25 OFFSET {offset}
), counts AS (
  SELECT l_orderkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_orderkey
), first AS (
  SELECT l_orderkey, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag = 'R'
  QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, s_name) = 1
)
SELECT o_orderkey AS entity_id, c_name AS name, o_orderstatus AS status, n_name AS jurisdiction_name,
       o_orderdate AS last_action_date, coalesce(n, 0) AS source_count, s_name AS primary_sponsor
FROM page LEFT JOIN counts ON o_orderkey = counts.l_orderkey LEFT JOIN first ON o_orderkey = first.l_orderkey
"""


@query(_browse_sql("WHERE o_orderstatus = 'F'", 0))
def browse_bills(spark: SparkSession, d: str) -> DataFrame:
    return _browse(spark, d, 0, o_orderstatus="F", n_name="")


@query(_browse_sql("WHERE o_orderstatus = 'F'", 25))
def browse_bills_page2(spark: SparkSession, d: str) -> DataFrame:
    return _browse(spark, d, 25, o_orderstatus="F")


@query(f"SELECT count(*) AS total FROM {BILLS_SQL} WHERE o_orderstatus = 'F'")
def browse_total(spark: SparkSession, d: str) -> DataFrame:
    return browse.total(browse.filtered(bills(spark, d), {"o_orderstatus": "F"}))


@query(_browse_sql("", 0))
def browse_no_filters(spark: SparkSession, d: str) -> DataFrame:
    return _browse(spark, d, 0, o_orderstatus=None, n_name="", c_mktsegment=None)


@query(f"SELECT o_orderkey, n_name, r_name FROM {BILLS_SQL} JOIN region ON n_regionkey = r_regionkey WHERE n_name = 'NATION_1' AND r_name = 'AMERICA'")
def filter_jurisdiction(spark: SparkSession, d: str) -> DataFrame:
    level = t(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    rows = bills(spark, d).join(level, "n_regionkey")
    return browse.filtered(rows, {"n_name": "NATION_1", "r_name": "AMERICA"}).select("o_orderkey", "n_name", "r_name")


@query("SELECT p_partkey, p_name FROM part WHERE list_contains(string_split(p_name, ' '), 'ring')")
def filter_array_membership(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "part").withColumn("names", F.split("p_name", " "))
    return browse.filtered(rows, {}, member=("names", "ring")).select("p_partkey", "p_name")


@query(r"SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_name ILIKE '%mer#00_0001%' ESCAPE '\' OR c_mktsegment ILIKE '%mer#00_0001%' ESCAPE '\'")
def search_ilike_or(spark: SparkSession, d: str) -> DataFrame:
    return browse.search(t(spark, d, "customer"), r"\mer#00_0001", ["c_name", "c_mktsegment"]).select("c_custkey", "c_name", "c_mktsegment")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_name ILIKE '%hold%' OR c_mktsegment ILIKE '%hold%'")
def search_second_column(spark: SparkSession, d: str) -> DataFrame:
    return browse.search(t(spark, d, "customer"), "hold", ["c_name", "c_mktsegment"]).select("c_custkey", "c_mktsegment")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN o_orderdate END AS last_action_date FROM orders
ORDER BY last_action_date DESC NULLS LAST, o_orderkey LIMIT 100 OFFSET 250""")
def sort_nulls_last(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 50 == 0, F.col("o_orderdate")).alias("last_action_date"))
    return browse.page(rows, "last_action_date", "o_orderkey", 100, 250)


@query("SELECT l_linenumber, count(*) AS n_links, count(DISTINCT l_partkey) AS source_count FROM lineitem WHERE l_orderkey = 7 GROUP BY l_linenumber")
def detail_claims_count(spark: SparkSession, d: str) -> DataFrame:
    one = t(spark, d, "lineitem").where("l_orderkey = 7")
    return one.groupBy("l_linenumber").agg(F.count("*").alias("n_links"), F.countDistinct("l_partkey").alias("source_count"))


@query("SELECT l_linenumber, s_name, l_returnflag FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_orderkey = 7 AND l_returnflag IN ('R', 'A')")
def detail_sponsors(spark: SparkSession, d: str) -> DataFrame:
    return sponsors(spark, d, "R", "A").where("o_orderkey = 7").select("l_linenumber", "s_name", "l_returnflag")


@query("SELECT event_id, ts, c_name FROM events JOIN customer ON user_id = c_custkey WHERE event_type = 'view'")
def detail_news(spark: SparkSession, d: str) -> DataFrame:
    owner = t(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    return t(spark, d, "events").where("event_type = 'view'").join(owner, "user_id").select("event_id", "ts", "c_name")


@query("SELECT conv_id, min(turn) AS turn, arg_min(text, turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def first_claim_by_type(spark: SparkSession, d: str) -> DataFrame:
    said = t(spark, d, "conversations").where("role = 'assistant'")
    return browse.first_by(said, "conv_id", ["turn"], {"turn": "turn", "text": "text"})


@query("SELECT o_orderkey, count(DISTINCT l_partkey) AS source_count FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def source_count_distinct(spark: SparkSession, d: str) -> DataFrame:
    counts = browse.distinct_counts(links(spark, d), "o_orderkey", "l_partkey", "source_count")
    return browse.with_default(t(spark, d, "orders").select("o_orderkey").join(counts, "o_orderkey", "left"), "source_count", 0)


@query("""SELECT l_orderkey AS o_orderkey, s_name AS primary_sponsor FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag = 'R'
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, s_name) = 1""")
def primary_sponsor(spark: SparkSession, d: str) -> DataFrame:
    return browse.first_by(sponsors(spark, d, "R"), "o_orderkey", ["l_linenumber", "l_suppkey"], {"primary_sponsor": "s_name"})


@query("SELECT name AS scope_name, count(*) AS bill_count FROM (SELECT unnest(string_split(p_name, ' ')) AS name FROM part) GROUP BY name")
def scope_counts(spark: SparkSession, d: str) -> DataFrame:
    return geo.scope_counts(t(spark, d, "part").withColumn("names", F.split("p_name", " ")), "names")


def _shaded(spark: SparkSession, d: str) -> DataFrame:
    counts = t(spark, d, "supplier").where("s_acctbal > 7500").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("bill_count"))
    return geo.shaded(t(spark, d, "nation").select("n_nationkey", "n_name"), counts, "n_nationkey")


SHADED_SQL = "SELECT n_nationkey, n_name, count(s_suppkey) AS bill_count FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > 7500 GROUP BY ALL"


@query(SHADED_SQL)
def map_left_zero(spark: SparkSession, d: str) -> DataFrame:
    return _shaded(spark, d).drop("bucket")


@query(f"SELECT n_name, bill_count, CASE WHEN bill_count = 0 THEN '0' WHEN bill_count = 1 THEN '1' WHEN bill_count <= 3 THEN '2-3' ELSE '4+' END AS bucket FROM ({SHADED_SQL})")
def choropleth_bucket(spark: SparkSession, d: str) -> DataFrame:
    return _shaded(spark, d).select("n_name", "bill_count", "bucket")


@query("SELECT event_id, ts, event_type FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 50")
def flag_queue(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.when(F.col("event_type") == "error", "pending").otherwise("reviewed")
    rows = flags.with_status(t(spark, d, "events").withColumn("status", kinds), "pending")
    return flags.newest(rows, "ts", "event_id").select("event_id", "ts", "event_type")


@query("""SELECT event_id, coalesce(c_name, '?') AS bill_number, p_name AS claim_text FROM events
LEFT JOIN customer ON user_id = c_custkey AND c_custkey % 3 <> 0 LEFT JOIN part ON event_id = p_partkey WHERE event_type = 'error'""")
def flag_queue_joined(spark: SparkSession, d: str) -> DataFrame:
    asked = t(spark, d, "events").where("event_type = 'error'").select("event_id", F.col("user_id").alias("bill_entity_id"), F.col("event_id").alias("claim_id"))
    numbers = t(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("bill_number"))
    texts = t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("claim_text"))
    return flags.queue(asked, numbers, texts).select("event_id", "bill_number", "claim_text")


@query("SELECT doc_id FROM documents WHERE length(text) BETWEEN 5 AND 2000")
def flag_validate(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").where(flags.valid_reason(F.col("text"))).select("doc_id")


@query("""SELECT k AS l_orderkey, p AS l_partkey FROM (SELECT o_orderkey AS k, (o_orderkey * 7) % 2000 AS p FROM orders)
WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = k AND l_partkey = p)""")
def claim_belongs(spark: SparkSession, d: str) -> DataFrame:
    asked = t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), ((F.col("o_orderkey") * 7) % 2000).alias("l_partkey"))
    return flags.belonging(asked, t(spark, d, "lineitem"), "l_orderkey", "l_partkey")


@query("""SELECT o_orderkey, CASE left(o_orderpriority, 1) WHEN '1' THEN 'Introduced' WHEN '2' THEN 'Engrossed' WHEN '3' THEN 'Enrolled' ELSE o_orderpriority END AS status FROM orders""")
def status_map_default(spark: SparkSession, d: str) -> DataFrame:
    code = F.left("o_orderpriority", F.lit(1)).cast("int")
    known = F.when(code <= 3, code)
    return t(spark, d, "orders").select("o_orderkey", X.status_name(known, F.col("o_orderpriority")).alias("status"))


@query("SELECT c_custkey, CASE WHEN starts_with(upper(substr(c_mktsegment, 4)), 'S') THEN 'Senate' ELSE 'House' END AS chamber FROM customer")
def chamber_case(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "customer").select("c_custkey", X.chamber(F.lower(F.substring("c_mktsegment", 4, 100))).alias("chamber"))


@query("""SELECT p_partkey, coalesce(nullif(CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 3 = 1 THEN NULL ELSE p_name END, ''),
nullif(CASE WHEN p_partkey % 2 = 0 THEN '' ELSE p_brand END, ''), 'none') AS title FROM part""")
def truthy_coalesce(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    a = F.when(k % 3 == 0, "").when(k % 3 == 2, F.col("p_name"))
    b = F.when(k % 2 == 0, "").otherwise(F.col("p_brand"))
    return t(spark, d, "part").select("p_partkey", X.first_filled(a, b, default="none").alias("title"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'absent' WHEN p_partkey % 3 = 0 THEN NULL ELSE p_name END AS value FROM part""")
def missing_key_default(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    given = F.create_map(F.lit("name"), F.when(k % 3 != 0, F.col("p_name")))
    values = F.when(k % 2 == 0, F.create_map(F.lit("other"), F.lit("x"))).otherwise(given)
    return t(spark, d, "part").withColumn("v", values).select("p_partkey", X.value_or_missing(F.col("v"), "name", F.lit("absent")).alias("value"))


BROKEN_DATE = """CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%-m-%-d')
WHEN 2 THEN strftime(o_orderdate, '%y-%m-%d') WHEN 3 THEN '' WHEN 4 THEN strftime(o_orderdate, '%Y-02-30') END"""


@query(f"""SELECT o_orderkey, CASE WHEN regexp_full_match(v, '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}') THEN cast(cast(try_strptime(v, '%Y-%m-%d') AS date) AS varchar) END AS d
FROM (SELECT o_orderkey, {BROKEN_DATE} AS v FROM orders)""")
def lenient_date(spark: SparkSession, d: str) -> DataFrame:
    k, when = F.col("o_orderkey") % 6, F.col("o_orderdate")
    given = (
        F.when(k == 0, F.date_format(when, "yyyy-MM-dd")).when(k == 1, F.date_format(when, "yyyy-M-d"))
        .when(k == 2, F.date_format(when, "yy-MM-dd")).when(k == 3, "").when(k == 4, F.date_format(when, "yyyy-'02-30'"))
    )
    return t(spark, d, "orders").select("o_orderkey", X.lenient_date(given).cast("string").alias("d"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 3 THEN cast(cast(o_orderdate AS date) AS varchar) END AS d FROM orders""")
def written_date(spark: SparkSession, d: str) -> DataFrame:
    k, when = F.col("o_orderkey") % 4, F.col("o_orderdate")
    day = F.date_format(when, "yyyy-MM-dd")
    given = F.when(k == 0, day).when(k == 1, F.concat(day, F.lit("T23:59:59Z"))).when(k == 2, F.concat(day, F.lit("T23:00:00-05:00"))).otherwise(F.concat(day, F.lit(" garbage")))
    return t(spark, d, "orders").select("o_orderkey", X.written_date(given).cast("string").alias("d"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '2026-01-31' ELSE cast(cast(ts AS date) AS varchar) END AS event_date FROM events")
def seen_date(spark: SparkSession, d: str) -> DataFrame:
    good = F.date_format(F.col("ts").cast("timestamp"), "yyyyMMdd'T'HHmmss'Z'")
    given = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("x"), good)).otherwise(good)
    return t(spark, d, "events").select("event_id", X.seen_date(given, F.lit("2026-01-31 10:00:00").cast("timestamp")).cast("string").alias("event_date"))


@query("""SELECT o_orderkey, cast(cast(try_strptime(regexp_extract(v, '(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\\s+\\d{1,2},\\s+\\d{4}'), '%b %d, %Y') AS date) AS varchar) AS d
FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'Heard on ' || strftime(o_orderdate, '%b %-d, %Y') || ' by the board'
WHEN 1 THEN strftime(o_orderdate, 'Feb 30, %Y') ELSE 'no date' END AS v FROM orders)""")
def month_name_date(spark: SparkSession, d: str) -> DataFrame:
    k, when = F.col("o_orderkey") % 3, F.col("o_orderdate")
    given = (
        F.when(k == 0, F.concat(F.lit("Heard on "), F.date_format(when, "MMM d, yyyy"), F.lit(" by the board")))
        .when(k == 1, F.date_format(when, "'Feb 30, 'yyyy")).otherwise("no date")
    )
    return t(spark, d, "orders").select("o_orderkey", X.month_name_date(given).cast("string").alias("d"))


@query("""SELECT doc_id, md5(CASE WHEN length(text) <= 490 THEN text ELSE left(text, 489) || '…' END) AS title, length(left(text, 12000)) AS prompt_chars, md5(left(text, 12000)) AS prompt
FROM documents""")
def truncate_ellipsis(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    cut = X.prefix(text, 12_000)
    return t(spark, d, "documents").select("doc_id", F.md5(X.shortened(text, 490)).alias("title"), F.length(cut).cast("bigint").alias("prompt_chars"), F.md5(cut).alias("prompt"))


@query("""SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(replace(p_name, ' ', ' ; ;'), ';'), lambda x: trim(x)), lambda x: x <> ''), '|') AS names FROM part""")
def split_trim(spark: SparkSession, d: str) -> DataFrame:
    given = F.replace(F.col("p_name"), F.lit(" "), F.lit(" ; ;"))
    return t(spark, d, "part").select("p_partkey", F.array_join(X.parts(given, ";"), "|").alias("names"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_exists(props, '$.k') AS has_k, json_exists(props, '$.z') AS has_z FROM events")
def json_get_has_key(spark: SparkSession, d: str) -> DataFrame:
    props = X.json_map(F.col("props"))
    return t(spark, d, "events").withColumn("m", props).select(
        "event_id", F.col("m")["k"].alias("k"), F.map_contains_key("m", "k").alias("has_k"), F.map_contains_key("m", "z").alias("has_z")
    )


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'new' ELSE json_extract_string(props, '$.k') END AS k, event_type AS kind FROM events""")
def json_merge_right_wins(spark: SparkSession, d: str) -> DataFrame:
    right = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("k"), F.lit("new"), F.lit("kind"), F.col("event_type"))).otherwise(F.create_map(F.lit("kind"), F.col("event_type")))
    both = X.merged(X.json_map(F.col("props")), right)
    return t(spark, d, "events").withColumn("m", both).select("event_id", F.col("m")["k"].alias("k"), F.col("m")["kind"].alias("kind"))


@query("SELECT greatest(coalesce(max(cast(json_extract_string(props, '$.k') AS bigint)), 19550) - 5, 1) AS start FROM events")
def high_water_mark(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").agg(upsert.high_water_mark(X.json_map(F.col("props"))["k"].cast("bigint"), 19_550).alias("start"))


def _digests(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Incoming and stored (o_orderkey, digest, o_orderstatus): some changed, some without a hash, some new."""
    k, own = F.col("o_orderkey"), F.md5(F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus"))
    rows = t(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    incoming = rows.where(k % 4 != 3).withColumn("digest", F.when(k % 10 == 0, F.md5(F.concat(own, F.lit("x")))).when(k % 10 == 1, "").when(k % 10 != 2, own))
    return incoming, rows.where(k % 7 != 0).withColumn("digest", F.when(k % 10 != 3, own))


CHANGED_SQL = """
WITH own AS (SELECT o_orderkey AS k, o_orderstatus, md5(o_orderkey || '|' || o_orderstatus) AS h FROM orders),
incoming AS (SELECT k, o_orderstatus, CASE WHEN k % 10 = 0 THEN md5(h || 'x') WHEN k % 10 = 1 THEN '' WHEN k % 10 <> 2 THEN h END AS digest FROM own WHERE k % 4 <> 3),
stored AS (SELECT k, o_orderstatus, CASE WHEN k % 10 <> 3 THEN h END AS digest FROM own WHERE k % 7 <> 0),
changed AS (SELECT i.* FROM incoming i LEFT JOIN stored s ON i.k = s.k WHERE NOT coalesce(i.digest = s.digest AND i.digest <> '', false))
"""


@query(CHANGED_SQL + "SELECT k AS o_orderkey, digest FROM changed")
def change_hash_skip(spark: SparkSession, d: str) -> DataFrame:
    incoming, stored = _digests(spark, d)
    return upsert.changed(incoming, stored, ["o_orderkey"], "digest").select("o_orderkey", "digest")


@query(CHANGED_SQL + """SELECT k AS o_orderkey, 'new' AS origin, digest FROM changed
UNION ALL SELECT k, 'old', digest FROM stored WHERE k NOT IN (SELECT k FROM changed)""")
def upsert_overlay(spark: SparkSession, d: str) -> DataFrame:
    incoming, stored = _digests(spark, d)
    fresh = upsert.changed(incoming, stored, ["o_orderkey"], "digest").withColumn("origin", F.lit("new"))
    return upsert.overlay(stored.withColumn("origin", F.lit("old")), fresh, ["o_orderkey"]).select("o_orderkey", "origin", "digest")


@query("""SELECT DISTINCT l_suppkey, l_orderkey, l_returnflag FROM lineitem l
WHERE NOT EXISTS (SELECT 1 FROM lineitem e WHERE e.l_orderkey % 2 = 0 AND e.l_suppkey = l.l_suppkey AND e.l_orderkey = l.l_orderkey AND e.l_returnflag = l.l_returnflag)""")
def edge_dedup(spark: SparkSession, d: str) -> DataFrame:
    edges = t(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_returnflag")
    return upsert.new_only(edges, edges.where("l_orderkey % 2 = 0"), ["l_suppkey", "l_orderkey", "l_returnflag"])


@query("""SELECT DISTINCT page_id % 5 AS bill, url FROM pages p WHERE url <> ''
AND NOT EXISTS (SELECT 1 FROM pages s WHERE s.page_id % 3 = 0 AND s.page_id % 5 = p.page_id % 5 AND s.url = p.url)""")
def url_dedup(spark: SparkSession, d: str) -> DataFrame:
    pages = t(spark, d, "pages").select((F.col("page_id") % 5).alias("bill"), "url", "page_id")
    batch = pages.union(pages).union(pages.withColumn("url", F.lit("")))
    return upsert.new_only(batch.drop("page_id"), pages.where("page_id % 3 = 0"), ["bill", "url"])


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def unclaimed(spark: SparkSession, d: str) -> DataFrame:
    return upsert.missing(t(spark, d, "orders"), links(spark, d), "o_orderkey").select("o_orderkey")


@query("""SELECT 'customer' AS name, count(*) AS n FROM customer WHERE c_custkey % 10 <> 0
UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey % 10 <> 0
UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 0)
UNION ALL SELECT 'events with an owner', count(*) FROM events WHERE user_id % 10 <> 0""")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    tables = {n: t(spark, d, n) for n in ("customer", "orders", "lineitem", "events")}
    edges = [
        ("customer", "c_custkey", "orders", "o_custkey", "cascade"), ("orders", "o_orderkey", "lineitem", "l_orderkey", "cascade"),
        ("customer", "c_custkey", "events", "user_id", "null"),
    ]
    left = upsert.cascaded(tables, edges, tables["customer"].where("c_custkey % 10 = 0"), "customer", "c_custkey")
    counted = [left[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in ("customer", "orders", "lineitem")]
    counted.append(left["events"].agg(F.count("user_id").alias("n")).select(F.lit("events with an owner").alias("name"), "n"))
    return counted[0].union(counted[1]).union(counted[2]).union(counted[3])


@query("""SELECT n_name AS scope_name, 'old' AS geom_source FROM nation WHERE n_nationkey % 5 <> 0 OR n_nationkey % 2 = 0
UNION ALL SELECT n_name, 'new' FROM nation WHERE n_nationkey % 5 = 0""")
def replace_boundaries(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    old = t(spark, d, "nation").select(F.col("n_name").alias("scope_name"), F.lit("old").alias("geom_source"), F.when(k % 2 == 0, k.cast("string")).alias("entity_id"), F.lit(None).cast("string").alias("event_id"))
    new = t(spark, d, "nation").where(k % 5 == 0).select(F.col("n_name").alias("scope_name"), F.lit("new").alias("geom_source"))
    return geo.replaced(old, new, ["scope_name"]).select("scope_name", "geom_source")


COUNTIES, CITIES = ("thor", "hener", "blested"), ("shen", "stor", "reer")


def _tag_sql(names: tuple[str, ...]) -> str:
    other = r"[^\p{L}\p{N}_]"
    found = ", ".join(rf"CASE WHEN regexp_matches(coalesce(text, ''), '(?i)(^|{other}){n}($|{other})') THEN '{n}' END" for n in names)
    return f"list_filter([{found}], lambda x: x IS NOT NULL)"


@query(f"""SELECT doc_id, CASE WHEN len(a) > 0 THEN 'county' WHEN len(b) > 0 THEN 'city' ELSE 'statewide' END AS scope_type,
CASE WHEN len(a) > 0 THEN array_to_string(a, '|') WHEN len(b) > 0 THEN array_to_string(b, '|') ELSE 'FL' END AS scope_names
FROM (SELECT doc_id, {_tag_sql(COUNTIES)} AS a, {_tag_sql(CITIES)} AS b FROM documents)""")
def geotag(spark: SparkSession, d: str) -> DataFrame:
    tag = places(COUNTIES, CITIES, "statewide", ["FL"])
    tagged = t(spark, d, "documents").select("doc_id", tag(F.col("text")).alias("s"))
    return tagged.select("doc_id", "s.scope_type", F.array_join("s.scope_names", "|").alias("scope_names"))


@query(r"SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages")
def html_title(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "pages").select("page_id", html.page_title(F.col("html")).alias("title"))


@query("""SELECT id AS before, nxt AS after, nxt - id - 1 AS misses FROM (SELECT id, lead(id) OVER (ORDER BY id) AS nxt
FROM (SELECT DISTINCT o_orderkey AS id FROM orders WHERE o_orderkey % 11 NOT IN (0, 1, 2) OR o_orderkey % 7 = 0)) WHERE nxt - id > 1""")
def gap_probe(spark: SparkSession, d: str) -> DataFrame:
    present = t(spark, d, "orders").where("o_orderkey % 11 NOT IN (0, 1, 2) OR o_orderkey % 7 = 0")
    return upsert.miss_runs(present, "o_orderkey")


@query("""WITH seen AS (SELECT DISTINCT o_orderkey AS id FROM orders WHERE o_orderkey BETWEEN 100 AND 3099 AND NOT o_orderkey % 1000 BETWEEN 900 AND 930),
gaps AS (SELECT id, lead(id) OVER (ORDER BY id) AS nxt FROM seen) SELECT min(id) AS highest FROM gaps WHERE nxt IS NULL OR nxt - id > 25""")
def frontier(spark: SparkSession, d: str) -> DataFrame:
    return upsert.frontier(t(spark, d, "orders").where("NOT o_orderkey % 1000 BETWEEN 900 AND 930"), "o_orderkey", 100)


@query("SELECT user_id, date_trunc('minute', ts) AS minute, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def rate_limit_minutes(spark: SparkSession, d: str) -> DataFrame:
    return flags.over_limit(t(spark, d, "events"), "user_id", "ts", 1).withColumn("minute", F.col("minute").cast("timestamp_ntz"))


@query("""SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 AND c_mktsegment <> 'FURNITURE' THEN
CASE lower('nation_' || c_nationkey) WHEN 'nation_2' THEN 'Nation_2' WHEN 'nation_4' THEN 'Nation_4' ELSE 'FL' END END AS jurisdiction FROM customer""")
def default_jurisdiction(spark: SparkSession, d: str) -> DataFrame:
    country = F.when(F.col("c_nationkey") % 2 == 0, "US").otherwise("CA")
    region = F.when(F.col("c_mktsegment") != "FURNITURE", "Florida").otherwise("Georgia")
    city = F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string"))
    return t(spark, d, "customer").select("c_custkey", X.default_jurisdiction(country, region, city, ("US", "Florida"), ["Nation_2", "Nation_4"], "FL").alias("jurisdiction"))


@query("SELECT o_orderstatus, count(*) AS total, cast(floor(count(*) / 3 / 50) + 1 AS bigint) AS page, greatest(cast(ceil(count(*) / 50) AS bigint), 1) AS pages FROM orders GROUP BY o_orderstatus")
def page_math(spark: SparkSession, d: str) -> DataFrame:
    counts = t(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("total"))
    return counts.select("o_orderstatus", "total", X.page_number(F.col("total") / 3, 50).alias("page"), X.page_count(F.col("total"), 50).alias("pages"))


@query("SELECT conv_id, role, min(turn) AS position, arg_max(text, turn) AS value FROM conversations GROUP BY conv_id, role")
def dedup_first_pos_last_value(spark: SparkSession, d: str) -> DataFrame:
    return browse.first_position_last_value(t(spark, d, "conversations"), "conv_id", "role", "turn", "text")


@query("""SELECT user_id, url_id AS event_id, ts FROM (SELECT user_id, event_id AS url_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n
FROM events WHERE ts >= TIMESTAMP '2024-01-10') WHERE n <= 5""")
def latest_articles(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "events").withColumn("url", F.col("event_id"))
    return feeds.latest_articles(rows, "user_id", "ts", F.lit("2024-01-10").cast("timestamp_ntz"), 5).select("user_id", "event_id", "ts")


@query("SELECT event_type, cast(date_trunc('day', ts) AS timestamp) AS start, count(*) AS n FROM events WHERE ts < (SELECT date_trunc('day', max(ts) - INTERVAL 1 HOUR) FROM events) GROUP BY ALL")
def stream_event_counts(spark: SparkSession, d: str) -> DataFrame:
    """Closed daily windows of the event stream, processed as far as it is there."""
    from gavel.streaming.batches import run_available, read_stream, window_counts
    from gavel.plans.storage import scratch

    base, source = scratch(spark, "events"), f"{d}/events.parquet"
    stream = read_stream(spark, source, t(spark, d, "events").schema)
    run_available(window_counts(stream, "ts", "event_type"), f"{base}/out", f"{base}/state")
    return spark.read.schema("start timestamp, event_type string, n bigint").parquet(f"{base}/out").withColumn("start", F.col("start").cast("timestamp_ntz"))


from gavel.plans import landings, records, runs  # noqa: E402, F401  the queries over composed payloads and stored runs join the catalogue
