"""Landed feed payloads to model tables.

Nothing here calls a network: payloads are landed as JSON and read with a schema. Each function
returns DataFrames of ``entities``, ``bills``, ``sources`` (with the ``entity_id`` of their bill), ``people`` and
``relationships``; ids are hashes of natural keys. Fixed values are the names that stored rows carry (source systems, types).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.functions import scalars as X
from gavel.operators.attempts import attempted
from gavel.sources.html import page_record

Tables = dict[str, DataFrame]


def landed_ok(raw: DataFrame, status: str = "status") -> DataFrame:
    """Payload rows, failing the job on one that doesn't say OK."""
    said = F.concat(F.lit("the feed answered "), F.coalesce(F.col(status), F.lit("nothing")))
    return raw.where(F.when(F.coalesce(F.col(status), F.lit("")) == "OK", True).otherwise(F.raise_error(said).cast("boolean")))


def listing_rows(payload: Column, row_schema: str) -> Column:
    """Rows of an object of objects, without the one under ``session``, as an array column."""
    entries = F.map_entries(F.from_json(payload, f"map<string,{row_schema}>"))
    return F.transform(F.filter(entries, lambda e: e["key"] != "session"), lambda e: e["value"])


def first_rows(feed: DataFrame, position: str, limit: int | None) -> DataFrame:
    """The first rows of a feed by their position; no limit means all."""
    if limit is not None and limit < 1:
        raise ValueError("limit must be positive; leave it out for all rows")
    return feed if limit is None else feed.orderBy(position).limit(limit)


def last_of(rows: DataFrame, key: str, *instead: Column) -> DataFrame:
    """One row for each key, as updates one after the other would leave it: the last by ``position`` if there is one, else by its fields.

    ``instead`` are named aggregates over all rows of the key, which take the place of the columns of their names.
    """
    if "position" in rows.columns:
        order = F.struct("position", *[F.col(c) for c in rows.columns if c not in (key, "position")])
    else:
        order = F.struct(*[F.col(c) for c in rows.columns if c != key])
    found = rows.groupBy(key).agg(F.max(order).alias("__last"), F.struct(*instead).alias("__instead") if instead else F.lit(None).alias("__instead"))
    found = found.select(key, "__last.*", "__instead")
    return found.withColumns({c: F.col("__instead")[c] for c in found.schema["__instead"].dataType.names}).drop("__instead") if instead else found.drop("__instead")


def _ids(key: Column, value: Column) -> Column:
    return F.create_map(key, value.cast("string"))


def _dealt_out(rows: DataFrame, entity_id: Column) -> DataFrame:
    """The rows with their ``entity_id``, in partitions by it: all that follows for one entity needs no further shuffle. It is
    worked out on both sides, since its 64 digits would be most of what travels."""
    spark = rows.sparkSession
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    return rows.repartition(count, entity_id).withColumn("entity_id", entity_id)


def _edges(people: DataFrame) -> DataFrame:
    """Distinct edges of (person_id, entity_id, relationship_type), each with the one source_id of its entity."""
    edges = people.select("person_id", "entity_id", "relationship_type", "source_id").distinct()
    return edges.select(
        X.natural_id(F.col("person_id"), F.col("entity_id"), F.col("relationship_type")).alias("id"),
        F.col("person_id").alias("from_entity_id"), F.col("entity_id").alias("to_entity_id"), "relationship_type", "source_id",
    )


def _people(people: DataFrame) -> DataFrame:
    """One entity a person; of several spellings the least stays."""
    one = people.groupBy("person_id").agg(F.min("person").alias("name"), F.min("place").alias("jurisdiction_name"))
    return one.select(F.col("person_id").alias("id"), F.lit("person").alias("entity_type"), "name", "jurisdiction_name")


def _source(rows: DataFrame, run_at: Column, url: Column, reference: Column, publisher: Column, kind: str, about: Column, *more: str) -> DataFrame:
    return rows.select(
        *more, F.col("source_id").alias("id"), url.alias("url"), reference.alias("document_reference"), publisher.alias("publisher"),
        F.lit(kind).alias("source_type"), run_at.alias("retrieved_at"), about.alias("metadata_json"),
    )


def state_records(listing: DataFrame, details: DataFrame) -> DataFrame:
    """The state feed: listing rows joined to their landed details on bill_id, one row for each bill, in partitions by its entity.

    A bill that the feed repeats is one bill, as its last row has it, with the sponsors of all of its rows.
    """
    listing, details = (_dealt_out(rows.where("bill_id IS NOT NULL"), X.natural_id(F.lit("legiscan_id"), F.col("bill_id"))) for rows in (listing, details))
    row = last_of(listing, "entity_id").drop("position")
    row = row.select("entity_id", *[F.col(c).alias(f"row_{c}") for c in row.columns if c not in ("entity_id", "bill_id")])
    named = F.array_distinct(F.flatten(F.collect_list("sponsors"))).alias("sponsors")
    return row.join(last_of(details, "entity_id", named).drop("position"), "entity_id")


def state_bills(listing: DataFrame, details: DataFrame, state: str, run_at: Column) -> Tables:
    """The tables of the state feed. Each is worked out on its own; to read the feed once, give kept ``state_records`` to ``state_tables``."""
    return state_tables(state_records(listing, details), state, run_at)


def state_tables(records: DataFrame, state: str, run_at: Column) -> Tables:
    """Tables of ``state_records``. Names of missing people ids are keys themselves, so that unknown people don't merge."""
    rows = records.withColumn("source_id", X.natural_id(F.col("entity_id"), run_at))
    number = F.coalesce(F.col("bill_number"), F.col("row_number"), F.lit(""))
    ids = F.map_concat(_ids(F.lit("legiscan_id"), F.col("bill_id")), _ids(F.lit("legiscan_change_hash"), F.col("row_change_hash")))
    link = X.first_filled(F.col("state_link"), F.col("row_url"), default="")
    entities = rows.select(
        F.col("entity_id").alias("id"), F.lit("bill").alias("entity_type"), X.first_filled(F.col("title"), F.col("row_title"), default="").alias("name"),
        F.lit("state").alias("jurisdiction_level"), F.lit(state).alias("jurisdiction_name"), ids.alias("external_ids"),
    )
    bills = rows.select(
        "entity_id", number.alias("bill_number"), F.coalesce(F.col("session.session_name"), F.lit("")).alias("session"), X.chamber(number).alias("chamber"),
        X.status_name(F.col("status"), F.col("row_status")).alias("status"), X.lenient_date(F.col("introduced")).alias("introduced_date"),
        X.lenient_date(X.first_filled(F.col("status_date"), F.col("row_last_action_date"))).alias("last_action_date"),
        X.first_filled(F.col("last_action"), F.col("row_last_action")).alias("last_action"),
        X.first_filled(F.col("state_link"), F.col("row_url")).alias("full_text_url"), F.lit("legiscan").alias("source_system"), "description",
        F.lit("statewide").alias("geo_scope_type"), F.array(F.lit(state)).alias("geo_scope_names"),
    )
    about = F.to_json(F.struct(F.col("bill_id").alias("legiscan_bill_id"), "change_hash"))
    sources = _source(rows, run_at, link, F.col("bill_number"), F.lit(f"{state} Legislature via LegiScan"), "legiscan_bill", about, "entity_id")
    sponsors = rows.select("entity_id", "source_id", F.explode("sponsors").alias("s"))
    name = F.coalesce(F.col("s.name"), F.lit("Unknown"))
    people = sponsors.select(
        "entity_id", "source_id", name.alias("person"), F.lit(None).cast("string").alias("place"),
        F.when(F.col("s.people_id").isNotNull(), X.natural_id(F.lit("legiscan_people_id"), F.col("s.people_id"))).otherwise(X.natural_id(F.lit("name"), name)).alias("person_id"),
        F.when(F.col("s.sponsor_type_id") == 1, "sponsor").otherwise("co_sponsor").alias("relationship_type"),
    )
    return {"entities": entities, "bills": bills, "sources": sources, "people": _people(people), "relationships": _edges(people)}


def city_records(matters: DataFrame, sponsors: DataFrame, client: str) -> DataFrame:
    """The city feed: matters with the distinct names of their (MatterId, MatterSponsorName) rows, in partitions by their entity.

    Of a matter that the feed repeats the last row.
    """
    entity_id = X.natural_id(F.lit(client), F.col("MatterId"))
    by = _dealt_out(sponsors.select("MatterId", "MatterSponsorName").where("MatterId IS NOT NULL"), entity_id)
    named = by.groupBy("entity_id").agg(F.collect_set("MatterSponsorName").alias("sponsors"))
    return last_of(_dealt_out(matters, entity_id), "entity_id").join(named, "entity_id", "left")


def city_bills(matters: DataFrame, sponsors: DataFrame, client: str, place: str, county: str, run_at: Column) -> Tables:
    """The tables of the city feed. Each is worked out on its own; to read the feed once, give kept ``city_records`` to ``city_tables``."""
    return city_tables(city_records(matters, sponsors, client), client, place, county, run_at)


def city_tables(records: DataFrame, client: str, place: str, county: str, run_at: Column) -> Tables:
    rows = records.withColumn("source_id", X.natural_id(F.col("entity_id"), run_at))
    key = F.col("MatterId").cast("string")
    url = F.concat(F.lit(f"https://{client}.legistar.com/LegislationDetail.aspx?ID="), key)
    number = F.coalesce(F.col("MatterFile"), key)
    title = X.first_filled(F.col("MatterName"), F.col("MatterTitle"), F.concat(F.lit("Matter "), key))
    introduced = X.written_date(F.col("MatterIntroDate"))
    ids = F.map_concat(_ids(F.lit("legistar_matter_id"), key), _ids(F.lit("legistar_client"), F.lit(client)))
    entities = rows.select(
        F.col("entity_id").alias("id"), F.lit("bill").alias("entity_type"), X.shortened(title, 490).alias("name"),
        F.lit("city").alias("jurisdiction_level"), F.lit(place).alias("jurisdiction_name"), ids.alias("external_ids"),
    )
    bills = rows.select(
        "entity_id", number.alias("bill_number"), X.agenda_session(F.col("MatterAgendaDate")).alias("session"), F.col("MatterBodyName").alias("chamber"),
        F.coalesce("MatterStatusName", F.lit("Introduced")).alias("status"), introduced.alias("introduced_date"),
        F.coalesce(X.written_date(F.col("MatterPassedDate")), introduced).alias("last_action_date"), F.col("MatterStatusName").alias("last_action"),
        url.alias("full_text_url"), F.lit("legistar").alias("source_system"), F.col("MatterTitle").alias("description"),
        F.lit("city").alias("geo_scope_type"), F.array(F.lit(county)).alias("geo_scope_names"),
    )
    about = F.to_json(F.struct(F.col("MatterId").alias("matter_id"), F.col("MatterTypeName").alias("matter_type")))
    sources = _source(rows, run_at, url, F.col("MatterFile"), F.lit(f"{place} City Clerk (Legistar)"), "legistar_agenda", about, "entity_id")
    people = _named_people(rows.select("entity_id", "source_id", F.explode("sponsors").alias("one")), F.col("one"), place)
    return {"entities": entities, "bills": bills, "sources": sources, "people": _people(people), "relationships": _edges(people)}


def _named_people(rows: DataFrame, name: Column, place: str) -> DataFrame:
    """Sponsors that are known by name and place alone; rows without a name are skipped."""
    return rows.where(X.filled(name).isNotNull()).select(
        "entity_id", "source_id", name.alias("person"), F.lit(place).alias("place"), X.natural_id(name, F.lit(place)).alias("person_id"),
        F.lit("sponsor").alias("relationship_type"),
    )


def page_records(pages: DataFrame) -> DataFrame:
    """The records of scraped pages (page_id, html): pages without a title are no record, and of a page that repeats the last record counts."""
    place_in_feed = [c for c in ("position",) if c in pages.columns]
    read = pages.select("page_id", *place_in_feed, page_record("html", "page_id").alias("r")).where(F.col("r.title").isNotNull())
    return last_of(read, "page_id").select("page_id", "r.*")


def scraped_bills(pages: DataFrame, base_url: str, place: str, county: str, run_at: Column) -> Tables:
    """Scraped pages (page_id, html), or the ``page_records`` of them, to bills.

    Each table is worked out on its own, so give records that are kept: pages are else parsed for every table.
    """
    records = page_records(pages) if "html" in pages.columns else pages
    rows = records.withColumn("entity_id", X.natural_id(F.lit("iqm2_legi_file_id"), F.col("page_id"))).withColumn("source_id", X.natural_id(F.col("entity_id"), run_at))
    url = F.concat(F.lit(f"{base_url}/Detail_LegiFile.aspx?ID="), F.col("page_id").cast("string"))
    acted = X.month_name_date(F.col("date_text"))
    entities = rows.select(
        F.col("entity_id").alias("id"), F.lit("bill").alias("entity_type"), X.shortened(F.col("title"), 490).alias("name"),
        F.lit("city").alias("jurisdiction_level"), F.lit(place).alias("jurisdiction_name"), _ids(F.lit("iqm2_legi_file_id"), F.col("page_id")).alias("external_ids"),
    )
    bills = rows.select(
        "entity_id", F.col("number").alias("bill_number"), X.year_session(acted).alias("session"), X.shortened(F.col("department"), 50).alias("chamber"), "status",
        F.lit(None).cast("date").alias("introduced_date"), acted.alias("last_action_date"), F.col("status").alias("last_action"), url.alias("full_text_url"),
        F.lit("iqm2").alias("source_system"), F.col("title").alias("description"), F.lit("city").alias("geo_scope_type"), F.array(F.lit(county)).alias("geo_scope_names"),
    )
    about = F.to_json(F.struct(F.col("page_id").alias("legi_file_id"), "type", "department"))
    sources = _source(rows, run_at, url, F.col("number"), F.lit(f"{place} (Granicus iQM2)"), "iqm2_legislation", about, "entity_id")
    named = rows.withColumn("one", F.explode(X.parts(F.col("sponsors"), ";")))
    people = _named_people(named, F.col("one"), place)
    return {"entities": entities, "bills": bills, "sources": sources, "people": _people(people), "relationships": _edges(people)}


def news(articles: DataFrame, stored: DataFrame, run_at: Column) -> Tables:
    """Articles (entity_id and the article's fields) that aren't stored for that bill yet.

    ``stored`` has (entity_id, url). The same article on two bills makes two sources. Of articles that
    repeat a url the first of the feed stays, by ``position`` if there is one, then by their fields.
    """
    rest = [c for c in articles.columns if c not in ("entity_id", "url", "position")]
    order = F.struct(*[c for c in ("position",) if c in articles.columns], *rest)
    first = articles.where(X.filled(F.col("url")).isNotNull()).groupBy("entity_id", "url").agg(F.min(order).alias("a"))
    usable = first.select("entity_id", "url", *[F.col("a")[c].alias(c) for c in rest])
    fresh = usable.join(stored.select("entity_id", "url"), ["entity_id", "url"], "left_anti")
    rows = fresh.withColumn("source_id", X.natural_id(F.col("entity_id"), F.col("url")))
    about = F.to_json(F.struct("language", "sourcecountry"))
    sources = _source(rows, run_at, F.col("url"), F.lit(None).cast("string"), F.col("domain"), "gdelt_article", about)
    events = rows.select(
        X.natural_id(F.lit("news_mention"), F.col("entity_id"), F.col("url")).alias("id"), "entity_id", F.lit("news_mention").alias("event_type"),
        X.seen_date(F.col("seendate"), run_at).alias("event_date"), X.prefix(F.coalesce("title", F.lit("")), 500).alias("title"), "source_id",
    )
    return {"sources": sources, "events": events}


def with_keywords(articles: DataFrame, column: str, words: Sequence[str]) -> DataFrame:
    """Articles that hold any of the words, as a part of their text, case ignored; no word means all."""
    hit = F.lit(not words)
    for word in words:
        hit = hit | F.lower(column).contains(word.lower())
    return articles.where(hit)


ARTICLES = "position bigint, url string, title string"


def searched(payload: str | None, words: Sequence[str]) -> list[dict]:
    """Articles of one answer of the search, (position, url, title) with any of the words in the title; a broken answer raises ``ValueError``."""
    answer = json.loads(payload or "")
    if not isinstance(answer, dict) or not isinstance(answer.get("articles", []), list):
        raise ValueError("the answer holds no list of articles")
    rows = [{"position": k, "url": a.get("url"), "title": a.get("title")} for k, a in enumerate(answer.get("articles", []))]
    return [r for r in rows if not words or any(w.lower() in (r["title"] or "").lower() for w in words)]


def searches(answers: DataFrame, key: str, words: Sequence[str]) -> DataFrame:
    """(key, position, url, title, error, empty) of the answers (key, payload) of a batch: one that can't be read
    gives one row with its error, and stops no other."""

    def make() -> Callable[[dict], list[dict]]:
        return lambda row: searched(row["payload"], words)

    return attempted(answers.select(key, "payload"), key, make, ARTICLES)


def batch_outcome(found: DataFrame, key: str) -> DataFrame:
    """(articles, bills, failed): distinct articles that a batch of ``searches`` wrote, the bills that have some, and the bills that failed."""
    fine, own = F.expr("error IS NULL AND NOT empty"), F.col(key)
    return found.agg(
        F.count_distinct(F.when(fine, F.struct(own, "url"))).alias("articles"), F.count_distinct(F.when(fine, own)).alias("bills"),
        F.count_distinct(F.when(F.col("error").isNotNull(), own)).alias("failed"),
    )


def newest_matters(matters: DataFrame, most: int) -> DataFrame:
    """The matters that were introduced last, those without a date at the end, ties by id; at most ``most``, which must be positive."""
    if most < 1:
        raise ValueError("most must be positive")
    return last_of(matters, "MatterId").orderBy(X.written_date(F.col("MatterIntroDate")).desc_nulls_last(), F.col("MatterId").desc()).limit(most)


def newest_successes(candidates: DataFrame, key: str, ok: str, most: int, tried: int | None = None) -> DataFrame:
    """The newest ``most`` candidates that are records, looked for downwards among the newest ``tried`` (twice as many)."""
    newest = candidates.orderBy(F.col(key).desc()).limit(tried or 2 * most)
    return newest.where(ok).orderBy(F.col(key).desc()).limit(most)


def latest_articles(landed: DataFrame, key: str, at: str, since: Column, most: int = 5) -> DataFrame:
    """The newest articles of each key since a time."""
    from pyspark.sql import Window as W

    ranked = landed.where(F.col(at) >= since).withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(F.col(at).desc(), "url")))
    return ranked.where(F.col("__n") <= most).drop("__n")
