"""Bills that come with what is said of them: sample rows, and bills that are entered by hand.

Both make six tables that belong together: entities, bills, sources, relationships, claims and the links
between claims and sources. Ids are hashes of natural keys, so entering the same rows again adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.functions.geotags import places
from gavel.functions.scalars import natural_id
from gavel.operators import claims
from gavel.operators.commits import Added, Commit, Store, Tables
from gavel.operators.upsert import absent
from gavel.schemas import TABLES

#: Kinds of sources by the system that a bill comes from, and the kind of any other.
KIND_BY_SYSTEM, OTHER_KIND = {"legiscan": "legiscan_bill"}, "legistar_agenda"
KEYS = {"entities": ["id"], "bills": ["entity_id"], "sources": ["id"], "relationships": ["id"], "claims": ["id"], "claim_sources": ["claim_id", "source_id"]}


def _shaped(name: str, rows: DataFrame) -> DataFrame:
    """The rows with the columns of a stored table, those that they lack null."""
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES[name]])


def sample_tables(rows: DataFrame, run_at: Column, made_by: str = "seed_demo_data", mark: str = "seed_demo_id") -> Tables:
    """Tables of rows as in ``SAMPLE_BILLS``: one bill each, with its source, its sponsor and its claims by type."""
    place = F.col("jurisdiction_name")
    keyed = rows.withColumn("entity_id", natural_id(F.lit(mark), F.col("bill_number"))).withColumn("source_id", natural_id(F.col("entity_id"), F.lit("sample")))
    keyed = keyed.withColumn("person_id", natural_id(F.col("sponsor"), place))
    own = keyed.select(
        F.col("entity_id").alias("id"), F.lit("bill").alias("entity_type"), F.col("title").alias("name"), "jurisdiction_level", "jurisdiction_name",
        F.create_map(F.lit(mark), F.col("bill_number")).alias("external_ids"), run_at.alias("created_at"),
    )
    named = keyed.where(F.col("sponsor").isNotNull())
    people = named.groupBy(F.col("person_id").alias("id")).agg(F.min("sponsor").alias("name"), F.min("jurisdiction_level").alias("jurisdiction_level"), F.min(place).alias("jurisdiction_name"))
    people = people.withColumn("entity_type", F.lit("person")).withColumn("created_at", run_at)
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in KIND_BY_SYSTEM.items() for x in pair]), F.col("source_system")), F.lit(OTHER_KIND))
    sources = keyed.select(
        F.col("source_id").alias("id"), F.col("source_url").alias("url"), F.col("bill_number").alias("document_reference"),
        F.concat(place, F.lit(" via "), F.col("source_system")).alias("publisher"), kind.alias("source_type"), run_at.alias("retrieved_at"), run_at.alias("created_at"),
    )
    edges = named.select(
        natural_id(F.col("person_id"), F.col("entity_id"), F.lit("sponsor")).alias("id"), F.col("person_id").alias("from_entity_id"), F.col("entity_id").alias("to_entity_id"),
        F.lit("sponsor").alias("relationship_type"), "source_id", run_at.alias("created_at"),
    )
    told = keyed.select("entity_id", "source_id", F.explode("claims").alias("claim_type", "claim_text"))
    told = told.withColumn("id", natural_id(F.col("entity_id"), F.col("claim_type"), F.lit(made_by)))
    said = told.select("id", F.col("entity_id").alias("bill_entity_id"), "claim_type", "claim_text", F.lit(made_by).alias("generated_by"), run_at.alias("created_at"))
    bills = keyed.withColumn("full_text_url", F.col("source_url")).withColumn("created_at", run_at)
    made = {
        "entities": _shaped("entities", own).unionByName(_shaped("entities", people)), "bills": bills, "sources": sources, "relationships": edges, "claims": said,
        "claim_sources": told.select(F.col("id").alias("claim_id"), "source_id"),
    }
    return {name: _shaped(name, df) for name, df in made.items()}


def enter(store: Store, made: Tables) -> Commit:
    """Add the rows whose keys aren't stored yet, all tables in one commit."""

    def change(stored: Tables) -> dict[str, DataFrame | Added]:
        return {n: Added(df if n not in stored else absent(df, stored[n], KEYS[n])) for n, df in made.items()}

    return store.update(change)


def by_hand(
    bills: DataFrame, run_at: Column, templates: Mapping[str, str], make: Callable[[], claims.Generator], model: str,
    counties: Sequence[str], cities: Sequence[str], default_type: str = "statewide", default_names: Sequence[str] = ("FL",),
) -> Tables:
    """The way of a bill that is entered by hand: its text says where it applies, a generator what it does, and its
    source stands beside each claim. ``bills`` is like ``SAMPLE_BILLS`` without scope and claims, but with ``bill_text``.

    A bill for which any prompt fails is entered without claims.
    """
    scope = places(counties, cities, default_type, default_names)
    rows = bills.withColumn("scope", scope(F.col("bill_text"))).withColumn("geo_scope_type", F.col("scope.scope_type")).withColumn("geo_scope_names", F.col("scope.scope_names"))
    rows = rows.withColumn("entity_id", natural_id(F.lit("manual_demo"), F.col("bill_number")))
    made = claims.generated(claims.prompts(rows, templates, text="bill_text"), make)
    whole = made.groupBy("entity_id").agg(F.map_from_entries(F.collect_list(F.struct("claim_type", "text"))).alias("claims"), F.bool_or(F.col("error").isNotNull()).alias("failed"))
    none = F.create_map().cast("map<string,string>")
    told = rows.join(whole.select("entity_id", F.when(F.col("failed"), none).otherwise(F.col("claims")).alias("claims")), "entity_id", "left").drop("entity_id", "scope")
    return sample_tables(told, run_at, f"llm:{model}", "manual_demo")


def shown(tables: Tables) -> DataFrame:
    """(bill_number, card): each bill as a text of its number, title, status, places, claims and sources."""
    said = tables["claims"].groupBy(F.col("bill_entity_id").alias("entity_id")).agg(F.sort_array(F.collect_list(F.struct("claim_type", "claim_text"))).alias("said"))
    cited = tables["claims"].select(F.col("id").alias("claim_id"), F.col("bill_entity_id").alias("entity_id")).join(tables["claim_sources"], "claim_id")
    urls = tables["sources"].select(F.col("id").alias("source_id"), "url")
    cited = cited.join(urls, "source_id").groupBy("entity_id").agg(F.array_sort(F.collect_set("url")).alias("urls"))
    names = tables["entities"].select(F.col("id").alias("entity_id"), "name")
    rows = tables["bills"].join(names, "entity_id").join(said, "entity_id", "left").join(cited, "entity_id", "left")
    lines = F.transform("said", lambda c: F.concat(c["claim_type"], F.lit(": "), c["claim_text"]))
    head = F.concat("bill_number", F.lit(" - "), F.coalesce("name", F.lit("")), F.lit("\nstatus: "), F.coalesce("status", F.lit("")), F.lit(", "), F.coalesce("geo_scope_type", F.lit("")), F.lit(": "), F.array_join("geo_scope_names", ", "))
    sources = F.when(F.size("urls") > 0, F.concat(F.lit("sources: "), F.array_join("urls", ", ")))
    return rows.select("bill_number", F.concat_ws("\n", head, F.array_join(lines, "\n"), sources).alias("card"))
