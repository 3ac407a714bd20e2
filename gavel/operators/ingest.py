"""One run of a feed against the stored tables: skip what is unchanged, merge, overlay, append."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel.functions.scalars import merged
from gavel.operators.commits import Added, Commit, Store
from gavel.operators.upsert import absent, overlay, with_unique
from gavel.schemas import TABLES

Tables = dict[str, DataFrame]
RUN_TABLES = ("entities", "bills", "sources", "relationships")


def none_stored(spark: SparkSession) -> Tables:
    """The stored tables before the first run."""
    return {name: spark.createDataFrame([], TABLES[name]).limit(0) for name in RUN_TABLES}  # a limit that the optimizer knows to be empty


def changed_ids(stored: DataFrame, incoming: DataFrame, digest: str) -> DataFrame:
    """Ids of incoming entities but for those whose stored digest, kept among the external ids, is the same and not empty."""
    known = stored.select(F.col("id").alias("__id"), F.col("external_ids")[digest].alias("__digest")).where("__digest <> ''")
    new = incoming.select("id", F.col("external_ids")[digest].alias("__new"))
    # the digest is no join key, so rows that lie by their ids stay where they are
    return new.join(known, (F.col("id") == F.col("__id")) & F.array_contains(F.array("__digest"), F.col("__new")), "left_anti").select("id")


def _entities(stored: DataFrame, incoming: DataFrame, digest: str | None) -> DataFrame:
    """Stored and incoming entities, met once: changed ones replace the stored row, whose maps and ``created_at`` they take over."""
    for column in ("attributes", "created_at"):
        if column not in incoming.columns:
            incoming = incoming.withColumn(column, F.lit(None).cast(stored.schema[column].dataType))
    before = lambda c: F.col(f"__old_{c}")
    old = stored.select("id", *[F.col(c).alias(f"__old_{c}") for c in stored.columns if c != "id"])
    both = incoming.withColumn("__new", F.lit(True)).join(old, "id", "full_outer")
    stays = F.col("__new").isNull()
    if digest is not None:
        known = before("external_ids")[digest]
        stays = stays | F.coalesce((known != "") & (known == F.col("external_ids")[digest]), F.lit(False))
    made = {c: merged(before(c), F.col(c)) for c in ("external_ids", "attributes")} | {"created_at": F.coalesce(before("created_at"), "created_at")}
    return both.select("id", *[F.when(stays, before(c)).otherwise(made.get(c, F.col(c))).alias(c) for c in stored.columns if c != "id"])


def _run(stored: Tables, made: Tables, digest: str | None) -> tuple[Tables, Tables]:
    """Entities and bills after the run, whole, and the sources and relationships that it adds."""
    everyone = _entities(stored["entities"], with_unique(made["entities"], ["id"]), digest)
    known = stored["entities"].select("id").union(made["entities"].select("id"))
    people = absent(made["people"].where("id <> ''").dropDuplicates(["id"]), known, ["id"])

    every = digest is None  # nothing can be unchanged
    ids = None if every else changed_ids(stored["entities"], made["entities"], digest)
    of_fresh = lambda name, key: made[name] if every else made[name].join(ids.withColumnRenamed("id", key), key, "left_semi")
    shaped = lambda name, rows: stored[name].limit(0).unionByName(rows.select(*[c for c in stored[name].columns if c in rows.columns]), allowMissingColumns=True)
    new_bills = shaped("bills", with_unique(of_fresh("bills", "entity_id"), ["entity_id"]))
    bills = overlay(stored["bills"], new_bills, ["entity_id"], keep_old=["created_at"])
    edges = absent(of_fresh("relationships", "to_entity_id"), stored["relationships"], ["id"], near="to_entity_id")
    sources = absent(of_fresh("sources", "entity_id"), stored["sources"], ["id"])
    return {"entities": everyone.unionByName(shaped("entities", people)), "bills": bills}, {"sources": shaped("sources", sources), "relationships": shaped("relationships", edges)}


def ingested(stored: Tables, made: Tables, digest: str | None = None) -> Tables:
    """The tables after the run: ``entities``, ``bills``, ``sources`` and ``relationships``.

    ``made`` are the tables of a feed, whose sources also name their bill. Bills that the digest says are unchanged write nothing, not even
    a source. Others replace the stored bill; external ids and attributes are merged, the new value
    winning, and ``created_at`` stays. People and relationships come only if they aren't stored yet.
    """
    whole, added = _run(stored, made, digest)
    return whole | {name: stored[name].unionByName(rows) for name, rows in added.items()}


def ingest_into(store: Store, made: Tables, digest: str | None = None) -> Commit:
    """Run a feed against a store: the four tables move in one commit, so bills never stand without their sources.

    Another writer's commit in between makes the run start from its tables. Tables of the store that a feed
    doesn't know stay as they are.
    """

    def change(tables: Tables) -> dict[str, DataFrame | Added]:
        whole, added = _run(none_stored(store.spark) | {n: df for n, df in tables.items() if n in RUN_TABLES}, made, digest)
        return whole | {name: Added(rows) for name, rows in added.items()}

    return store.update(change)
