"""Review flags: validation, queue, status changes and request limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.functions.scalars import natural_id
from gavel.schemas import FLAG_STATUSES

EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


def valid_reason(c: Column) -> Column:
    return F.coalesce(F.length(c).between(5, 2000), F.lit(False))


def valid_email(c: Column) -> Column:
    return c.isNull() | c.rlike(EMAIL)


def with_status(flags: DataFrame, status: str = "pending", column: str = "status") -> DataFrame:
    """Flags of one status; ``all`` means any."""
    if status not in (*FLAG_STATUSES, "all"):
        raise ValueError(f"no such status: {status}")
    return flags if status == "all" else flags.where(F.col(column) == status)


def newest(flags: DataFrame, at: str, key: str, limit: int = 50) -> DataFrame:
    if not 1 <= limit <= 200:
        raise ValueError("limit must be from 1 to 200")
    return flags.orderBy(F.col(at).desc(), key).limit(limit)


def queue(flags: DataFrame, bills: DataFrame, claims: DataFrame) -> DataFrame:
    """Flags with their bill's number (``?`` where there is none) and their claim's text (null where there is none)."""
    numbered = flags.join(bills.select(F.col("entity_id").alias("bill_entity_id"), "bill_number"), "bill_entity_id", "left")
    told = numbered.join(claims.select(F.col("id").alias("claim_id"), "claim_text"), "claim_id", "left")
    return told.withColumn("bill_number", F.coalesce("bill_number", F.lit("?")))


def belonging(claims_asked: DataFrame, claims: DataFrame, *keys: str) -> DataFrame:
    """The pairs that exist: a claim has to belong to the bill."""
    return claims_asked.join(claims.select(*keys).distinct(), list(keys), "left_semi")


def created(requests: DataFrame, bills: DataFrame, claims: DataFrame) -> DataFrame:
    """New pending flags from requests that are valid; requests have the fields of a flag and created_at."""
    valid = requests.where(valid_reason(F.col("reason_text")) & valid_email(F.col("reporter_email")))
    known = valid.join(bills.select(F.col("entity_id").alias("bill_entity_id")), "bill_entity_id", "left_semi")
    whole = known.where(F.col("claim_id").isNull())
    part = known.where(F.col("claim_id").isNotNull())
    owned = belonging(part, claims.select(F.col("id").alias("claim_id"), "bill_entity_id"), "claim_id", "bill_entity_id")
    keys = [F.col(c) for c in ("bill_entity_id", "claim_id", "reason_text", "reporter_email", "created_at")]
    return whole.unionByName(owned).withColumn("status", F.lit("pending")).withColumn("id", natural_id(*keys))


def status_changed(flags: DataFrame, changes: DataFrame) -> DataFrame:
    """Flags with the statuses of ``changes`` (id, new_status) where these are valid.

    Of several changes of one flag the last stays, by ``changed_at`` if there is one, then by name.
    """
    order = [c for c in ("changed_at", "new_status") if c in changes.columns]
    valid = changes.where(F.col("new_status").isin(*FLAG_STATUSES)).groupBy("id").agg(F.max(F.struct(*order))["new_status"].alias("new_status"))
    return flags.join(valid, "id", "left").withColumn("status", F.coalesce("new_status", "status")).drop("new_status")


def over_limit(requests: DataFrame, key: str, at: str, most: int) -> DataFrame:
    """(key, minute, n) of every minute in which a key made more than ``most`` requests."""
    minute = F.date_trunc("minute", at).alias("minute")
    return requests.groupBy(key, minute).agg(F.count("*").alias("n")).where(F.col("n") > most)
