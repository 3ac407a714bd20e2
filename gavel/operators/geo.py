"""Scopes of bills and the boundaries they shade."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel.functions.scalars import shade


def scope_counts(bills: DataFrame, names: str, name: str = "scope_name", n: str = "bill_count") -> DataFrame:
    """Bills per scope name; a name twice in one list counts twice."""
    return bills.select(F.explode(names).alias(name)).groupBy(name).agg(F.count("*").alias(n))


def shaded(boundaries: DataFrame, counts: DataFrame, key: str, n: str = "bill_count") -> DataFrame:
    """Every boundary with its count, 0 where there is none, and its shade; boundaries that share a name each stay."""
    joined = boundaries.join(counts, key, "left").withColumn(n, F.coalesce(n, F.lit(0)).cast("bigint"))
    return joined.withColumn("bucket", shade(F.col(n)))


def features(rows: DataFrame) -> DataFrame:
    """GeoJSON features as JSON text, one row each, of (scope_type, scope_name, bill_count, geom_source, geom)."""
    geometry = F.struct(F.lit("MultiPolygon").alias("type"), F.col("geom").alias("coordinates"))
    about = F.struct("scope_type", "scope_name", "bill_count", F.col("geom_source").alias("source"))
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), about.alias("properties"))
    return rows.select("scope_name", F.to_json(feature).alias("feature"))


def collection(features: DataFrame) -> DataFrame:
    """(collection): the features as one FeatureCollection, in the order of their names. One text holds them
    all, so this is for what a map shows."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("scope_name", "feature"))), lambda f: f["feature"])
    text = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(ordered, ","), F.lit("]}"))
    return features.agg(text.alias("collection"))


def replaced(existing: DataFrame, loaded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Reference rows (of no entity and no event) with a loaded key go, then the loaded rows come."""
    of_something = F.col("entity_id").isNotNull() | F.col("event_id").isNotNull()
    kept = existing.where(of_something).unionByName(
        existing.where(~of_something).join(loaded.select(*keys).distinct(), list(keys), "left_anti").select(*existing.columns)
    )
    return kept.unionByName(loaded, allowMissingColumns=True)
