"""Schemas of the stored tables and of the records that queries return.

Never inferred: every reader names one of these. String "enums" stay strings with a validation
predicate, and ids are hashes of natural keys, so that a task that runs twice writes the same row.
"""

from __future__ import annotations

from pyspark.sql import types as T

S, D, TS = T.StringType(), T.DateType(), T.TimestampType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


ENTITIES = _struct(
    ("id", S), ("entity_type", S), ("name", S), ("jurisdiction_level", S), ("jurisdiction_name", S),
    ("external_ids", T.MapType(S, S)), ("attributes", T.MapType(S, S)), ("created_at", TS),
)
BILLS = _struct(
    ("entity_id", S), ("bill_number", S), ("session", S), ("chamber", S), ("status", S), ("introduced_date", D),
    ("last_action_date", D), ("last_action", S), ("full_text_url", S), ("source_system", S), ("description", S),
    ("geo_scope_type", S), ("geo_scope_names", T.ArrayType(S)), ("created_at", TS),
)
CLAIMS = _struct(("id", S), ("bill_entity_id", S), ("claim_type", S), ("claim_text", S), ("generated_by", S), ("created_at", TS))
CLAIM_SOURCES = _struct(("claim_id", S), ("source_id", S))
SOURCES = _struct(
    ("id", S), ("url", S), ("document_reference", S), ("publisher", S), ("source_type", S), ("retrieved_at", TS),
    ("metadata_json", S), ("created_at", TS),
)
EVENTS = _struct(
    ("id", S), ("entity_id", S), ("event_type", S), ("event_date", D), ("title", S), ("description", S),
    ("attributes", T.MapType(S, S)), ("source_id", S), ("created_at", TS),
)
RELATIONSHIPS = _struct(
    ("id", S), ("from_entity_id", S), ("to_entity_id", S), ("relationship_type", S), ("attributes", T.MapType(S, S)),
    ("source_id", S), ("created_at", TS),
)
#: GeoJSON MultiPolygon coordinates: polygons of rings of points.
MULTIPOLYGON = T.ArrayType(T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType()))))
SPATIAL_CONTEXTS = _struct(
    ("id", S), ("entity_id", S), ("event_id", S), ("scope_type", S), ("scope_name", S), ("geom_source", S),
    ("geom", MULTIPOLYGON), ("created_at", TS),
)
FLAGS = _struct(("id", S), ("bill_entity_id", S), ("claim_id", S), ("reason_text", S), ("reporter_email", S), ("status", S), ("created_at", TS))

TABLES = {
    "entities": ENTITIES, "bills": BILLS, "claims": CLAIMS, "claim_sources": CLAIM_SOURCES, "sources": SOURCES,
    "events": EVENTS, "relationships": RELATIONSHIPS, "spatial_contexts": SPATIAL_CONTEXTS, "flags": FLAGS,
}

#: A file of bills for review, and of sample bills with what is said of them.
REVIEW_BILLS = _struct(("bill_number", S), ("title", S), ("bill_text", S))
SAMPLE_BILLS = _struct(
    ("bill_number", S), ("title", S), ("jurisdiction_level", S), ("jurisdiction_name", S), ("session", S), ("chamber", S), ("status", S),
    ("introduced_date", D), ("last_action_date", D), ("last_action", S), ("source_url", S), ("source_system", S),
    ("geo_scope_type", S), ("geo_scope_names", T.ArrayType(S)), ("sponsor", S), ("claims", T.MapType(S, S)),
)

#: Values that validation admits.
FLAG_STATUSES = ("pending", "reviewed", "dismissed")
CLAIM_TYPES = ("what_it_does", "who_it_affects", "key_provision")
SPONSOR_TYPES = ("sponsor", "co_sponsor")

#: Landed payloads of the feeds.
STATE_DETAIL = _struct(
    ("bill_id", T.LongType()), ("title", S), ("bill_number", S), ("state_link", S), ("change_hash", S), ("status", T.IntegerType()),
    ("session", _struct(("session_name", S))), ("introduced", S), ("status_date", S), ("last_action", S), ("description", S),
    ("sponsors", T.ArrayType(_struct(("people_id", T.LongType()), ("name", S), ("sponsor_type_id", T.IntegerType())))),
)
STATE_LISTING = _struct(
    ("bill_id", T.LongType()), ("number", S), ("title", S), ("change_hash", S), ("status", S), ("last_action", S),
    ("last_action_date", S), ("url", S),
)
CITY_MATTER = _struct(
    ("MatterId", T.LongType()), ("MatterName", S), ("MatterTitle", S), ("MatterFile", S), ("MatterTypeName", S),
    ("MatterAgendaDate", S), ("MatterIntroDate", S), ("MatterPassedDate", S), ("MatterBodyName", S), ("MatterStatusName", S),
)
ARTICLE = _struct(("url", S), ("title", S), ("domain", S), ("language", S), ("sourcecountry", S), ("seendate", S))
JURISDICTIONS = _struct(("state", S), ("counties", T.ArrayType(S)), ("cities", T.ArrayType(S)))
FEATURES = _struct(
    ("type", S),
    ("features", T.ArrayType(_struct(
        ("properties", _struct(("scope_type", S), ("scope_name", S), ("jurisdiction_name", S))),
        ("geometry", S),
    ))),
)
