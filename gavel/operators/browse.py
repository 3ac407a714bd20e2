"""Browse, search and detail: filters, first per group, distinct counts, paging."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.functions.scalars import like_pattern

MAX_PAGE = 100


def search(df: DataFrame, q: str | None, columns: Sequence[str]) -> DataFrame:
    """Rows of which any column holds the text, case ignored; an empty text means all rows."""
    if not q:
        return df
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.col(c).ilike(like_pattern(q))
    return df.where(hit)


def filtered(df: DataFrame, equal: Mapping[str, str | None], member: tuple[str, str | None] | None = None, q: str | None = None, search_in: Sequence[str] = ()) -> DataFrame:
    """Conjunction of the filters that are given; null and the empty text give none.

    Equalities reach the Parquet scan; ``member`` is (array column, value).
    """
    for column, value in equal.items():
        if value:
            df = df.where(F.col(column) == value)
    if member and member[1]:
        df = df.where(F.array_contains(member[0], member[1]))
    return search(df, q, search_in)


def checked_page(limit: int, offset: int, most: int = MAX_PAGE) -> None:
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be from 1 to {most}")
    if offset < 0:
        raise ValueError("offset must not be negative")


def page(df: DataFrame, latest: str, key: str, limit: int = 25, offset: int = 0) -> DataFrame:
    """One page, latest first, rows without a date last; the key breaks ties."""
    checked_page(limit, offset)
    return df.orderBy(F.col(latest).desc_nulls_last(), key).offset(offset).limit(limit)


def total(df: DataFrame) -> DataFrame:
    """Number of rows before paging."""
    return df.agg(F.count("*").alias("total"))


def first_by(df: DataFrame, key: str, order: Sequence[str], values: Mapping[str, str]) -> DataFrame:
    """One row per key: ``values`` (new name -> column) of the row that is first in ``order``.

    A minimum of structs, so that partitions reduce to a row per key before the shuffle.
    """
    fields = [*order, *[c for c in values.values() if c not in order]]
    least = df.groupBy(key).agg(F.min(F.struct(*fields)).alias("first"))
    return least.select(key, *[F.col("first")[c].alias(name) for name, c in values.items()])


def distinct_counts(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Distinct values per key, counted exactly: distinct pairs first, so that a key with a third
    of all rows is spread by its values before it meets itself."""
    return df.select(key, value).where(F.col(value).isNotNull()).distinct().groupBy(key).agg(F.count("*").alias(name))


def with_default(df: DataFrame, column: str, value: object) -> DataFrame:
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(value)))


def list_items(rows: DataFrame, key: str, links: DataFrame, source: str, sponsors: DataFrame, order: Sequence[str], sponsor_name: str) -> DataFrame:
    """Page rows with the distinct sources of their claims and their first sponsor.

    The page, at most ``MAX_PAGE`` rows, is computed once, here; its keys reach the scans of ``links``
    and ``sponsors`` as a filter.
    """
    page_rows = rows.limit(MAX_PAGE).collect()
    keys = [r[key] for r in page_rows]
    rows = rows.sparkSession.createDataFrame(page_rows, rows.schema)
    counts = distinct_counts(links.where(F.col(key).isin(keys)), key, source, "source_count")
    first = first_by(sponsors.where(F.col(key).isin(keys)), key, order, {"primary_sponsor": sponsor_name})
    return with_default(rows.join(counts, key, "left"), "source_count", 0).join(first, key, "left")


def detail(bills: DataFrame, key: str, claims: DataFrame, claim_sources: DataFrame, sources: DataFrame, sponsors: DataFrame, news: DataFrame) -> DataFrame:
    """Bills with nested claims (each with its sources), sponsors and news, in a fixed order.

    What belongs to other bills is left out before anything is gathered.

    ``claims`` has the key, claim_id, claim_type and claim_text; ``claim_sources`` claim_id and
    source_id; ``sources`` source_id and url; ``sponsors`` the key, name and relationship_type;
    ``news`` the key, event_date, title and url.
    """
    ids = bills.select(key)
    claims, sponsors, news = (df.join(ids, key, "left_semi") for df in (claims, sponsors, news))
    linked = claim_sources.join(claims.select("claim_id"), "claim_id", "left_semi").join(sources, "source_id")
    nested = linked.groupBy("claim_id").agg(F.sort_array(F.collect_list(F.struct("source_id", "url"))).alias("sources"))
    none = F.array().cast(nested.schema["sources"].dataType)
    with_sources = claims.join(nested, "claim_id", "left").withColumn("sources", F.coalesce("sources", none))

    def gathered(df: DataFrame, name: str, *columns: str | Column) -> DataFrame:
        return df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))

    parts = [
        gathered(with_sources, "claims", "claim_id", "claim_type", "claim_text", "sources"),
        gathered(sponsors, "sponsors", "name", "relationship_type"),
        gathered(news, "news", "event_date", "title", "url"),
    ]
    for part in parts:
        name = part.columns[-1]
        bills = bills.join(part, key, "left").withColumn(name, F.coalesce(name, F.array().cast(part.schema[name].dataType)))
    return bills


def first_position_last_value(df: DataFrame, group: str, key: str, position: str, value: str) -> DataFrame:
    """Duplicates of a key within a group: the first position and the last value, the largest of those at one position."""
    return df.groupBy(group, key).agg(F.min(position).alias("position"), F.max(F.struct(position, value))[value].alias("value"))


def json_records(df: DataFrame) -> DataFrame:
    """(record): each row as a JSON object."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("record"))
