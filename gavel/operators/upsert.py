"""Incremental tables: change detection, overlays, deduplicated appends, cascades, gaps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def changed(incoming: DataFrame, stored: DataFrame, keys: Sequence[str], digest: str) -> DataFrame:
    """Incoming rows whose hash is not the stored one; a null or empty hash counts as changed.

    Stored rows that repeat a key don't multiply anything: any of their hashes counts as known.
    """
    known = stored.where(F.col(digest) != "").select(*keys, digest)
    return incoming.join(known, [*keys, digest], "left_anti")


def with_unique(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows, failing the job if two of them share their keys; a join on the keys reuses the partitioning."""
    said = F.concat(F.lit("repeated key: "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys]))
    counted = rows.withColumn("__n", F.count(F.lit(1)).over(W.partitionBy(*keys)))
    return counted.where(F.when(F.col("__n") == 1, True).otherwise(F.raise_error(said).cast("boolean"))).drop("__n")


def overlay(base: DataFrame, incoming: DataFrame, keys: Sequence[str], keep_old: Sequence[str] = ()) -> DataFrame:
    """Incoming rows, and the base's where no incoming row has the key.

    Columns in ``keep_old`` keep the base's value where it has one.
    """
    fresh = incoming.select(*base.columns)
    if keep_old:  # both meet once
        rest = [c for c in base.columns if c not in keys]
        old = base.select(*keys, *[F.col(c).alias(f"__old_{c}") for c in rest])
        both = fresh.withColumn("__new", F.lit(True)).join(old, list(keys), "full_outer")
        chosen = lambda c: F.coalesce(f"__old_{c}", c) if c in keep_old else F.when(F.col("__new").isNull(), F.col(f"__old_{c}")).otherwise(F.col(c))
        return both.select(*[F.col(c) if c in keys else chosen(c).alias(c) for c in base.columns])
    return fresh.unionByName(base.join(incoming.select(*keys), list(keys), "left_anti").select(*base.columns))


def new_only(batch: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row for each key of the batch that isn't stored yet; keys with a null or an empty text are skipped."""
    for k in keys:
        batch = batch.where(F.col(k).isNotNull() & (F.col(k).cast("string") != ""))
    return batch.dropDuplicates(list(keys)).join(stored.select(*keys), list(keys), "left_anti")


def absent(rows: DataFrame, stored: DataFrame, keys: Sequence[str], near: str | None = None) -> DataFrame:
    """The rows whose keys aren't stored; stored keys travel once and without the rest of their rows, as 128 bits of a hash.

    ``near`` is a column that follows from the keys and is never null: rows that lie in partitions by it stay where they are.
    """
    named = [F.xxhash64(*keys), F.xxhash64(F.lit(1), *keys)]
    known = stored.where(F.concat(*[F.col(k).cast("string") for k in keys]).isNotNull())
    if near is not None:
        known = known.select(F.col(near).alias("__near"), F.struct(*named).alias("__known"))
        # the hash is no join key: the partitions of the rows are by ``near`` alone
        return rows.join(known, (F.col(near) == F.col("__near")) & F.array_contains(F.array("__known"), F.struct(*named)), "left_anti")
    known = known.select(named[0].alias("__k1"), named[1].alias("__k2"))
    return rows.withColumns({"__k1": named[0], "__k2": named[1]}).join(known, ["__k1", "__k2"], "left_anti").drop("__k1", "__k2")


def missing(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    return rows.join(others.select(key), key, "left_anti")


def high_water_mark(values: Column, floor: int, back: int = 5) -> Column:
    """Aggregate: where to resume, a little below the largest value seen (or below ``floor``)."""
    return F.greatest(F.coalesce(F.max(values), F.lit(floor)) - back, F.lit(1))


def cascaded(tables: Mapping[str, DataFrame], edges: Sequence[tuple[str, str, str, str, str]], gone: DataFrame, root: str, root_key: str) -> dict[str, DataFrame]:
    """Tables after rows of ``root`` with the keys of ``gone`` are deleted.

    ``edges`` are (parent, parent key, child, child column, action), parents first; the action is
    ``cascade`` or ``null``.
    """
    left = dict(tables)
    lost = {root: tables[root].join(gone.select(root_key), root_key, "left_semi")}
    left[root] = tables[root].join(gone.select(root_key), root_key, "left_anti")
    for parent, parent_key, child, column, action in edges:
        if parent not in lost:
            continue
        keys = lost[parent].select(F.col(parent_key).alias(column)).distinct()
        if action == "cascade":
            dropped = left[child].join(keys, column, "left_semi")
            lost[child] = dropped if child not in lost else lost[child].unionByName(dropped)
            left[child] = left[child].join(keys, column, "left_anti")
        else:
            marked = left[child].join(keys.withColumn("__gone", F.lit(True)), column, "left")
            left[child] = marked.withColumn(column, F.when(F.col("__gone").isNull(), F.col(column))).select(*left[child].columns)
    return left


def frontier(ids: DataFrame, key: str, start: int, misses: int = 25, most: int = 3000) -> DataFrame:
    """(highest) the last id before the first run of ``misses`` absent ids, seen from ``start``.

    Gaps and islands over the ids present: the first id whose successor is more than ``misses``
    away, or that has none, ends the search. Only ids within ``most`` of the start take part, so
    the ordered pass has at most that many rows.
    """
    near = ids.select(F.col(key).cast("bigint").alias("id")).where((F.col("id") >= start) & (F.col("id") < start + most)).distinct()
    near = near.union(near.sparkSession.range(1).select(F.lit(start - 1).cast("bigint")))
    following = F.lead("id").over(W.orderBy("id"))
    ends = near.withColumn("next", following).where(F.col("next").isNull() | (F.col("next") - F.col("id") > misses))
    return ends.agg(F.greatest(F.min("id"), F.lit(start)).alias("highest"))


#: Bits of an id by which blocks are told apart, from the finest level to one of 16 blocks.
BLOCK_BITS = (20, 40, 60)


def miss_runs(ids: DataFrame, key: str) -> DataFrame:
    """(before, after, misses) of every run of absent ids between two present ones.

    The next larger id of an id is looked for in its block of 2^20 ids, then, for the last of a block, among
    the least ids of the blocks of 2^40, and so on up to 2^60, of which a long has 16. So no task sorts more
    than 2^20 rows, whatever the spread, and each level has only one row for each block of the one below.
    """
    block = lambda bits: F.shiftright("id", bits)
    levels = [ids.select(F.col(key).cast("bigint").alias("id")).distinct()]
    for bits in BLOCK_BITS:
        levels.append(levels[-1].groupBy(block(bits).alias("block")).agg(F.min("id").alias("id")).select("id"))
    top = levels.pop().select("id", block(BLOCK_BITS[-1]).alias("block"))
    lower = top.where("block > -8").select("id", F.explode(F.sequence(F.lit(-8).cast("bigint"), F.col("block") - 1)).alias("block"))
    later = lower.groupBy("block").agg(F.min("id").alias("later"))  # least id of any higher block
    for bits, rows in zip(BLOCK_BITS[::-1], levels[::-1], strict=True):
        own = rows.withColumn("block", block(bits))
        within = own.withColumn("next", F.lead("id").over(W.partitionBy("block").orderBy("id")))
        found = within.join(later, "block", "left").select("id", F.coalesce("next", "later").alias("later"))
        later = found.where("later IS NOT NULL")
        if bits != BLOCK_BITS[0]:  # these ids are the least of the blocks one level down
            later = later.select(F.shiftright("id", BLOCK_BITS[BLOCK_BITS.index(bits) - 1]).alias("block"), "later")
    missing_ids = F.col("later") - F.col("id") - 1
    return later.where(missing_ids > 0).select(F.col("id").alias("before"), F.col("later").alias("after"), missing_ids.alias("misses"))
