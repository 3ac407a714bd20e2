"""Streams that change stored tables: one commit a micro-batch, each batch applied once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel.operators.commits import Store, Tables
from gavel.operators.upsert import overlay
from gavel.streaming.batches import each_batch

Change = Callable[[Tables, DataFrame], Tables]


def stream_into(stream: DataFrame, store: Store, name: str, change: Change, checkpoint: str) -> int:
    """Apply what is there of a stream to a store, batch by batch, and stop; gives the number of commits made.

    The log of the store knows the last batch of ``name``. A batch whose commit was made, but whose end
    the checkpoint hasn't seen, comes again after a restart and then writes nothing. Another writer in between
    costs one more try.
    """
    made = 0

    def apply(batch: DataFrame, number: int) -> None:
        nonlocal made
        kept = batch.persist()  # a conflict works it out again
        try:
            made += store.update(lambda tables: change(tables, kept), (name, number)) is not None
        finally:
            kept.unpersist()

    each_batch(stream, apply, checkpoint)
    return made


def latest_by(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each key, that of the greatest ``order``; pre-aggregated before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return best.select(*[F.col(c) if c in keys else F.col("__row")[c].alias(c) for c in rows.columns])


def upsert_latest(table: str, keys: Sequence[str], order: Sequence[str]) -> Change:
    """A change that leaves in ``table`` the row of the greatest ``order`` for each key, whichever batch it came in."""

    def change(tables: Tables, batch: DataFrame) -> Tables:
        fresh = latest_by(batch, keys, order)
        if table not in tables:
            return {table: fresh}
        old = tables[table]
        # rows of keys that the batch doesn't hold pass through without being grouped
        met = old.join(fresh.select(*keys), list(keys), "left_semi")
        return {table: overlay(old, latest_by(met.unionByName(fresh), keys, order), keys)}

    return change
