"""What changed in a feed, by state that each key keeps: the digest it was last seen with.

The stream form of ``upsert.changed`` for feeds that come in batches: a row goes on if its digest isn't the
one that its key had. State begins with the stored table, so the first batch of a new stream already skips what is
unchanged; a key that isn't seen for a time is forgotten by a timer, and then counts as new.
Within a batch rows of a key are taken in the order of their version, and a row that is older than the
last one applied is late and skipped, so what goes on doesn't depend on the order of arrival.

Keys are dealt out to buckets by a hash, and the state of a bucket is one small table of its keys. So a batch costs a few
calls of state for each bucket that it touches, not for each key, and the rows of a bucket are compared as whole columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Provider of keyed state with timers and an initial state.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Buckets of keys. A stream must go on with the number that it began with.
BUCKETS = 1024
#: Columns by which a key, and the bucket that it is in, go through the state.
KEY, BUCKET = "__key", "__bucket"


class _Changes(StatefulProcessor):
    """Changes of a bucket; ``keys`` is the one column that tells its keys apart."""

    def __init__(self, keys: list[str], digest: str, version: str, columns: list[str], forget_ms: int | None):
        (self.key,) = keys
        self.digest, self.version, self.columns, self.forget_ms = digest, version, columns, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "keys binary")

    def _held(self) -> pd.DataFrame:
        """(key, digest, version, at) of the bucket's keys; ``at`` is when a key was seen last."""
        kept = self.seen.get()
        if not kept:
            return pd.DataFrame({"key": [], "digest": [], "version": np.zeros(0, np.int64), "at": np.zeros(0, np.int64)})
        with pa.ipc.open_stream(bytes(kept[0])) as held:
            return held.read_pandas()

    def _hold(self, held: pd.DataFrame) -> None:
        """Keep the bucket's keys, and wake up when the first of them is to be forgotten."""
        if len(held):
            table = pa.Table.from_pandas(held, pa.schema([("key", pa.string()), ("digest", pa.string()), ("version", pa.int64()), ("at", pa.int64())]), preserve_index=False)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            self.seen.update((sink.getvalue().to_pybytes(),))
        else:
            self.seen.clear()
        if self.forget_ms is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(int(old[0]))
            if len(held):
                self.handle.registerTimer(int(held["at"].min()) + self.forget_ms)

    def _now(self, timers) -> int:
        return 0 if self.forget_ms is None else int(timers.getCurrentProcessingTimeInMs())

    def handleInitialState(self, key, initial: pd.DataFrame, timers) -> None:  # noqa: N802
        if not len(initial):
            return  # a restarted stream hands over empty parts
        come = pd.DataFrame({"key": initial[KEY], "digest": initial["digest"].fillna(""), "version": initial["version"].astype(np.int64), "at": self._now(timers)})
        every = pd.concat([self._held(), come]).sort_values("version", kind="stable")  # a large bucket comes in parts
        self._hold(every.drop_duplicates("key", keep="last"))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        parts = [part for part in rows if len(part)]
        if not parts:
            return
        held, come = self._held(), pd.concat(parts, ignore_index=True)
        if self.key not in come.columns:  # a restarted stream loses the names of columns that are worked out
            come.columns = [*self.columns, KEY, BUCKET]
        n = len(held)
        every = pd.DataFrame({
            "key": [*held["key"], *come[self.key]], "digest": [*held["digest"], *come[self.digest].fillna("")],
            "version": np.r_[held["version"].to_numpy(np.int64), come[self.version].to_numpy(np.int64)],
            "there": np.r_[np.zeros(n, bool), come[self.digest].notna().to_numpy(bool)],  # a missing digest comes before an empty one
        })
        every["place"] = np.arange(len(every)) - n  # those held before have negative places
        every["owner"] = pd.factorize(every["key"])[0]
        last = np.full(every["owner"].max() + 1, np.iinfo(np.int64).min)
        last[every["owner"].to_numpy()[:n]] = held["version"].to_numpy(np.int64)
        at = np.zeros(len(last), np.int64)
        at[every["owner"].to_numpy()[:n]] = held["at"].to_numpy(np.int64)
        at[every["owner"].to_numpy()[n:]] = self._now(timers)
        every["come"] = every["place"] >= 0
        every = every[every["version"].to_numpy() >= last[every["owner"].to_numpy()]]  # the others are older states of their keys
        every = every.sort_values(["owner", "come", "version", "there", "digest", "place"])
        before = every.groupby("owner")["digest"].shift()
        kept = every["come"] & ((every["digest"] == "") | before.isna() | (every["digest"] != before))
        ends = every.drop_duplicates("owner", keep="last")
        self._hold(pd.DataFrame({"key": ends["key"], "digest": ends["digest"], "version": ends["version"], "at": at[ends["owner"].to_numpy()]}))
        yield come.iloc[every["place"][kept].to_numpy()][self.columns]

    def handleExpiredTimer(self, key, timers, expired) -> Iterator[pd.DataFrame]:  # noqa: N802
        held = self._held()
        self._hold(held[held["at"] + self.forget_ms > self._now(timers)])
        yield pd.DataFrame([], columns=self.columns)

    def close(self) -> None:
        pass


def _key(rows: DataFrame, keys: list[str]) -> Column:
    """A text that is equal for equal keys only."""

    def text(k: str) -> Column:
        kind = rows.schema[k].dataType
        return (F.unix_micros(k) if isinstance(kind, T.TimestampType) else F.hex(k) if isinstance(kind, T.BinaryType) else F.col(k)).cast("string")

    return F.to_json(F.array(*[text(k) for k in keys]))


def changed_in_stream(
    stream: DataFrame, keys: list[str], digest: str, version: str, stored: DataFrame | None = None, forget_after_s: int | None = None, buckets: int = BUCKETS,
) -> DataFrame:
    """Rows of the stream whose digest differs from their key's last one; a null or empty digest always does.

    ``version`` (a whole number, not null) orders the rows of a key. ``stored``, a batch table, has the keys, the
    digest and the version to begin with. The session needs ``ROCKS`` as its provider of state.
    """
    bucket = F.pmod(F.xxhash64(KEY), F.lit(buckets)).cast("int")
    initial = None
    if stored is not None:
        initial = stored.select(_key(stored, keys).alias(KEY), F.col(digest).alias("digest"), F.col(version).cast("bigint").alias("version")).withColumn(BUCKET, bucket).groupBy(BUCKET)
    # numbers travel as texts: among rows with nulls pandas would make floats of whole numbers, and nulls of NaN
    numbers = [f.name for f in stream.schema if isinstance(f.dataType, (T.IntegralType, T.FloatType, T.DoubleType)) and f.name != version]
    plain = stream.select(*[F.col(c).cast("string").alias(c) if c in numbers else F.col(c) for c in stream.columns])
    made = T.StructType([T.StructField(f.name, T.StringType() if f.name in numbers else f.dataType) for f in stream.schema])
    come = plain.withColumn(KEY, _key(stream, keys)).withColumn(BUCKET, bucket)
    processor = _Changes([KEY], digest, version, stream.columns, None if forget_after_s is None else 1000 * forget_after_s)
    time_mode = "none" if forget_after_s is None else "processingTime"
    fresh = come.groupBy(BUCKET).transformWithStateInPandas(processor, made, "append", time_mode, initial)
    return fresh.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in stream.schema])
