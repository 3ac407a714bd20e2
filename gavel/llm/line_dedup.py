"""Line deduplication through sharded minimal perfect hashes.

A first pass digests every line (128 bits, each line once per row) and counts the rows that hold
it; counts and largest ids are pre-aggregated before the shuffle, so a line that stands in a third
of all rows costs a few rows of shuffle. Lines found often enough go, by digest, to shards; each
shard becomes a minimal perfect hash over its digests with three compact arrays beside it: the
fingerprint that tells members from strangers, the count, and the largest id. Rows then probe the
arrays with their own lines; no line is joined to a line.

While the arrays take at most ``BROADCAST_BYTES`` (known from the count before anything is
gathered), every task holds them all and the second pass is a map without shuffle. Beyond that
bound probes travel to the shards instead. Each shard is dealt out by row to as many salts as its
probes need, unique lines included, so that a hot line is spread over many tasks; a task holds one
shard's arrays and streams probes past them. Only the digests to drop travel back.

A key is the line, stripped of ``[\\x20\\x09-\\x0D]`` at both ends, with A-Z lower-cased; keys
under ``min_chars`` code points are left alone.

Defined results: a null or empty text is one empty line and comes back as an empty text; each row
counts as a document, so rows that repeat an id count each; of rows with the largest id all keep
the line; a null id is below every other; a very long text is split whole, in one task; an empty table
gives an empty result; other columns, whatever their names, pass through ``dedup_lines`` untouched.
Ids are integers.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavel.llm.common import batch, small, unused, written

MIN_DOCS, MIN_CHARS = 3, 20
STRIPPED = b" \t\n\x0b\x0c\r"
SHARD_KEYS = 500_000
ENTRY_BYTES = 24
BROADCAST_BYTES = 64 << 20
PROBES_PER_TASK = 250_000
#: Stands for a null id, below every other.
NO_ID = -(1 << 63)


def line_digest(line: bytes, min_chars: int) -> bytes | None:
    """Digest of the line's key; None if the key is too short to count."""
    key = line.strip(STRIPPED)
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode()) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key.lower())


def as_halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def mixed(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    x = a ^ (b * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level * 0xD1B54A32D192ED03 % 2**64))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@dataclass
class PerfectHash:
    """Maps n distinct digests to 0..n-1. Each level holds the digests that fell on a place of
    their own; the others go on to the next level. The rank of the place is the index."""

    places: list[int]
    words: np.ndarray
    ranks: np.ndarray

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray, room: float = 1.6) -> PerfectHash:
        places, bits = [], []
        while len(a):
            m = 64 * max(1, int(np.ceil(room * len(a) / 64)))
            at = (mixed(a, b, len(places)) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            places.append(m)
            bits.append(alone)
            left = ~alone[at]
            a, b = a[left], b[left]
            if len(places) > 200:
                raise ValueError("digests repeat")
        words = np.packbits(np.concatenate(bits), bitorder="little").view("<u8") if bits else np.zeros(0, np.uint64)
        ones = np.bitwise_count(words).astype(np.int64)
        return cls(places, words, np.cumsum(ones) - ones)

    def index(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Index of each digest; of a stranger, -1 or the index of some member."""
        found, open_, base = np.full(len(a), -1, np.int64), np.arange(len(a)), 0
        for level, m in enumerate(self.places):
            at = base + (mixed(a[open_], b[open_], level) % np.uint64(m)).astype(np.int64)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            here = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            found[open_[here]] = self.ranks[at[here] >> 6] + below[here]
            open_, base = open_[~here], base + m
            if not len(open_):
                break
        return found


@dataclass
class Shard:
    hash: PerfectHash
    fingerprints: np.ndarray
    counts: np.ndarray
    holders: np.ndarray

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray, counts: np.ndarray, holders: np.ndarray) -> Shard:
        made = PerfectHash.build(a, b)
        at = made.index(a, b)
        arrays = []
        for values, kind in ((b, np.uint64), (np.minimum(counts, 2**31 - 1), np.int32), (holders, np.int64)):
            placed = np.zeros(len(a), kind)
            placed[at] = values
            arrays.append(placed)
        return cls(made, *arrays)

    def drops(self, a: np.ndarray, b: np.ndarray, ids: np.ndarray, min_docs: int) -> np.ndarray:
        """Which probes are of a counted line that another row holds under the largest id."""
        at = self.hash.index(a, b)
        known = at >= 0
        if len(self.fingerprints):
            known &= self.fingerprints[at] == b
            return known & (self.counts[at] >= min_docs) & (self.holders[at] != ids)
        return known & False


def binaries(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def ids_of(column: pa.Array) -> np.ndarray:
    return np.array([NO_ID if x is None else x for x in column.to_pylist()], np.int64)


DIGESTS = pa.schema([pa.field("a", pa.int64()), pa.field("b", pa.int64()), pa.field("id", pa.int64())])


def line_counts(docs: DataFrame, min_docs: int, min_chars: int, total: Observation | None = None) -> DataFrame:
    """(a, b, n, holder) of every line that at least ``min_docs`` rows hold; docs has id and text.

    ``total`` observes ``n``, the lines of all rows, each counted once for a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found, owner = [], []
            for i, text in zip(ids_of(rows.column(0)).tolist(), binaries(rows.column(1)), strict=True):
                own = {line_digest(x, min_chars) for x in text.split(b"\n")} - {None}
                found += own
                owner += [i] * len(own)
            a, b = as_halves(found)
            yield batch(DIGESTS, pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), owner)

    lines = docs.mapInArrow(run, "a bigint, b bigint, id bigint")
    counted = lines.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("id").alias("holder"))
    return (counted if total is None else counted.observe(total, F.sum("n").alias("n"))).where(F.col("n") >= min_docs)


def build_shards(counted: DataFrame, n_shards: int) -> DataFrame:
    """(shard, data): each shard's hash and arrays, pickled."""

    def run(part: pa.Table) -> pa.Table:
        a, b = (part.column(x).to_numpy().view(np.uint64) for x in ("a", "b"))
        made = Shard.build(a, b, part.column("n").to_numpy(), part.column("holder").to_numpy())
        return pa.table({"shard": pa.array([part.column("shard")[0].as_py()], pa.int32()), "data": pa.array([pickle.dumps(made)], pa.binary())})

    sharded = counted.withColumn("shard", F.pmod("a", F.lit(n_shards)).cast("int"))
    return sharded.groupBy("shard").applyInArrow(run, "shard int, data binary")


Judge = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _without_lines(rows: list[bytes], min_chars: int, judge: Judge) -> tuple[list[bytes], list[int], list[int]]:
    """Texts without the lines that ``judge`` drops, with counts of lines and of dropped ones."""
    lines = [text.split(b"\n") for text in rows]
    digests, owner, place = [], [], []
    for n, own in enumerate(lines):
        for k, line in enumerate(own):
            if (digest := line_digest(line, min_chars)) is not None:
                digests.append(digest)
                owner.append(n)
                place.append(k)
    dropped: dict[int, set[int]] = {}
    if digests:
        a, b = as_halves(digests)
        for hit in np.flatnonzero(judge(a, b, np.array(owner))).tolist():
            dropped.setdefault(owner[hit], set()).add(place[hit])
    kept = list(rows)
    for n, gone in dropped.items():
        kept[n] = b"\n".join(line for k, line in enumerate(lines[n]) if k not in gone)
    return kept, [len(x) for x in lines], [len(dropped.get(n, ())) for n in range(len(rows))]


def _emit(rows: pa.RecordBatch, width: int, text_at: int, names: list[str], result: tuple[list, list, list]) -> pa.RecordBatch:
    kept, n_lines, n_dropped = result
    columns = [pa.array(kept, pa.binary()).cast(pa.string()) if k == text_at else rows.column(k) for k in range(width)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=names)


def shard_salts(counted: DataFrame, n_shards: int, total: int) -> DataFrame:
    """(shard, salts): tasks for the probes of each shard, from its counted lines and its share of the others."""
    per_shard = counted.groupBy(F.pmod("a", F.lit(n_shards)).cast("int").alias("shard")).agg(F.sum("n").alias("n"))
    every = counted.sparkSession.range(n_shards).select(F.col("id").cast("int").alias("shard")).join(per_shard, "shard", "left")
    many = counted.agg(F.sum("n")).first()[0] or 0
    probes = F.coalesce("n", F.lit(0)) + F.lit((total - many) / n_shards)
    return every.select("shard", F.greatest(F.lit(1), F.ceil(probes / PROBES_PER_TASK)).cast("int").alias("salts"))


def probe(docs: DataFrame, id_col: str, text_col: str, min_docs: int, min_chars: int, broadcast_bytes: int, counts: tuple[str, str]) -> DataFrame:
    """``docs`` with shortened texts and, as last columns named ``counts``, numbers of lines and of dropped ones."""
    spark = docs.sparkSession
    keyed = docs.select(F.col(f"`{id_col}`").cast("bigint"), F.col(f"`{text_col}`"))
    seen = Observation()
    counted = written(line_counts(keyed, min_docs, min_chars, seen), "line-counts")
    n = counted.count()
    n_shards = max(1, -(-n // SHARD_KEYS))
    shards = written(build_shards(counted, n_shards), "line-shards")
    names = [f"`{c}`" for c in docs.columns]
    width, text_at, id_at = len(names), docs.columns.index(text_col), docs.columns.index(id_col)
    out = T.StructType(list(docs.schema.fields)).add(counts[0], T.LongType()).add(counts[1], T.LongType())
    labels = [f.name for f in out]

    if n * ENTRY_BYTES <= broadcast_bytes:
        held = spark.sparkContext.broadcast({x["shard"]: bytes(x["data"]) for x in shards.collect()})

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            arrays = {k: pickle.loads(v) for k, v in held.value.items()}

            def judge(ids: np.ndarray) -> Judge:
                def drops(a: np.ndarray, b: np.ndarray, owner: np.ndarray) -> np.ndarray:
                    shard, found = a.view(np.int64) % n_shards, np.zeros(len(a), bool)
                    for k, part in arrays.items():
                        at = np.flatnonzero(shard == k)
                        found[at] = part.drops(a[at], b[at], ids[owner[at]], min_docs)
                    return found

                return drops

            for rows in batches:
                ids = ids_of(rows.column(id_at))
                yield _emit(rows, width, text_at, labels, _without_lines(binaries(rows.column(text_at)), min_chars, judge(ids)))

        return docs.select(*names).mapInArrow(whole, out)

    salts = written(shard_salts(counted, n_shards, int(seen.get["n"] or 0)), "line-salts")
    row_key = F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    per_row = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"), row_key.alias("row"))
    probe_fields = pa.schema([*DIGESTS, pa.field("row", pa.int64())])

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found, owner, keys = [], [], []
            for i, text, key in zip(ids_of(rows.column(0)).tolist(), binaries(rows.column(1)), rows.column(2).to_pylist(), strict=True):
                own = {line_digest(x, min_chars) for x in text.split(b"\n")} - {None}
                found += own
                owner += [i] * len(own)
                keys += [key] * len(own)
            a, b = as_halves(found)
            yield batch(probe_fields, pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), owner, keys)

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shard and salt, a shard's arrays before the probes."""
        held, of = None, None
        schema = pa.schema([pa.field("row", pa.int64()), pa.field("digest", pa.binary())])
        for rows in batches:
            shard, salt, kind = (rows.column(k).to_numpy() for k in range(3))
            starts = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (salt[1:] != salt[:-1]) | (kind[1:] != kind[:-1])])
            for low, high in zip(starts, np.r_[starts[1:], len(shard)], strict=True):
                if kind[low] == 0:
                    held, of = pickle.loads(rows.column(7)[int(low)].as_py()), (shard[low], salt[low])
                    continue
                if of != (shard[low], salt[low]):
                    continue  # a shard without counted lines
                part = rows.slice(low, high - low)
                a, b = (part.column(k).to_numpy().view(np.uint64) for k in (3, 4))
                gone = held.drops(a, b, part.column(5).to_numpy(), min_docs)
                digests = np.stack([a[gone], b[gone]], axis=1)
                yield batch(schema, part.column(6).filter(pa.array(gone)), [x.tobytes() for x in digests])

    sent = per_row.mapInArrow(probes, "a bigint, b bigint, id bigint, row bigint").withColumn("shard", F.pmod("a", F.lit(n_shards)).cast("int"))
    sent = sent.join(small(salts), "shard").withColumn("salt", F.pmod("row", F.col("salts")).cast("int"))
    copies = shards.join(small(salts), "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    both = copies.select("shard", "salt", F.lit(0).alias("kind"), *[none("bigint", c) for c in ("a", "b", "id", "row")], "data").union(
        sent.select("shard", "salt", F.lit(1).alias("kind"), "a", "b", "id", "row", none("binary", "data"))
    )
    gone = both.repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind").mapInArrow(answered, "row bigint, digest binary")
    row, digests = unused("row", docs.columns), unused("digests", docs.columns)
    gone = written(gone.groupBy(F.col("row").alias(row)).agg(F.collect_set("digest").alias(digests)), "line-drops")
    joined = docs.withColumn(row, row_key).join(gone, row, "left").select(*names, digests)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            lists = [set(x or ()) for x in rows.column(width).to_pylist()]

            def drops(a: np.ndarray, b: np.ndarray, owner: np.ndarray, lists: list[set[bytes]] = lists) -> np.ndarray:
                both = np.stack([a, b], axis=1)
                return np.array([both[k].tobytes() in lists[n] for k, n in enumerate(owner)], bool)

            yield _emit(rows, width, text_at, labels, _without_lines(binaries(rows.column(text_at)), min_chars, drops))

    return joined.mapInArrow(local, out)


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
    min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """The rows with the columns of the input and repeated lines gone from their texts."""
    counts = unused("n_lines", docs.columns), unused("n_dropped", docs.columns)
    return probe(docs, id_col, text_col, min_docs, min_chars, broadcast_bytes, counts).drop(*counts)


def line_report(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
    min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Per row the id, ``n_lines``, ``n_dropped`` and the ``kept`` text."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("kept"))
    found = probe(rows, "id", "kept", min_docs, min_chars, broadcast_bytes, ("n_lines", "n_dropped"))
    return found.select(F.col("id").alias(id_col), "n_lines", "n_dropped", "kept")


REPORT_SQL = r"""
WITH numbered AS (
  SELECT doc_id, text, row_number() OVER () AS rid FROM documents
), lines AS (
  SELECT rid, doc_id, t.k AS k, t.line AS line,
         translate(regexp_replace(t.line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM numbered),
       LATERAL (SELECT unnest(parts) AS line, unnest(range(len(parts))) AS k) AS t
), counted AS (
  SELECT key, max(doc_id) AS holder FROM lines WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT rid) >= 3
), marked AS (
  SELECT l.rid, l.doc_id, l.k, l.line, c.key IS NOT NULL AND c.holder <> l.doc_id AS gone
  FROM lines l LEFT JOIN counted c ON l.key = c.key
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY rid, doc_id
"""
