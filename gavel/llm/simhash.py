"""SimHash near-duplicates with pigeonring filtering.

A fingerprint has a bit for each bit of the shingle hashes: 1 where over half of them have a 1.
Fingerprints link at ``MAX_BITS`` or fewer differing bits, and linked ones form components.

Candidates come from the pigeonring principle. Lay the 64 bits out as a ring of 8 segments of 8
bits. If two fingerprints differ in at most 3 bits, there is a segment from which every chain of
l consecutive segments differs in at most floor(3 l / 8) bits: 0, 0, 1, 1, 1, 2, 2, 3 for l = 1
to 8. So from that segment on two segments are equal, and of the next three at most one differs.
Each of the 8 starts and 3 choices of the segment left open gives a key of 32 bits; fingerprints
that share a key are candidates, the longer chains prune them, and only what is left gets the
full Hamming check. No link is lost, and at random only one pair in 2^32 shares a key.

Fingerprints that share a key are never expanded into all pairs: each group gives the edges of a
spanning forest of its links. A key with more than ``BLOCK`` fingerprints is dealt out to tasks by
pairs of blocks, which is exact and keeps every task small.

Defined results: a null, empty or wordless text has the fingerprint zero, which links like any
other; a text with fewer words than a shingle is one shingle; equal texts have equal
fingerprints and meet in one class before any comparison; rows that repeat an id are rows of
their own with the same component; a null id never names a component unless all ids of the
component are null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.llm.common import batch, small, written

SEED = 42
SHINGLE = 3
MAX_BITS = 3
#: Segments of the ring and bits of each.
SEGMENTS, WIDTH = 8, 8
#: Most fingerprints of one block of a key.
BLOCK = 4096
#: Rows of one fingerprint beyond which it is named by a broadcast join, so that its rows aren't shuffled to one task.
HOT_ROWS = 100_000
#: Groups up to this size are compared by shifting whole columns, larger ones node by node.
SMALL = 32


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of each shingle of the text, repeats included."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z alone are lowered, and the ASCII spaces split
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined, SEED)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: 1 - size].tolist()
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes; zero for none."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    whole = len(bits) // 255 * 255
    ones = bits[whole:].sum(axis=0, dtype=np.int64)
    if whole:  # sums of 255 ones fit in a byte
        ones += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(bits)).tobytes())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(id, fp): the fingerprint of each row as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = [fingerprint(shingle_hashes(x.as_py(), size)) for x in rows.column(1)]
            schema = pa.schema([pa.field("id", rows.column(0).type), pa.field("fp", pa.int64())])
            yield batch(schema, rows.column(0), pa.array(np.array(found, np.uint64).view(np.int64)))

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, fp bigint")


def chain_budgets(max_bits: int = MAX_BITS, segments: int = SEGMENTS) -> list[int]:
    """Most differing bits that the first l segments of a chain may hold, for l = 1, 2, ..."""
    return [length * max_bits // segments for length in range(1, segments + 1)]


def key_masks() -> list[int]:
    """For a ring turned to its start: the bits of the two equal segments and of two of the next three."""
    five = (1 << 5 * WIDTH) - 1
    return [five & ~(0xFF << WIDTH * left_open) for left_open in (2, 3, 4)]


def ring_keys(fp: Column) -> Column:
    """The 24 keys of a fingerprint: start and open segment in the high bits, 40 bits of the ring below."""
    keys = []
    for start in range(SEGMENTS):
        turn = WIDTH * start
        turned = fp if not turn else F.shiftrightunsigned(fp, turn).bitwiseOR(F.shiftleft(fp, 64 - turn))
        for n, mask in enumerate(key_masks()):
            keys.append(turned.bitwiseAND(F.lit(mask)).bitwiseOR(F.lit((start * 3 + n) << 5 * WIDTH)))
    return F.array(*keys)


def linked(a: np.ndarray, b: np.ndarray, start: np.ndarray | int) -> np.ndarray:
    """Which pairs pass the chains from the ring's ``start`` and then the full Hamming check."""
    turn = np.asarray(start, np.uint64) * np.uint64(WIDTH)
    differ = a ^ b
    differ = (differ >> turn) | (differ << ((np.uint64(64) - turn) & np.uint64(63)))
    passed = np.ones(differ.shape, bool)
    for length, budget in enumerate(chain_budgets(), 1):
        if length < SEGMENTS and budget == length * MAX_BITS // SEGMENTS and chain_budgets()[length] == budget:
            continue  # a longer chain has the same budget
        inside = differ & np.uint64((1 << WIDTH * length) - 1)
        passed &= np.bitwise_count(inside) <= budget
    return passed


def forest(fps: np.ndarray, start: int) -> list[tuple[int, int]]:
    """Positions of the edges of a spanning forest of the links within one group."""
    edges, rest = [], np.arange(len(fps))
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            node = queue.pop()
            near = linked(fps[rest], fps[node], start)
            if near.any():
                found = rest[near].tolist()
                edges += [(node, other) for other in found]
                queue += found
                rest = rest[~near]
    return edges


def group_edges(keys: np.ndarray, groups: np.ndarray, fps: np.ndarray) -> np.ndarray:
    """Edges (n, 2) within runs of equal ``groups``; rows come sorted by group."""
    starts = (keys >> np.int64(5 * WIDTH)) // 3
    bounds = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1], True])
    sizes = np.diff(bounds)
    found = []
    small = np.repeat(sizes <= SMALL, sizes)
    for step in range(1, min(SMALL, len(fps))):
        pair = np.flatnonzero((groups[step:] == groups[:-step]) & small[step:])
        if not len(pair):
            break
        pair = pair[linked(fps[pair], fps[pair + step], starts[pair])]
        found.append(np.stack([fps[pair], fps[pair + step]], axis=1))
    for n in np.flatnonzero(sizes > SMALL):
        part = fps[bounds[n] : bounds[n + 1]]
        if edges := forest(part, int(starts[bounds[n]])):
            found.append(part[np.array(edges)])
    return np.concatenate(found) if found else np.zeros((0, 2), np.uint64)


EDGES = pa.schema([pa.field("a", pa.int64()), pa.field("b", pa.int64())])


def _edges_of_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by key and blocks, cut at group borders."""
    held: list[np.ndarray] | None = None

    def compared(columns: list[np.ndarray], end: int) -> pa.RecordBatch:
        keys, lo, hi, fps = (c[:end] for c in columns)
        new = np.r_[True, (keys[1:] != keys[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])] if end else np.zeros(0, bool)
        edges = group_edges(keys, np.cumsum(new), fps.view(np.uint64)).view(np.int64)
        return batch(EDGES, pa.array(edges[:, 0]), pa.array(edges[:, 1]))

    for rows in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in rows.columns]
        held = columns if held is None else [np.concatenate(x) for x in zip(held, columns, strict=True)]
        keys, lo, hi, _ = held
        if not len(keys):
            continue
        last = (keys == keys[-1]) & (lo == lo[-1]) & (hi == hi[-1])
        end = int(np.argmax(last))  # the last group may go on in the next batch
        if end:
            yield compared(held, end)
            held = [c[end:] for c in held]
    if held is not None and len(held[0]):
        yield compared(held, len(held[0]))


def candidate_edges(fps: DataFrame) -> DataFrame:
    """Distinct edges (a, b), a < b, whose components are those of all links of ``fps`` (one column, fp)."""
    keyed = written(fps.select("fp", F.explode(ring_keys(F.col("fp"))).alias("key")), "ring-keys")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = (
        keyed.join(shared, "key")
        .withColumn("blocks", blocks)
        .withColumn("own", own)
        .select("key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp")
    )
    grouped = dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    found = grouped.mapInArrow(_edges_of_sorted, "a bigint, b bigint")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def are_stars(edges: DataFrame) -> bool:
    """Whether every node of distinct edges (a, b), a > b, has one such b or is a root: no path is longer than an edge."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("root").alias("root")).where("up > 1 OR up + root > 1").isEmpty()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node that has an edge, by alternating large and small stars.

    Each round links every node's larger neighbours, then its smaller ones, to the least node
    around; rounds grow with the logarithm of the longest path, and end when every node has one
    edge, to a node that has none itself. Every round is written to the shared folder, so that
    lineage stays short; minima are pre-aggregated before each shuffle.
    """
    stars = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name)
    while not are_stars(stars):
        both = stars.select(F.col("a").alias("u"), F.col("b").alias("v")).union(stars.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        both = large.join(lowest, "u")
        stars = written(
            both.select(F.col("v").alias("a"), F.col("m").alias("b"))
            .union(lowest.select(F.col("u").alias("a"), F.col("m").alias("b")))
            .where("a <> b")
            .distinct(),
            name,
        )
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(stars.select("b", "b").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """One row per input row: the id, its fingerprint (signed) and the least id of its component."""
    prints = written(fingerprints(docs, id_col, text_col, size), "fingerprints")
    classes = written(prints.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")), "classes")
    roots = components(candidate_edges(classes.select("fp")))
    placed = roots.join(classes, roots["node"] == classes["fp"]).select("node", "root", "first")
    heads = placed.groupBy("root").agg(F.min("first").alias("head"))
    moved = placed.join(heads, "root").select("node", "head")
    named = classes.join(moved, classes["fp"] == moved["node"], "left").select(
        "fp", F.coalesce("head", "first").alias("component_id"), "n"
    )
    named = written(named, "named-classes")
    hot, rest = named.where(F.col("n") > HOT_ROWS), named.where(F.col("n") <= HOT_ROWS)
    columns = [F.col("id").alias(id_col), "fp", "component_id"]
    if hot.isEmpty():
        return prints.join(rest, "fp").select(*columns)
    hot = small(hot)
    return prints.join(hot, "fp").select(*columns).union(prints.join(hot, "fp", "left_anti").join(rest, "fp").select(*columns))


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
