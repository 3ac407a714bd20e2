"""Removal of repeated stretches of words by super-k-mer partitioning.

A window is ``SIZE`` consecutive words of one text. Its minimiser is the ``GRAM`` consecutive words in it
with the least hash, the leftmost of equal ones. Consecutive windows with the same minimiser at the same
place are a super-k-mer: they travel to the minimiser's bucket as one packed string, which is far
shorter than the windows one by one. Equal windows have equal minimisers, so they meet in a bucket, where
sorting the windows finds all but the first of each, exactly, by their words.

Only super-k-mers whose minimiser occurs more than once can hold a repeated window. Occurrences are
counted first, and a bit map of the repeated ones, of ``MAP_BITS`` bits at most, keeps the others at home;
when more are repeated than the map can tell apart, all travel. Neither changes the result.

A minimiser of over ``HOT`` super-k-mers is dealt out over as many buckets as there are shuffle partitions.
In each of them all but the first of equal windows are dropped for good, and only those first ones,
one for each window and bucket, meet once more by their words. So a passage that a third of all texts
share never lies in one task.

Defined results: words are runs of anything but ``[\\x20\\x09-\\x0D]``; a null, empty or short text has no
window and loses nothing; rows with the same id and the same text count as one document and are treated
alike, other rows that share an id come one after the other in an order that their texts give; a null id
comes after all others; a very long text is worked through in pieces that overlap by a window; an empty table
gives an empty result; other columns pass through, whatever their names. The input is read three times and
must give the same rows each time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from gavel.llm.common import batch, unused, written
from gavel.llm.hashing import mixed

#: Words of a window, and of the runs of which the least is its minimiser.
SIZE = 20
GRAM = 6
#: Super-k-mers of a minimiser beyond which it is dealt out over all buckets.
HOT = 4096
#: Most bits of a map of minimisers (32 MB), and bits for each of them.
MAP_BITS = 28
BITS_PER_KEY = 16
#: Words that are hashed at a time.
PIECE = 1 << 18
#: Low bits of a sort key that hold the place in a piece.
PLACE = 20
RADIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").split()


def super_kmers(words: list[bytes], size: int = SIZE, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and minimiser of every super-k-mer of one piece of text."""
    n = len(words)
    if n < size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    single = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    grams = single[: n - gram + 1].copy()
    for k in range(1, gram):
        grams *= RADIX
        grams += single[k : n - gram + 1 + k]
    grams = mixed(grams)
    keys = (grams >> np.uint64(PLACE) << np.uint64(PLACE)) | np.arange(len(grams), dtype=np.uint64)
    least, width, want = keys, 1, size - gram + 1
    while width < want:  # least of `width` neighbours, then of twice as many, and so on
        step = min(width, want - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    place = (least & np.uint64((1 << PLACE) - 1)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    return first, np.diff(np.r_[first, len(place)]), grams[place[first]]


def pieces(words: list[bytes], size: int) -> Iterator[tuple[int, list[bytes]]]:
    """Parts of a long text, each window in one of them."""
    if len(words) <= PIECE:
        yield 0, words
        return
    for low in range(0, len(words) - size + 1, PIECE - size + 1):
        yield low, words[low : low + PIECE]


def bit_map(keys: DataFrame, n: int) -> tuple[int, np.ndarray] | None:
    """Bits of the keys' highest bits, and how many of those; none if the map would be too full to help."""
    if n > 1 << MAP_BITS:
        return None
    bits = min(MAP_BITS, max(12, (n * BITS_PER_KEY).bit_length()))
    # words of 64 bits are made by Spark, so the driver gets 64 MB of them at most
    part = keys.select(F.shiftrightunsigned("mini", 64 - bits).alias("slot")).selectExpr("slot >> 6 AS at", "shiftleft(1L, CAST(slot & 63 AS INT)) AS bit")
    found = part.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    whole = np.zeros((1 << bits) // 64, np.uint64)
    whole[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return bits, whole


def in_map(held: tuple[int, np.ndarray] | None, keys: np.ndarray) -> np.ndarray:
    if held is None:
        return np.ones(len(keys), bool)
    slot = keys >> np.uint64(64 - held[0])
    return (held[1][(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) > 0


def windows(packed: bytes, n: int, size: int) -> list[bytes]:
    words = packed.split(b" ")
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    return [packed[a : b - 1] for a, b in zip([0, *ends[: n - 1]], ends[size - 1 : size - 1 + n], strict=True)]


Sent = tuple[bytes, tuple, int]  # packed words, (id is null, id, digest, first window), number of windows


def repeated(group: list[Sent], size: int) -> tuple[list[tuple[tuple, int]], list[tuple[bytes, tuple]]]:
    """Runs of windows that also start earlier in the group, and the first ones of each window.

    A run is the order of its first window with the number of windows.
    """
    runs, held = [], {}
    for packed, order, n in sorted(group, key=lambda x: (x[0], x[1])):
        if packed not in held:
            held[packed] = (order, n)
        elif order != held[packed][0]:
            runs.append((order, n))
    found = [(w, (*order[:3], order[3] + k)) for packed, (order, n) in held.items() for k, w in enumerate(windows(packed, n, size))]
    found.sort()
    gone, stay, last = [], [], None
    for window, order in found:
        if window != last:
            stay.append((window, order))
        elif order != stay[-1][1]:
            gone.append(order)
        last = window
    gone.sort()
    for order in gone:
        if runs and runs[-1][0][:3] == order[:3] and runs[-1][0][3] + runs[-1][1] == order[3]:
            runs[-1] = (runs[-1][0], runs[-1][1] + 1)
        else:
            runs.append((order, 1))
    return runs, stay


def repeats(docs: DataFrame, size: int, gram: int, hot: int) -> DataFrame:
    """(id, digest, start, n): runs of windows that also start earlier; ``docs`` has id, digest and text."""
    spark = docs.sparkSession
    n_buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def minimisers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([pa.field("mini", pa.int64())])
        for rows in batches:
            found = [np.zeros(0, np.uint64)]
            for text in rows.column(0).cast(pa.binary()):
                found += [super_kmers(part, size, gram)[2] for _, part in pieces(words_of(text.as_py()), size)]
            yield batch(schema, np.concatenate(found).view(np.int64))

    counted = docs.select("text").mapInArrow(minimisers, "mini bigint").groupBy("mini").agg(F.count("*").alias("n"))
    counted = written(counted.where("n > 1"), "minimisers")
    sizes = counted.agg(F.count("*").alias("n"), F.count_if(F.col("n") > hot).alias("hot")).first()
    open_keys = spark.sparkContext.broadcast(bit_map(counted, sizes["n"]))
    hot_keys = spark.sparkContext.broadcast(bit_map(counted.where(F.col("n") > hot), sizes["hot"]))
    id_type = docs.schema["id"].dataType
    sent_type = T.StructType.fromDDL("mini bigint, salt int, digest bigint, start bigint, n int, packed binary").add("id", id_type)
    sent_schema, of_id = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in sent_type]), to_arrow_type(id_type)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId()
        for rows in batches:
            columns: list[list] = [[] for _ in range(6)]
            for digest, text, ident in zip(rows.column(1).to_pylist(), rows.column(2).cast(pa.binary()), rows.column(0).to_pylist(), strict=True):
                turn += 1
                for low, words in pieces(words_of(text.as_py()), size):
                    first, n, mini = super_kmers(words, size, gram)
                    take = np.flatnonzero(in_map(open_keys.value, mini)) if len(mini) else []
                    if not len(take):
                        continue
                    first, n, mini = first[take], n[take], mini[take]
                    salt = np.where(in_map(hot_keys.value, mini), turn % n_buckets, -1)
                    packed = [b" ".join(words[a:b]) for a, b in zip(first.tolist(), (first + n + size - 1).tolist(), strict=True)]
                    for column, values in zip(columns, (mini.view(np.int64).tolist(), salt.tolist(), (first + low).tolist(), n.tolist(), packed, [(digest, ident)] * len(take)), strict=True):
                        column += values
            mini, salt, start, n, packed, own = columns
            yield batch(sent_schema, mini, salt, pa.array([x[0] for x in own], pa.int64()), start, n, packed, pa.array([x[1] for x in own], of_id))

    sent = docs.select("id", "digest", "text").mapInArrow(send, sent_type)
    out_type = T.StructType.fromDDL("window binary, digest bigint, start bigint, n int").add("id", id_type)
    out_schema = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in out_type])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by minimiser and salt; the last group of a batch may go on in the next."""
        group: list[Sent] = []
        of = None

        def told(found: list[tuple]) -> pa.RecordBatch:
            return batch(
                out_schema, [w for w, _, _ in found], pa.array([o[2] for _, o, _ in found], pa.int64()),
                pa.array([o[3] for _, o, _ in found], pa.int64()), [n for _, _, n in found], pa.array([o[1] for _, o, _ in found], of_id),
            )

        def closed() -> list[tuple]:
            if len(group) < 2 and of[1] < 0:
                return []
            runs, stay = repeated(group, size)
            return [(None, order, n) for order, n in runs] + ([(w, order, 1) for w, order in stay] if of[1] >= 0 else [])

        for rows in batches:
            found: list[tuple] = []
            mini, salt = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            starts = np.flatnonzero(np.r_[True, (mini[1:] != mini[:-1]) | (salt[1:] != salt[:-1])]).tolist() if len(mini) else []
            digest, start, n, packed, ident = (rows.column(k) for k in (2, 3, 4, 5, 6))
            for low, high in zip(starts, [*starts[1:], len(mini)], strict=True):
                if (mini[low], salt[low]) != of:
                    if group:
                        found += closed()
                    group, of = [], (mini[low], salt[low])
                part = slice(low, high)
                ids, texts = ident[part].to_pylist(), packed[part].to_pylist()
                group += [(p, (i is None, i, d, s), k) for p, i, d, s, k in zip(texts, ids, digest[part].to_pylist(), start[part].to_pylist(), n[part].to_pylist(), strict=True)]
            yield told(found)
        if group:
            yield told(closed())

    told = written(sent.repartition("mini", "salt").sortWithinPartitions("mini", "salt").mapInArrow(count, out_type), "window-runs")
    columns = ["id", "digest", "start", "n"]
    sure = told.where("window IS NULL").select(columns)
    if not sizes["hot"]:
        return sure
    first = Window.partitionBy("window").orderBy(F.col("id").asc_nulls_last(), "digest", "start")
    # equal rows are one document: they have the same rank
    late = told.where("window IS NOT NULL").withColumn("rank", F.rank().over(first)).where("rank > 1").select(columns)
    return sure.union(late)


def without_repeats(docs: DataFrame, id_col: str, text_col: str, counts: tuple[str, str], size: int, gram: int, hot: int) -> DataFrame:
    """``docs`` with what stays of each text, and two more columns: words before, and words removed."""
    if not 0 < gram <= size:
        raise ValueError("a minimiser must fit in a window")
    taken = [*docs.columns, *counts]
    digest, spans, of = (unused(c, taken) for c in ("digest", "spans", "of"))
    names, text_at = [f"`{c}`" for c in docs.columns], docs.columns.index(text_col)
    rows = docs.withColumn(digest, F.xxhash64(F.col(f"`{text_col}`")))
    keyed = rows.select(F.col(f"`{id_col}`").alias("id"), F.col(digest).alias("digest"), F.col(f"`{text_col}`").alias("text"))
    found = repeats(keyed, size, gram, hot).groupBy("id", "digest").agg(F.collect_set(F.struct("start", "n")).alias("runs"))
    found = found.select(F.struct("id", "digest").alias(of), F.col("runs").alias(spans))
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(of)["id"]) & (F.col(digest) == F.col(of)["digest"])
    joined = rows.join(found, same, "left").select(*names, spans)
    out = T.StructType(list(docs.schema.fields)).add(counts[0], T.LongType()).add(counts[1], T.LongType())
    labels = [f.name for f in out]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            texts, total, gone = [], [], []
            for text, runs in zip(part.column(text_at).cast(pa.binary()), part.column(len(names)).to_pylist(), strict=True):
                words = words_of(text.as_py())
                stays = np.ones(len(words), bool)
                for run in runs or ():
                    stays[run["start"] : run["start"] + run["n"] + size - 1] = False
                total.append(len(words))
                gone.append(len(words) - int(stays.sum()))
                texts.append(b" ".join([w for w, s in zip(words, stays.tolist(), strict=True) if s] if gone[-1] else words))
            kept = pa.array(texts, pa.binary()).cast(part.schema.field(text_at).type)
            columns = [kept if k == text_at else part.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(gone, pa.int64())], names=labels)

    return joined.mapInArrow(cut, out)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = SIZE, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """The rows with the columns of the input; words of windows that start earlier are gone, the others joined by one space."""
    counts = unused("n_words", docs.columns), unused("n_removed", docs.columns)
    return without_repeats(docs, id_col, text_col, counts, size, gram, hot).drop(*counts)


def repeat_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = SIZE, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Per row the id, ``n_words``, ``n_removed`` and the ``kept`` text."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("kept"))
    found = without_repeats(rows, "id", "kept", ("n_words", "n_removed"), size, gram, hot)
    return found.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept")


REPEAT_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), wins AS (
  SELECT rid, doc_id, t.s AS s, array_to_string(w[t.s + 1 : t.s + 20], ' ') AS win
  FROM docs, LATERAL (SELECT unnest(range(greatest(0, len(w) - 19))) AS s) AS t
), late AS (
  SELECT rid, s FROM (SELECT rid, s, row_number() OVER (PARTITION BY win ORDER BY doc_id, rid, s) AS k FROM wins) WHERE k > 1
), gone AS (
  SELECT DISTINCT rid, s + t.k AS i FROM late, (SELECT unnest(range(20)) AS k) AS t
), words AS (
  SELECT rid, t.i AS i, w[t.i + 1] AS word FROM docs, LATERAL (SELECT unnest(range(len(w))) AS i) AS t
), kept AS (
  SELECT rid, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS txt
  FROM words WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.rid = words.rid AND gone.i = words.i) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(txt, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (rid)
"""
