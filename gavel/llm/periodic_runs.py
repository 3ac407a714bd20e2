"""Periodic runs of words by difference-cover LCE queries on a harmonic grid.

A run is a stretch of consecutive words with smallest period q, of at least ``max(LEAST, 3 q)`` words, that
no neighbouring word extends. Two copies of it, q apart, agree on at least ``max(LEAST / 3 * 2, 2 q)`` words,
so for every q some point of the grid 0, s, 2 s, ... with s = max(``GRAM``, q) lies in the agreeing part with
``GRAM`` words after it. All grids together have about n ln n points. A point is looked at further only if
the hashes of the ``GRAM`` words there and q further on are equal; then two longest common extensions,
forwards and backwards, give the whole agreeing stretch, and so the run.

The extensions (LCE) are those of a difference cover: only suffixes that begin at places whose remainder
modulo ``MODULUS`` is in ``COVER`` are sorted, by prefix doubling. Any two places reach sampled ones together
after fewer than ``MODULUS`` words; those few are compared one by one, and the rest is the least of the common
prefixes of neighbours in the sorted order between the two, by a sparse table of range minima. For the
backward ones the same is built over the words in reverse. Texts of a batch share the arrays; a mark of its
own after each keeps them apart.

A stretch that is found for several periods has the least of them: with three periods in it all are
multiples of the smallest. Words are told apart by number, never by hash alone, so runs are exact.

The operator first plants runs: with h the crc32 of the decimal id and g = h / 10, a text with h divisible by
``PLANT`` has every word i >= a replaced by word a + (i - a) % p, a = g % n, p = 1 + (n - a) / (3 + g % 8).

Defined results: words are runs of anything but ``[\\x20\\x09-\\x0D]``; a null or empty text has no words and
no run; a null id plants nothing; rows that repeat are judged one by one; a very long text is worked through
by slices of the periods; an empty table gives an empty result; the general form passes other columns
through, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from gavel.llm.common import batch, unused
from gavel.llm.hashing import mixed

#: Fewest words of a run; fewest periods in it.
LEAST, PERIODS = 24, 3
#: Words that are compared by hash at a point of the grid; a run's agreeing part holds at least twice as many.
GRAM = 8
#: All differences modulo 13 occur between these.
MODULUS, COVER = 13, (0, 1, 3, 9)
#: One in so many texts has a run planted.
PLANT = 10
#: Words of the texts that share their arrays, and points of the grid that are looked at together.
SLICE_WORDS = 1 << 17
POINTS = 1 << 18
RADIX = np.uint64(0x9E3779B97F4A7C15)


@cache
def meeting() -> np.ndarray:
    """For two remainders: the fewest words after which both places are sampled."""
    inside = np.zeros(MODULUS, bool)
    inside[list(COVER)] = True
    steps = np.arange(MODULUS)
    both = inside[(steps[:, None, None] + steps) % MODULUS] & inside[(steps[None, :, None] + steps) % MODULUS]
    return both.argmax(axis=2)


class Extensions:
    """Longest common extensions of any two places of ``ids``, whose last one is like no other."""

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        self.ids, self.padded = ids, np.r_[ids, np.full(MODULUS, -1, ids.dtype)]
        lanes = [np.arange(r, n, MODULUS) for r in COVER]
        #: place of each sampled suffix, lane by lane, and its number; a lane ends with a gap, so that none runs into the next
        sizes = np.array([len(x) + 1 for x in lanes])
        ends = np.cumsum(sizes)
        at = np.full(int(ends[-1]), -1, np.int64)
        for lane, end, size in zip(lanes, ends, sizes, strict=True):
            at[end - size : end - 1] = lane
        self.number = np.full(n + 1, -1, np.int64)
        real = np.flatnonzero(at >= 0)
        self.number[at[real]] = real
        blocks = np.full((len(at), MODULUS), -1, self.padded.dtype)
        blocks[real] = self.padded[at[real][:, None] + np.arange(MODULUS)]
        levels = [self._ranks(blocks)]
        step = 1
        while step < len(at) and len(np.unique(levels[-1][real])) < len(real):
            names = levels[-1].astype(np.int64)
            after = np.r_[names[step:], np.zeros(min(step, len(at)), np.int64)]
            after[at < 0] = 0
            levels.append(np.unique(names * (len(at) + 1) + after, return_inverse=True)[1])
            step *= 2
        order = real[np.argsort(levels[-1][real], kind="stable")]
        self.rank = np.zeros(len(at), np.int64)
        self.rank[order] = np.arange(len(order))
        common = np.zeros(len(order), np.int64)
        if len(order) > 1:
            common[1:] = self._between(order[:-1], order[1:], levels, at)
        self.table = [common]
        width = 1
        while 2 * width <= len(common):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    @staticmethod
    def _ranks(blocks: np.ndarray) -> np.ndarray:
        """Numbers of the blocks in their order."""
        order = np.lexsort(blocks.T[::-1])
        new = np.r_[False, (blocks[order[1:]] != blocks[order[:-1]]).any(axis=1)]
        out = np.zeros(len(blocks), np.int64)
        out[order] = np.cumsum(new)
        return out

    def _between(self, a: np.ndarray, b: np.ndarray, levels: list[np.ndarray], at: np.ndarray) -> np.ndarray:
        """Common prefixes of pairs of sampled suffixes, by the numbers of their doubled blocks, then word by word."""
        a, b, far = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        last = len(at) - 1
        for k in range(len(levels) - 1, -1, -1):
            same = (levels[k][a] == levels[k][b]) & (at[a] >= 0) & (at[b] >= 0) & (a != b)
            hop = 1 << k
            far[same] += hop * MODULUS
            a[same], b[same] = np.minimum(a[same] + hop, last), np.minimum(b[same] + hop, last)
        there = (at[a] >= 0) & (at[b] >= 0)
        pa_, pb = at[a[there]], at[b[there]]
        more = (self.padded[pa_[:, None] + np.arange(MODULUS)] == self.padded[pb[:, None] + np.arange(MODULUS)]).cumprod(axis=1).sum(axis=1)
        far[there] += more
        return far

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words agree from ``i`` and ``j`` on, i < j."""
        n = len(self.ids)
        wait = meeting()[i % MODULUS, j % MODULUS]
        found, live = np.zeros(len(i), np.int64), np.flatnonzero(j < n)
        for k in range(MODULUS):
            live = live[wait[live] > k]
            if not len(live):
                break
            live = live[self.padded[i[live] + k] == self.padded[j[live] + k]]
            found[live] += 1
        rest = np.flatnonzero((found == wait) & (j + wait < n))
        a, b = self.rank[self.number[i[rest] + wait[rest]]], self.rank[self.number[j[rest] + wait[rest]]]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((high - low).astype(float))[1] - 1
        for k in np.unique(level):
            of = np.flatnonzero(level == k)
            table = self.table[k]
            found[rest[of]] += np.minimum(table[low[of]], table[high[of] - (1 << int(k))])
        return found


def planted(words: list, h: int | None) -> list:
    """The words with the run that the id's ``h`` plants."""
    n = len(words)
    if h is None or h % PLANT or not n:
        return words
    g = h // PLANT
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * (-(-(n - a) // p)))[: n - a]


def grid(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Text, place and period of all grid points of texts of the given sizes, some at a time."""
    periods = np.where(sizes >= LEAST, sizes // PERIODS, 0)
    text = np.repeat(np.arange(len(sizes)), periods)
    q = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    step = np.maximum(GRAM, q)
    # the last GRAM words that agree with those q further on begin at size - q - GRAM
    points = np.maximum(0, (sizes[text] - q - GRAM) // step + 1)
    ends = np.cumsum(points)
    first = 0
    while first < len(points):
        base = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + POINTS, "right")))
        part = slice(first, last)
        n = points[part]
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(text[part], n), place * np.repeat(step[part], n), np.repeat(q[part], n)
        first = last


def runs_of(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each text of word numbers (from 0), by start and period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    sizes = np.array([len(x) for x in texts], np.int64)
    if not len(texts) or sizes.max() < LEAST:
        return out
    heads = np.cumsum(sizes + 1) - sizes - 1
    marks = int(max(x.max() for x in texts if len(x))) + 1
    ids = np.empty(int(sizes.sum()) + len(texts), np.int64)
    for k, x in enumerate(texts):
        ids[heads[k] : heads[k] + len(x)] = x
        ids[heads[k] + len(x)] = marks + k
    grams = np.zeros(len(ids), np.uint64)
    whole = len(ids) - GRAM + 1
    single = mixed(ids.astype(np.uint64) + np.uint64(1))
    for k in range(GRAM):
        grams[:whole] = grams[:whole] * RADIX + single[k : k + whole]
    hit = np.zeros(len(texts), bool)
    for text, place, q in grid(sizes):
        at = heads[text] + place
        hit[text[grams[at] == grams[at + q]]] = True
    mine = np.flatnonzero(hit)
    if not len(mine):
        return out
    # only texts with a hit get suffixes; their grids are walked once more
    own = np.concatenate([np.arange(heads[k], heads[k] + sizes[k] + 1) for k in mine])
    ids, grams, sizes = ids[own], grams[own], sizes[mine]
    heads = np.cumsum(sizes + 1) - sizes - 1
    forward, backward, last = Extensions(ids), Extensions(np.r_[ids[:-1][::-1], ids[-1]]), len(ids) - 2
    found: list[np.ndarray] = []
    for text, place, q in grid(sizes):
        at = heads[text] + place
        same = grams[at] == grams[at + q]
        i, period, k = at[same], q[same], text[same]
        after = forward(i, i + period)
        # backwards from i - 1 and i + q - 1: in reverse the later place comes first
        before = np.zeros(len(i), np.int64)
        inner = np.flatnonzero(i > 0)
        before[inner] = backward(last - (i[inner] + period[inner] - 1), last - (i[inner] - 1))
        length = before + after + period
        good = length >= np.maximum(LEAST, PERIODS * period)
        found.append(np.unique(np.stack([mine[k], i - before - heads[k], length, period], axis=1)[good], axis=0))
    least: dict[tuple[int, int, int], int] = {}
    for k, start, length, period in np.unique(np.concatenate(found), axis=0).tolist():
        least.setdefault((k, start, length), period)
    for (k, start, length), period in least.items():
        out[k].append((start, length, period))
    for found_runs in out:
        found_runs.sort(key=lambda r: (r[0], r[2]))
    return out


def best_run(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """That of the greatest length by period, exactly; of equal ones the first, then that of the least period."""
    best = None
    for start, length, period in runs:
        if best is None or length * best[2] > best[1] * period:
            best = (start, length, period)
    return best


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run repeats."""
    if not runs:
        return words
    stays = np.ones(len(words), bool)
    for start, length, period in runs:
        stays[start + period : start + length] = False
    return [w for w, s in zip(words, stays.tolist(), strict=True) if s]


def _slices(rows: pa.RecordBatch, text_at: int, h_at: int) -> Iterator[tuple[int, list[list[bytes]], list[np.ndarray]]]:
    """Number of the first row, and the planted words and word numbers of some rows at a time."""
    first, held, numbers, n, known = 0, [], [], 0, {}
    for k, (text, h) in enumerate(zip(rows.column(text_at).cast(pa.binary()), rows.column(h_at).to_pylist(), strict=True)):
        words = planted((text.as_py() or b"").split(), h)
        held.append(words)
        numbers.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)))
        n += len(words)
        if n >= SLICE_WORDS:
            yield first, held, numbers
            first, held, numbers, n, known = k + 1, [], [], 0, {}
    if held:
        yield first, held, numbers


FOUND = "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string"


def with_runs(docs: DataFrame, id_col: str, text_col: str, names: dict[str, str]) -> DataFrame:
    """``docs`` with collapsed texts, and the columns of ``FOUND`` under the given names."""
    h = unused("h", docs.columns)
    columns, text_at = [f"`{c}`" for c in docs.columns], docs.columns.index(text_col)
    rows = docs.select(*columns, F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")).alias(h))
    out = T.StructType(list(docs.schema.fields))
    for f in T.StructType.fromDDL(FOUND):
        out = out.add(names[f.name], f.dataType)
    schema = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for first, held, numbers in _slices(part, text_at, len(columns)):
                own = part.slice(first, len(held))
                texts, found = [], []
                for words, runs in zip(held, runs_of(numbers), strict=True):
                    best = best_run(runs)
                    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
                    found.append((len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(listed.encode()).hexdigest()))
                    texts.append(b" ".join(collapsed(words, runs)))
                kept = pa.array(texts, pa.binary()).cast(schema.field(text_at).type)
                given = [kept if k == text_at else own.column(k) for k in range(len(columns))]
                yield batch(schema, *given, *[list(x) for x in zip(*found, strict=True)])

    return rows.mapInArrow(run, out)


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with the columns of the input; of each run only its first period stays, words joined by one space."""
    names = {f.name: unused(f.name, docs.columns) for f in T.StructType.fromDDL(FOUND)}
    return with_runs(docs, id_col, text_col, names).drop(*names.values())


def run_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row the id, the columns of ``FOUND`` and the ``collapsed`` text."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("collapsed"))
    names = {f.name: f.name for f in T.StructType.fromDDL(FOUND)}
    return with_runs(rows, "id", "collapsed", names).withColumnRenamed("id", id_col)


RUNS_SQL = r"""
WITH split AS (
  SELECT row_number() OVER () AS rid, doc_id,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
             lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1))))) AS h
  FROM documents
), placed AS (
  SELECT *, CAST(len(w) AS BIGINT) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a, 3 + (h // 10) % 8 AS parts FROM split
), docs AS (
  SELECT rid, doc_id, n,
         CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // parts) END]) END AS w
  FROM placed
), grams AS (
  SELECT rid, n, i, array_to_string(w[i + 1 : i + 8], ' ') AS g FROM docs, LATERAL (SELECT unnest(range(n - 7)) AS i) AS t WHERE n >= 24
), periods AS (
  SELECT DISTINCT x.rid, y.i - x.i AS q FROM grams x JOIN grams y ON x.rid = y.rid AND x.g = y.g AND y.i > x.i AND 3 * (y.i - x.i) <= x.n WHERE x.i % 8 = 0
), equal AS (
  SELECT d.rid, q, t.i AS i FROM periods p JOIN docs d ON p.rid = d.rid, LATERAL (SELECT unnest(range(d.n - p.q)) AS i) AS t WHERE d.w[t.i + 1] = d.w[t.i + p.q + 1]
), stretches AS (
  SELECT rid, q, min(i) AS s, count(*) + q AS len FROM (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM equal) GROUP BY rid, q, island
), runs AS (
  SELECT rid, s, len, min(q) AS q FROM stretches WHERE len >= greatest(24, 3 * q) GROUP BY rid, s, len
), by_row AS (
  SELECT rid, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS listed FROM runs GROUP BY rid
), best AS (
  SELECT rid, s, len, q FROM runs QUALIFY row_number() OVER (PARTITION BY rid ORDER BY CAST(len AS DOUBLE) / q DESC, s, q) = 1
), gone AS (
  SELECT DISTINCT rid, t.i AS i FROM runs, LATERAL (SELECT unnest(range(s + q, s + len)) AS i) AS t
), kept AS (
  SELECT rid, string_agg(word, ' ' ORDER BY i) AS txt FROM (SELECT rid, t.i AS i, w[t.i + 1] AS word FROM docs, LATERAL (SELECT unnest(range(n)) AS i) AS t) AS words
  WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.rid = words.rid AND gone.i = words.i) GROUP BY rid
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(s AS BIGINT) AS start, CAST(len AS BIGINT) AS length, CAST(q AS BIGINT) AS period,
       CAST(1000 * len // q AS BIGINT) AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(txt, '')) AS collapsed_sha256
FROM docs LEFT JOIN by_row USING (rid) LEFT JOIN best USING (rid) LEFT JOIN kept USING (rid)
"""
