"""Quality scores from random Fourier features of document statistics.

A text is described by some fifteen statistics of the whole of it. Random cosines of the
standardised statistics approximate a Gaussian kernel; each partition sums the normal equations of
ridge regression over its rows, Spark adds the sums up, and the driver solves one small system.
Labelled rows that the regression did not see then calibrate its scores: they are counted by score
bin, pooled into an isotonic step function, and scores are read off it by interpolation.

Texts are read once: the statistics are written to the shared folder and everything else works
on those.

Defined results: a null, empty or wordless text has statistics of zero and is scored like any
other; a very long text is hashed in pieces and counts whole; rows with a null label or id are not
learned from; if only one of the two parts, to regress on and to calibrate, has labelled rows, it serves
for both; without any labelled row all scores are 0; equal scores are one step of the calibration; a text with several labels is learned from once for each; repeated rows are scored each on its
own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql import types as T

from gavel.llm.common import batch, spans, utf8, written
from gavel.llm.hashing import run_hashes, word_hashes

#: Cosines, width of the kernel in standardised units, ridge penalty per row, bins of a score.
COSINES, SIGMA, RIDGE, BINS = 192, 3.0, 1e-4, 1000
CLIP = 6.0
#: Share of a score that stays the regression's own, so that a pooled step still ranks its rows.
OWN = 0.01

STATISTICS = (
    "log_bytes", "log_words", "word_length", "upper", "digits", "symbols", "punctuation", "beyond_ascii",
    "marks", "log_lines", "repeated_lines", "distinct_words", "log_symbols", "doubled_words", "words_a_line",
)


def _among(codes: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(codes.encode())] = True
    return table


UPPER, DIGIT, SYMBOL = _among("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _among("0123456789"), _among("#*$%&|<>")
PUNCTUATION, MARK = _among(".,;:()'\"-"), _among("!?")
BEYOND = np.arange(256) > 127


def distinct_by_owner(owner: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """How many distinct hashes each owner has, to 40 bits."""
    keys = np.unique((owner.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
    return np.bincount((keys >> np.uint64(40)).astype(np.int64), minlength=n)


def statistics(data: np.ndarray, at: np.ndarray, tables: tuple | None = None) -> np.ndarray:
    """One row of STATISTICS for each text at ``at``."""
    n, low = len(at) - 1, int(at[0])
    part, bounds = data[low : int(at[-1])], at - low
    sizes = np.diff(bounds)

    def count(mask: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(part) + 1, np.int64)
        np.cumsum(mask, out=sums[1:])
        return np.diff(sums[bounds])

    owner, words = word_hashes(data, at, tables)
    n_words = np.bincount(owner, minlength=n)
    same = np.zeros(0, bool) if len(owner) < 2 else (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    doubled = np.bincount(owner[1:][same], minlength=n)
    distinct = distinct_by_owner(owner, words, n)

    breaks = np.flatnonzero(part == 10)
    begins = np.unique(np.r_[bounds[:-1], breaks + 1])
    begins = begins[begins < len(part)]
    ends = np.r_[begins[1:], len(part)][: len(begins)]
    ends = ends - (part[ends - 1] == 10)
    whole = ends > begins
    line_owner = np.searchsorted(bounds, begins[whole], "right") - 1
    n_lines = np.bincount(line_owner, minlength=n)
    lines = run_hashes(part, begins[whole], ends[whole], tables)
    distinct_lines = distinct_by_owner(line_owner, lines, n)

    of_bytes, of_words, of_lines = np.maximum(sizes, 1), np.maximum(n_words, 1), np.maximum(n_lines, 1)
    symbols = count(SYMBOL[part])
    return np.stack([
        np.log1p(sizes), np.log1p(n_words), sizes / of_words, count(UPPER[part]) / of_bytes, count(DIGIT[part]) / of_bytes,
        symbols / of_bytes, count(PUNCTUATION[part]) / of_bytes, count(BEYOND[part]) / of_bytes, count(MARK[part]) / of_bytes,
        np.log1p(n_lines), 1 - distinct_lines / of_lines, distinct / of_words, np.log1p(symbols), doubled / of_words,
        np.log1p(n_words / of_lines),
    ], axis=1)


def with_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, stats) of every row, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            data, at = utf8(rows.column(1))
            found = [statistics(data, at[a : b + 1]) for a, b in spans(at)]
            flat = np.concatenate(found).ravel() if found else np.zeros(0)
            offsets = np.arange(0, len(flat) + 1, len(STATISTICS), dtype=np.int32)
            yield batch(
                pa.schema([pa.field("id", rows.column(0).type), pa.field("stats", pa.list_(pa.float64()))]),
                rows.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
            )

    out = T.StructType().add("id", docs.schema[id_col].dataType).add("stats", T.ArrayType(T.DoubleType()))
    return written(docs.select(F.col(f"`{id_col}`"), text_col).mapInArrow(run, out), "statistics")


@dataclass
class Kernel:
    """Standardisation and random cosines."""

    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phases: np.ndarray

    @classmethod
    def drawn(cls, mean: np.ndarray, deviation: np.ndarray, seed: int = 11) -> Kernel:
        rng = np.random.default_rng(seed)
        waves = rng.normal(0, 1 / SIGMA, (len(mean), COSINES))
        return cls(mean, np.where(deviation > 1e-9, deviation, 1.0), waves, rng.uniform(0, 2 * np.pi, COSINES))

    def features(self, stats: np.ndarray) -> np.ndarray:
        """Cosines and a constant for each row."""
        x = np.clip((stats - self.mean) / self.scale, -CLIP, CLIP)
        cosines = np.sqrt(2 / COSINES) * np.cos(x @ self.waves + self.phases)
        return np.concatenate([cosines, np.ones((len(x), 1))], axis=1)


def stats_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))


def normal_equations(rows: DataFrame, kernel: Kernel) -> tuple[np.ndarray, np.ndarray, int]:
    """Sums over all rows of f f', f y and the number of rows; rows has stats and y.

    A partition emits its sums once, as one row for each entry, and Spark adds entries up.
    """
    held = rows.sparkSession.sparkContext.broadcast(kernel)
    width = COSINES + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, right, n = np.zeros((width, width)), np.zeros(width), 0
        for part in batches:
            f, y = held.value.features(stats_of(part.column(0))), part.column(1).to_numpy()
            gram, right, n = gram + f.T @ f, right + f.T @ y, n + len(y)
        if n:
            values = np.concatenate([gram[np.triu_indices(width)], right, [n]])
            yield batch(pa.schema([pa.field("entry", pa.int32()), pa.field("value", pa.float64())]), np.arange(len(values), dtype=np.int32), values)

    sums = rows.select("stats", F.col("y").cast("double")).mapInArrow(run, "entry int, value double").groupBy("entry").agg(F.sum("value").alias("value"))
    values = np.array([r["value"] for r in sorted(sums.collect())])
    gram = np.zeros((width, width))
    gram[np.triu_indices(width)] = values[: -width - 1]
    return gram + np.triu(gram, 1).T, values[-width - 1 : -1], int(values[-1])


def pooled(scores: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling adjacent violators: mean score and mean label of each pool."""
    pools: list[list[float]] = []
    for s, y, n in zip(scores.tolist(), sums.tolist(), counts.tolist(), strict=True):
        pools.append([s * n, y, n])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


@dataclass
class QualityModel:
    kernel: Kernel
    weights: np.ndarray
    at: np.ndarray
    level: np.ndarray

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.kernel.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        raw = self.raw(stats)
        return (1 - OWN) * np.interp(raw, self.at, self.level) + OWN / (1 + np.exp(-np.clip(4 * raw - 2, -30, 30)))


def fit(stats: DataFrame, labels: DataFrame, calibrate: Column, label_col: str = "quality", id_col: str = "doc_id") -> QualityModel | None:
    """Learn from ``labels`` (id and label); rows that ``calibrate`` admits calibrate, others are regressed on."""
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y"), F.coalesce(calibrate, F.lit(False)).alias("later")).where(F.col("id").isNotNull() & F.col("y").isNotNull())
    rows = written(stats.join(usable, "id").select("stats", "y", "later"), "labelled-statistics")
    first, later = rows.where(~F.col("later")), rows.where("later")
    if first.isEmpty():
        first = later
    elif later.isEmpty():
        later = first
    n = len(STATISTICS)
    moments = first.agg(*[F.avg(F.get("stats", F.lit(k))).alias(f"m{k}") for k in range(n)], *[F.stddev_pop(F.get("stats", F.lit(k))).alias(f"s{k}") for k in range(n)]).first()
    if moments["m0"] is None:
        return None
    kernel = Kernel.drawn(np.array([moments[f"m{k}"] for k in range(n)]), np.array([moments[f"s{k}"] for k in range(n)]))
    gram, right, count = normal_equations(first, kernel)
    penalty = RIDGE * count * np.eye(len(right))
    penalty[-1, -1] = 1e-9
    weights = np.linalg.solve(gram + penalty, right)
    model = QualityModel(kernel, weights, np.zeros(1), np.zeros(1))
    held = rows.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            yield batch(pa.schema([pa.field("raw", pa.float64()), pa.field("y", pa.float64())]), held.value.raw(stats_of(part.column(0))), part.column(1))

    bins = later.select("stats", "y").mapInArrow(scored, "raw double, y double").groupBy(F.least(F.greatest(F.floor(F.col("raw") * BINS), F.lit(-BINS)), F.lit(2 * BINS)).alias("bin"))
    counted = sorted(bins.agg(F.avg("raw"), F.sum("y"), F.count("*")).collect())
    at, level = pooled(*(np.array([r[k] for r in counted]) for k in (1, 2, 3)))
    return QualityModel(kernel, weights, at, level)


def score(stats: DataFrame, model: QualityModel | None, id_col: str = "doc_id") -> DataFrame:
    """Per row of (id, stats) the id and ``score``: a map without shuffle."""
    if model is None:
        return stats.select(F.col("id").alias(id_col), F.lit(0.0).alias("score"))
    held = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            yield batch(pa.schema([pa.field(id_col, part.column(0).type), pa.field("score", pa.float64())]), part.column(0), np.clip(held.value.score(stats_of(part.column(1))), 0, 1))

    return stats.select("id", "stats").mapInArrow(run, T.StructType().add(id_col, stats.schema["id"].dataType).add("score", T.DoubleType()))
