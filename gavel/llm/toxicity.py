"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the hashes of its words (whole, and their stems, so that inflected forms
share weight), of its pairs of neighbours and of its pairs with one word between them; each feature
counts once. Every coordinate has a learning rate of its own,
and the L1 term keeps weights at zero until the evidence outweighs it, so the fitted model is a
short list of weights; there are ``2 ** BITS`` coordinates, so it has 50 MB at most when broadcast.

Words are those of ``hashing.word_hashes``; whole texts count, very long ones in pieces cut between words.

Defined results: a null, empty or wordless text has no features and gets the score of the bias
alone; rows with a null label or id are not learned from; without any labelled row all scores are
0; a text with several labels is learned from once for each, and so is each row of a repeated id; a
text whose features alone exceed the sample's bytes isn't learned from; repeated rows are scored each on its own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavel.llm.common import batch, spans, unit, utf8, written
from gavel.llm.hashing import mixed, powers, stem_hashes

BITS = 22
#: Sizes of the stems of a word, in bytes.
STEMS = (4, 5)
#: Bounds of the training sample: labelled texts, and bytes of their features, which the driver gathers.
SAMPLE, SAMPLE_BYTES = 12_000, 80 << 20
ALPHA, BETA, L1, L2, PASSES = 1.0, 1.0, 6.0, 0.1, 3


def features(data: np.ndarray, at: np.ndarray, tables: tuple | None = None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Owner and coordinate of each word and its stems, pair of neighbours, and pair around one word."""
    shift = np.uint64(64 - bits)
    owner, (words, *stems) = stem_hashes(data, at, STEMS, tables)
    owners, found = [owner] * (1 + len(stems)), [words >> shift]
    found += [mixed(x + np.uint64(n)) >> shift for n, x in enumerate(stems, 1)]
    for step, salt in ((1, 0xA0761D6478BD642F), (2, 0xE7037ED1A0B428DB)):
        same = np.flatnonzero(owner[step:] == owner[:-step])
        owners.append(owner[same])
        found.append(mixed(words[same] * np.uint64(salt) + words[same + step]) >> shift)
    return np.concatenate(owners), np.concatenate(found).astype(np.int64)


@dataclass
class SparseLogit:
    """Non-zero weights by ascending coordinate, and the bias."""

    coordinates: np.ndarray
    weights: np.ndarray
    bias: float

    def dense(self, bits: int = BITS) -> np.ndarray:
        table = np.zeros(1 << bits, np.float32)
        table[self.coordinates] = self.weights
        return table


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def ftrl(rows: list[tuple[np.ndarray, int]], bits: int = BITS) -> SparseLogit:
    """FTRL-proximal over rows of (distinct coordinates, label), in the given order.

    The bias is a coordinate of its own without penalties.
    """
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bias_z = bias_n = 0.0

    def solved(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(PASSES):
        for at, label in rows:
            own_z, own_n = z[at], n[at]
            w = solved(own_z, own_n)
            bias = -bias_z / ((BETA + bias_n**0.5) / ALPHA)
            g = float(sigmoid(w.sum() + bias)) - label
            grown = np.sqrt(own_n + g * g)
            z[at] = own_z + g - (grown - np.sqrt(own_n)) / ALPHA * w
            n[at] = own_n + g * g
            bias_z += g - ((bias_n + g * g) ** 0.5 - bias_n**0.5) / ALPHA * bias
            bias_n += g * g
    w = solved(z, n)
    at = np.flatnonzero(w)
    return SparseLogit(at, w[at].astype(np.float32), -bias_z / ((BETA + bias_n**0.5) / ALPHA))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int, sample_bytes: int) -> list[tuple[np.ndarray, int]]:
    """About ``sample`` labelled texts, drawn by a hash of the id, as distinct coordinates and label.
    Ids are taken in the order of the draw, each if its features still fit in ``sample_bytes``.

    ``labels`` holds the rows that may be learned from, as id and label.
    """
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isNotNull())
    n = usable.count()
    if not n:
        return []
    # About ``sample`` rows of two numbers each, whatever the input: small enough to broadcast, so texts stay where they are.
    drawn = F.broadcast(usable.where(unit("id", salt="toxicity") < sample / n))
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(drawn, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([pa.field("draw", pa.int64()), pa.field("y", pa.int32()), pa.field("at", pa.binary())])
        for rows in batches:
            data, at = utf8(rows.column(2))
            found = []
            for k in range(len(rows)):
                _, own = features(data, at[k : k + 2])
                found.append(np.unique(own).astype("<i4").tobytes())
            yield batch(schema, rows.column(0), rows.column(1), found)

    sent = written(picked.select(F.xxhash64("id").alias("draw"), "y", "text").mapInArrow(run, "draw bigint, y int, at binary"), "training-features")
    sizes = sorted(tuple(r) for r in sent.groupBy("draw").agg(F.sum(F.octet_length("at"))).collect())  # a row for each drawn id
    taken, total = [], 0
    for draw, size in sizes:
        if total + size <= sample_bytes:
            taken, total = [*taken, draw], total + size
    ids = F.broadcast(sent.sparkSession.createDataFrame([(x,) for x in taken], "draw bigint"))
    ordered = sorted((r["draw"], r["y"], bytes(r["at"])) for r in sent.join(ids, "draw").collect())
    return [(np.frombuffer(at, "<i4"), y) for _, y, at in ordered]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> SparseLogit | None:
    rows = training_rows(docs, labels, id_col, text_col, label_col, sample, sample_bytes)
    return ftrl(rows) if rows else None


def score(docs: DataFrame, model: SparseLogit | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row the id and ``score``: a map without shuffle.

    Sparse weights also make the work small: only the few features with a weight are told apart
    by text, so that each counts once.
    """
    if model is None:
        return docs.select(id_col, F.lit(0.0).alias("score"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        table, tables = model.dense(), powers((1 << 20) + 1)
        for rows in batches:
            data, at = utf8(rows.column(1))
            total = np.full(len(rows), model.bias)
            for low, high in spans(at):
                owner, found = features(data, at[low : high + 1], tables)
                weighed = np.flatnonzero(table[found])
                pairs = np.unique(owner[weighed] << BITS | found[weighed])
                np.add.at(total, low + (pairs >> BITS), table[pairs & ((1 << BITS) - 1)])
            schema = pa.schema([pa.field(id_col, rows.column(0).type), pa.field("score", pa.float64())])
            yield batch(schema, rows.column(0), sigmoid(total))

    out = T.StructType().add(id_col, docs.schema[id_col].dataType).add("score", T.DoubleType())
    return docs.select(F.col(f"`{id_col}`"), text_col).mapInArrow(run, out)
