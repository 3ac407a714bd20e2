"""Language identification by a byte convolutional network.

A text's bytes are cut into windows of fixed length that overlap by the widest filter less one, so
that no run of bytes is lost at a border. Bytes (A-Z as a-z) are embedded, filters of several
widths slide over each window, each filter's maximum passes a rectifier, and a softmax layer gives
the languages. A text's probabilities are those of its windows, weighted by their bytes. The whole
network is trained in numpy on windows drawn from labelled texts.

To apply it, embedding and filters are folded into one table of responses by byte, so that a
window needs look-ups, sums and maxima only, block by block.

Defined results: a null text, or one without a letter, is ``und`` with score 0, as is every text
when no labelled text was there to learn from; of equal probabilities the first language by name wins;
a very long text has as many windows as it needs, worked through block by block; rows with a null language or id are not learned
from; repeated rows are predicted each on its own; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavel.llm.common import batch, small, spans, unit, utf8, written

UNKNOWN = "und"
WIDTHS, FILTERS, DEPTH, LENGTH = (2, 3, 4), 8, 8, 256
#: Bounds of the training sample: texts of each language and of all (one of each language at least), and windows of each text.
TEXTS_PER_LANGUAGE, TEXTS, WINDOWS_PER_TEXT = 400, 160_000, 4
EPOCHS, BATCH, RATE = 6, 64, 0.01
BLOCK = 16

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def cut(at: np.ndarray, length: int = LENGTH, overlap: int = max(WIDTHS) - 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, first byte and number of bytes of the windows of texts at ``at``; an empty text has none."""
    sizes = np.diff(at)
    each = np.where(sizes > 0, np.maximum(1, -(-(sizes - overlap) // (length - overlap))), 0)
    owner = np.repeat(np.arange(len(sizes)), each)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
    first = at[:-1][owner] + place * (length - overlap)
    return owner, first, np.minimum(length, at[1:][owner] - first)


def windows(data: np.ndarray, first: np.ndarray, size: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Bytes of the windows, lower-cased, filled up with zeros."""
    steps = np.arange(length)
    found = LOWER[data[np.minimum(first[:, None] + steps, len(data) - 1)]]
    found[steps >= size[:, None]] = 0
    return found


@dataclass
class ByteNet:
    languages: list[str]
    embedding: np.ndarray  # byte, depth
    filters: dict[int, np.ndarray]  # width -> (width, depth, filters)
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], seed: int = 7) -> ByteNet:
        rng = np.random.default_rng(seed)
        normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        n = FILTERS * len(WIDTHS)
        return cls(
            languages, normal(256, DEPTH, scale=0.5),
            {w: normal(w, DEPTH, FILTERS, scale=(w * DEPTH) ** -0.5) for w in WIDTHS},
            np.zeros(n, np.float32), normal(n, len(languages), scale=n**-0.5), np.zeros(len(languages), np.float32),
        )

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters.values(), self.bias, self.dense, self.dense_bias]

    def folded(self) -> np.ndarray:
        """Response of every filter's every place to every byte: (places, 256)."""
        rows = [self.embedding @ self.filters[w][j] for w in WIDTHS for j in range(w)]
        return np.ascontiguousarray(np.concatenate(rows, axis=1).T)

    def features(self, x: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Rectified maxima of the filters over windows x (n, length)."""
        found, n, length = np.empty((len(x), FILTERS * len(WIDTHS)), np.float32), len(x), x.shape[1]
        index, buffer, row = x.astype(np.intp), np.empty(x.shape, np.float32), 0
        for k, w in enumerate(WIDTHS):
            for f in range(FILTERS):
                total = np.zeros((n, length - w + 1), np.float32)
                for j in range(w):
                    np.take(table[row + j * FILTERS + f], index, out=buffer, mode="clip")
                    total += buffer[:, j : length - w + 1 + j]
                found[:, k * FILTERS + f] = total.max(axis=1)
            row += w * FILTERS
        return np.maximum(found + self.bias, 0)

    def probabilities(self, features: np.ndarray) -> np.ndarray:
        logits = features @ self.dense + self.dense_bias
        raised = np.exp(logits - logits.max(axis=1, keepdims=True))
        return raised / raised.sum(axis=1, keepdims=True)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Gradients of the mean cross-entropy; only the places of the maxima carry any."""
        e, length = self.embedding[x], x.shape[1]
        best, values = [], []
        for w in WIDTHS:
            response = sum(e[:, j : length - w + 1 + j] @ self.filters[w][j] for j in range(w))
            best.append(response.argmax(axis=1))
            values.append(np.take_along_axis(response, best[-1][:, None], axis=1)[:, 0])
        raw = np.concatenate(values, axis=1) + self.bias
        features = np.maximum(raw, 0)
        error = self.probabilities(features)
        error[np.arange(len(y)), y] -= 1
        error /= len(y)
        back = (error @ self.dense.T) * (raw > 0)
        d_embedding, d_filters, rows = np.zeros_like(self.embedding), [], np.arange(len(x))[:, None]
        for k, w in enumerate(WIDTHS):
            g, made = back[:, k * FILTERS : (k + 1) * FILTERS], np.zeros_like(self.filters[w])
            for j in range(w):
                seen = x[rows, best[k] + j]
                made[j] = np.einsum("nf,nfd->df", g, self.embedding[seen])
                np.add.at(d_embedding, seen, g[:, :, None] * self.filters[w][j].T[None])
            d_filters.append(made)
        return [d_embedding, *d_filters, back.sum(axis=0), features.T @ error, error.sum(axis=0)]


def train(x: np.ndarray, y: np.ndarray, languages: list[str], seed: int = 7) -> ByteNet:
    """Adam over shuffled batches; the order depends on the seed alone."""
    net, rng = ByteNet.fresh(languages, seed), np.random.default_rng(seed)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for start in range(0, len(order), BATCH):
            part, step = order[start : start + BATCH], step + 1
            for p, g, (m, v) in zip(net.parameters(), net.gradients(x[part], y[part]), state, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def training_windows(docs: DataFrame, learn: Column, id_col: str, text_col: str, lang_col: str) -> tuple[np.ndarray, list[str]]:
    """Windows of a sample of the rows that ``learn`` admits, with their languages.

    Languages are counted over all rows, and all of them are learned; each gives about ``TEXTS_PER_LANGUAGE``
    texts, or fewer if there are so many languages that ``TEXTS`` would be passed, drawn by a hash of the id,
    and of each text at most ``WINDOWS_PER_TEXT`` windows spread over the whole.
    """
    rows = docs.where(learn).select(F.col(f"`{id_col}`").alias("own"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").alias("text"))
    admitted = rows.where(F.col("lang").isNotNull() & F.col("own").isNotNull())
    counts = written(admitted.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    if not (n_languages := counts.count()):
        return np.zeros((0, LENGTH), np.uint8), []
    each = max(1.0, min(TEXTS_PER_LANGUAGE, TEXTS / n_languages))
    drawn = admitted.where(F.col("text").isNotNull()).join(small(counts), "lang").where(unit(F.col("own"), salt="language") < F.lit(each) / F.col("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([pa.field("id", pa.string()), pa.field("lang", pa.string()), pa.field("win", pa.binary())])
        for rows in batches:
            data, at = utf8(rows.column(2))
            owner, first, size = cut(at)
            if not len(owner):
                continue
            total = np.bincount(owner, minlength=len(at) - 1)
            place = np.arange(len(owner)) - (np.cumsum(total) - total)[owner]
            gap = np.maximum(1, -(-total // WINDOWS_PER_TEXT))[owner]
            taken = np.flatnonzero(place % gap == 0)
            x = windows(data, first[taken], size[taken])
            take = pa.array(owner[taken])
            yield batch(schema, rows.column(0).take(take), rows.column(1).take(take), [w.tobytes() for w in x])

    picked = drawn.select(F.col("own").cast("string").alias("id"), "lang", "text")
    found = sorted((r["id"], r["lang"], bytes(r["win"])) for r in picked.mapInArrow(run, "id string, lang string, win binary").collect())
    return np.frombuffer(b"".join(w for *_, w in found), np.uint8).reshape(-1, LENGTH), [lang for _, lang, _ in found]


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ByteNet | None:
    x, labels = training_windows(docs, learn, id_col, text_col, lang_col)
    languages = sorted(set(labels))
    if not languages:
        return None
    place = {lang: n for n, lang in enumerate(languages)}
    return train(x, np.array([place[lang] for lang in labels]), languages)


def predict(docs: DataFrame, net: ByteNet | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row the id, ``lang_pred`` and ``score``: a map without shuffle."""
    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    if net is None:
        return docs.select(id_col, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    held = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held.value
        table = net.folded()
        names = np.array([UNKNOWN, *net.languages], object)
        for rows in batches:
            data, at = utf8(rows.column(1))
            sums = np.zeros((len(rows), len(net.languages)))
            for low, high in spans(at):
                owner, first, size = cut(at[low : high + 1])
                for k in range(0, len(owner), BLOCK):
                    p = net.probabilities(net.features(windows(data, first[k : k + BLOCK], size[k : k + BLOCK]), table))
                    np.add.at(sums, low + owner[k : k + BLOCK], p * size[k : k + BLOCK, None])
            total = sums.sum(axis=1)
            known = rows.column(2).to_numpy(zero_copy_only=False).astype(bool) & (total > 0)
            best = np.where(known, sums.argmax(axis=1) + 1, 0)
            score = np.where(known, np.minimum(1.0, sums.max(axis=1) / np.where(total > 0, total, 1)), 0.0)
            schema = pa.schema([pa.field(id_col, rows.column(0).type), pa.field("lang_pred", pa.string()), pa.field("score", pa.float64())])
            yield batch(schema, rows.column(0), names[best].tolist(), score)

    out = T.StructType().add(id_col, docs.schema[id_col].dataType).add("lang_pred", T.StringType()).add("score", T.DoubleType())
    return docs.select(F.col(f"`{id_col}`"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), letters.alias("letters")).mapInArrow(run, out)
