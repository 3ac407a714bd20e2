"""Benchmark decontamination by latent semantic retrieval.

Benchmark items and texts are cut into passages that overlap by half, of a size that suits the item
(``SCALES``), so that an item in the midst of other words still fills a passage. Word weights are
inverse document frequencies counted over all texts. A randomised SVD of the items' TF-IDF passages,
its products summed over partitions, spans the latent space; every passage of every text is
projected, and those whose cosine to an item's passage reaches ``COSINE`` become candidates. A
candidate counts as a leak only if the longest common subsequence of words covers enough of the
item, or less of it together with the item's answer (the ``answer`` column if there is one, else its
last sentence).

A passage is projected only if words of the items of its scale carry ``SHARED`` of its weight, or weigh
``LIGHTEST`` of the lightest passage of these items, however heavy the words between them are.

Latent directions tell items of rare words apart better than items of frequent ones, so every stretch in which
``SEEDED`` of an item's runs of ``GRAM`` words stand on one diagonal is a candidate too. With this no item that
stands in a text word for word is lost; all candidates go through the same checks.

The benchmark is the query set. Its distinct items are dealt into blocks of about ``BLOCK`` items and
``BLOCK_BYTES`` of text, each with its own latent space, and one pass over the texts tries as many
blocks as fit in ``PASS_BYTES``. Texts and items are lower-cased throughout, accented letters too.
Texts are never shuffled; only word counts are, pre-aggregated by partition.

Defined results: a null, empty or wordless text or item matches nothing; rows that repeat an id
or an item give a pair each, of which one stays: that of the best coverage, then cosine, then the
first place; a null id is an id like any other; a very long text is hashed in pieces and counts whole;
an empty table gives an empty result; other columns pass through ``drop_leaks`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from gavel.llm.common import arrow_rows, batch, spans, unused, utf8
from gavel.llm.hashing import mixed, powers, word_hashes

#: Least words of an item, and words and step of the passages that are compared with it.
SCALES = ((1, 6, 3), (12, 12, 6), (30, 24, 12))
#: Buckets of the word counts, as bits of the word hash.
BITS = 18
RANK, EXTRA, POWERS = 256, 16, 1
#: Items and bytes of items of a block, about; bytes of the latent spaces of one pass; rows of a strip of sums.
BLOCK, BLOCK_BYTES, PASS_BYTES, STRIP = 1024, 256 << 10, 256 << 20, 1024
#: Least share of a passage's weight on words of the items of its scale.
SHARED = 0.2
#: Least weight of these words, as a share of that of the lightest passage of those items.
LIGHTEST = 0.5
COSINE = 0.55
#: Words of the runs that are looked up as they are, and the share of an item's that must stand on one diagonal.
GRAM, SEEDED = 4, 0.5
#: Bits of the hash by which most runs are told to be no item's.
GRAM_BITS = 20
#: Covered share of an item that makes a leak, alone or with the answer, and of an answer.
COVERED, COVERED_WITH_ANSWER, ANSWER_COVERED = 0.7, 0.5, 0.8
TABLES = (1 << 20) + 1
#: Windows that are projected at a time, so that their sums stay in a fast cache.
WINDOWS = 512
#: Entries of a table of windows and words.
ROOM = 1 << 20
#: Texts that a task counts words of at a time.
ROWS = 1000


def bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Texts that hold a word of each bucket, and the number of texts; ``texts`` has one column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n, tables = np.zeros(1 << BITS, np.int64), 0, powers(TABLES)
        for rows in batches:
            data, at = utf8(rows.column(0))
            n += len(rows)
            for low, high in spans(at):
                owner, words = word_hashes(data, at[low : high + 1], tables)
                pairs = np.unique(owner << BITS | bucket(words))
                counts += np.bincount(pairs & ((1 << BITS) - 1), minlength=1 << BITS)
        seen = np.flatnonzero(counts)
        schema = pa.schema([pa.field("bucket", pa.int32()), pa.field("n", pa.int64())])
        yield batch(schema, np.r_[seen, -1].astype(np.int32), np.r_[counts[seen], n])

    found = texts.mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts, total = np.zeros(1 << BITS, np.int64), 0
    with arrow_rows(texts.sparkSession, ROWS):
        whole = found.toArrow()
    for r in whole.to_batches():  # at most one row for each bucket
        at, n = r.column(0).to_numpy(), r.column(1).to_numpy()
        counts[at[at >= 0]] = n[at >= 0]
        total += int(n[at < 0].sum())
    return counts, total


def scale_of(n_words: int) -> int:
    return max(k for k, (least, _, _) in enumerate(SCALES) if n_words >= least)


def passages(n_words: int) -> list[tuple[int, int]]:
    """First word and end of the passages of one item."""
    _, window, step = SCALES[scale_of(n_words)]
    if n_words <= window:
        return [(0, n_words)]
    starts = list(range(0, n_words - window, step)) + [n_words - window]
    return [(s, s + window) for s in starts]


@dataclass
class Item:
    """An item's id, its words as hashes, and those of its answer."""

    key: object
    words: list[int]
    answer: list[int]
    masks: dict[int, int] = field(default_factory=dict)
    answer_masks: dict[int, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.masks, self.answer_masks = bit_masks(self.words), bit_masks(self.answer)


def bit_masks(words: list[int]) -> dict[int, int]:
    masks: dict[int, int] = {}
    for n, w in enumerate(words):
        masks[w] = masks.get(w, 0) | 1 << n
    return masks


def common_words(masks: dict[int, int], length: int, other: list[int]) -> int:
    """Length of the longest common subsequence: one bit for each word of the item, a step for each other word."""
    row = every = (1 << length) - 1
    for w in other:
        if mask := masks.get(w):
            hit = row & mask
            row = ((row + hit) | (row - hit)) & every
    return length - row.bit_count()


def hashed(text: str) -> list[int]:
    data = np.frombuffer((text or "").encode(), np.uint8)
    return word_hashes(data, np.array([0, len(data)]))[1].tolist() if len(data) else []


def last_sentence(text: str) -> str:
    """The text after the last sentence end that still leaves words behind it."""
    body = text.rstrip(" \t\r\n.!?")
    cut = max((body.rfind(c) for c in ".!?\n"), default=-1)
    return body[cut + 1 :]


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words, in order."""
    turns = [np.uint64((2 * k + 3) * 0x9E3779B97F4A7C15 % (1 << 64) | 1) for k in range(size)]
    whole = max(0, len(words) - size + 1)
    return mixed(sum((words[k : k + whole] * turns[k] for k in range(size)), np.zeros(whole, np.uint64)) + np.uint64(size))


@dataclass
class Seeds:
    """Runs of words of the items of one block that have the same length: hash, item, and place in the item."""

    size: int
    hashes: np.ndarray
    item: np.ndarray
    place: np.ndarray
    marks: np.ndarray  # by the highest bits of the hash

    @classmethod
    def of(cls, items: list[Item], size: int) -> Seeds | None:
        """Of the items of ``size`` words, for less than ``GRAM``, or of all longer ones."""
        own = [n for n, x in enumerate(items) if min(len(x.words), GRAM) == size]
        if not own:
            return None
        grams = [gram_hashes(np.array(items[n].words, np.uint64), size) for n in own]
        hashes = np.concatenate(grams)
        order = np.argsort(hashes, kind="stable")
        marks = np.zeros(1 << GRAM_BITS, bool)
        marks[hashes >> np.uint64(64 - GRAM_BITS)] = True
        item, place = np.repeat(own, [len(g) for g in grams]), np.concatenate([np.arange(len(g)) for g in grams])
        return cls(size, hashes[order], item[order], place[order], marks)

    def hits(self, grams: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, diagonal, runs) of each diagonal with runs of an item; ``owner`` has the text of each word."""
        at = np.flatnonzero(self.marks[grams >> np.uint64(64 - GRAM_BITS)])
        at = at[owner[at] == owner[at + self.size - 1]]
        low, high = np.searchsorted(self.hashes, grams[at], "left"), np.searchsorted(self.hashes, grams[at], "right")
        n = high - low
        found = np.repeat(low, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(at, n)
        rows, runs = np.unique(np.stack([owner[at], self.item[found], at - self.place[found]], axis=1), axis=0, return_counts=True)
        return *rows.T, runs


@dataclass
class Latent:
    """What a task needs to judge passages against one block of items."""

    idf: np.ndarray  # by bucket
    row: np.ndarray  # bucket -> row of a word, -1 for none; words share a bucket only by accident
    vocabulary: np.ndarray  # hash of each row's word
    vectors: np.ndarray  # (rows, rank): a word's place in the latent space, times its weight
    of_scale: np.ndarray  # (scales, rows): whether an item of the scale holds the word
    queries: list[np.ndarray]  # by scale: (item passages, rank), unit length
    owner: list[np.ndarray]  # by scale: item of each passage
    items: list[Item]
    lightest: list[float]  # by scale: weight of the lightest passage
    seeds: list[Seeds]
    lengths: np.ndarray  # words of each item
    item_rows: np.ndarray  # (items, longest): rows of the items' words, filled up with the number of rows

    @property
    def n_bytes(self) -> int:
        seeds = sum(x.hashes.nbytes + x.item.nbytes + x.place.nbytes + x.marks.nbytes for x in self.seeds)
        return self.vectors.nbytes + self.row.nbytes + self.item_rows.nbytes + seeds + sum(q.nbytes for q in self.queries) + 200 * sum(len(x.words) for x in self.items)

    def words_around(self, item: np.ndarray, begin: np.ndarray, end: np.ndarray, first: np.ndarray, last: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """For each pair of an item and a window (words ``first`` to ``last`` of the text from ``begin`` to ``end``): how many
        of the item's words stand within its length around the window. Pairs are sorted by window; ``rows`` is by word."""
        out, reach = np.zeros(len(item), np.int64), self.lengths[item]
        low, high = np.maximum(begin, first - reach), np.minimum(end, last + reach)
        width = len(self.vocabulary) + 1
        at = 0
        while at < len(item):  # some at a time, so that the table of what is there stays small
            to = min(len(item), at + max(1, ROOM // width))
            while to > at + 1 and int((high - low)[at:to].sum()) > ROOM:
                to = at + (to - at) // 2
            n = (high - low)[at:to]
            owner = np.repeat(np.arange(to - at), n)
            place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[at:to], n)
            there = np.zeros((to - at, width), bool)
            there[owner, rows[place]] = True  # -1, for a word of no item, is the last column
            there[:, -1] = False
            out[at:to] = there[np.arange(to - at)[:, None], self.item_rows[item[at:to]]].sum(axis=1)
            at = to
        return out

    def rows_of(self, words: np.ndarray) -> np.ndarray:
        found = self.row[bucket(words)]
        known = np.flatnonzero(found >= 0)
        wrong = known[self.vocabulary[found[known]] != words[known]]
        if len(wrong):  # another word of the same bucket may be the one
            at = np.minimum(np.searchsorted(self.vocabulary, words[wrong]), len(self.vocabulary) - 1)
            found[wrong] = np.where(self.vocabulary[at] == words[wrong], at, -1)
        return found


def latent_products(rows: DataFrame, basis: np.ndarray, both: bool) -> np.ndarray:
    """A' A basis (``both``) or (A basis)' (A basis), for A the passages ``rows`` (at, weights).

    Each partition emits its sums as strips of ``STRIP`` rows, and strips are added by Spark.
    """
    held = rows.sparkSession.sparkContext.broadcast(basis)
    width = basis.shape[1]
    height = len(basis) if both else width
    schema = pa.schema([pa.field("strip", pa.int32()), pa.field("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis, total = held.value, None
        for part in batches:
            for at, weights in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                total = np.zeros((height, width)) if total is None else total
                y = np.array(weights) @ basis[at]
                if both:
                    total[at] += np.array(weights)[:, None] * y
                else:
                    total += np.outer(y, y)
        if total is not None:
            strips = range(0, height, STRIP)
            yield batch(schema, [k // STRIP for k in strips], [total[k : k + STRIP].tobytes() for k in strips])

    def added(strips: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.float64) for x in strips.column("data").to_pylist())
        return pa.table({"strip": strips.column("strip")[:1], "data": pa.array([total.tobytes()], pa.binary())})

    sums = rows.mapInArrow(run, "strip int, data binary").groupBy("strip").applyInArrow(added, "strip int, data binary")
    found = sorted((r["strip"], bytes(r["data"])) for r in sums.collect())
    return np.frombuffer(b"".join(x for _, x in found), np.float64).reshape(height, width)


def randomised_svd(rows: DataFrame, n_terms: int, n_rows: int, seed: int = 5) -> np.ndarray:
    """Right singular vectors (terms, rank) of the passages by power iteration from a random start."""
    width = min(RANK + EXTRA, n_rows, n_terms)
    basis, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(n_terms, width)))
    for _ in range(POWERS):
        basis, _ = np.linalg.qr(latent_products(rows, basis, True))
    values, turn = np.linalg.eigh(latent_products(rows, basis, False))
    best = np.argsort(values)[::-1][: min(RANK, width)]
    return basis @ turn[:, best]


def fit_block(block: DataFrame, idf: np.ndarray) -> Latent | None:
    """The latent space of one block (id, text, answer) of items, lower-cased."""
    items = []
    for r in block.collect():
        if words := hashed(r["text"]):
            items.append(Item(r["id"], words, hashed(r["answer"] or last_sentence(r["text"]))))
    if not items:
        return None
    items.sort(key=lambda x: (str(x.key), x.words))
    vocabulary = np.unique(np.array([w for x in items for w in x.words], np.uint64))
    weight = idf[bucket(vocabulary)].astype(np.float64)
    owner, rows, of_scale, lightest = [], [], np.zeros((len(SCALES), len(vocabulary)), bool), [np.inf] * len(SCALES)
    for n, item in enumerate(items):
        places = np.searchsorted(vocabulary, np.array(item.words, np.uint64))
        scale = scale_of(len(places))
        of_scale[scale, places] = True
        for first, end in passages(len(places)):
            lightest[scale] = min(lightest[scale], float((weight[places[first:end]] ** 2).sum()))
            at, times = np.unique(places[first:end], return_counts=True)
            weights = times * weight[at]
            if (norm := float(np.sqrt((weights**2).sum()))) > 0:
                owner.append(n)
                rows.append((at.tolist(), (weights / norm).tolist()))
    spark = block.sparkSession
    matrix = spark.createDataFrame(rows, "at array<int>, weights array<double>").repartition(max(1, len(rows) // 256))
    vectors = randomised_svd(matrix, len(vocabulary), len(rows))
    queries = np.stack([np.array(weights) @ vectors[at] for at, weights in rows])
    queries /= np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-12)
    row = np.full(1 << BITS, -1, np.int32)
    row[bucket(vocabulary)] = np.arange(len(vocabulary))
    owner = np.array(owner)
    scales = np.array([scale_of(len(x.words)) for x in items])[owner]
    by_scale = [np.flatnonzero(scales == k) for k in range(len(SCALES))]
    lengths = np.array([len(x.words) for x in items])
    item_rows = np.full((len(items), int(lengths.max())), len(vocabulary), np.int32)
    for n, x in enumerate(items):
        item_rows[n, : lengths[n]] = np.searchsorted(vocabulary, np.array(x.words, np.uint64))
    return Latent(
        idf, row, vocabulary, (vectors * weight[:, None]).astype(np.float32), of_scale,
        [queries[k].astype(np.float32) for k in by_scale], [owner[k] for k in by_scale], items,
        lightest, [x for k in range(1, GRAM + 1) if (x := Seeds.of(items, k))], lengths, item_rows,
    )


@dataclass
class Leak:
    row: int
    item: int
    cosine: float
    covered: float
    answer: bool
    first_word: int


def find_in(latents: list[Latent], data: np.ndarray, at: np.ndarray, tables: tuple) -> Iterator[tuple[Latent, Leak]]:
    """Leaks in the texts at ``at``: for each text and item the best candidate passage."""
    owner, words = word_hashes(data, at, tables)
    if not len(words):
        return
    n_words = np.bincount(owner, minlength=len(at) - 1)
    weight2 = latents[0].idf[bucket(words)].astype(np.float64) ** 2
    whole = np.r_[0.0, np.cumsum(weight2)]
    grams = {size: gram_hashes(words, size) for size in {x.size for latent in latents for x in latent.seeds}}
    for latent in latents:
        best: dict[tuple[int, int], Leak] = {}
        rows = latent.rows_of(words)
        for seeds in latent.seeds:
            for leak in find_seeded(latent, seeds, grams[seeds.size], owner, words, n_words, rows):
                best[leak.row, leak.item] = leak
        for scale in range(len(SCALES)):
            if len(latent.queries[scale]):
                of_scale = np.where(rows >= 0, np.where(latent.of_scale[scale][rows], rows, -1), -1)
                for leak in find_at(latent, scale, words, n_words, rows, of_scale, weight2, whole):
                    old = best.get((leak.row, leak.item))
                    if old is None or (leak.covered, leak.cosine, -leak.first_word) > (old.covered, old.cosine, -old.first_word):
                        best[leak.row, leak.item] = leak
        for leak in best.values():
            yield latent, leak


def find_at(latent: Latent, scale: int, words: np.ndarray, n_words: np.ndarray, all_rows: np.ndarray, rows: np.ndarray, weight2: np.ndarray, whole: np.ndarray) -> Iterator[Leak]:
    """Leaks of the items of one scale; ``rows`` has the words of that scale's items, -1 for others; ``all_rows`` those of all items."""
    _, size, step = SCALES[scale]
    begin = np.cumsum(n_words) - n_words
    each = np.where(n_words > 0, np.maximum(1, -(-(n_words - size) // step) + 1), 0)
    doc = np.repeat(np.arange(len(n_words)), each)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
    first = begin[doc] + place * step
    end = np.minimum(first + size, (begin + n_words)[doc])
    known = np.r_[0.0, np.cumsum(np.where(rows >= 0, weight2, 0))]
    weight, shared = whole[end] - whole[first], known[end] - known[first]
    likely = np.flatnonzero((shared > 0) & ((shared >= SHARED * weight) | (shared >= LIGHTEST * latent.lightest[scale])))
    for low in range(0, len(likely), WINDOWS):
        part = likely[low : low + WINDOWS]
        steps = first[part][:, None] + np.arange(size)
        inside = steps < end[part][:, None]
        at_row = np.where(inside, rows[np.minimum(steps, len(rows) - 1)], -1)
        projected = summed(latent.vectors, at_row)
        cosines = projected @ latent.queries[scale].T / np.maximum(np.linalg.norm(projected, axis=1, keepdims=True), 1e-12)
        hit, query = np.nonzero(cosines >= COSINE)
        pair = hit * len(latent.items) + latent.owner[scale][query]
        order = np.argsort(pair, kind="stable")
        starts = np.flatnonzero(np.r_[True, pair[order[1:]] != pair[order[:-1]]]) if len(pair) else np.zeros(0, np.int64)
        best = np.maximum.reduceat(cosines[hit, query][order], starts) if len(starts) else np.zeros(0)
        hit, item = np.divmod(pair[order[starts]], len(latent.items))
        window = part[hit]
        texts = begin[doc[window]], (begin + n_words)[doc[window]]
        enough = latent.words_around(item, *texts, first[window], end[window], all_rows) >= COVERED_WITH_ANSWER * latent.lengths[item]
        for w, own, cosine in zip(window[enough].tolist(), item[enough].tolist(), best[enough].tolist(), strict=True):
            d, low_word = int(doc[w]), int(begin[doc[w]])
            covered, answer = coverage(latent.items[own], words, low_word, low_word + int(n_words[d]), int(first[w]), int(end[w]))
            if covered >= COVERED or (answer and covered >= COVERED_WITH_ANSWER):
                yield Leak(d, own, cosine, covered, answer, int(first[w]) - low_word)


def summed(vectors: np.ndarray, at_row: np.ndarray) -> np.ndarray:
    """The sum of the vectors of each row of ``at_row``, in which -1 stands for none."""
    n = (at_row >= 0).sum(axis=1)
    order = np.argsort(-n, kind="stable")  # the fullest first, so that each step adds to the first rows only
    at_row = -np.sort(-at_row[order], axis=1)  # and what is there before what isn't
    total = np.zeros((len(at_row), vectors.shape[1]), vectors.dtype)
    for k in range(int(n.max(initial=0))):
        live = int(np.searchsorted(-n[order], -k, "left"))
        total[:live] += vectors[at_row[:live, k]]
    out = np.empty_like(total)
    out[order] = total
    return out


def coverage(item: Item, words: np.ndarray, begin: int, end: int, first: int, last: int) -> tuple[float, bool]:
    """Share of the item that stands in order around words ``first`` to ``last`` of the text from ``begin`` to ``end``; whether its answer does."""
    reach = len(item.words)
    region = words[max(begin, first - reach) : min(end, last + reach)].tolist()
    present = set(region)
    if sum(w in present for w in item.words) < COVERED_WITH_ANSWER * reach:
        return 0.0, False  # the common subsequence can't be longer than the words that the region has
    covered = common_words(item.masks, reach, region) / reach
    return covered, bool(item.answer) and common_words(item.answer_masks, len(item.answer), region) >= ANSWER_COVERED * len(item.answer)


def find_seeded(latent: Latent, seeds: Seeds, grams: np.ndarray, owner: np.ndarray, words: np.ndarray, n_words: np.ndarray, rows: np.ndarray) -> Iterator[Leak]:
    """Leaks of items of which many runs of words stand on one diagonal: for each text and item the fullest, of equal ones the first."""
    text, item, diagonal, runs = seeds.hits(grams, owner)
    if not len(text):
        return
    sizes = np.array([len(x.words) for x in latent.items])[item]
    enough = np.flatnonzero(runs >= SEEDED * (sizes - seeds.size + 1))
    enough = enough[np.lexsort((diagonal[enough], -runs[enough], item[enough], text[enough]))]
    first = np.r_[True, (item[enough[1:]] != item[enough[:-1]]) | (text[enough[1:]] != text[enough[:-1]])] if len(enough) else np.zeros(0, bool)
    begin = np.cumsum(n_words) - n_words
    for d, n, at, size in zip(*(x[enough[first]].tolist() for x in (text, item, diagonal, sizes)), strict=True):
        low_word, high_word = int(begin[d]), int(begin[d] + n_words[d])
        a, b = max(low_word, at), min(high_word, at + size)
        covered, answer = coverage(latent.items[n], words, low_word, high_word, a, b)
        if covered >= COVERED or (answer and covered >= COVERED_WITH_ANSWER):
            scale = scale_of(size)
            own = latent.vectors[rows[a:b][rows[a:b] >= 0]].sum(axis=0)
            cosine = float((latent.queries[scale][latent.owner[scale] == n] @ own).max(initial=0.0) / max(float(np.linalg.norm(own)), 1e-12))
            yield Leak(d, n, cosine, covered, answer, a - low_word)


def blocks_of(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str) -> Iterator[list[Latent]]:
    """Latent spaces of the blocks of the benchmark, as many at a time as one pass holds."""
    answers = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = benchmark.select(F.col(item_col).alias("id"), F.lower(item_text_col).alias("text"), F.lower(answers).alias("answer")).distinct()
    n, n_bytes = items.agg(F.count("text"), F.sum(F.octet_length("text"))).first()
    if not n:
        return
    counts, total = document_frequencies(docs.select(F.lower(text_col)))
    idf = np.log((1 + total) / (1 + counts)).astype(np.float32) + np.float32(1e-3)
    n_blocks = max(1, -(-n // BLOCK), -(-n_bytes // BLOCK_BYTES))
    held: list[Latent] = []
    for k in range(n_blocks):
        latent = fit_block(items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)) == k), idf)
        if latent is None:
            continue
        if held and sum(x.n_bytes for x in held) + latent.n_bytes > PASS_BYTES:
            yield held
            held = []
        held.append(latent)
    if held:
        yield held


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item, cosine, covered, answer_found, first_word) of every text and item that it holds."""
    kinds = docs.schema[id_col].dataType, benchmark.schema[item_col].dataType
    schema = T.StructType().add(id_col, kinds[0]).add(item_col, kinds[1]).add("cosine", T.DoubleType()).add("covered", T.DoubleType()).add("answer_found", T.BooleanType()).add("first_word", T.LongType())
    found, item_type = None, to_arrow_type(kinds[1])
    for latents in blocks_of(docs, benchmark, text_col, item_col, item_text_col):
        held = docs.sparkSession.sparkContext.broadcast(latents)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            tables = powers(TABLES)
            for rows in batches:
                data, at = utf8(rows.column(1))
                leaks = [(low + x.row, latent.items[x.item].key, x) for low, high in spans(at) for latent, x in find_in(held.value, data, at[low : high + 1], tables)]
                yield pa.RecordBatch.from_arrays([
                    rows.column(0).take(pa.array([k for k, *_ in leaks], pa.int64())), pa.array([key for _, key, _ in leaks], item_type),
                    pa.array([x.cosine for *_, x in leaks], pa.float64()), pa.array([x.covered for *_, x in leaks], pa.float64()),
                    pa.array([x.answer for *_, x in leaks], pa.bool_()), pa.array([x.first_word for *_, x in leaks], pa.int64()),
                ], names=schema.names)

        part = docs.select(F.col(f"`{id_col}`"), F.lower(text_col)).mapInArrow(run, schema)
        found = part if found is None else found.union(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], schema)
    best = F.max_by(F.struct("cosine", "covered", "answer_found", "first_word"), F.struct("covered", "cosine", -F.col("first_word"))).alias("best")
    return found.groupBy(F.col(f"`{id_col}`"), F.col(f"`{item_col}`")).agg(best).select(F.col(f"`{id_col}`"), F.col(f"`{item_col}`"), "best.*")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows whose text holds no item, with the columns of the input: a map without shuffle."""
    kept, place = docs, len(docs.columns)
    lower = unused("lower", docs.columns)
    for latents in blocks_of(docs, benchmark, text_col, item_col, item_text_col):
        held = docs.sparkSession.sparkContext.broadcast(latents)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            tables = powers(TABLES)
            for rows in batches:
                data, at = utf8(rows.column(place))
                clean = np.ones(len(rows), bool)
                for low, high in spans(at):
                    for _, leak in find_in(held.value, data, at[low : high + 1], tables):
                        clean[low + leak.row] = False
                yield rows.filter(pa.array(clean)).select(list(range(place)))

        kept = kept.select(*[F.col(f"`{c}`") for c in docs.columns], F.lower(text_col).alias(lower)).mapInArrow(run, docs.schema)
    return kept
