"""Hard negatives by an inverted multi-index.

Vectors are scaled and floored to whole numbers; the score of two rows is their inner product. An anchor's
positives are the other rows of its label with the highest scores. For each positive, the negatives are the
rows of other labels with the highest scores among those from ``LOW`` to ``HIGH`` per cent of the positive's.
Ties go to the smaller id.

Index: each half of the vectors has a codebook, fitted by k-means in numpy to a sample of at most ``SAMPLE`` rows and
``SAMPLE_BYTES``; every row of the table is assigned to the nearest word of either, and the two words are its
cell. The radius of a word is the largest distance of any row's half to it. So no row of a cell can score more
with an anchor than the sum of two half bounds, each the product with the word plus the anchor's length
times the radius.

Search: a heap walks the cells of an anchor by the sum of its two sorted half bounds (multi-sequence). It ends
at the first cell whose bound is below what the anchor still needs: the score of its last positive so far,
or the lowest that could still enter one of its windows. What is left cannot hold a better row, so the result is
certified, and equal to that of all pairs. Cells are visited in rounds of ``FIRST_ROWS`` rows, then
``GROWTH`` times as many, so that later rounds know what is needed; only rows that are better
than that leave a task. Where vectors have no structure the bounds cut little off, and the anchors, a stated
query set, meet all rows in blocks.

Rows of a cell lie in blocks of ``BLOCK`` rows, dealt out in parts of ``PART_ROWS``, so one vector that a third of all
rows share fills many tasks. Parts are dealt to lanes of about ``LANE_ROWS`` rows; anchors travel in groups of ``ANCHORS``,
once to each lane that holds a cell one of them visits, however many cells that are. The codebooks, their radii and the sizes of the cells are bounded by ``WORDS`` and its
square, whatever the table holds.

Defined results: rows with a null id or label, a null vector or a null or non-finite component take no part; a
shorter vector counts as filled up with zeros; rows that repeat an id are rows of their own, and an anchor
that repeats is answered as often; a positive without a negative in its window gives no row; an empty
table gives an empty result; other columns are ignored, whatever their names. Scores must
fit in a long with two digits to spare; larger components raise ``ValueError``.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavel.llm.common import batch, written

POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95
SCALE = 256
#: Most words of a codebook, and rows for each cell that the number of words aims at.
WORDS, CELL_ROWS = 256, 512
#: Rows to which the codebooks are fitted, at most, and their bytes; rounds of k-means.
SAMPLE, SAMPLE_BYTES, ROUNDS = 20_000, 64 << 20, 12
#: Rows of a block, and rows of a cell that travel together.
BLOCK, PART_ROWS = 2048, 16_384
#: Rows of the parts that share a lane, about, and the least number of lanes.
LANE_ROWS, LANES = 1 << 18, 64
#: Anchors that are compared with a block at once (their places fit in a byte), and bytes of the requests made at once.
ANCHORS, REQUEST_BYTES = 256, 16 << 20
#: Rows in the cells of the first round, and how many times more each next one has.
FIRST_ROWS, GROWTH = 4096, 8


@dataclass
class Index:
    """Two codebooks (words, half the dimensions), the radii of their words, and the rows and parts of each cell."""

    books: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    sizes: np.ndarray
    parts: np.ndarray
    lanes: int

    def lanes_of(self, cell: int) -> set[int]:
        """Lanes of the parts of a cell, as ``lane`` has them."""
        return {(cell * STRIDE + part) % self.lanes for part in range(min(self.lanes, int(self.parts[cell])))}

    def half_bounds(self, vectors: np.ndarray) -> list[np.ndarray]:
        """Most that a row with each word can add to each vector's score: (vectors, words) for each half."""
        split, out = self.books[0].shape[1], []
        for book, radius, part in zip(self.books, self.radii, (vectors[:, :split], vectors[:, split:]), strict=True):
            length = np.linalg.norm(part, axis=1)[:, None]
            bound = part @ book.T + length * radius
            # room for rounding: bounds may be too high, never too low
            out.append(bound + 1e-9 * (length * (radius + np.linalg.norm(book, axis=1))) + 1e-6)
        return out

    def cells(self, first: np.ndarray, second: np.ndarray, least: float) -> Iterator[tuple[int, float]]:
        """Cells with rows and their bounds, highest bound first, as long as it reaches ``least``."""
        a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
        first, second, a, b = first[a].tolist(), second[b].tolist(), a.tolist(), b.tolist()
        heap, width = [(-first[0] - second[0], 0, 0)], len(second)
        while heap:
            bound, i, j = heapq.heappop(heap)
            if -bound < least:
                return
            cell = a[i] * width + b[j]
            if self.sizes[cell]:
                yield cell, -bound
            if j + 1 < width:
                heapq.heappush(heap, (-first[i] - second[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(first):
                heapq.heappush(heap, (-first[i + 1] - second[0], i + 1, 0))


def lane(lanes: int) -> Column:
    return F.pmod(F.col("cell").cast("bigint") * STRIDE + F.col("part"), F.lit(lanes)).cast("int").alias("lane")


def nearest(points: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest word of each point, and its distance."""
    found = ((words**2).sum(axis=1) - 2 * (points @ words.T)).argmin(axis=1)
    return found, np.linalg.norm(points - words[found], axis=1)


def codebook(points: np.ndarray, words: int, rounds: int = ROUNDS) -> np.ndarray:
    """k-means, begun from points drawn evenly; words that no point is next to stay where they are."""
    points = points.astype(float)
    out = points[np.linspace(0, len(points) - 1, words).astype(int)].copy()
    for _ in range(rounds):
        own = nearest(points, out)[0]
        sums = np.zeros_like(out)
        np.add.at(sums, own, points)
        n = np.bincount(own, minlength=words)
        out[n > 0] = sums[n > 0] / n[n > 0, None]
    return out


def usable(rows: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """(vec_id, label, vec): rows that take part, components as whole numbers."""
    kept = rows.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), F.col(f"`{label_col}`").cast("bigint").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    kept = kept.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & finite)
    return kept.withColumn("vec", F.transform("vec", lambda x: F.floor(x * float(SCALE)).cast("double")))


def exact_kind(dims: int, most: float) -> type:
    """A type in which sums of ``dims`` products of components up to ``most`` are exact."""
    total = dims * most * most
    if 100 * total >= float(1 << 63):
        raise ValueError("components are too large: scores would not fit in a long")
    return np.float32 if total < 1 << 24 else np.float64 if total < 1 << 53 else np.int64


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Lists of numbers as rows of a matrix, filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    out[owner, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


CODED = "uid bigint, vec_id bigint, label bigint, one int, two int, far_one double, far_two double, vec binary"
CODED_TYPES = pa.schema([*[pa.field(c, pa.int64()) for c in ("uid", "vec_id", "label")], *[pa.field(c, pa.int32()) for c in ("one", "two")], *[pa.field(c, pa.float64()) for c in ("far_one", "far_two")], pa.field("vec", pa.binary())])
BLOCKS = "cell int, part int, n int, uid binary, vec_id binary, label binary, vec binary"
BLOCK_TYPES = pa.schema([*[pa.field(c, pa.int32()) for c in ("cell", "part", "n")], *[pa.field(c, pa.binary()) for c in ("uid", "vec_id", "label", "vec")]])
#: Of a request: its lane, the cells there and which of its anchors visit each; of each anchor the number, label, vector and windows.
ASKED = "lane int, cells array<int>, members array<binary>, uid binary, label binary, vec binary, low binary, high binary, least binary, least_id binary"
ASKED_TYPES = pa.schema([
    pa.field("lane", pa.int32()), pa.field("cells", pa.list_(pa.int32())), pa.field("members", pa.list_(pa.binary())),
    *[pa.field(c, pa.binary()) for c in ("uid", "label", "vec", "low", "high", "least", "least_id")],
])
FOUND = "anchor bigint, slot int, score bigint, vec_id bigint, uid bigint"
FOUND_TYPES = pa.schema([pa.field("anchor", pa.int64()), pa.field("slot", pa.int32()), *[pa.field(c, pa.int64()) for c in ("score", "vec_id", "uid")]])
FAR = (1 << 63) - 1
#: Lanes between the first parts of neighbouring cells.
STRIDE = 40_503


def coded(rows: DataFrame, index_of: tuple[np.ndarray, np.ndarray], dims: int, store: type) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast(index_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = held.value
        for part in batches:
            vectors = matrix(part.column(3), dims)
            split = books[0].shape[1]
            (one, far_one), (two, far_two) = nearest(vectors[:, :split], books[0]), nearest(vectors[:, split:], books[1])
            yield batch(CODED_TYPES, *[part.column(k) for k in range(3)], one.astype(np.int32), two.astype(np.int32), far_one, far_two, [x.tobytes() for x in vectors.astype(store)])

    return rows.withColumn("uid", F.monotonically_increasing_id()).select("uid", "vec_id", "label", "vec").mapInArrow(run, CODED)


def blocks_of(rows: DataFrame, sizes: DataFrame, width: int) -> DataFrame:
    """Rows of equal cell and part in blocks of ``BLOCK`` rows at most."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            cell, own = part.column(0).to_numpy(), part.column(1).to_numpy()
            starts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (own[1:] != own[:-1])]).tolist() if len(cell) else []
            numbers = [part.column(k).to_numpy() for k in (2, 3, 4)]
            vectors = part.column(5).to_pylist()
            cuts = [(low, min(low + BLOCK, high)) for first, high in zip(starts, [*starts[1:], len(cell)], strict=True) for low in range(first, high, BLOCK)]
            yield batch(
                BLOCK_TYPES, [int(cell[a]) for a, _ in cuts], [int(own[a]) for a, _ in cuts], [b - a for a, b in cuts],
                *[[x[a:b].tobytes() for a, b in cuts] for x in numbers], [b"".join(vectors[a:b]) for a, b in cuts],
            )

    placed = rows.withColumn("cell", F.col("one") * width + F.col("two")).join(F.broadcast(sizes.select("cell", "parts")), "cell")
    placed = placed.withColumn("part", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int")).select("cell", "part", "uid", "vec_id", "label", "vec")
    return placed.repartition("cell", "part").sortWithinPartitions("cell", "part").mapInArrow(pack, BLOCKS)


def requests(anchors: DataFrame, index, budget: tuple[int, int], dims: int, store: type) -> DataFrame:
    """What each anchor asks of which cell: cells of the walk before which at least ``budget[0]`` rows and fewer than ``budget[1]`` lie.

    ``anchors`` has uid, label, vec, and for each window (slot) its bounds, and the score and id of its last row so far.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Index = index.value
        sizes = known.sizes.tolist()
        for whole in batches:
            for at in range(0, whole.num_rows, ANCHORS):
                part = whole.slice(at, ANCHORS)
                low, high, least, least_id = (np.array(part.column(k).to_pylist(), np.int64).reshape(part.num_rows, -1) for k in (3, 4, 5, 6))
                vectors = part.column(2).to_pylist()
                first, second = known.half_bounds(np.frombuffer(b"".join(vectors), store).reshape(len(vectors), dims).astype(float))
                open_ = low <= high
                needed = np.where(open_, np.maximum(low, least), FAR).min(axis=1)
                asking: dict[int, list[int]] = {}
                for k in np.flatnonzero(open_.any(axis=1)).tolist():
                    before = 0
                    for cell, _ in known.cells(first[k], second[k], float(needed[k])):
                        if before >= budget[1]:
                            break
                        if before >= budget[0]:
                            asking.setdefault(cell, []).append(k)
                        before += sizes[cell]
                numbers = [part.column(k).to_numpy() for k in (0, 1)]
                by_lane: dict[int, list[int]] = {}
                for cell in asking:
                    for place in known.lanes_of(cell):
                        by_lane.setdefault(place, []).append(cell)
                rows, size = [], 0
                for place, cells in by_lane.items():
                    who = sorted(set().union(*(asking[c] for c in cells)))
                    at_of = {k: n for n, k in enumerate(who)}
                    members = [bytes(at_of[k] for k in asking[c]) for c in cells]
                    rows.append((place, cells, members, *[x[who].tobytes() for x in numbers], b"".join([vectors[k] for k in who]), *[x[who].tobytes() for x in (low, high, least, least_id)]))
                    size += sum(map(len, members)) + sum(map(len, rows[-1][3:]))
                    if size > REQUEST_BYTES:
                        yield batch(ASKED_TYPES, *[list(x) for x in zip(*rows, strict=True)])
                        rows, size = [], 0
                if rows:
                    yield batch(ASKED_TYPES, *[list(x) for x in zip(*rows, strict=True)])

    return anchors.select("uid", "label", "vec", "low", "high", "least", "least_id").mapInArrow(run, ASKED)


def best(score: np.ndarray, ids: np.ndarray, uids: np.ndarray, want: int) -> np.ndarray:
    """Places of the first ``want``, by score, id and number."""
    if len(score) > 4 * want:
        near = np.flatnonzero(score >= np.partition(score, -want)[-want])
        return near[np.lexsort((uids[near], ids[near], -score[near]))[:want]]
    return np.lexsort((uids, ids, -score))[:want]


def answers(pairs: DataFrame, same_label: bool, want: int, dims: int, store: type, kind: type) -> DataFrame:
    """Rows of the blocks that are among the best ``want`` of a window of an anchor, and better than its last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(5)]
            for k in range(part.num_rows):
                read = lambda c, kind=np.int64: np.frombuffer(part.column(c)[k].as_py(), kind)  # noqa: B023, E731
                every, own = read(0), read(11, np.uint8)
                a_uid, a_label, a_vec = every[own], read(1)[own], read(2, store).reshape(len(every), dims)[own].astype(kind)
                low, high, least, least_id = (read(c).reshape(len(every), -1)[own] for c in (3, 4, 5, 6))
                uid, ids, label = read(7), read(8), read(9)
                vec = read(10, store).reshape(len(uid), dims).astype(kind)
                scores = (a_vec @ vec.T).astype(np.int64)
                fits = (a_label[:, None] == label) if same_label else (a_label[:, None] != label)
                fits &= (scores >= np.maximum(low, least).min(axis=1)[:, None]) & (scores <= high.max(axis=1)[:, None])
                for n in np.flatnonzero(fits.any(axis=1)).tolist():
                    rows = np.flatnonzero(fits[n] & (uid != a_uid[n]))
                    score = scores[n, rows]
                    for slot in range(low.shape[1]):
                        inside = (score >= low[n, slot]) & (score <= high[n, slot])
                        inside &= (score > least[n, slot]) | (score == least[n, slot]) & (ids[rows] < least_id[n, slot])
                        taken = rows[inside]
                        if len(taken):
                            taken = taken[best(score[inside], ids[taken], uid[taken], want)]
                            for column, values in zip(out, (np.full(len(taken), a_uid[n]), np.full(len(taken), slot), scores[n, taken], ids[taken], uid[taken]), strict=True):
                                column.append(values)
            none = np.zeros(0, np.int64)
            yield batch(FOUND_TYPES, *[np.concatenate(x or [none]).astype(np.int32 if c == 1 else np.int64) for c, x in enumerate(out)])

    columns = [f"asked_{c}" for c in ("uid", "label", "vec", "low", "high", "least", "least_id")]
    return pairs.select(*columns, "uid", "vec_id", "label", "vec", "member").mapInArrow(run, FOUND)


class Search:
    """The index over all rows, and the walks of the anchors."""

    def __init__(self, rows: DataFrame, name: str):
        spark = rows.sparkSession
        facts = rows.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dims"), F.max(F.array_max(F.transform("vec", F.abs))).alias("most")).first()
        self.n, self.dims, most = facts["n"], facts["dims"] or 0, facts["most"] or 0.0
        self.kind = exact_kind(self.dims, most)
        self.store = np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64
        words = int(min(WORDS, max(1, np.ceil(np.sqrt(self.n / CELL_ROWS)))))
        room = int(min(SAMPLE, max(words, SAMPLE_BYTES // (8 * max(1, self.dims)))))
        drawn = rows.orderBy(F.xxhash64("vec_id", "vec")).limit(room).select("vec").toArrow().column("vec")
        sample, split = matrix(drawn, self.dims), (self.dims + 1) // 2
        books = tuple(codebook(part, min(words, len(sample))) if len(sample) else np.zeros((1, part.shape[1])) for part in (sample[:, :split], sample[:, split:]))
        whole = written(coded(rows, books, self.dims, self.store), f"{name}-coded")
        width = len(books[1])
        radii = [np.zeros(len(b)) for b in books]
        for k, (word, far) in enumerate((("one", "far_one"), ("two", "far_two"))):
            for r in whole.groupBy(word).agg(F.max(far).alias("far")).collect():
                radii[k][r[word]] = r["far"]
        cells = whole.groupBy((F.col("one") * width + F.col("two")).alias("cell")).agg(F.count("*").alias("n"))
        self.cells = written(cells.withColumn("parts", F.ceil(F.col("n") / PART_ROWS).cast("int")), f"{name}-cells")
        sizes, parts = (np.zeros(len(books[0]) * width, np.int64) for _ in range(2))
        for r in self.cells.collect():
            sizes[r["cell"]], parts[r["cell"]] = r["n"], r["parts"]
        lanes = max(LANES, -(-self.n // LANE_ROWS))
        self.index = spark.sparkContext.broadcast(Index(books, tuple(radii), sizes, parts, lanes))
        self.blocks = written(blocks_of(whole, self.cells, width).select("*", lane(lanes)), f"{name}-blocks")
        self.whole, self.name = whole, name

    def rounds(self, anchors: DataFrame, same_label: bool, want: int) -> DataFrame:
        """(anchor, slot, score, vec_id, uid, rank): the first ``want`` rows of each window of each anchor.

        ``anchors`` has uid, label, vec, and arrays ``low`` and ``high`` with the bounds of its windows, as many for each.
        """
        anchors = written(anchors, f"{self.name}-anchors")
        first = Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), "vec_id", "uid")
        found, budget = None, (0, FIRST_ROWS)
        while budget[0] < self.n:
            asking = self.asking(anchors, found, want)
            asked = written(requests(asking, self.index, budget, self.dims, self.store), f"{self.name}-asked")
            budget = (budget[1], budget[1] * GROWTH)
            if asked.isEmpty():
                continue
            asked = asked.select("lane", *[F.col(c).alias(f"asked_{c}") for c in asked.columns[1:]])
            pairs = asked.join(self.blocks, "lane").withColumn("visit", F.array_position("asked_cells", F.col("cell")).cast("int")).where("visit > 0")
            more = answers(pairs.withColumn("member", F.element_at("asked_members", F.col("visit"))), same_label, want, self.dims, self.store, self.kind)
            both = more if found is None else more.union(found.select(more.columns))
            found = written(both.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= want), f"{self.name}-found")
        return anchors.sparkSession.createDataFrame([], FOUND + ", rank int") if found is None else found

    @staticmethod
    def asking(anchors: DataFrame, found: DataFrame | None, want: int) -> DataFrame:
        """Anchors with the score and id of the last row of each window that is full so far."""
        slots = F.sequence(F.lit(0), F.size("low") - 1)
        if found is None:
            return anchors.withColumn("least", F.transform(slots, lambda k: F.lit(-FAR))).withColumn("least_id", F.transform(slots, lambda k: F.lit(FAR)))
        last = found.where(F.col("rank") == want).groupBy(F.col("anchor").alias("uid")).agg(
            F.map_from_entries(F.collect_list(F.struct("slot", F.struct("score", "vec_id")))).alias("last")
        )
        joined = anchors.join(last, "uid", "left")
        at = lambda k: F.try_element_at("last", k.cast("int"))
        return joined.withColumn("least", F.transform(slots, lambda k: F.coalesce(at(k)["score"], F.lit(-FAR)))).withColumn(
            "least_id", F.transform(slots, lambda k: F.coalesce(at(k)["vec_id"], F.lit(FAR)))
        )


def mine_hard_negatives(
    rows: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", *,
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
) -> DataFrame:
    """For each anchor (a row for which ``anchor``, a condition on ``vec_id``, ``label`` and ``vec``, holds) and each
    of its positives, its first negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    search = Search(usable(rows, id_col, label_col, vector_col), "negatives")
    anchors = search.whole.where(anchor).sortWithinPartitions("one", "two").select("uid", F.col("vec_id").alias("anchor_id"), "label", "vec")
    bounds = lambda value: F.array(F.lit(value).cast("bigint"))
    near = search.rounds(anchors.select("uid", "label", "vec", bounds(-FAR).alias("low"), bounds(FAR).alias("high")), True, positives)
    near = near.select(F.col("anchor").alias("uid"), (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # least and greatest whole score of each positive's window; below zero it is empty, and written as 1 to 0
    inside = F.expr(f"IF(positive_score < 0, NULL, struct((positive_score * {low} + 99) div 100 AS low, positive_score * {high} div 100 AS high))")
    of_slot = [F.max(F.when(F.col("slot") == k, inside)).alias(f"w{k}") for k in range(positives)]
    edges = lambda side, none: F.array(*[F.coalesce(F.col(f"w{k}")[side], F.lit(none).cast("bigint")) for k in range(positives)])
    windows = near.groupBy("uid").agg(*of_slot).select("uid", edges("low", 1).alias("low"), edges("high", 0).alias("high"))
    far = search.rounds(anchors.select("uid", "label", "vec").join(windows, "uid"), False, negatives)
    far = far.select(F.col("anchor").alias("uid"), "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    joined = far.join(near, ["uid", "slot"]).join(anchors.select("uid", "anchor_id"), "uid")
    return joined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


MINE_SQL = """
WITH kept AS (
  SELECT row_number() OVER () AS uid, vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vec
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.uid AS a, a.vec_id AS anchor_id, r.uid AS r, r.vec_id AS vec_id, r.label = a.label AS same,
         CAST(list_inner_product(a.vec, r.vec) AS BIGINT) AS score
  FROM kept a JOIN kept r ON a.uid <> r.uid WHERE a.vec_id % 50 = 0
), near AS (
  SELECT a, anchor_id, r, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, r) <= 5
)
SELECT near.anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY near.a, near.r ORDER BY score DESC, vec_id, scored.r) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM near JOIN scored ON near.a = scored.a AND NOT same
 AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
