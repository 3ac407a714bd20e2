"""Packing into optimal length buckets.

Texts longer than the context become several sequences: full ones and a remainder. The global
histogram of sequence lengths goes to a dynamic programme that chooses the bucket lengths with the
least padding for the number of buckets. Inside each bucket, sequences fill batches of a token
budget: a bucket of length b takes ``budget // b`` sequences a batch, each padded to b.

Places inside a bucket come from two steps that no single task has to hold: shards of a bucket
(by a hash of the sequence and of its row's number) are numbered within, and shards are offset by the
sizes of those before. So a bucket with a third of all rows, be they equal, is spread over as many tasks
as any other rows, and each bucket has one batch at most that isn't full.

Defined results: a null, empty or wordless text has length 0, forms no sequence and is returned
once, with null bucket, batch and place; rows that repeat an id are told apart by their text, and
full repeats get places of their own; a null id is an id like any other; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gavel.llm.common import written

CONTEXT, BUCKETS, BUDGET = 4096, 12, 32_768
#: Sequences of one shard of a bucket, about.
SHARD_ROWS = 50_000


def word_count(text: Column) -> Column:
    """Length of a text in words, ``[^\\x20\\x09-\\x0D]+``."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), ""))


def best_buckets(lengths: np.ndarray, counts: np.ndarray, most: int) -> tuple[list[int], int]:
    """Bucket lengths with the least padding, and that padding.

    ``lengths`` ascend and have no repeats. Bucket lengths are lengths that occur; the programme
    goes over the number of buckets and, for each last length, over where the last bucket begins.
    """
    if not len(lengths):
        return [], 0
    n = len(lengths)
    many = np.r_[0, np.cumsum(counts)].astype(np.int64)
    tokens = np.r_[0, np.cumsum(lengths * counts)].astype(np.int64)
    cost = np.full(n + 1, np.iinfo(np.int64).max // 4, np.int64)
    cost[0] = 0
    choices, best = [], None
    for _ in range(min(most, n)):
        new, choice = np.full_like(cost, np.iinfo(np.int64).max // 4), np.zeros(n + 1, np.int64)
        new[0] = 0
        for end in range(1, n + 1):
            padded = cost[:end] + lengths[end - 1] * (many[end] - many[:end]) - (tokens[end] - tokens[:end])
            choice[end] = int(np.argmin(padded))
            new[end] = padded[choice[end]]
        cost = new
        choices.append(choice)
        best = int(cost[n])
    chosen, end = [], n
    for choice in reversed(choices):
        if end == 0:
            break
        chosen.append(int(lengths[end - 1]))
        end = int(choice[end])
    return sorted(chosen), best


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, length: Column | None = None,
    context: int = CONTEXT, buckets: int = BUCKETS, budget: int = BUDGET,
) -> DataFrame:
    """One row per sequence: id, chunk, n_tokens, bucket (its length), batch and place in the batch.

    ``length`` is the number of tokens of a row; by default its words. What the driver gathers is
    bounded by the context: one count for each length, and the bucket lengths.
    """
    if budget < context:
        raise ValueError("a batch must hold a sequence of the context's length")
    tokens = (word_count(F.col(f"`{text_col}`")) if length is None else length).cast("bigint")
    ident, body = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    # numbers of rows are written once, and so stay what they are when a task runs again
    sized = written(docs.select(ident.alias("id"), F.xxhash64(ident, body).alias("key"), F.monotonically_increasing_id().alias("row"), F.coalesce(tokens, F.lit(0)).alias("tokens")), "lengths")
    chunks = F.when(F.col("tokens") > 0, F.sequence(F.lit(0), ((F.col("tokens") - 1) / context).cast("int")))
    cut = sized.select("id", "key", "row", "tokens", F.explode_outer(chunks).alias("chunk"))
    cut = cut.select("id", "key", "row", "chunk", F.least(F.lit(context), F.col("tokens") - F.coalesce("chunk", F.lit(0)) * context).cast("int").alias("n_tokens"))

    real = cut.where("n_tokens > 0")
    histogram = sorted(tuple(r) for r in real.groupBy("n_tokens").agg(F.count("*")).collect())
    lengths, counts = (np.array([r[k] for r in histogram], np.int64) for k in (0, 1))
    chosen, _ = best_buckets(lengths, counts, buckets)
    bucket = F.lit(None).cast("int")
    for b in reversed(chosen):
        bucket = F.when(F.col("n_tokens") <= b, b).otherwise(bucket)
    shards = max(1, -(-int(counts.sum()) // SHARD_ROWS)) * 8
    order = F.xxhash64("key", "chunk")
    placed = real.withColumn("bucket", bucket).withColumn("order", order).withColumn("shard", F.pmod(F.xxhash64("order", "row"), F.lit(shards)))
    # Numbers within shards, and the sizes of the shards before, from one written table of shard numbers.
    numbered = placed.withColumn("number", F.row_number().over(W.partitionBy("bucket", "shard").orderBy("order", "row")) - 1)
    sizes = placed.groupBy("bucket", "shard").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("bucket").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("bucket", "shard", before.alias("before"))
    rank = F.col("before") + F.col("number")
    room = F.floor(F.lit(budget) / F.col("bucket"))
    done = numbered.join(offsets, ["bucket", "shard"]).select(
        F.col("id").alias(id_col), "chunk", "n_tokens", "bucket", F.floor(rank / room).cast("bigint").alias("batch"), (rank % room).cast("int").alias("place")
    )
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    empty = cut.where("n_tokens = 0").select(
        F.col("id").alias(id_col), "chunk", "n_tokens", none("int", "bucket"), none("bigint", "batch"), none("int", "place")
    )
    return done.unionByName(empty)
