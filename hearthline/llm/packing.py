"""Packing by optimal length buckets.

Sequences are padded to the length of their bucket.  The global histogram of lengths (at most ``max_length`` rows,
whatever the table holds) goes through a dynamic programme that chooses the bucket boundaries with the least padding;
batches with a token budget form inside each bucket.  A document longer than ``max_length`` is cut into pieces of
that length and a rest, so every token lands in exactly one sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hearthline.llm import bitplane
from hearthline.storage import materialize

MAX_LENGTH = 2048
BUCKETS = 16
TOKEN_BUDGET = 65_536
#: Sequences numbered together: a bucket with more is dealt to several shards, each with one unfilled batch at most.
SHARD = 65_536


def words(text: str) -> Column:
    """Length of a text in words; 0 for null."""
    found = F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), "[\\x20\\x09-\\x0D]+"), "")
    return F.size(found).cast("long")


def tokens(path: str, text: str = "text") -> Column:
    """Length of a text in tokens of the vocabulary file at ``path``, readable on every executor; 0 for null."""

    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        library = bitplane._library(path)
        for batch in batches:
            counts = [len(ids) // 4 for low in range(0, len(batch), 512) for ids in library.encode([t or "" for t in batch[low : low + 512]])]
            yield pd.Series(counts, dtype="int64")

    return F.pandas_udf(each, "long")(F.col(text))


def boundaries(histogram: dict[int, int], buckets: int) -> list[int]:
    """Ends of at most ``buckets`` length ranges with the least total padding; the last is the greatest length.

    ``best[k][j]``: least padding of the lengths up to the j-th with k buckets.  A range from i to j costs its number
    of sequences times its end, less its tokens, and both come from prefix sums.
    """
    lengths = np.array(sorted(n for n, c in histogram.items() if c and n > 0), np.int64)
    if not len(lengths):
        return []
    counts = np.array([histogram[n] for n in lengths.tolist()], np.float64)
    number, tokens = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * lengths)])
    best = np.concatenate([[0.0], lengths * number[1:] - tokens[1:]])
    cuts = [np.zeros(len(lengths) + 1, np.int64)]
    for _ in range(1, min(buckets, len(lengths))):
        after, cut = best.copy(), np.zeros(len(lengths) + 1, np.int64)
        for j in range(1, len(lengths) + 1):
            total = best[:j] + lengths[j - 1] * (number[j] - number[:j]) - (tokens[j] - tokens[:j])
            cut[j] = int(total.argmin())
            after[j] = total[cut[j]]
        best = after
        cuts.append(cut)
    out, j = [], len(lengths)
    for cut in reversed(cuts):
        if not j:
            break
        out.append(int(lengths[j - 1]))
        j = int(cut[j])
    return out[::-1]


def pieces(df: DataFrame, id_column: str, length: Column, max_length: int) -> DataFrame:
    """``(id, piece, start, n_tokens)``: every document cut at ``max_length``; one empty piece where it has no token."""
    count = F.greatest(F.lit(1), F.ceil(F.col("_n") / max_length)).cast("int")
    cut = df.select(F.col(id_column), length.alias("_n")).select(id_column, "_n", F.explode(F.sequence(F.lit(0), count - 1)).alias("piece"))
    start = F.col("piece").cast("long") * max_length
    return cut.select(id_column, "piece", start.alias("start"), F.least(F.lit(max_length), F.col("_n") - start).alias("n_tokens"))


def pack(
    df: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    length: Column | None = None,
    max_length: int = MAX_LENGTH,
    buckets: int = BUCKETS,
    budget: int = TOKEN_BUDGET,
) -> DataFrame:
    """One row per piece: id, piece, start, n_tokens, bucket (padded length), shard, batch, slot (place in the batch).

    ``length`` counts a row's tokens (default: words of ``text``).  A batch is named by bucket, shard and batch, and
    bucket times its number of rows never exceeds ``budget`` (which is at least ``max_length``).  Rows without tokens
    stay, with null bucket, shard, batch and slot.  Null and equal ids are packed like any others.
    """
    if budget < max_length:
        raise ValueError("the budget of a batch must hold the longest sequence")
    cut = materialize(pieces(df, id_column, words(text) if length is None else length, max_length), "pieces")
    histogram = {r[0]: r[1] for r in cut.groupBy("n_tokens").count().collect()}
    ends = boundaries(histogram, buckets)
    plan = []
    for low, end in zip([0, *ends], ends):
        n = sum(c for size, c in histogram.items() if low < size <= end)
        plan.append((end, -(-n // SHARD), budget // end))
    names = ("end", "shards", "holds")
    known = [F.struct(*[F.lit(v).cast("long").alias(k) for k, v in zip(names, p)]) for p in plan or [(0, 1, 1)]]
    placed = cut.withColumn("_to", F.when(F.col("n_tokens") > 0, F.get(F.filter(F.array(*known), lambda b: b["end"] >= F.col("n_tokens")), F.lit(0))))
    # Equal rows of different parts of the table go to different shards, so that no shard can be crowded by copies.
    deal = F.pmod(F.xxhash64(id_column, "piece") + F.spark_partition_id(), F.col("_to.shards"))
    placed = placed.select(id_column, "piece", "start", "n_tokens", F.col("_to.end").alias("bucket"), F.col("_to.holds").alias("_holds"), deal.alias("shard"))
    full = placed.where("bucket is not null")
    rank = F.row_number().over(W.partitionBy("bucket", "shard").orderBy(F.xxhash64(id_column, "piece"), id_column, "piece")).cast("long") - 1
    full = full.withColumn("_rank", rank).select(
        id_column, "piece", "start", "n_tokens", "bucket", "shard",
        F.floor(F.col("_rank") / F.col("_holds")).alias("batch"), F.pmod("_rank", "_holds").alias("slot"),
    )
    none = F.lit(None).cast("long")
    empty = placed.where("bucket is null").select(id_column, "piece", "start", "n_tokens", "bucket", "shard", none.alias("batch"), none.alias("slot"))
    return full.unionByName(empty)
