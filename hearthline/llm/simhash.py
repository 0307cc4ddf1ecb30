"""SimHash near-duplicate classes through a segment-popcount embedding.

A fingerprint's 64 bits form 32 segments of two bits; its embedding is the number of set bits in each.  The
Manhattan distance of two embeddings never exceeds the Hamming distance of the fingerprints.  The segments are
the axes of a grid, dealt to six groups: two points within distance 3 differ on at most three groups, so they
lie in one grid cell of at least one choice of three groups.  Joining on these cells finds every pair in range;
the Manhattan bound and then the exact Hamming distance decide.

Counts of a segment are written in unary (00, 01, 11), so the Manhattan distance is the bit count of an xor.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import components
from hearthline.storage import materialize

SEED = 42
MAX_DISTANCE = 3
LOW_BITS = 0x5555555555555555
GROUPS = MAX_DISTANCE + 3


def fingerprint(text: str | None, words: int) -> int:
    """Signed 64-bit SimHash of the word shingles of a whole text; 0 without words."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    counts, total = np.zeros(64, np.int64), max(1, len(tokens) - words + 1)
    for start in range(0, total, 65536):
        part = tokens[start : min(start + 65536, total) + words - 1]
        shingles = zip(*(part[i:] for i in range(words))) if total > 1 or len(part) >= words else [part]
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in shingles], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<i8")[0])


def with_fingerprint(df: DataFrame, text: str = "text", words: int = 3, name: str = "fingerprint") -> DataFrame:
    """Add the signed 64-bit fingerprint of ``text``; null and empty texts get 0."""

    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([fingerprint(t, words) for t in batch], dtype="int64")

    return df.withColumn(name, F.pandas_udf(each, "long")(F.col(text)))


def embedding(bits: F.Column) -> F.Column:
    """Unary-coded bit counts of the 32 two-bit segments."""
    high = F.shiftrightunsigned(bits, 1)
    low = bits.bitwiseOR(high).bitwiseAND(F.lit(LOW_BITS))
    return low.bitwiseOR(F.shiftleft(bits.bitwiseAND(high).bitwiseAND(F.lit(LOW_BITS)), 1))


def cell_masks() -> list[int]:
    """For each choice of three of the six axis groups, the mask of their segments (signed)."""
    groups = [sum(3 << 2 * s for s in range(32) if s % GROUPS == g) for g in range(GROUPS)]
    masks = [sum(groups[g] for g in chosen) for chosen in combinations(range(GROUPS), GROUPS - MAX_DISTANCE)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(classes: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of distinct values of ``fingerprint`` that differ in three bits or fewer."""
    points = classes.select("fingerprint", embedding(F.col("fingerprint")).alias("at"))
    cells = F.array(*[F.struct(F.lit(i).alias("view"), F.col("at").bitwiseAND(F.lit(m)).alias("cell")) for i, m in enumerate(cell_masks())])
    placed = points.select("fingerprint", "at", F.inline(cells))
    a, b = placed.alias("a"), placed.alias("b")
    near = (
        (F.col("a.view") == F.col("b.view"))
        & (F.col("a.cell") == F.col("b.cell"))
        & (F.col("a.fingerprint") < F.col("b.fingerprint"))
        & (F.bit_count(F.col("a.at").bitwiseXOR(F.col("b.at"))) <= MAX_DISTANCE)
        & (F.bit_count(F.col("a.fingerprint").bitwiseXOR(F.col("b.fingerprint"))) <= MAX_DISTANCE)
    )
    return a.join(b, near).select(F.col("a.fingerprint").alias("a"), F.col("b.fingerprint").alias("b")).distinct()


def near_duplicates(
    df: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = 3, keep: tuple[str, ...] = ()
) -> DataFrame:
    """One row per input row: id, signed fingerprint, class (its smallest fingerprint), component id (smallest id
    reachable), and ``keep`` columns.

    Copies fall together before any join: only distinct fingerprints are embedded and linked.  Null and empty
    texts share fingerprint 0 and are linked like others.  Rows with a null id keep it and take part; a component
    of null ids only has a null component id.  Repeated rows each come back.
    """
    marked = with_fingerprint(df.select(F.col(id_column), F.col(text).alias("_text"), *keep), "_text", words)
    marked = materialize(marked.drop("_text"), "fingerprints")
    classes = materialize(marked.groupBy("fingerprint").agg(F.min(id_column).alias("_first")), "classes")
    roots = components(links(classes))
    rooted = classes.join(roots, classes["fingerprint"] == roots["node"], "left").select(
        "fingerprint", "_first", F.coalesce("root", "fingerprint").alias("_root")
    )
    # Stored, so that adaptive execution can split the other side where one class has very many rows.
    lowest = materialize(rooted.groupBy("_root").agg(F.min("_first").alias("component_id")), "components")
    named = rooted.join(lowest, "_root").select("fingerprint", F.col("_root").alias("class"), "component_id")
    return marked.join(materialize(named, "named"), "fingerprint").select(id_column, "fingerprint", "class", "component_id", *keep)
