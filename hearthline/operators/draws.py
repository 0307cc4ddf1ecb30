"""Ranking of many draws over many units, as blocks of packed numbers.

A draw scores every unit, so there are draws times units scores: far more than input rows.  They travel as
one row per draw and block of a few hundred units; numpy scores, ranks and summarizes inside the tasks, Spark
deals the blocks, gathers each draw and turns the ranks back to their blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Units of a block; bounds a row, and with the number of draws the group of a block.
BLOCK = 512
#: Tasks that score the blocks; draws of a block leave its task in batches of this many.
SCORE_PARTS, SCORE_BATCH = 64, 256

SCORED = "iteration int, block long, scores binary, places binary"
RANKED = "iteration int, block long, ranks binary, r double"
SPREAD = "block long, position int, n long, total double, squares double, p05 double, p95 double, shift int"


def blocks_of(units: DataFrame, key: str, n_units: int) -> DataFrame:
    """``(block, units)``: the rows dealt by the hash of their key into blocks of about ``BLOCK``."""
    n_blocks = max(1, math.ceil(n_units / BLOCK))
    rest = [c for c in units.columns if c != key]
    dealt = units.withColumn("block", F.pmod(F.xxhash64(key), F.lit(n_blocks)))
    return dealt.groupBy("block").agg(F.array_sort(F.collect_list(F.struct(key, *rest))).alias("units"))


def scored(blocks: DataFrame, weights: np.ndarray) -> DataFrame:
    """Scores of each block under each draw, one row of ``weights`` a draw.

    ``blocks`` has ``block, units, k``; a unit has ``values`` and its primary ``place``.
    """

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for block, k, values, places in zip(frame["block"], frame["k"], frame["values"], frame["places"]):
                columns = np.array([np.asarray(v, dtype="f8") for v in values]).T
                kept = np.asarray(places, dtype="f8").tobytes()
                for start in range(0, len(weights), SCORE_BATCH):
                    part = weights[start : start + SCORE_BATCH]
                    # Added in the order of the components, so equal units keep equal scores.
                    total = part[:, :1] * columns[0]
                    for i in range(1, len(columns)):
                        total += part[:, i : i + 1] * columns[i]
                    total = 100.0 + k * total
                    yield pd.DataFrame({
                        "iteration": np.arange(start, start + len(part), dtype="i4"), "block": block,
                        "scores": [row.tobytes() for row in total], "places": [kept] * len(part),
                    })

    flat = blocks.select("block", "k", F.col("units.values").alias("values"), F.col("units.place").alias("places"))
    return flat.repartition(SCORE_PARTS, "block").mapInPandas(score, SCORED)


def places_of(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and mean place, from one, of each score; equal scores share both."""
    order = np.argsort(scores, kind="stable")
    ordered = scores[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    length = np.diff(np.append(first, len(ordered)))
    low, mean = np.empty(len(ordered), "i4"), np.empty(len(ordered), "f8")
    low[order] = np.repeat(first + 1, length)
    mean[order] = np.repeat(first + (length + 1) / 2.0, length)
    return low, mean


def correlation(x: np.ndarray, y: np.ndarray) -> float | None:
    """Pearson correlation, none without variance."""
    x, y = x - x.mean(), y - y.mean()
    scale = math.sqrt(float(x @ x)) * math.sqrt(float(y @ y))
    return float(x @ y) / scale if scale else None


def ranked(scores: DataFrame) -> DataFrame:
    """Ranks of each draw by block, and on the first block's row the draw's agreement with the primary places.

    A group is the units of one draw.
    """

    def rank(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("block")
        parts = [np.frombuffer(b, "f8") for b in frame["scores"]]
        low, mean = places_of(np.concatenate(parts))
        r = correlation(np.concatenate([np.frombuffer(b, "f8") for b in frame["places"]]), mean)
        ends = np.cumsum([len(p) for p in parts])[:-1]
        return pd.DataFrame({
            "iteration": frame["iteration"].to_numpy(), "block": frame["block"].to_numpy(),
            "ranks": [p.tobytes() for p in np.split(low, ends)], "r": [r] + [None] * (len(parts) - 1),
        }).astype({"r": "f8"})

    return scores.groupBy("iteration").applyInPandas(rank, RANKED)


def spread(ranks: DataFrame) -> DataFrame:
    """Sums, two interpolated percentiles and range of every unit's ranks over the draws.

    A group is the draws of one block.
    """

    def between(ordered: np.ndarray, share: float) -> np.ndarray:
        at = share * (len(ordered) - 1)
        low, high = math.floor(at), math.ceil(at)
        return ordered[low].astype("f8") if low == high else (high - at) * ordered[low] + (at - low) * ordered[high]

    def summarize(frame: pd.DataFrame) -> pd.DataFrame:
        ordered = np.array([np.frombuffer(b, "i4") for b in frame["ranks"]])
        ordered.sort(axis=0)
        return pd.DataFrame({
            "block": frame["block"].iloc[0], "position": np.arange(ordered.shape[1], dtype="i4"), "n": len(ordered),
            "total": ordered.sum(axis=0, dtype="f8"), "squares": np.einsum("ij,ij->j", ordered, ordered, dtype="f8"),
            "p05": between(ordered, 0.05), "p95": between(ordered, 0.95), "shift": ordered[-1] - ordered[0],
        })

    return ranks.select("block", "ranks").groupBy("block").applyInPandas(summarize, SPREAD)
