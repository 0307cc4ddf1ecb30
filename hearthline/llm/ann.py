"""Nearest neighbours through learned partitions.

On a bounded sample a neighbour graph is built and cut into parts of equal size with few edges between them.  A
small network learns, for a vector, how its neighbours spread over the parts.  Every row of the table is stored in
its most probable part; a query visits its most probable parts until their summed probability reaches a limit that
the sample calibrates for the wanted recall.  Visited candidates are ranked by the exact inner product.

Rows are dealt to a fixed number of slices and queries to blocks.  A task holds one block of queries, reads the rows
of one slice batch by batch and keeps the best of each query so far, so it gives out at most k rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hearthline.storage import materialize

#: Bound of the sample that graph, parts and network are made from.
SAMPLE = 6_000
#: Rows from which one part (all rows visited) is no longer enough, rows a part should have, and most parts.
PLAIN, ROWS_PER_PART, MOST_PARTS = 2_000, 500, 64
NEIGHBOURS, HIDDEN = 16, 96
#: Slices of the rows, rows scored at once, and queries of a block.
SLICES, CANDIDATES, QUERIES = 8, 8_192, 4_096
RECALL = 0.95


@dataclass
class Router:
    """A two-layer network from vectors to probabilities of parts, and how much probability a query visits."""

    layers: list[np.ndarray]
    visit: float

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        z = np.maximum(x @ w1 + b1, 0) @ w2 + b2
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def parts(self, x: np.ndarray) -> np.ndarray:
        return self.probabilities(x).argmax(1)

    def visits(self, x: np.ndarray, sizes: np.ndarray, least: int) -> list[np.ndarray]:
        """Parts that each query visits: the most probable, until probability and number of rows suffice."""
        p = self.probabilities(x)
        order = np.argsort(-p, axis=1, kind="stable")
        reached = np.cumsum(np.take_along_axis(p, order, 1), 1)
        rows = np.cumsum(sizes[order], 1)
        need = 1 + np.maximum((reached < self.visit).sum(1), (rows < least).sum(1))
        return [o[:n] for o, n in zip(order, np.minimum(need, p.shape[1]))]


def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """The k rows with the largest inner product of each row, itself left out."""
    out = np.empty((len(x), k), np.int64)
    for low in range(0, len(x), 1024):
        s = x[low : low + 1024] @ x.T
        s[np.arange(len(s)), np.arange(low, low + len(s))] = -np.inf
        best = np.argpartition(-s, k - 1, axis=1)[:, :k]
        out[low : low + 1024] = np.take_along_axis(best, np.argsort(-np.take_along_axis(s, best, 1), axis=1), 1)
    return out


def balanced_cut(x: np.ndarray, graph: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """Parts of nearly equal size with few graph edges between them.

    Seeds grow by recursive halving along a direction of large spread; then, in rounds, vertices move to the part that
    most of their neighbours are in, best gains first, while no part leaves its size limits.
    """
    label = np.zeros(len(x), np.int64)
    groups = [np.arange(len(x))]
    while len(groups) < parts:
        groups.sort(key=len)
        own = groups.pop()
        centred = x[own] - x[own].mean(0)
        way = rng.normal(size=x.shape[1])
        for _ in range(8):
            way = centred.T @ (centred @ way)
            way /= np.linalg.norm(way) + 1e-12
        order = own[np.argsort(centred @ way, kind="stable")]
        groups += [order[: len(order) // 2], order[len(order) // 2 :]]
    for i, own in enumerate(groups):
        label[own] = i
    source, target = np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()
    mean = len(x) / parts
    for _ in range(12):
        links = np.zeros((len(x), parts), np.int32)
        np.add.at(links, (source, label[target]), 1)
        np.add.at(links, (target, label[source]), 1)
        here = links[np.arange(len(x)), label]
        best = links.argmax(1)
        gain = links[np.arange(len(x)), best] - here
        sizes, moved = np.bincount(label, minlength=parts), 0
        for v in np.argsort(-gain, kind="stable"):
            if gain[v] <= 0:
                break
            if sizes[best[v]] < 1.1 * mean and sizes[label[v]] > 0.9 * mean:
                sizes[label[v]] -= 1
                sizes[best[v]] += 1
                label[v] = best[v]
                moved += 1
        if not moved:
            break
    return label


def fit(x: np.ndarray, parts: int, seed: int = 11) -> Router:
    """Graph, cut, network and the calibrated visit limit of a sample of vectors."""
    dim, rng = x.shape[1], np.random.default_rng(seed)
    if parts == 1 or len(x) <= NEIGHBOURS + 1:
        return Router([np.zeros((dim, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)], 1.0)
    x = x / np.abs(x).max()
    graph = neighbours(x, NEIGHBOURS)
    label = balanced_cut(x, graph, parts, rng)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), NEIGHBOURS), label[graph].ravel()), 0.6 / NEIGHBOURS)
    target[np.arange(len(x)), label] += 0.4
    scale = 1 / (x.std() + 1e-12)
    layers = [rng.normal(0, dim**-0.5, (dim, HIDDEN)) * scale, np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, (HIDDEN, parts)), np.zeros(parts)]
    first, second, steps, step = [0.0] * 4, [0.0] * 4, 8 * -(-len(x) // 256), 0
    held = rng.permutation(len(x))
    probe, learn = held[: len(x) // 10], held[len(x) // 10 :]
    while step < steps:
        for low in range(0, len(learn), 256):
            step += 1
            pick = rng.choice(learn, min(256, len(learn)), replace=False)
            w1, b1, w2, b2 = layers
            h = np.maximum(x[pick] @ w1 + b1, 0)
            z = h @ w2 + b2
            p = np.exp(z - z.max(1, keepdims=True))
            d = (p / p.sum(1, keepdims=True) - target[pick]) / len(pick)
            dh = (d @ w2.T) * (h > 0)
            for i, g in enumerate((x[pick].T @ dh, dh.sum(0), h.T @ d, d.sum(0))):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.99 * second[i] + 0.01 * g * g
                rate = 0.01 * (1 - (step - 1) / (steps + 256)) * (scale if i == 0 else 1)
                layers[i] = layers[i] - rate * first[i] / (1 - 0.9**step) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
            if step >= steps:
                break
    router = Router(layers, 1.0)
    home, p = router.parts(x), router.probabilities(x[probe])
    order = np.argsort(-p, axis=1, kind="stable")
    reached = np.cumsum(np.take_along_axis(p, order, 1), 1) - np.take_along_axis(p, order, 1)
    place = np.argsort(order, axis=1)
    # A neighbour is found if the probability visited before its part is below the limit.
    needed = np.take_along_axis(reached, np.take_along_axis(place, home[graph[probe]], 1), 1)
    router.visit = float(min(1.0, np.quantile(needed, RECALL) + 1e-9))
    return router


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, not empty, not zero, no null and no infinite or undefined component."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda v: v != 0)


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def _routed(router: Router, scale: float, sizes: np.ndarray | None, least: int):
    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            if not len(batch):
                yield pd.Series([], dtype=object)
                continue
            x = _matrix(batch) * scale
            found = [[p] for p in router.parts(x).tolist()] if sizes is None else [v.tolist() for v in router.visits(x, sizes, least)]
            yield pd.Series(found)

    return F.pandas_udf(each, "array<int>")


def best_of(queries: pd.DataFrame, rows: pd.DataFrame, k: int, visited: np.ndarray) -> pd.DataFrame:
    """The k best rows of a batch in the parts that each query visits; scores do not depend on the batches."""
    q, x = _matrix(queries["vector"]), _matrix(rows["vector"])
    ids, own, part = rows["id"].to_numpy(), queries["id"].to_numpy(), rows["part"].to_numpy(dtype=np.int64)
    out = []
    for low in range(0, len(q), 256):
        rough = q[low : low + 256] @ x.T
        rough[(own[low : low + 256, None] == ids[None, :]) | ~visited[low : low + 256][:, part]] = -np.inf
        kept = min(k, len(ids))
        edge = -np.partition(-rough, kept - 1, axis=1)[:, kept - 1]
        for i, (row, limit) in enumerate(zip(rough, edge), low):
            # Products of a block may differ in their last bits; what is near the edge is scored again, one by one.
            near = np.flatnonzero((row >= limit - 1e-9 * max(1.0, abs(limit))) & (row > -np.inf)) if limit > -np.inf else np.flatnonzero(row > -np.inf)
            score = (x[near] * q[i]).sum(axis=1)
            top = np.lexsort((ids[near], -score))[:k]
            out.append(pd.DataFrame({"query_id": own[i], "vec_id": ids[near][top], "score": score[top]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def first_of(found: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best of each query."""
    found = found.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True], kind="stable")
    return found[found.groupby("query_id").cumcount() < k]


def best_of_slices(k: int, parts: int, at_once: int):
    """A group's queries come first in its batches, then its rows."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asking, queries, visited, kept = [], None, None, None
        for frame in frames:
            asks = frame["parts"].notna()
            if asks.any():
                if queries is not None:
                    raise ValueError("queries after rows")
                asking.append(frame[asks])
            rows = frame[~asks]
            if not len(rows) or not asking:
                continue
            if queries is None:
                queries = pd.concat(asking)
                visited = np.zeros((len(queries), parts), bool)
                for i, chosen in enumerate(queries["parts"]):
                    visited[i, np.asarray(chosen, dtype=np.int64)] = True
            for low in range(0, len(rows), at_once):
                found = best_of(queries, rows.iloc[low : low + at_once], k, visited)
                if len(found):
                    kept = first_of(found if kept is None else pd.concat([kept, found]), k)
        if kept is not None:
            yield kept

    return each


def learn(rows: DataFrame, parts: int) -> tuple[Router, float]:
    """Fit the router in one task, on the ``SAMPLE`` rows with the lowest content hash; its weights reach the driver."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x = _matrix(pd.concat(list(batches))["vector"])
        router = fit(x, parts)
        values = [*router.layers, np.array([router.visit]), np.array([1 / max(float(np.abs(x).max()), 1e-300)])]
        yield pd.DataFrame({"at": range(6), "data": [v.tobytes() for v in values], "shape": [list(v.shape) for v in values]})

    sample = rows.orderBy(F.xxhash64("id", "vector"), "id").limit(SAMPLE).select("vector").coalesce(1)
    got = sorted(sample.mapInPandas(each, "at int, data binary, shape array<int>").collect())
    *layers, visit, scale = (np.frombuffer(bytes(r["data"])).reshape(list(r["shape"])) for r in got)
    return Router(list(layers), float(visit[0])), float(scale[0])


def search(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", queries: Column | None = None, k: int = 20) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest found of each query row, by inner product, ties to the smaller id.

    ``queries`` chooses query rows (default: ids divisible by 20) and all usable rows are candidates but the query's
    own id.  Rows with a null id, an unusable vector, or another dimension than most take no part; ids are whole
    numbers, and rows that share one are one another's own.
    """
    picked = F.col(id_column) % 20 == 0 if queries is None else queries
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), picked.alias("asks"))
    rows = materialize(rows.where(F.col("id").isNotNull() & usable(F.col("vector"))), "vectors")
    common = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if common is None:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    dim, total = common
    rows = rows.where(F.size("vector") == dim)
    parts = 1 if total <= PLAIN else int(min(MOST_PARTS, max(2, total // ROWS_PER_PART)))
    router, scale = learn(rows, parts) if parts > 1 else (fit(np.zeros((1, dim)), 1), 1.0)
    rows = materialize(rows.withColumn("part", _routed(router, scale, None, 0)("vector")[0]), "parts")
    counts = {r[0]: (r[1], r[2]) for r in rows.groupBy("part").agg(F.count("*"), F.count(F.when(F.col("asks"), 1))).collect()}
    sizes = np.array([counts.get(p, (0, 0))[0] for p in range(parts)])
    mod = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    query_blocks = max(1, -(-sum(c for _, c in counts.values()) // QUERIES))
    asks = rows.where("asks").withColumns({"parts": _routed(router, scale, sizes, 5 * k)("vector"), "qblock": mod(query_blocks)})
    asks = asks.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
    stored = rows.withColumns({
        "parts": F.lit(None).cast("array<int>"), "qblock": F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))), "slice": mod(SLICES),
    })
    columns = ["id", "vector", "part", "parts", "qblock", "slice"]
    met = asks.select(*columns).unionByName(stored.select(*columns)).repartition("qblock", "slice")
    # Within a group queries lie before rows; the task fails if they do not.
    met = met.sortWithinPartitions("qblock", "slice", F.col("parts").isNull())
    found = met.groupBy("qblock", "slice").applyInPandas(best_of_slices(k, parts, CANDIDATES), "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
