import random
from itertools import combinations

import pytest

from hearthline.llm import packing


def padding(histogram, ends):
    return sum(c * (min(e for e in ends if e >= n) - n) for n, c in histogram.items())


def test_boundaries_are_optimal():
    rng = random.Random(1)
    for _ in range(60):
        lengths = rng.sample(range(1, 40), rng.randrange(1, 9))
        histogram = {n: rng.randrange(1, 30) for n in lengths}
        for buckets in (1, 2, 3, 5):
            ends = packing.boundaries(histogram, buckets)
            assert len(ends) <= buckets and ends[-1] == max(lengths)
            tried = [padding(histogram, (*c, max(lengths))) for k in range(buckets) for c in combinations(sorted(lengths)[:-1], k)]
            assert padding(histogram, ends) == min(tried)
    assert packing.boundaries({}, 4) == [] and packing.boundaries({0: 9}, 4) == []


def test_every_token_in_one_sequence_and_batches_within_budget(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 50)
    rng = random.Random(2)
    sizes = [0, 0, 1, 700, 100, 99, 101] + [rng.randrange(1, 150) for _ in range(400)] + [40] * 200
    rows = [(i if i % 50 else None, " ".join(["w"] * n) if n or i else None, "x") for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "doc_id long, text string, bucket string").repartition(4)
    out = packing.pack(df, max_length=100, buckets=5, budget=400).collect()
    assert sum(r["n_tokens"] for r in out) == sum(sizes)
    assert sum(r["n_tokens"] == 0 for r in out) == sizes.count(0) == sum(r["bucket"] is None for r in out)
    batches = {}
    for r in out:
        if r["bucket"] is not None:
            assert r["n_tokens"] <= r["bucket"] <= 100
            batches.setdefault((r["bucket"], r["shard"], r["batch"]), []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) and len(s) * b <= 400 for (b, _, _), s in batches.items())
    # All batches but the last of a shard are full.
    last = {}
    for b, s, n in batches:
        last[b, s] = max(last.get((b, s), 0), n)
    assert all(len(v) == 400 // b for (b, s, n), v in batches.items() if n < last[b, s])
    for i in {r["doc_id"] for r in out if r["doc_id"] is not None}:
        own = sorted((r["start"], r["n_tokens"]) for r in out if r["doc_id"] == i)
        assert [s for s, _ in own] == [100 * k for k in range(len(own))] and sum(n for _, n in own) == sizes[i]


def test_empty_table_and_bad_budget(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(empty).count() == 0
    with pytest.raises(ValueError):
        packing.pack(empty, budget=10)
