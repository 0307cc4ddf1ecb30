import numpy as np
import pytest

from hearthline.llm import ann


def brute(ids, x, k=20):
    out = {}
    for i, q in zip(ids, x):
        if i % 20 == 0:
            score = (x * q).sum(axis=1)
            order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def frame(spark, ids, x, more=()):
    rows = [(int(i), [float(c) for c in v], "r") for i, v in zip(ids, x)] + list(more)
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string").repartition(4)


def results(df):
    out = {}
    for r in sorted(ann.search(df).collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_small_tables_are_searched_whole(spark):
    rng = np.random.default_rng(1)
    ids = rng.permutation(400)
    x = rng.normal(size=(400, 8)).astype(np.float32).astype(np.float64)
    x[50:90] = x[50]  # ties
    odd = [(None, [1.0] * 8, "x"), (1000, None, "x"), (1020, [0.0] * 8, "x"), (1040, [1.0, None] * 4, "x"), (1060, [float("nan")] * 8, "x"), (1080, [float("inf")] * 8, "x"), (1100, [], "x"), (1120, [1.0] * 3, "x")]
    got, want = results(frame(spark, ids, x, odd)), brute(ids, x)
    assert got == want
    few = results(frame(spark, ids[:5] * 20, x[:5]))
    assert all(len(v) == 4 for v in few.values()) and len(few) == 5
    assert results(frame(spark, [], [], odd)) == {}


@pytest.mark.parametrize("clustered", [True, False])
def test_recall_and_scores(spark, monkeypatch, clustered):
    monkeypatch.setattr(ann, "CANDIDATES", 300)
    monkeypatch.setattr(ann, "QUERIES", 60)
    rng = np.random.default_rng(2)
    n = 4000
    x = rng.normal(size=(n, 16))
    if clustered:
        x = rng.normal(size=(30, 16))[rng.integers(0, 30, n)] + 0.3 * x
        x[: n // 3] = x[0] + 0.001 * rng.normal(size=(n // 3, 16))
    x = x.astype(np.float32).astype(np.float64)
    ids = rng.permutation(n)
    got, want = results(frame(spark, ids, x)), brute(ids, x)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9
    exact = {i: v for i, v in zip(ids.tolist(), x)}
    for q, found in got.items():
        assert [s for _, s in found] == [float((exact[i] * exact[q]).sum()) for i, _ in found]
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))


def test_a_slice_gives_out_at_most_k_rows_a_query(spark, monkeypatch):
    import pandas as pd

    monkeypatch.setattr(ann, "QUERIES", 7)
    rng = np.random.default_rng(4)
    ids, x = np.arange(300), rng.integers(-3, 4, (300, 4)).astype(float) + 0.5
    assert results(frame(spark, ids, x)) == brute(ids, x)
    queries = pd.DataFrame({"id": [0, 20], "vector": [x[0], x[20]], "part": [0, 0], "parts": [[0, 1], [1]]})
    rows = pd.DataFrame({"id": ids, "vector": list(x), "part": ids % 3, "parts": None})
    found = pd.concat(ann.best_of_slices(5, 3, 16)(iter([queries, rows[:100], rows[100:]])))
    assert found.groupby("query_id").size().to_dict() == {0: 5, 20: 5}
    for q, parts in ((0, [0, 1]), (20, [1])):
        allowed = [i for i in ids if i % 3 in parts and i != q]
        best = sorted(allowed, key=lambda i: (-(x[i] * x[q]).sum(), i))[:5]
        assert found[found.query_id == q].vec_id.tolist() == best
