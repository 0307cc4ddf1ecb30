import random

import numpy as np
import pytest

from hearthline.llm import suffix


def brute(texts):
    """Spans by counting every 200-byte string."""
    seen, spans = {}, []
    data = [(t or "").encode() for t in texts]
    for d in data:
        for s in range(len(d) - suffix.LENGTH + 1):
            w = d[s : s + suffix.LENGTH]
            seen[w] = seen.get(w, 0) + 1
    for d in data:
        hit = np.zeros(len(d), bool)
        for s in range(len(d) - suffix.LENGTH + 1):
            if seen[d[s : s + suffix.LENGTH]] > 1:
                hit[s : s + suffix.LENGTH] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(int), [0]])))
        spans.append([tuple(x) for x in edges.reshape(-1, 2).tolist()])
    return spans


def words(rng, n):
    return " ".join(rng.choice(["the", "of", "añejo", "thing", "rest", "onea", "überall"]) + str(rng.randrange(60)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    passage, other = words(rng, 60), words(rng, 45)
    out = [None, "", "short", "a" * 199, "a" * 200, "b" * 1000, "ab" * 700 + "c", passage, passage]
    for _ in range(30):
        parts = [words(rng, rng.randrange(5, 80)) for _ in range(3)]
        parts.insert(rng.randrange(4), rng.choice([passage, other, passage[: rng.randrange(190, 230)], ""]))
        out.append(" ".join(parts))
    for i in range(20):  # near copies, each changed at another place
        base = out[12].split(" ")
        base[rng.randrange(len(base))] = f"edit{i % 7}"
        out.append(" ".join(base))
    out.append(words(rng, 60) * 3)
    out.append("x" * 150_000 + passage + words(rng, 3000) + "x" * 300)
    return out


def test_same_spans_as_brute_force(spark, texts):
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, kept string").repartition(5)
    rows = {r["doc_id"]: r for r in suffix.without_repeats(df).collect()}
    expected = brute(texts)
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        data = (t or "").encode()
        assert [(s["start"], s["end"]) for s in rows[i]["spans"]] == expected[i], i
        kept = np.ones(len(data), bool)
        for a, b in expected[i]:
            kept[a:b] = False
        assert bytes(rows[i]["kept"]) == bytes(np.frombuffer(data, np.uint8)[kept]), i
        assert rows[i]["n_bytes"] == len(data)


def test_null_and_equal_ids_and_repeated_rows(spark):
    long = words(random.Random(5), 100)
    df = spark.createDataFrame([(None, long), (None, long), (7, "x"), (7, None)], "doc_id long, text string")
    rows = suffix.without_repeats(df, characters=True).collect()
    assert len(rows) == 4
    assert sorted(len(r["kept"]) for r in rows) == [0, 0, 0, 1]


def test_empty_table(spark):
    assert suffix.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_characters():
    text = "aéb".encode()
    assert suffix._inward(text, np.array([[0, 2]])).tolist() == [[0, 1]]
    assert suffix._inward(text, np.array([[2, 4]])).tolist() == [[3, 4]]
    assert suffix._inward(text, np.array([[2, 3]])).tolist() == []
