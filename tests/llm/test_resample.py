import hashlib
import math
import random
import re
import zlib
from collections import Counter

from hearthline.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [zlib.crc32(w.encode()) % 10000 for w in WORD.findall(text)]


def brute(docs, target, percent=10, least=20):
    each = [(i, features(t)) for i, t in docs]
    s = Counter(b for _, f in each for b in f)
    t = Counter(b for x in target for b in features(x))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n_s + 10000.0) / ((s[b] + 1) * (n_t + 10000.0))))
    rows = []
    for i, f in each:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(f), weight, score, None])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[2], -r[1]))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = rank
    return sorted(map(tuple, rows), key=str)


def told(out):
    return sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in out.collect()), key=str)


def made(seed, n):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß19") for _ in range(rng.randrange(1, 7))) for _ in range(400)]
    text = lambda: rng.choice([" ", ", ", "\n", "-"]).join(rng.choices(vocabulary, k=rng.randrange(60)))
    docs = [(i, text().title() if i % 7 else text()) for i in range(n)]
    return docs + [(n, None), (n + 1, ""), (n + 2, "\x00?!"), (n + 3, "long " * 50_000)], [text() for _ in range(30)] + [None, ""]


def test_rows_match_brute_force(spark):
    docs, target = made(1, 600)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, score long, _buckets string").repartition(4)
    aims = spark.createDataFrame([(t,) for t in target], "text string")
    assert told(resample.resample(df, aims)) == brute(docs, target)


def test_repeated_rows_ties_and_null_ids(spark):
    docs, target = made(2, 90)
    docs = docs * 3 + [(7, t) for _, t in docs[:40]] + [(None, t) for _, t in docs[:60]]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    aims = spark.createDataFrame([(t,) for t in target], "text string")
    stored = resample.scored(df, aims).cache()
    for percent in (0, 1, 10, 37, 100):
        got = told(resample.draw(stored, percent=percent))
        assert got == brute(docs, target, percent)


def test_draw_splits_ties_by_id(spark):
    rows = [(i, 30, 0, 5 if i < 70 else 9 if i < 75 else 1) for i in range(100)]
    rows += [(None, 30, 0, 5)] * 3
    df = spark.createDataFrame(rows, "doc_id long, n_features long, weight long, score long").repartition(6)
    ranked = {r["rank"]: r["doc_id"] for r in resample.draw(df, percent=20).collect() if r["rank"]}
    assert [ranked[i] for i in range(1, 21)] == [70, 71, 72, 73, 74, *range(15)]
    ranked = [r["doc_id"] for r in resample.draw(df, percent=75).collect() if r["rank"]]
    assert len(ranked) == 77 and ranked.count(None) == 2


def test_bisection_finds_the_cutoff(spark):
    rng = random.Random(3)
    for spread in (1, 5, 10**6, 10**15):
        values = [rng.randrange(-spread, spread + 1) for _ in range(200)]
        df = spark.createDataFrame([(v,) for v in values], "v long").cache()
        for want in (1, 2, 77, 199, 200):
            cut, more = resample.bisect(df, "v", want)
            assert cut == sorted(values, reverse=True)[want - 1] and more == sum(v > cut for v in values)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c"), (2, "word " * 30)], "doc_id long, text string")
    assert resample.resample(empty, some).count() == 0
    assert told(resample.resample(some, empty)) == brute([(1, "a b c"), (2, "word " * 30)], [])
