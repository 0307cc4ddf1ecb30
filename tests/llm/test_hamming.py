import random
import re
from itertools import combinations

import numpy as np
from hearthline.llm import hamming

LETTERS = "abcdefghijklmnop"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text, k):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) or frozenset([tuple(words)])


def brute(rows, k):
    sets, parent = [grams(t, k) for _, t in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            parent[root(i)] = root(j)
    lowest = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            lowest[root(i)] = min(d, lowest.get(root(i), d))
    out = []
    for i, (d, _) in enumerate(rows):
        c = lowest.get(root(i)) if sets[i] else d
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=str)


def word(rng):
    return "".join(rng.choice(LETTERS) for _ in range(6))


def edited(rng, words, edits):
    out = list(words)
    for at in rng.sample(range(len(out)), edits):
        out[at] = word(rng)
    return out


def told(out):
    return sorted((tuple(r[c] for c in ("doc_id", "n_shingles", "component_id", "kept")) for r in out.collect()), key=str)


def corpus(seed):
    rng = random.Random(seed)
    texts = [None, "", " \n", "one", "one", "ONE", "one two", "One\ttwo", "three little words", "é É", "é é"]
    for edits in [0, 1, 2, 3, 5, 8, 10, 12, 15, 18, 20, 25, 30]:
        for _ in range(4):
            words = [word(rng) for _ in range(rng.randrange(60, 300))]
            texts += [" ".join(words), " ".join(edited(rng, words, edits)), " ".join(edited(rng, words, edits)).upper()]
    for _ in range(60):
        words = [rng.choice("abc") for _ in range(rng.randrange(1, 12))]
        texts.append(" ".join(words))
    # A chain of copies of copies, and a wide group about one text.
    words = [word(rng) for _ in range(200)]
    texts += [" ".join(words := edited(rng, words, 6)) for _ in range(15)]
    base = [word(rng) for _ in range(150)]
    texts += [" ".join(edited(rng, base, rng.randrange(2, 16))) for _ in range(80)]
    texts.append(" ".join(base[:20]) + " tail" * 20_000)
    return list(enumerate(texts))


def test_classes_match_brute_force(spark):
    for seed, k in ((1, 2), (3, 5)):
        rows = corpus(seed)
        df = spark.createDataFrame([(i, t, "a", b"b") for i, t in rows], "doc_id long, text string, size string, key binary").repartition(6)
        assert told(hamming.near_duplicates(df, words=k)) == brute(rows, k)


def test_repeated_rows_and_null_ids(spark):
    rows = [(5, "a b c d"), (5, "a b c d"), (3, "A b c d"), (None, "a b c d"), (None, "x y z"), (9, None), (9, None), (8, ""), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = [
        (5, 3, 3, False), (5, 3, 3, False), (3, 3, 3, True), (None, 3, 3, False), (None, 2, None, True),
        (9, 0, 9, True), (9, 0, 9, True), (8, 0, 8, True), (None, 0, None, True),
    ]
    assert told(hamming.near_duplicates(df)) == sorted(want, key=str)


def test_empty_and_unlinked_tables(spark):
    assert hamming.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(1, None), (2, "")]
    assert told(hamming.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_every_signature_in_range_shares_a_view(spark):
    rng = np.random.default_rng(7)
    masks = hamming.view_masks()
    assert len(masks) == 56
    pairs = []
    for far in [*range(28), 40]:
        for _ in range(20):
            a = rng.integers(0, 1 << 16, 56, dtype=np.uint16)
            b = a.copy()
            at = rng.choice(56, far, replace=False)
            b[at] ^= rng.integers(1, 1 << 16, far, dtype=np.uint16)
            x, y = a.view("<i8"), b.view("<i8")
            if far <= hamming.MAX_DISTANCE:
                assert any(x[c] & m == y[c] & m for c, m, _ in masks)
            pairs.append((far, *map(int, x), *map(int, y)))
    names = [f"w{i}" for i in range(14)]
    df = spark.createDataFrame(pairs, "far int, " + ", ".join(f"a_{n} long" for n in names) + ", " + ", ".join(f"b_{n} long" for n in names))
    from pyspark.sql import functions as F

    both = df.select("far", F.struct(*[F.col(f"a_{n}").alias(n) for n in names]).alias("a"), F.struct(*[F.col(f"b_{n}").alias(n) for n in names]).alias("b"))
    assert both.where(hamming.distance("a", "b") != F.col("far")).count() == 0


def test_signature_estimates_similarity():
    rng = random.Random(8)
    words = [word(rng) for _ in range(400)]
    far = []
    for _ in range(200):
        a, b = (hamming.shingles(" ".join(edited(rng, words, 22)), 2) for _ in "ab")
        s = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        x, y = (hamming.signature(h).view("<u2") for h in (a, b))
        far.append(((x != y).mean(), 1 - s))
    got, want = np.mean(far, axis=0)
    assert abs(got - want) < 0.02
    assert all(f * 56 <= hamming.MAX_DISTANCE for (f, d) in far if d <= 0.2)


def test_long_signature_keeps_pairs_at_the_limit():
    rng = random.Random(9)
    for size in (20, 200, 1000):
        words = [word(rng) for _ in range(size)]
        for _ in range(40):
            a, b = (hamming.shingles(" ".join(edited(rng, words, max(1, size // 20))), 2) for _ in "ab")
            s = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            x, y = (hamming.fine_signature(h).view(np.uint8) for h in (a, b))
            far = int(np.unpackbits(x ^ y).sum())
            assert abs(far / 1536 - (1 - s)) < 0.08
            assert s < 0.8 or far <= hamming.MAX_FINE
            assert s < 0.8 or np.unpackbits((x ^ y)[: 8 * hamming.BRIEF_WORDS]).sum() <= hamming.MAX_BRIEF


def test_texts_far_from_the_ends_of_their_views_are_linked_before_the_join(spark, monkeypatch):
    """The last join made 6,312 pairs here, most of texts that a few more links put into one component."""
    draw, left = random.Random(7), []
    base = [f"w{i}" for i in range(80)]
    texts = []
    for i in range(360):
        words = list(base)
        for j, at in enumerate(draw.sample(range(80), 1 + i % 4)):
            words[at] = f"x{i}n{j}"
        texts.append((i, " ".join(words)))
    store = hamming.Steps.store

    def counted(self, df, name):
        out = store(self, df, name)
        if name == "pairs":
            left.append(out.count())
        return out

    monkeypatch.setattr(hamming.Steps, "store", counted)
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in hamming.near_duplicates(rows).collect()}
    assert got == {d: c for d, _, c, _ in brute(texts, 2)}
    assert left[-1] < 4000
