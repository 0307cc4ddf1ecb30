import random

from hearthline.llm import near

LETTERS = "abcdefghijklmnop"


def grams(text, k=5):
    words = text.lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def edited(rng, words, edits):
    out = list(words)
    for at in rng.sample(range(len(out)), edits):
        out[at] = "".join(rng.choice(LETTERS) for _ in range(7))
    return out


def test_classes_match_brute_force_for_one_to_many_edits(spark):
    rng = random.Random(5)
    texts = ["", "one two", "one two", "three little words"]
    for edits in [0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12]:
        for _ in range(4):
            words = ["".join(rng.choice(LETTERS) for _ in range(6)) for _ in range(rng.randrange(60, 300))]
            texts += [" ".join(words), " ".join(edited(rng, words, edits)), " ".join(edited(rng, words, edits)).upper()]
    # A chain of copies of copies, and a group whose texts also share a long passage with other texts.
    words = ["".join(rng.choice(LETTERS) for _ in range(6)) for _ in range(200)]
    for _ in range(12):
        words = edited(rng, words, 3)
        texts.append(" ".join(words))
    texts += [" ".join(words[:60] + ["".join(rng.choice(LETTERS) for _ in range(6)) for _ in range(100)]) for _ in range(12)]
    sets, parent, close = [grams(t) for t in texts], list(range(len(texts))), 0

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
                close += 0 < i and sets[i] != sets[j]
    assert close > 40
    rows = [(i, t or None) for i, t in enumerate(texts)]
    out = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    got, want = {}, {}
    for r in out:
        got.setdefault(r["class"], set()).add(r["doc_id"])
    assert got[None] == {0}
    for i in range(len(texts)):
        want.setdefault(root(i), set()).add(i)
    assert len(out) == len(texts)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_near_copy_leaves_the_corpus(spark):
    import corpus_pipeline

    rng = random.Random(9)
    words = ["".join(rng.choice(LETTERS) for _ in range(6)) for _ in range(248)]
    other = list(words)
    other[80], other[170] = "changed", "words"
    rows = [(917, " ".join(other)), (596, " ".join(words)), (None, None), (3, "alone")]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(r["doc_id"] or 0 for r in kept) == [0, 3, 596]


def test_edges_of_rows_and_columns(spark):
    schema = "doc_id long, text string, key string, class string, size string"
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(None, words, "k", "c", "s"), (None, words, "k", "c", "s"), (7, words.upper(), "l", "d", "t"), (8, " \n", "m", "e", "u"), (9, None, None, None, None)]
    out = near.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    found = [(r["doc_id"], r["class"]) for r in out]
    assert len(found) == 5 and len({c for i, c in found if i in (None, 7)}) == 1
    assert {i for i, c in found if c is None} == {8, 9}
    assert near.near_duplicates(spark.createDataFrame([], schema)).collect() == []


def test_proposed_pairs_do_not_grow_with_the_square(spark):
    rows = [(f"{i:04d}".encode(), i % 2) for i in range(300)]
    assert near.proposed(spark.createDataFrame(rows, "key binary, fingerprint long")).count() <= 600
