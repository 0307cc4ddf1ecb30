import random
import re

import xxhash
import pytest

from hearthline.llm import simhash
from hearthline.llm.common import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text, k):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return value - (1 << 64) if value >> 63 else value


def test_fingerprint_matches_brute_force():
    rng = random.Random(1)
    texts = [None, "", " \n", "a", "A b", "a b c", "É a B c d é", " x y z\n\tq r ", "w " * 50]
    texts += [" ".join(rng.choice("abcdeéÄ") for _ in range(rng.randrange(60))) for _ in range(50)]
    texts.append(" ".join(str(rng.random()) for _ in range(66_000)))
    for text in texts:
        assert simhash.fingerprint(text, 3) == brute(text, 3)
        if len(text or "") < 1000:
            assert simhash.fingerprint(text, 5) == brute(text, 5)


def test_every_pair_in_range_shares_a_cell():
    rng = random.Random(2)
    masks = [m % (1 << 64) for m in simhash.cell_masks()]
    assert len(masks) == 20

    def embed(x):
        high = x >> 1
        low = (x | high) & simhash.LOW_BITS
        return low | (x & high & simhash.LOW_BITS) << 1

    for _ in range(3000):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randrange(4)):
            y ^= 1 << b
        assert (embed(x) ^ embed(y)).bit_count() <= (x ^ y).bit_count()
        assert any(embed(x) & m == embed(y) & m for m in masks)


def flip(value, bits):
    for b in bits:
        value ^= 1 << b
    return value - (1 << 64) if value >> 63 else value


def test_links_match_all_pairs(spark):
    rng = random.Random(3)
    values = {0, -1}
    for _ in range(60):
        center = rng.getrandbits(64)
        values |= {flip(center, rng.sample(range(64), rng.randrange(6))) for _ in range(8)}
    df = spark.createDataFrame([(v,) for v in values], "fingerprint long")
    got = {(r["a"], r["b"]) for r in simhash.links(df).collect()}
    want = {(a, b) for a in values for b in values if a < b and ((a ^ b) % (1 << 64)).bit_count() <= 3}
    assert got == want


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_union_find(spark, seed):
    rng = random.Random(seed)
    pairs = [(i, i + 1) for i in range(1, 40)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(150)] + [(7, 7)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent if root(x) != x}


def test_rows_of_a_table(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(5, base, 1), (3, base, 2), (None, base, 3), (9, None, 4), (8, "", 5), (8, "", 6), (None, "alone here now", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint long")
    out = sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in simhash.near_duplicates(df).collect())
    assert out == [(0, 0), (0, 3), (3, 3), (5, 3), (8, 8), (8, 8), (9, 8)]
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
