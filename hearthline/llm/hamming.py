"""MinHash near-duplicates by a multi-index Hamming join of b-bit signatures.

A text's signature has 56 symbols of 16 bits, each the low part of one minimum hash of its shingle set.  Two sets of
similarity s differ in a symbol with chance 1 - s, so at 0.8 they differ in about 11 of 56; pairs up to
``MAX_DISTANCE`` = 27 are sought, which a pair at exactly 0.8 exceeds in 5 of 10^7 cases.

The symbols lie in 14 chunks of four.  Were two signatures to differ twice or more in every chunk, they would differ in
28 symbols; so within distance 27 some chunk has at most one error.  The errors allowed in a chunk are enumerated by
blanking each of its four places in turn: any pair in range is equal in one of 56 views.  Joining on these views finds
every such pair; the signature distance, a longer signature of single bits and then the whole sets decide.

Groups of many near copies do not become all their pairs.  First every text is linked to the nearest of the smallest
and greatest texts of its views, in several rounds of components.  Where a view still has many pairs across components,
its texts outside the largest one are linked to the nearest of some members of that one, drawn anew each round.  Then
only texts of different components are joined, in each view those outside its largest component with the others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.llm.common import components
from hearthline.storage import discard, materialize, scratch_path

#: Similarity as a fraction: 80 / 100.
PART, WHOLE = 80, 100
CHUNKS, LANES, BITS = 14, 4, 16
MAX_DISTANCE = 2 * CHUNKS - 1
#: Rounds of linking texts to the least and greatest text of their views.
ROUNDS = 3
#: Rounds of linking texts to drawn members of the largest component of a view, members a text meets in one round, and
#: the pairs across components from which on a view takes part.  The join after them leaves no pair out.
DRAWS, DRAWN, CROWDED = 2, 16, 1024
SEED = 42
_DRAWN = np.random.default_rng(SEED)
FACTORS = _DRAWN.integers(1, 1 << 63, CHUNKS * LANES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _DRAWN.integers(0, 1 << 63, CHUNKS * LANES, dtype=np.uint64) * np.uint64(2)
#: Single bits of the longer signature and the most that may differ: at 0.8 the mean is 307, beyond the limit 1 in 10^6.
FINE_BITS, MAX_FINE = 3072, 387
#: The same for its first words, which are compared first.
BRIEF_WORDS, MAX_BRIEF = 16, 150
FINE_FACTORS = _DRAWN.integers(1, 1 << 31, FINE_BITS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
FINE_SHIFTS = _DRAWN.integers(0, 1 << 32, FINE_BITS, dtype=np.uint32)
STEP = np.uint64(0x9E3779B97F4A7C15)
WORDS = [f"w{i}" for i in range(CHUNKS)]


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a shorter text is one shingle, one without words has none."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    known: dict[bytes, int] = {t: xxhash.xxh64_intdigest(t, SEED) for t in set(tokens)}
    each = np.array([known[t] for t in tokens], np.uint64)
    width = min(words, len(tokens))
    count = len(tokens) - width + 1
    out = each[:count].copy()
    for i in range(1, width):
        out = (out ^ (out >> np.uint64(29))) * STEP + each[i : i + count]
    return np.unique(out)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The symbols of a set, four to a 64-bit word."""
    least = np.full(CHUNKS * LANES, np.iinfo(np.uint64).max, np.uint64)
    for low in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[low : low + 1024, None] * FACTORS + SHIFTS).min(axis=0), out=least)
    mixed = (least ^ (least >> np.uint64(29))) * STEP >> np.uint64(64 - BITS)
    return mixed.astype("<u2").view("<i8")


def fine_signature(hashes: np.ndarray) -> np.ndarray:
    """One bit of each of many more minimum hashes of a set, 64 to a word."""
    folded = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    least = np.full(FINE_BITS, np.iinfo(np.uint32).max, np.uint32)
    for low in range(0, len(folded), 32):
        np.minimum(least, (folded[low : low + 32, None] * FINE_FACTORS + FINE_SHIFTS).min(axis=0), out=least)
    mixed = (least ^ (least >> np.uint32(15))) * np.uint32(0x9E3779B1) >> np.uint32(31)
    return np.packbits(mixed.astype(np.uint8), bitorder="little").view("<i8")


def with_signature(df: DataFrame, text: str, words: int) -> DataFrame:
    """Add ``size`` of the shingle set, its ``key`` (equal for equal sets, null for the empty one) and its ``words``."""

    def each(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for t in batch:
                found = shingles(t, words)
                key = xxhash.xxh3_128_digest(found.tobytes(), SEED) if len(found) else None
                rows.append((len(found), key, signature(found) if len(found) else None))
            yield pd.DataFrame(rows, columns=["size", "key", "words"])

    sketch = F.pandas_udf(each, "size long, key binary, words array<long>")
    return df.withColumn("_sketch", sketch(F.col(text))).select("*", "_sketch.*").drop("_sketch")


def _of_set(text: str, words: int, what: Callable[[np.ndarray], np.ndarray]) -> Column:
    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([what(shingles(t, words)).view(np.int64) for t in batch], dtype=object)

    return F.pandas_udf(each, "array<long>")(F.col(text))


def view_masks() -> list[tuple[int, int, int]]:
    """Of each view its chunk, the mask that blanks one symbol (signed), and its number put at the blank."""
    out = []
    for chunk in range(CHUNKS):
        for lane in range(LANES):
            mask = ~(((1 << BITS) - 1) << BITS * lane) & ((1 << 64) - 1)
            tag = (chunk * LANES + lane + 1) << BITS * lane
            out.append((chunk, *(x - (1 << 64) if x >> 63 else x for x in (mask, tag))))
    return out


def views(words: list[Column]) -> Column:
    """Array of the 56 views of a signature; texts equal in one of them are candidates."""
    return F.array(*[words[c].bitwiseAND(F.lit(mask)).bitwiseOR(F.lit(tag)) for c, mask, tag in view_masks()])


def distance(a: str, b: str) -> Column:
    """Number of symbols in which the words ``a.w0``... and ``b.w0``... differ."""
    ones = F.lit(0x0001000100010001)

    def differing(word: str) -> Column:
        x = F.col(f"{a}.{word}").bitwiseXOR(F.col(f"{b}.{word}"))
        for by in (8, 4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, by))
        return F.bit_count(x.bitwiseAND(ones))

    return reduce(lambda x, y: x + y, [differing(w) for w in WORDS])


def fine_distance(a: str, b: str, part: str) -> Column:
    """Number of bits in which one part of the longer signatures differs."""
    bits = F.zip_with(f"{a}.{part}", f"{b}.{part}", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(bits, F.lit(0), lambda acc, n: acc + n)


def _first_shared(a: str, b: str) -> Column:
    """Number of the first view in which two signatures are equal."""
    both = [views([F.col(f"{side}.words")[i] for i in range(CHUNKS)]) for side in (a, b)]
    return F.array_position(F.zip_with(*both, lambda x, y: x == y), True)


def _sized(a: str, b: str) -> Column:
    """Whether two sets' sizes allow the similarity."""
    return WHOLE * F.least(f"{a}.size", f"{b}.size") >= PART * F.greatest(f"{a}.size", f"{b}.size")


class Steps:
    """Stored tables of one run; each is deleted when nothing reads it any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def store(self, df: DataFrame, name: str) -> DataFrame:
        self.drop(name)
        self.paths[name] = scratch_path(self.spark, name)
        return materialize(df, name, self.paths[name])

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.paths:
                discard(self.spark, self.paths.pop(name))


def _with_sets(keys: DataFrame, classes: DataFrame, texts: DataFrame, words: int, what: Callable, name: str, steps: Steps) -> DataFrame:
    """Stored ``what`` of the whole shingle set of each of ``keys(key)``."""
    wanted = steps.store(classes.join(keys, "key", "left_semi").select("key", "at"), "wanted")
    # Copies fall together before they are dealt out.
    whole = texts.join(wanted.select("at"), "at", "left_semi").groupBy("at").agg(F.first("_text").alias("_text"))
    return steps.store(whole.join(wanted, "at").select("key", _of_set("_text", words, what).alias(name)), name)


def _verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, words: int, steps: Steps) -> DataFrame:
    """Those of the stored ``pairs(a, b)`` whose whole sets are similar enough."""
    keys = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
    sets = _with_sets(keys, classes, texts, words, lambda h: h, "hashes", steps)
    left, right = (sets.select(F.col("key").alias(k), F.col("hashes").alias(f"_{k}")) for k in "ab")
    both = F.size(F.array_intersect("_a", "_b"))
    similar = (PART + WHOLE) * both >= PART * (F.size("_a") + F.size("_b"))
    return pairs.join(left, "a").join(right, "b").where(similar).select("a", "b")


def links(classes: DataFrame, texts: DataFrame, words: int, steps: Steps, known: DataFrame | None = None) -> DataFrame:
    """Components ``(node, root)`` of the similar classes, roots left out.

    ``classes(key, size, words, at)`` has one row per distinct set; ``texts(at, _text)`` the texts by their hash.
    ``known(a, b)``, stored, are candidates found elsewhere; they are decided first.
    """
    spark = classes.sparkSession
    symbols = [F.col("words")[i] for i in range(CHUNKS)]
    signed = classes.select("key", "size", *[c.alias(w) for c, w in zip(symbols, WORDS)])
    placed = classes.select("key", F.posexplode(views(symbols)).alias("place", "view"))
    shared = placed.groupBy("view").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high")
    members = placed.join(steps.store(shared, "shared"), "view").withColumn("place", F.col("place").cast("byte"))
    members = steps.store(members, "members")
    steps.drop("shared")
    # Round by round: every text with the nearest end of its views that is not yet in its component.
    ends = members.select("key", F.explode(F.array("low", "high")).alias("end")).where("key <> end").distinct()
    ends = ends.join(signed.alias("x"), "key").select("end", F.struct("key", "size", *WORDS).alias("x"))
    ends = ends.join(signed.select(F.col("key").alias("end"), F.struct("size", *WORDS).alias("y")), "end")
    near = ends.where(_sized("x", "y") & (distance("x", "y") <= MAX_DISTANCE))
    near = steps.store(near.select(F.col("x.key").alias("key"), "end", distance("x", "y").alias("far")), "ends")
    tested, roots = None, None
    if known is not None and known.take(1):
        given = steps.store(_verified(known, classes, texts, words, steps), "given")
        roots = steps.store(components(given), "given_roots")
        tested = known.select(F.col("a").alias("key"), F.col("b").alias("end"))
        tested = tested.unionByName(known.select(F.col("b").alias("key"), F.col("a").alias("end")))
    for turn in range(ROUNDS):
        fresh = near if roots is None else _across(near, roots, "key", "end").join(tested, ["key", "end"], "left_anti")
        best = fresh.groupBy("key").agg(F.min_by("end", F.struct("far", "end")).alias("end"))
        best = steps.store(best, f"best{turn}")
        if not best.take(1):
            break
        tested = best if tested is None else tested.unionByName(best)
        pairs = best.select(F.least("key", "end").alias("a"), F.greatest("key", "end").alias("b")).distinct()
        good = steps.store(_verified(steps.store(pairs, "pairs"), classes, texts, words, steps), f"good{turn}")
        roots = _linked(roots, good, f"roots{turn}", steps)
    steps.drop("ends", "pairs", "hashes", "wanted")
    if roots is None:
        return spark.createDataFrame([], "node binary, root binary")
    rooted = steps.store(_rooted(members.select("key", "place", "view"), roots), "rooted")
    steps.drop("members")
    mixed = steps.store(_mixed(rooted).drop("root", "main", "across"), "mixed")
    steps.drop("rooted")
    fine = _with_sets(mixed.select("key").distinct(), classes, texts, words, fine_signature, "fine", steps)
    brief = F.slice("fine", 1, BRIEF_WORDS).alias("brief"), F.slice("fine", BRIEF_WORDS + 1, FINE_BITS // 64).alias("rest")
    fine = fine.select("key", *brief)
    for turn in range(DRAWS):
        best = steps.store(_drawn(_mixed(_rooted(mixed, roots)), fine, signed, tested, turn), f"drawn{turn}")
        if not best.take(1):
            break
        tested = tested.unionByName(best)
        pairs = best.select(F.least("key", "end").alias("a"), F.greatest("key", "end").alias("b")).distinct()
        good = steps.store(_verified(steps.store(pairs, "pairs"), classes, texts, words, steps), f"fit{turn}")
        if good.take(1):
            roots = _linked(roots, good, f"drawn_roots{turn}", steps)
    mixed = _mixed(_rooted(mixed, roots)).join(fine.join(classes.select("key", "size", "words"), "key"), "key")
    mixed = steps.store(mixed, "signed")
    a, b = mixed.where("root <> main").alias("a"), mixed.alias("b")
    close = (
        (F.col("a.view") == F.col("b.view"))
        & (F.col("a.root") != F.col("b.root"))
        & ((F.col("b.root") == F.col("b.main")) | (F.col("a.key") < F.col("b.key")))
        & _sized("a", "b")
        & (fine_distance("a", "b", "brief") <= MAX_BRIEF)
        & (fine_distance("a", "b", "brief") + fine_distance("a", "b", "rest") <= MAX_FINE)
        # Of the views that a pair shares, only the first makes a row.
        & (_first_shared("a", "b") == F.col("a.place") + 1)
    )
    rest = a.join(b, close).select(F.least("a.key", "b.key").alias("a"), F.greatest("a.key", "b.key").alias("b"))
    old = tested.select(F.least("key", "end").alias("a"), F.greatest("key", "end").alias("b")).distinct()
    rest = steps.store(rest.join(old, ["a", "b"], "left_anti"), "pairs")
    steps.drop("mixed", "signed", "fine")
    if rest.take(1):
        good = steps.store(_verified(rest, classes, texts, words, steps), "good")
        roots = _linked(roots, good, "roots", steps)
    steps.drop("wanted", "hashes", "pairs")
    return roots


def _linked(roots: DataFrame | None, good: DataFrame, name: str, steps: Steps) -> DataFrame:
    """Stored components after the links ``good(a, b)``: only the roots that they join are linked anew."""
    if roots is None:
        return steps.store(components(good), name)
    ends = good
    for end in "ab":
        of = roots.select(F.col("node").alias(end), F.col("root").alias("_root"))
        ends = ends.join(of, end, "left").withColumn(end, F.coalesce("_root", end)).drop("_root")
    merged = steps.store(components(ends), "merged")
    to = merged.select(F.col("node").alias("root"), F.col("root").alias("_to"))
    moved = roots.join(to, "root", "left").select("node", F.coalesce("_to", "root").alias("root"))
    return steps.store(moved.unionByName(merged), name)


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of ``key`` with the ``root`` of its component."""
    joined = rows.join(roots.withColumnRenamed("node", "key"), "key", "left")
    return joined.withColumn("root", F.coalesce("root", "key"))


def _mixed(rooted: DataFrame) -> DataFrame:
    """Rows of views with several roots, the largest one as ``main`` and the pairs ``across`` that it makes."""
    counted = rooted.groupBy("view", "root").agg(F.count("*").alias("n"))
    most = F.max(F.struct("n", "root")).alias("most")
    largest = counted.groupBy("view").agg(most, F.sum("n").alias("rows"), F.count("*").alias("roots")).where("roots > 1")
    across = F.col("most.n") * (F.col("rows") - F.col("most.n"))
    return rooted.join(largest.select("view", F.col("most.root").alias("main"), across.alias("across")), "view")


def _drawn(mixed: DataFrame, fine: DataFrame, signed: DataFrame, tested: DataFrame, turn: int) -> DataFrame:
    """``(key, end)``: of each text outside the largest component of a crowded view the nearest drawn member not tested."""
    crowded = mixed.where(F.col("across") >= CROWDED)
    order = F.xxhash64("key", "view", F.lit(turn))
    members = crowded.where("root = main").groupBy("view").agg(F.min_by("key", order).alias("low"), F.max_by("key", order).alias("high"))
    met = crowded.where("root <> main").select("key", "view").join(members, "view")
    met = met.groupBy("key").agg(F.array_union(F.collect_set("low"), F.collect_set("high")).alias("ends"))
    some = F.slice(F.array_sort(F.transform("ends", lambda e: F.struct(F.xxhash64(e, "key", F.lit(turn)).alias("at"), e.alias("end")))), 1, DRAWN)
    met = met.select("key", F.explode(F.transform(some, lambda e: e["end"])).alias("end")).join(tested, ["key", "end"], "left_anti")
    known = fine.join(signed.select("key", "size"), "key").select("key", F.struct("size", "brief", "rest").alias("x"))
    both = met.join(known, "key").join(known.select(F.col("key").alias("end"), F.col("x").alias("y")), "end")
    far = fine_distance("x", "y", "brief") + fine_distance("x", "y", "rest")
    near = both.where(_sized("x", "y") & (fine_distance("x", "y", "brief") <= MAX_BRIEF) & (far <= MAX_FINE))
    return near.groupBy("key").agg(F.min_by("end", F.struct(far, "end")).alias("end"))


def _across(pairs: DataFrame, roots: DataFrame, a: str, b: str) -> DataFrame:
    """Those of ``pairs`` whose two ends are not of one component yet."""
    one = roots.select(F.col("node").alias(a), F.col("root").alias("_one"))
    two = roots.select(F.col("node").alias(b), F.col("root").alias("_two"))
    joined = pairs.join(one, a, "left").join(two, b, "left")
    return joined.where(F.coalesce("_one", a) != F.coalesce("_two", b)).drop("_one", "_two")


def near_duplicates(df: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = 2) -> DataFrame:
    """One row per input row: id, ``n_shingles``, ``component_id`` (smallest id reachable) and ``kept``.

    Texts are linked when their sets of ``words``-word shingles have a similarity of 0.8 or more; a text with fewer
    words is one shingle.  A null text, or one without words, has no set and is linked with nothing, not even with
    its like.  Rows with equal sets fall together before any join.  Rows with a null id take part; a component of
    null ids only has a null id, and all its rows are kept.  Equal rows come back as often as they are there and share
    ``kept``.  An empty table gives no rows.  Other columns play no part and may have any name.
    """
    steps = Steps(df.sparkSession)
    text_or_empty = F.coalesce(F.col(text), F.lit("")).alias("_text")
    texts = df.select(F.col(id_column).alias("_id"), text_or_empty).withColumn("at", F.xxhash64("_text"))
    marked = materialize(with_signature(texts, "_text", words).drop("_text"), "sketches")
    some = marked.where("size > 0")
    firsts = [F.first("size").alias("size"), F.first("words").alias("words"), F.min("at").alias("at"), F.min("_id").alias("first")]
    classes = some.groupBy("key").agg(*firsts)
    classes = steps.store(classes, "classes")
    roots = links(classes, texts.select("at", "_text"), words, steps)
    rooted = classes.select("key", "first").join(roots.withColumnRenamed("node", "key"), "key", "left")
    rooted = steps.store(rooted.withColumn("root", F.coalesce("root", "key")), "named")
    lowest = steps.store(rooted.groupBy("root").agg(F.min("first").alias("lowest")), "lowest")
    named = materialize(rooted.join(lowest, "root").select("key", "lowest"), "components")
    for name in list(steps.paths):
        steps.drop(name)
    out = marked.join(named, "key", "left")
    component = F.when(F.col("size") > 0, F.col("lowest")).otherwise(F.col("_id"))
    return out.select(
        F.col("_id").alias(id_column),
        F.col("size").alias("n_shingles"),
        component.alias("component_id"),
        F.col("_id").eqNullSafe(component).alias("kept"),
    )
