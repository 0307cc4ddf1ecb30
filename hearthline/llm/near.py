"""Near-duplicate documents of a corpus: SimHash neighbours first, then what fingerprints cannot reach.

The popcount embedding and grid range-join of ``simhash`` propose texts whose fingerprints differ in three bits or
fewer.  At a similarity of 0.8 two fingerprints differ in about a sixth of their bits, so this alone finds exact and
very close copies only.  The multi-index join of ``hamming`` then joins the components that SimHash left apart.
Every link, wherever it was proposed, is decided on the whole sets of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm import hamming, simhash
from hearthline.storage import materialize


def with_sketches(df: DataFrame, text: str, words: int) -> DataFrame:
    """Add ``size``, ``key`` and ``words`` as ``hamming.with_signature`` does, and the fingerprint of ``simhash``.

    One function for both, so that a task keeps one Python worker.
    """

    def each(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for t in batch:
                found = hamming.shingles(t, words)
                some = len(found) > 0
                key = xxhash.xxh3_128_digest(found.tobytes(), hamming.SEED) if some else None
                rows.append((len(found), key, hamming.signature(found) if some else None, simhash.fingerprint(t, words)))
            yield pd.DataFrame(rows, columns=["size", "key", "words", "fingerprint"])

    sketch = F.pandas_udf(each, "size long, key binary, words array<long>, fingerprint long")
    return df.withColumn("_sketch", sketch(F.col(text))).select("*", "_sketch.*").drop("_sketch")


def proposed(classes: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of keys with equal or close fingerprints: every key with at most two others.

    ``classes(key, fingerprint)``.  A key meets the smallest key of its fingerprint, and that one the smallest key of
    the smallest fingerprint within range, so a group of many close copies makes no more pairs than it has members.
    """
    first = classes.groupBy("fingerprint").agg(F.min("key").alias("first"))
    equal = classes.join(first, "fingerprint").select(F.col("first").alias("a"), F.col("key").alias("b"))
    lowest = simhash.links(first.select("fingerprint")).groupBy(F.col("b").alias("fingerprint")).agg(F.min("a").alias("low"))
    here = lowest.join(first, "fingerprint").select(F.col("first").alias("a"), F.col("low").alias("fingerprint"))
    close = here.join(first, "fingerprint").select("a", F.col("first").alias("b"))
    pairs = equal.unionByName(close).where("a <> b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(df: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = 5, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id, ``class`` and ``keep`` columns.

    Rows of one class are connected by texts whose sets of ``words``-word shingles have a similarity of 0.8 or more; a
    shorter text is one shingle.  A text without words (null, empty, blank) has no class (null) and is linked with
    nothing.  Null and equal ids, and equal rows, take part like any others.  An empty table gives no rows.
    """
    steps = hamming.Steps(df.sparkSession)
    text_or_empty = F.coalesce(F.col(text), F.lit("")).alias("_text")
    texts = df.select(F.col(id_column), text_or_empty, *keep).withColumn("at", F.xxhash64("_text"))
    marked = materialize(with_sketches(texts, "_text", words).drop("_text"), "sketches")
    least = [F.first("size").alias("size"), F.first("words").alias("words"), F.min("at").alias("at"), F.min("fingerprint").alias("fingerprint")]
    classes = steps.store(marked.where("size > 0").groupBy("key").agg(*least), "classes")
    known = steps.store(proposed(classes.select("key", "fingerprint")), "proposed")
    roots = hamming.links(classes.drop("fingerprint"), texts.select("at", "_text"), words, steps, known)
    named = classes.select("key").join(roots.withColumnRenamed("node", "key"), "key", "left")
    named = materialize(named.select("key", F.coalesce("root", "key").alias("class")), "named")
    steps.drop(*list(steps.paths))
    return marked.select(id_column, "key", *keep).join(named, "key", "left").select(id_column, "class", *keep)
