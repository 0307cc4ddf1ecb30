"""Target-distribution importance resampling by an array of scores and a bisected threshold.

Every text becomes the array of its words' hash buckets.  Counts of the buckets in the corpus and in the target texts
give each bucket a gain; a document's weight is the mean gain of its array.  A Gumbel draw of the id is added, so the
highest scores are a sample without replacement in proportion to the weights.

The draw needs no global sort: the cutoff is found by bisection.  Each job counts, over the stored scores, the rows
above several thresholds at once (the midpoints of the next halvings), first of the score and then of the id among
rows tied at the cutoff score.  Only the rows above it are dealt by range and numbered.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.storage import materialize

BUCKETS = 10_000
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
#: Halvings decided by one count job: 2**4 - 1 thresholds.
HALVINGS = 4
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def buckets(text: str) -> Column:
    """Array of the words' buckets of a text column, in order and with repeats; null texts have none."""
    words = F.regexp_extract_all(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))
    return F.transform(words, lambda w: (F.crc32(w.cast("binary")) % BUCKETS).cast("smallint"))


def counts(df: DataFrame, column: str) -> list[int]:
    """Exact number of features in each bucket; at most BUCKETS numbers reach the driver, however large the table."""
    found = df.select(F.explode(column).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n")).collect()
    out = [0] * BUCKETS
    for row in found:
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: list[int], target: list[int]) -> Column:
    """Gain of each bucket as one constant array of BUCKETS whole numbers."""
    total, aimed = float(sum(corpus) + BUCKETS), float(sum(target) + BUCKETS)
    values = (math.floor(1000 * math.log((t + 1) * total / ((s + 1) * aimed))) for s, t in zip(corpus, target))
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")


def noise(id_column: str, seed: int = SEED) -> Column:
    """Gumbel draw of a document in thousandths, from its id alone; a null id counts as the empty string."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296)))


def _floor_mean(total: Column, n: Column) -> Column:
    return F.when(n > 0, ((total - F.pmod(total, n)) / n).cast("long")).otherwise(0)


def scored(docs: DataFrame, target: DataFrame, id_column: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """Stored table of id, ``n_features``, ``weight`` and ``score`` of every document against the target's texts."""
    hashed = materialize(docs.select(F.col(id_column).alias("_id"), buckets(text).alias("_buckets")), "buckets")
    aims = target.select(buckets(text).alias("_buckets"))
    table = gains(counts(hashed, "_buckets"), counts(aims, "_buckets"))
    total = F.aggregate("_buckets", F.lit(0).cast("long"), lambda acc, b: acc + table[b])
    n = F.size("_buckets").cast("long")
    weighed = hashed.select(F.col("_id").alias(id_column), n.alias("n_features"), _floor_mean(total, n).alias("weight"))
    return materialize(weighed.select("*", (F.col("weight") + noise(id_column, seed)).alias("score")), "scores")


def bisect(rows: DataFrame, column: str, want: int) -> tuple[int, int]:
    """Greatest value ``v`` such that at least ``want`` rows have ``column >= v``, and how many have more than ``v``.

    ``want`` is from 1 to the number of rows.  Every step is one job that counts exactly; only its 15 counts return.
    """
    low, high = rows.agg(F.min(column), F.max(column)).first()
    # At least ``want`` rows reach ``low``; fewer have more than ``high``.
    more = 0
    while low < high:
        cuts = sorted({low + ((high - low) * i + (1 << HALVINGS) - 1) // (1 << HALVINGS) for i in range(1, 1 << HALVINGS)} | {high})
        cuts = [c for c in cuts if c > low]
        found = rows.agg(*[F.count_if(F.col(column) >= c).alias(f"c{i}") for i, c in enumerate(cuts)]).first()
        reached = [i for i, n in enumerate(found) if n >= want]
        last = reached[-1] if reached else -1
        if last + 1 < len(cuts):
            high, more = cuts[last + 1] - 1, found[last + 1]
        low = cuts[last] if reached else low
    return low, more


def draw(rows: DataFrame, id_column: str = "doc_id", percent: int = PERCENT, least: int = LEAST_WORDS) -> DataFrame:
    """All rows of a stored ``scored`` table with their ``rank``: 1, 2, 3... for the drawn, null for all others.

    ``percent`` of the documents with ``least`` words or more are drawn, highest scores first, ties to the smaller id;
    a null id follows all others.  Rows equal in score and id are drawn in the order of their other columns.
    """
    fit = F.col("n_features") >= least
    # Ids are turned so that the smaller one is the greater key; null ids have no key and come last.
    key = -F.col(id_column).cast("decimal(20,0)")
    able = rows.where(fit)
    many = able.count() * percent // 100
    if many == 0:
        return rows.select("*", F.lit(None).cast("long").alias("rank"))
    score, above = bisect(able, "score", many)
    tied = able.where(F.col("score") == score).select(key.alias("key")).where("key is not null")
    beyond = many - above
    known = tied.count()
    if beyond <= known:
        last, _ = bisect(tied.select(F.col("key").cast("long").alias("key")), "key", beyond)
        reach = (F.col("score") > score) | ((F.col("score") == score) & (F.coalesce(key >= last, F.lit(False))))
    else:
        reach = F.col("score") >= score
    order = [F.desc("score"), F.asc_nulls_last(id_column), F.desc("weight"), F.desc("n_features")]
    ranged = able.where(reach).repartitionByRange(*order).sortWithinPartitions(*order)
    # Within a task that counter's low 33 bits number the rows in their order.
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = materialize(ranged.select("*", F.spark_partition_id().alias("_part"), place.alias("_place")), "drawn")
    before, offsets = 0, [(-1, 0)]
    for part, n in sorted(placed.groupBy("_part").agg(F.count("*")).collect()):
        offsets.append((part, before))
        before += n
    starts = F.create_map(*[F.lit(x) for pair in offsets for x in pair])
    rank = (starts[F.col("_part")] + F.col("_place") + 1).cast("long")
    rank = F.when(rank <= many, rank).alias("rank")
    drawn = placed.select(*rows.columns, rank)
    rest = rows.where(~fit | ~reach).select("*", F.lit(None).cast("long").alias("rank"))
    return drawn.unionByName(rest)


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    percent: int = PERCENT,
    least: int = LEAST_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """One row per document: id, ``n_features``, ``weight``, ``score`` and ``rank`` (null where not drawn).

    A null or empty text has no features and weight 0 and can still be drawn where ``least`` allows it.  An empty
    target makes every gain depend on the corpus alone; an empty table gives no rows.  Equal rows come back as often
    as they are there.  Other columns play no part and may have any name.
    """
    return draw(scored(docs, target, id_column, text, seed), id_column, percent, least)
