"""The corpus pipeline: documents pass five stages, each written as Parquet and read again by the next.

quality rules (rejected documents go) - near-duplicates (one document of each group stays) - repeated passages
(removed) - personal data (masked) - packing (pieces of documents with bucket and batch).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.llm import near, packing, pii, quality, suffix
from hearthline.llm.common import table
from hearthline.llm.queries import vocabulary
from hearthline.storage import materialize


def _wrapped(docs: DataFrame) -> DataFrame:
    """Text and id of the documents, and all their other columns out of reach of an operator's own names."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(F.struct(*others).alias("document"), "doc_id", "text")


def _restored(rows: DataFrame, docs: DataFrame, text: Column) -> DataFrame:
    """The columns of ``docs`` again, with a new text and its length."""
    changed = {"text": text, "n_chars": F.length(text).cast("long")}
    return rows.select(*[changed.get(c, F.col("document")[c]).alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither a base rule nor the learned verdict rejects."""
    kept = quality.judge(_wrapped(docs)).where("kept")
    return kept.select(*[(F.col("text") if c == "text" else F.col("document")[c]).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class linked by a five-word-shingle similarity of 0.8.

    Of rows with equal id and text one stays, also where they have no class because they have no words.
    """
    whole = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("text").isNull(), "text")
    marked = _wrapped(docs).withColumn("which", F.md5(whole))
    found = near.near_duplicates(marked.select("doc_id", "text", "which"), words=5, keep=("which",))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "which")).alias("first")
    alone = F.when(F.col("class").isNull(), F.col("which"))
    stays = materialize(found.groupBy("class", alone).agg(first).select("first.which"), "stays")
    kept = marked.join(stays, "which", "left_semi").dropDuplicates(["which"])
    return kept.select(*[(F.col("text") if c == "text" else F.col("document")[c]).alias(c) for c in docs.columns])


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 200 bytes or more that occur twice; cut at whole characters."""
    kept = suffix.without_repeats(_wrapped(docs), characters=True)
    return _restored(kept, docs, F.decode("kept", "UTF-8"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every span of personal data replaced by its kind."""
    return _restored(pii.hidden(_wrapped(docs)), docs, F.col("text"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, counted in tokens, with the bucket and batch they are packed into."""
    return packing.pack(docs.select("doc_id", "text"), length=packing.tokens(vocabulary()))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Sketches, repeated strings, a trained network and dynamic programming have no SQL form.
ORACLE_SQL = None
