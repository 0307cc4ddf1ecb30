"""The operators of this folder bound to the given tables: one query each, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.llm import ann, bitplane, bpe, fim, hamming, license, packing, pii, quality, resample, simhash, suffix, toxicity
from hearthline.llm.common import table
from hearthline.storage import materialize, scratch_path


def op5_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    found = simhash.near_duplicates(table(spark, folder, "documents"), words=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


VOCABULARY = "byte_bpe_50k.json"


def vocabulary() -> str:
    """Path of the public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_bit_plane_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of all documents written in order as planes, and what is read back of them."""
    to = scratch_path(spark, "ids")
    bitplane.write(table(spark, folder, "documents"), to, vocabulary())
    return bitplane.read(spark, to).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op2_character_lstm_crf(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document: counts of the fixed patterns, their digest, and all spans."""
    found = pii.with_spans(table(spark, folder, "documents").select("doc_id", "text")).drop("text")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("pii", lambda s: s["base"])
    of_kind = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    counts = [of_kind(k).alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined("pii").alias("spans"))


def op3_length_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's pieces, counted in tokens, with their bucket and batch."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return packing.pack(docs, length=packing.tokens(vocabulary()))


def op4_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of every document that stay when all 200-byte strings found twice are removed."""
    kept = suffix.without_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return kept.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op6_learned_partitions(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest found of every vector whose id is divisible by 20."""
    return ann.search(table(spark, folder, "embeddings").select("vec_id", "embedding"))


def op7_weak_supervision(spark: SparkSession, folder: str) -> DataFrame:
    """Counts, base verdict and learned verdict of every document."""
    counted = quality.features(table(spark, folder, "documents").select("doc_id", "text")).drop("text")
    judged = quality.verdict(materialize(counted, "counts"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"
    )


def op8_streaming_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document by the streaming transducer, and their text by the incremental decoder."""
    coded = bpe.with_digests(table(spark, folder, "documents").select("doc_id", "text"), vocabulary())
    return coded.select("doc_id", "digests.*")


def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Licence of every document, its own or that of a directory above it (source, then language)."""
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return license.scan(table(spark, folder, "documents").select("doc_id", "text", path.alias("path")))


THRESHOLD = 0.7


def op10_levenshtein_lexicon(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity score and verdict of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, folder, "labels"))
    scored = toxicity.with_score(docs, model).drop("text")
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op11_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    """Form, cut widths, and digests of the transformed and the restored text of every document."""
    made = fim.transform(table(spark, folder, "documents").select("doc_id", "text"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


FIM_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units FROM documents
), n AS (
  SELECT doc_id, text, units, len(units) AS n,
         ('0x' || substr(h, 1, 8))::BIGINT % (len(units) + 1) AS u1, ('0x' || substr(h, 9, 8))::BIGINT % (len(units) + 1) AS u2,
         ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d
), p AS (
  SELECT doc_id, text, n, array_to_string(units[1:least(u1, u2)], '') AS prefix,
         array_to_string(units[least(u1, u2) + 1:greatest(u1, u2)], '') AS middle,
         array_to_string(units[greatest(u1, u2) + 1:], '') AS suffix,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM n
)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM p
"""


def op12_multi_index_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Shingle count, component and verdict of every document, linked at a similarity of 0.8 of two-word shingles."""
    return hamming.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"), words=2)


def op13_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    """Weight, score and rank of every document drawn towards the benchmark's texts."""
    return resample.resample(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_bit_plane_ids": (op1_bit_plane_ids, None),
    "op2_character_lstm_crf": (op2_character_lstm_crf, None),
    "op3_length_buckets": (op3_length_buckets, None),
    "op4_suffix_array_dedup": (op4_suffix_array_dedup, None),
    "op5_simhash_near_dedup": (op5_simhash_near_dedup, None),
    "op6_learned_partitions": (op6_learned_partitions, None),
    "op7_weak_supervision": (op7_weak_supervision, None),
    "op8_streaming_bpe": (op8_streaming_bpe, None),
    "op9_license_scan": (op9_license_scan, license.sql("concat_ws('/', source, lang, doc_id || '.txt')")),
    "op10_levenshtein_lexicon": (op10_levenshtein_lexicon, None),
    "op11_fill_in_middle": (op11_fill_in_middle, FIM_SQL),
    "op12_multi_index_minhash": (op12_multi_index_minhash, None),
    "op13_importance_resampling": (op13_importance_resampling, None),
}
