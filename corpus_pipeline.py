"""From raw documents to tokens: toxicity, near-duplicates, benchmark passages, personal data, BPE.

Each stage reads what the one before has kept and written. All but the last return the columns they got;
rows without doc_id pass the near-duplicate stage, which has no id to tell them apart by, and are treated
like others elsewhere. Null and empty texts are clean and stay; an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from fathomline.llm import bpe, decontamination, pii, toxicity
from fathomline.llm.minhash import near_duplicates
from fathomline.llm.queries import fold, ranks, table
from fathomline.sources.tables import stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below one half."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), lambda doc_id: fold(doc_id, 5) != 0)
    rows = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), "text")
    return toxicity.score(rows, model, "row").where("score < 0.5").select("row.*")


def _row_keys(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_key``: the doc_id, but a hashed number above all usual ids for further texts of one id.

    Rows get the same key only if they share id and text.
    """
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    per_id = docs.groupBy("doc_id").agg(F.min(text).alias("_own"), F.max(text).alias("_last"))
    several = stage(per_id.where("_own < _last").select(F.col("doc_id").alias("_id"), "_own"), "several")
    other = F.shiftrightunsigned(F.xxhash64("doc_id", text), 2) + F.lit(1 << 62)
    key = F.when(F.col("_own").isNull() | (text == F.col("_own")), F.col("doc_id").cast("long")).otherwise(other)
    return docs.join(several, F.col("doc_id") == F.col("_id"), "left").select(*[f"`{c}`" for c in docs.columns], key.alias("_key"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the smallest id, once.

    Rows that share an id are told apart by their texts: each that is linked with nothing stays.
    """
    named = _row_keys(docs.where("doc_id IS NOT NULL"))
    found = near_duplicates(named.select("_key", "text"), id_column="_key")
    kept = stage(found.where("kept").select(F.col("doc_id").alias("_kept")).distinct(), "kept")
    row = F.struct(*[f"`{c}`" for c in docs.columns])
    rows = named.join(kept, F.col("_key") == F.col("_kept"), "left_semi").select("_key", row.alias("_row"))
    one = rows.groupBy("_key").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row")).select("_row.*")
    return one.unionByName(docs.where("doc_id IS NULL"))


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every span of personal data replaced by its kind; n_chars follows the text."""
    done = pii.redact(docs, pii.fit(docs))
    if "n_chars" not in docs.columns:
        return done
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): token ids as little-endian unsigned 32-bit integers, decoded for proof."""
    tokens = bpe.round_trip(docs, ranks(spark), public_tokenizers.PATTERN)
    return tokens.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash", drop_near_duplicates),
    ("decontamination", drop_benchmark_passages),
    ("pii", redact_personal_data),
    ("bpe", encode_tokens),
]

# Trained models and a tokenizer decide what stays and what comes out; SQL cannot express that.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, work in STAGES:
        docs = stage(work(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
