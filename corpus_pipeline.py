"""A training-corpus pipeline: each stage filters or encodes all that its predecessor kept.

language_id    rejects documents without letters (``und``) or unlike every profile
line_dedup     deletes later copies of repeated line runs; a document left with nothing goes
near_dup       one document of each group of near duplicates stays
decontaminate  documents that hold a benchmark window go
bpe            token counts and digests of what is left

All stages but the last return the columns of ``documents``; other columns, whatever their names, are dropped.
Rows equal in doc_id and text are one document to near_dup.  Nulls in any column are allowed: a null or empty
text has no language, and a null doc_id is no smallest one.  Texts are read whole, whatever their length.  An
empty table goes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from percolith.llm import bpe, decontaminate, language_id, line_dedup, near_dup
from percolith.shared import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The cut is this share of the score that all training documents but ``LOWEST`` of them reach.
SHARE, LOWEST = 0.5, 0.001


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are like the profile of a language; a document without letters goes, as does one far from every profile.

    Profiles are learned from all documents of the training fold, and the cut from their scores (a sketch of bounded
    size), so it lies well under theirs.  Where nothing could be learned no document stays.  Repeated rows each stay or go.
    """
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4
    train = docs.where(fold != 2)
    profiles = language_id.fit(train)
    known = language_id.predict(train.where("lang is not null").select("text"), profiles, keep=[]).where("lang_pred <> 'und'")
    lowest = known.agg(F.percentile_approx("score", LOWEST, 100_000)).first()[0]
    said = language_id.predict(docs, profiles, keep=COLUMNS)
    return said.where((F.col("lang_pred") != "und") & (F.col("score") >= SHARE * (lowest or 0.0))).select(*COLUMNS)


def deduplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of line runs; one that is left with nothing goes, one that had nothing stays.

    ``n_chars`` is that of the text left.  Rows without doc_id lose only what stands further up in themselves.
    """
    out = line_dedup.deduplicate(docs, carry=COLUMNS)
    out = out.where((F.col("n_removed") == 0) | (F.col("kept") != ""))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    size = F.when(F.col("n_removed") > 0, F.char_length("kept").cast("long")).otherwise(F.col("n_chars"))
    return out.select("doc_id", text.alias("text"), "lang", "source", size.alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest doc_id; rows of one id go by the hash of their text.

    Documents without words are no duplicates and all stay, those without doc_id only where no other of the group has one.
    """
    near = near_dup.near_duplicates(docs, similarity=0.8).select("_id", "_th", "component")
    order = F.struct(F.col("_id").isNull().alias("last"), F.col("_id"), F.col("_th"))
    stay = near.where("component is not null").groupBy("component").agg(F.min(order).alias("m")).select("m._id", "m._th", F.lit(False).alias("empty"))
    stay = stay.union(near.where("component is null").select("_id", "_th", F.lit(True)).distinct())
    rows = docs.select(*COLUMNS, F.col("doc_id").cast("long").alias("_d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_t"))
    kept = rows.join(stay, rows["_d"].eqNullSafe(stay["_id"]) & (rows["_t"] == stay["_th"]))
    own = F.when(F.col("empty"), F.monotonically_increasing_id()).otherwise(F.lit(-1))
    return kept.withColumn("_own", own).dropDuplicates(["_d", "_t", "_own"]).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item; with an empty benchmark all stay."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.find(docs, benchmark, keep=COLUMNS).where("not contaminated").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token count and digests of every document; a null or empty text has no tokens."""
    return bpe.encode(docs, keep=["doc_id"])


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", deduplicate_lines),
    ("near_dup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("bpe", encode),
]

#: Prefix doubling, sketches and a tokenizer are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs)
    return docs
