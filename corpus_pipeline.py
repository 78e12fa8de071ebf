"""The corpus pipeline: quality rules, near duplicates, repeated substrings, benchmark leaks, packing.

Every stage takes ``(spark, docs, sf_dir)`` and works on all documents its predecessor kept; its result is
written as Parquet in the shared folder and read again as the next stage's ``docs``. All stages but the last
return the columns of ``documents``. Null ids, empty texts, repeated rows and empty tables have the results
that the operators define; columns beside those of ``documents`` are dropped at the start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from feedloom.llm import decontaminate, near_duplicates, packing, quality_rules, substrings
from feedloom.llm.components import stored
from feedloom.session import scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
PERCENT, SHINGLE = 80, 5


def _id():
    """The id as text, so that null is a value."""
    return F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("_id")


def _key() -> list:
    """What names a row: its id and its text's SHA-256. Rows that are equal in both have equal results in every stage."""
    return [_id(), F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)).alias("_sha")]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rejected documents; the others lose their failing lines."""
    judged = quality_rules.with_quality(docs.select(*COLUMNS), into="_quality").filter("_quality.kept")
    return judged.withColumn("text", F.col("_quality.cleaned")).withColumn(
        "n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that of the smallest id (of repeated rows, one)."""
    found = near_duplicates.near_duplicates(docs, scratch_path(spark, "pipeline-near"), percent=PERCENT, size=SHINGLE, digest=True)
    kept = found.filter("kept").select(_id(), F.col("text_sha256").alias("_sha"))
    return (docs.select(*COLUMNS, *_key()).join(kept, ["_id", "_sha"], "left_semi")
            .dropDuplicates(["_id", "_sha"]).select(*COLUMNS))


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the bytes that a smaller document holds too; a document of which no word is left goes."""
    cut = substrings.substring_dedup(docs, scratch_path(spark, "pipeline-substrings"), with_text=True)
    cut = cut.select(_id(), F.col("text_sha256").alias("_sha"), "kept_text", "n_removed").dropDuplicates(["_id", "_sha"])
    rest = docs.select("doc_id", "lang", "source", *_key()).join(cut, ["_id", "_sha"])
    return (rest.filter("n_removed = 0 or kept_text rlike '[^\\\\x20\\\\x09-\\\\x0D]'").withColumnRenamed("kept_text", "text")
            .withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    named = F.concat_ws(":", "_id", F.hex("_sha"))
    keyed = docs.select(*COLUMNS, *_key())
    found = decontaminate.decontaminate(keyed.select(named.alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"),
                                        scratch_path(spark, "pipeline-postings"))
    # stored, so that its size is known when the join is planned: while it is small, no text is exchanged
    bad, _ = stored(found.filter("contaminated").select(F.col("doc_id").alias("_bad")).distinct(), scratch_path(spark, "pipeline-leaks"))
    return keyed.join(bad, named == F.col("_bad"), "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into training sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality), ("near_duplicates", near), ("substring_dedup", substring), ("decontamination", leaks),
          ("packing", pack)]

#: SQL can express neither the min-hash components nor the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = scratch_path(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{path}/{k}-{name}")
        docs = spark.read.parquet(f"{path}/{k}-{name}")
    return docs
