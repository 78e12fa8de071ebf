"""The registered queries of the corpus operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import scratch_path
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


@query("op1_token_counts")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op9_warc_archive")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_archive, write_archive

    path = scratch_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    back = read_archive(spark, path)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type",
                       F.col("refers_to").cast("long").alias("refers_to"))


@query("op6_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op7_quality_rules")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_report

    return quality_report(table(spark, sf_dir, "documents"))


@query("op8_decontamination")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import NEAR, decontaminate

    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), scratch_path(spark, "postings"), near=NEAR)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
                        F.size("near_items").cast("long").alias("n_near_items"))


@query("op3_license_scan")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import license_report

    return license_report(table(spark, sf_dir, "documents"))


@query("op4_quality_classifier")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_model import score, train

    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


@query("op5_near_duplicates")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_duplicates import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), scratch_path(spark, "near"), percent=85, size=3).drop("text_crc32")


@query("op2_substring_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents"), scratch_path(spark, "substrings"))


@query("op10_compact_windows")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .passages import near_passages

    return near_passages(table(spark, sf_dir, "documents"))


@query("op11_centroids")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .centroids import cluster_vectors

    found = cluster_vectors(table(spark, sf_dir, "embeddings"), scratch_path(spark, "centroids"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia",
                        F.sha2(F.col("centroid").cast("binary"), 256).alias("centroid_sha256"))


@query("op12_language_id")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .languages import identify, train

    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs)).select("doc_id", "held_out", "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


@query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic_runs import echo_plan, periodic_runs

    found = periodic_runs(table(spark, sf_dir, "documents"), rewrite=echo_plan)
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    best = F.col("strongest")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"), F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
