"""Routing corrections: turn pairing (W1), confidence and signal tagging
(F12-F15, P8, P9, V16), allow lists (J6), invoked skills (J7), scope
conflicts (A8) and scope routing (J8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.arrays import floor_div
from ..functions.routing import confidence_tier, correction_signals, review_flag

DEFAULT_TURN_BUCKET = 1024


def turn_pairs(conversations: DataFrame, bucket_turns: int = DEFAULT_TURN_BUCKET,
               user_role: str = "user", ai_role: str = "assistant") -> DataFrame:
    """Every user turn directly after an AI turn, with that AI text.

    Equal to ``lag`` over (conv_id order by turn), but a long conversation is
    not one task: turns are cut into buckets of ``bucket_turns``, and the lag runs
    inside each (conv_id, bucket) after the one exchange of the texts. Only the edges of the buckets meet again: a user turn
    that opens a bucket (its head) takes the turn that closes the previous non-empty bucket (its tail),
    so at most two rows per bucket are exchanged a second time, and a tail carries its text only if it is an AI turn.
    """
    base = conversations.select("conv_id", "turn", "role", "text", floor_div(F.col("turn"), bucket_turns).alias("_b"))
    w = Window.partitionBy("conv_id", "_b").orderBy("turn")
    seen = (base.withColumn("_prev_role", F.lag("role").over(w)).withColumn("_prev_text", F.lag("text").over(w))
            .withColumn("_first", F.lag("turn").over(w).isNull()).withColumn("_last", F.lead("turn").over(w).isNull()))
    inner = (seen.filter((F.col("role") == user_role) & (F.col("_prev_role") == ai_role))
             .select("conv_id", "turn", F.col("_prev_text").alias("ai_output"), F.col("text").alias("user_input")))
    heads = seen.filter(F.col("_first") & (F.col("role") == user_role)).select("conv_id", "_b", F.lit(0).alias("_tail"), "turn", "role", "text")
    tails = seen.filter("_last").select("conv_id", "_b", F.lit(1).alias("_tail"), "turn", "role", F.when(F.col("role") == ai_role, F.col("text")).alias("text"))
    edge = Window.partitionBy("conv_id").orderBy("_b", "_tail")
    crossing = (heads.unionByName(tails).withColumn("_prev", F.lag(F.struct("role", "text")).over(edge))
                .filter((F.col("_tail") == 0) & (F.col("_prev.role") == ai_role))
                .select("conv_id", "turn", F.col("_prev.text").alias("ai_output"), F.col("text").alias("user_input")))
    return inner.unionByName(crossing)


def tag_confidence(corrections: DataFrame) -> DataFrame:
    """Tier, expected review flag and whether the sent flag agrees."""
    c = F.col("classification_confidence")
    return corrections.select(
        "id", confidence_tier(c).alias("tier"), review_flag(c).alias("review_flag"),
        (F.col("needs_batch_review") == review_flag(c)).alias("flag_consistent"))


def tag_signals(pairs: DataFrame, families: dict[str, list[str]] | None = None,
                text_col: str = "user_input") -> DataFrame:
    """matched correction-signal families of each user input."""
    return pairs.withColumn("matched_signals", correction_signals(F.col(text_col), families))


def scope_skills(scopes: DataFrame) -> DataFrame:
    """(feedback_scope, skill) pairs of the allow lists, duplicates removed."""
    return (scopes.select("feedback_scope", F.explode(F.array_distinct("reportable_skills")).alias("skill_name"))
            .filter(F.col("skill_name").isNotNull()))


def scope_conflicts(scopes: DataFrame) -> DataFrame:
    """Skills declared by more than one scope."""
    return (scope_skills(scopes).groupBy("skill_name")
            .agg(F.count_distinct("feedback_scope").alias("scope_count"),
                 F.min("feedback_scope").alias("first_scope"), F.max("feedback_scope").alias("last_scope"))
            .filter(F.col("scope_count") > 1))


HOT_PARTS = 256


def hot_keys(rows: DataFrame, key: str, parts: int = HOT_PARTS) -> Column:
    """A map from each key that holds more than 1/``parts`` of the rows to the number of shares of that size in it: at most
    ``parts`` entries, measured by a combinable count and read inside the plan."""
    total = rows.agg(F.count(F.lit(1))).scalar()
    counts = rows.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    hot = counts.filter(F.col("_k").isNotNull() & (F.col("_n") * parts > total))
    shares = F.ceil(F.col("_n") * parts / total).cast("int")
    return hot.select("_k", shares.alias("_m")).agg(F.map_from_entries(F.collect_list(F.struct("_k", "_m")))).scalar()


def salted_join(rows: DataFrame, small: DataFrame, key: str, row_key: str = "id", how: str = "inner", parts: int = HOT_PARTS) -> DataFrame:
    """An equi-join on ``key`` that splits the rows of hot keys: each hot key's rows go to as many salts as it has shares
    (by the hash of ``row_key``), and ``small``'s rows of that key are repeated for each salt. Other keys are joined as
    they are. No broadcast is asked for, so ``small`` may grow; adaptive execution still broadcasts it where it measures small."""
    salts = F.coalesce(F.try_element_at(F.col("_hot"), F.col(key)), F.lit(1))
    hot = hot_keys(rows, key, parts)
    left = rows.withColumn("_hot", hot).withColumn("_salt", F.pmod(F.xxhash64(row_key), salts).cast("int")).drop("_hot")
    right = small.withColumn("_hot", hot).withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_hot")
    return left.join(right, [key, "_salt"], how).drop("_salt")


def invoked_only(corrections: DataFrame, invocations: DataFrame) -> DataFrame:
    """Corrections whose skill was invoked at least once."""
    return salted_join(corrections, invocations.select("skill_name").distinct(), "skill_name", how="left_semi")


def allow_list(corrections: DataFrame, scopes: DataFrame) -> DataFrame:
    """(feedback_scope, correction row) for every scope whose list holds the skill."""
    return salted_join(corrections, scope_skills(scopes), "skill_name")


def route(corrections: DataFrame, scopes: DataFrame) -> DataFrame:
    """Each correction to the single scope owning its skill; skills with no owner or
    several owners are not routed."""
    owners = (scope_skills(scopes).groupBy("skill_name")
              .agg(F.count_distinct("feedback_scope").alias("_n"), F.min("feedback_scope").alias("feedback_scope"))
              .filter(F.col("_n") == 1).drop("_n"))
    return salted_join(corrections, owners, "skill_name")
