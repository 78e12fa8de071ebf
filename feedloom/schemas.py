"""Explicit schemas of the stored tables.

Instants are ``TIMESTAMP_NTZ`` holding UTC wall-clock time: inputs must be in
the ``...Z`` form, so the zone is fixed and results do not depend on the
session time zone.
"""

from pyspark.sql import types as T

_S = T.StringType()
_L = T.LongType()
_TS = T.TimestampNTZType()

INVOCATIONS = T.StructType([
    T.StructField("id", _L, False),
    T.StructField("skill_name", _S, False),
    T.StructField("working_directory", _S, False),
    T.StructField("tech_stack", T.ArrayType(_S, True), False),
    T.StructField("started_at", _TS, False),
    T.StructField("finished_at", _TS, True),
    T.StructField("status", _S, False),
])

CORRECTIONS = T.StructType([
    T.StructField("id", _L, False),
    T.StructField("skill_name", _S, False),
    T.StructField("working_directory", _S, False),
    T.StructField("tech_stack", T.ArrayType(_S, True), False),
    T.StructField("ai_output", _S, False),
    T.StructField("user_correction_input", _S, False),
    T.StructField("classification_confidence", T.DoubleType(), False),
    T.StructField("needs_batch_review", T.BooleanType(), False),
    T.StructField("created_at", _TS, False),
])

MERGE_REQUESTS = T.StructType([
    T.StructField("id", _L, False),
    T.StructField("mr_url", _S, False),
    T.StructField("title", _S, False),
    T.StructField("head_commit_hash", _S, False),
    T.StructField("iteration_type", _S, False),
    T.StructField("feedback_id_start", _L, False),
    T.StructField("feedback_id_end", _L, False),
    T.StructField("status", _S, False),
    T.StructField("opened_at", _TS, False),
    T.StructField("merged_at", _TS, True),
    T.StructField("purged_at", _TS, True),
])

PURGE_AUDIT = T.StructType([
    T.StructField("id", _L, False),
    T.StructField("merge_request_id", _L, False),
    T.StructField("feedback_id_start", _L, False),
    T.StructField("feedback_id_end", _L, False),
    T.StructField("deleted_count", _L, False),
    T.StructField("purged_at", _TS, False),
])

SCOPES = T.StructType([
    T.StructField("feedback_scope", _S, True),
    T.StructField("feedback_server_url", _S, True),
    T.StructField("reportable_skills", T.ArrayType(_S, True), True),
])

LAST_SEEN = T.StructType([
    T.StructField("scope", _S, False),
    T.StructField("head_commit_hash", _S, True),
])

MR_COLUMNS = [f.name for f in MERGE_REQUESTS.fields]
CORRECTION_COLUMNS = [f.name for f in CORRECTIONS.fields]
INVOCATION_COLUMNS = [f.name for f in INVOCATIONS.fields]

# Fixed values of the domain (must equal the reference's for right results).
INVOCATION_STATUSES = ["success", "failed", "unknown"]
MR_STATUSES = ["open", "merged", "closed"]
ITERATION_TYPES = ["minor", "major"]
