"""Validation (V1-V18): type-strict checks of raw JSON payloads on VARIANT.

A payload is parsed once with ``try_parse_json``; every field's JSON kind is
read with ``schema_of_variant`` before any cast, so ``123`` is not taken for
the string ``"123"`` and ``"0.9"`` is not taken for a number. Each check is a
named boolean column; the operator returns valid rows (typed) and rejected
rows with all their errors. Surplus keys are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.arrays import all_nonempty_strings, compact
from ..functions.names import is_reserved_skill
from ..functions.urls import is_http_url

_INT_KINDS = ["TINYINT", "SMALLINT", "INT", "BIGINT"]
_NUM_KINDS = _INT_KINDS + ["FLOAT", "DOUBLE"]
# Fixed value: UTC ISO-8601 instants in the ``Z`` form (no offsets); seconds and their fraction may be left out.
ISO_UTC_PATTERN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?Z\z"
MAX_SAFE_INTEGER = 9007199254740991


@dataclass
class Field:
    name: str
    kind: str  # nonempty_string | string_array | iso_datetime | unit_number | boolean | enum | positive_int | http_url
    optional: bool = False  # absent or JSON null allowed
    values: list[str] = field(default_factory=list)


def _is_numeric_kind(k: Column) -> Column:
    return k.isin(*_NUM_KINDS) | k.startswith("DECIMAL")


def _ntz(text: Column) -> Column:
    # digits below microseconds don't fit the type and are cut. A string cast to TIMESTAMP_NTZ never consults the session time zone, so a
    # wall-clock time inside a DST gap of that zone is kept as written
    return F.regexp_replace(F.regexp_replace(text, "Z\\z", ""), r"(\.[0-9]{6})[0-9]+\z", "$1").try_cast("timestamp_ntz")


def iso_instant_ntz(text: Column) -> Column:
    """V3: ``...Z`` text to a TIMESTAMP_NTZ of UTC wall-clock time; NULL when invalid."""
    return F.when(F.coalesce(text.rlike(ISO_UTC_PATTERN), F.lit(False)), _ntz(text))


def field_reads(sub: Column, f: Field) -> dict[str, Column]:
    """Stage 3 of validation: the raw reads of one field's sub-VARIANT ``sub`` (its kind and
    its typed value), each once. A missing key is SQL NULL, a JSON null has kind VOID."""
    path = "$"
    v = sub
    n = f.name
    reads = {f"_k_{n}": F.schema_of_variant(F.try_variant_get(v, path, "variant"))}
    if f.kind in ("nonempty_string", "enum", "http_url", "iso_datetime"):
        reads[f"_s_{n}"] = F.try_variant_get(v, path, "string")
    elif f.kind == "boolean":
        reads[f"_b_{n}"] = F.try_variant_get(v, path, "boolean")
    elif f.kind == "unit_number":
        reads[f"_d_{n}"] = F.try_variant_get(v, path, "double")
    elif f.kind == "positive_int":
        reads[f"_d_{n}"] = F.try_variant_get(v, path, "double")
        reads[f"_l_{n}"] = F.try_variant_get(v, path, "bigint")
    elif f.kind == "string_array":
        reads[f"_a_{n}"] = F.try_variant_get(v, path, "array<string>")
    else:
        raise ValueError(f"unknown field kind {f.kind}")
    return reads


def field_rule(f: Field) -> tuple[Column, Column]:
    """Stage 3: (error code or NULL, typed value) of one field from its raw reads."""
    n = f.name
    k = F.col(f"_k_{n}")
    missing = k.isNull() | (k == "VOID")
    if f.kind in ("nonempty_string", "enum", "http_url", "iso_datetime"):
        s = F.col(f"_s_{n}")
    if f.kind == "nonempty_string":
        err = F.when(k != "STRING", F.lit("type")).when(F.length(s) == 0, F.lit("empty"))
        val = s
    elif f.kind == "enum":
        err = F.when(k != "STRING", F.lit("type")).when(~s.isin(*f.values), F.lit("enum"))
        val = s
    elif f.kind == "http_url":
        err = F.when(k != "STRING", F.lit("type")).when(~is_http_url(s), F.lit("url"))
        val = s
    elif f.kind == "iso_datetime":
        ts = iso_instant_ntz(s)
        err = F.when(k != "STRING", F.lit("type")).when(ts.isNull(), F.lit("format"))
        val = ts
    elif f.kind == "boolean":
        err = F.when(k != "BOOLEAN", F.lit("type"))
        val = F.col(f"_b_{n}")
    elif f.kind == "unit_number":
        d = F.col(f"_d_{n}")
        err = (F.when(~_is_numeric_kind(k), F.lit("type"))
               .when(~F.coalesce(d.between(0.0, 1.0) & ~F.isnan(d), F.lit(False)), F.lit("range")))
        val = d
    elif f.kind == "positive_int":
        d, b = F.col(f"_d_{n}"), F.col(f"_l_{n}")
        err = (F.when(~_is_numeric_kind(k), F.lit("type"))
               .when(~F.coalesce((d == F.floor(d)) & b.isNotNull() & (F.abs(d) <= MAX_SAFE_INTEGER), F.lit(False)),
                     F.lit("type"))
               .when(b <= 0, F.lit("range")))
        val = b
    else:  # string_array
        arr = F.col(f"_a_{n}")
        err = (F.when(k == "ARRAY<VOID>", F.when(F.coalesce(F.size(arr), F.lit(1)) != 0, F.lit("element")))
               .when(k != "ARRAY<STRING>", F.lit("type"))
               .when(~all_nonempty_strings(arr), F.lit("element")))
        val = F.when(k == "ARRAY<VOID>", F.array().cast("array<string>")).otherwise(arr)
    if f.optional:
        err = F.when(~missing, err)
        val = F.when(~missing, val)
    else:
        err = F.when(missing, F.lit("missing")).otherwise(err)
    return err, val


_ERROR_TYPE = "struct<field:string,message:string>"


def error_list(named: list[tuple[str, Column]]) -> Column:
    """All failures of a row, in field order, as ARRAY<STRUCT<field, message>>."""
    return compact([(err.isNotNull(), F.struct(F.lit(name).alias("field"), err.alias("message")))
                    for name, err in named], _ERROR_TYPE)


def errors_text(errors: Column) -> Column:
    """``field:message`` pairs joined by commas (a comparable text form of V18's array)."""
    return F.array_join(F.transform(errors, lambda e: F.concat(e["field"], F.lit(":"), e["message"])), ",")


@dataclass
class Rule:
    """A whole-row rule checked only when every field passed (refinements)."""
    field: str
    message: str
    ok: callable  # (typed columns dict) -> Column


def once(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """Add ``cols`` computed exactly once per row (a Generate barrier against inlining)."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def validate(raw: DataFrame, fields: list[Field], rules: list[Rule] | None = None,
             payload_col: str = "payload", keep: list[str] | None = None,
             reserved_skill_field: str | None = None, stage_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Split raw JSON rows into (valid, rejected).

    ``valid`` keeps ``keep`` columns plus the typed fields; ``rejected`` keeps
    ``keep``, the payload and ``errors``. With ``stage_path`` the
    checked rows are written there once and both results read them, so no payload is
    parsed twice.
    """
    typed = check(raw, fields, rules, payload_col, keep, reserved_skill_field)
    if stage_path:
        typed.write.mode("overwrite").parquet(stage_path)
        typed = raw.sparkSession.read.schema(typed.schema).parquet(stage_path)
    return split(typed, fields, payload_col, keep)


def split(checked: DataFrame, fields: list[Field], payload_col: str = "payload", keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) of checked rows."""
    valid = checked.filter(F.size("errors") == 0).select(*(keep or []), *[f.name for f in fields])
    return valid, checked.filter(F.size("errors") > 0).select(*(keep or []), payload_col, "errors")


def add_errors(checked: DataFrame, errors: Column) -> DataFrame:
    """``checked`` with further ``errors`` on the rows that have none."""
    return checked.withColumn("errors", F.when(F.size("errors") > 0, F.col("errors")).otherwise(errors))


def check(raw: DataFrame, fields: list[Field], rules: list[Rule] | None = None, payload_col: str = "payload",
          keep: list[str] | None = None, reserved_skill_field: str | None = None, keep_sent: bool = False) -> DataFrame:
    """``keep``, the payload, the typed fields and ``errors`` (V18; empty: valid) of every raw row, each payload parsed once.
    With ``keep_sent`` each instant also stands as it was sent, in ``<field>_sent``: the typed one holds microseconds.

    Rules run only on rows whose fields
    all pass, and the reserved-skill check only on rows that pass everything
    else, as the service answers one error class at a time.
    """
    keep = keep or []
    # Stage 1: parse once. Stage 2: split the object into its fields. Stage 3:
    # read every field's kind and value once. Stage 4: rules. Stage 5: errors.
    # Each stage is a Generate (``inline`` of a one-row array): filters on the
    # errors cannot be pushed below it, so the parse and the field reads are
    # not copied into every use of their results.
    parsed = once(raw.select(*keep, payload_col), {"_v": F.try_parse_json(F.col(payload_col))})
    # all fields at once: an object cast to a struct of VARIANTs (surplus keys dropped)
    as_struct = "struct<" + ",".join(f"`{f.name}`:variant" for f in fields) + ">"
    split = once(parsed, {
        "_not_object": ~F.coalesce(F.schema_of_variant(F.col("_v")).startswith("OBJECT"), F.lit(False)),
        "_o": F.try_variant_get(F.col("_v"), "$", as_struct)}).drop("_v")
    reads = {}
    for f in fields:
        reads.update(field_reads(F.col("_o")[f.name], f))
    parsed = split
    raw_cols = list(reads)
    errs, vals = [], {}
    for f in fields:
        e, val = field_rule(f)
        errs.append((f.name, e))
        vals[f.name] = val
    if keep_sent:
        vals |= {f"{f.name}_sent": F.col(f"_s_{f.name}") for f in fields if f.kind == "iso_datetime"}
    typed = once(once(parsed, reads).drop("_o"), {**vals, **{f"_e_{n}": e for n, e in errs}}).drop(*raw_cols)
    field_errors = error_list([(n, F.col(f"_e_{n}")) for n, _ in errs])
    field_errors = F.when(F.col("_not_object"), F.array(F.struct(F.lit("$").alias("field"),
                                                                 F.lit("type").alias("message")))
                          ).otherwise(field_errors)
    typed = once(typed, {"errors": field_errors})
    cols = {f.name: F.col(f.name) for f in fields}
    if rules:
        rule_errs = error_list([(r.field, F.when(~F.coalesce(r.ok(cols), F.lit(False)), F.lit(r.message)))
                                for r in rules])
        typed = typed.withColumn("errors", F.when(F.size("errors") > 0, F.col("errors")).otherwise(rule_errs))
    if reserved_skill_field:
        reserved = error_list([(reserved_skill_field,
                                F.when(is_reserved_skill(F.col(reserved_skill_field)), F.lit("reserved")))])
        typed = typed.withColumn("errors", F.when(F.size("errors") > 0, F.col("errors")).otherwise(reserved))
    return typed.drop("_not_object", *[f"_e_{n}" for n, _ in errs])


# The three payload schemas of the service.
INVOCATION_FIELDS = [
    Field("skill_name", "nonempty_string"),
    Field("working_directory", "nonempty_string"),
    Field("tech_stack", "string_array"),
    Field("started_at", "iso_datetime"),
    Field("finished_at", "iso_datetime", optional=True),
    Field("status", "enum", values=["success", "failed", "unknown"]),
]

CORRECTION_FIELDS = [
    Field("skill_name", "nonempty_string"),
    Field("working_directory", "nonempty_string"),
    Field("tech_stack", "string_array"),
    Field("ai_output", "nonempty_string"),
    Field("user_correction_input", "nonempty_string"),
    Field("classification_confidence", "unit_number"),
    Field("needs_batch_review", "boolean"),
    Field("created_at", "iso_datetime"),
]

MR_FIELDS = [
    Field("mr_url", "http_url"),
    Field("title", "nonempty_string"),
    Field("head_commit_hash", "nonempty_string"),
    Field("iteration_type", "enum", values=["minor", "major"]),
    Field("feedback_id_start", "positive_int"),
    Field("feedback_id_end", "positive_int"),
    Field("status", "enum", values=["open", "merged", "closed"]),
    Field("opened_at", "iso_datetime"),
    Field("merged_at", "iso_datetime", optional=True),
]

STATUS_FIELDS = [
    Field("status", "enum", values=["open", "merged", "closed"]),
    Field("merged_at", "iso_datetime", optional=True),
]


def merged_at_consistent(status: Column, merged_at: Column) -> Column:
    """Merged needs merged_at; other statuses must not carry one."""
    return (status == "merged") == merged_at.isNotNull()


def range_ordered(start: Column, end: Column) -> Column:
    """Start <= end."""
    return start <= end


MR_RULES = [
    Rule("feedback_id_end", "range_order", lambda c: range_ordered(c["feedback_id_start"], c["feedback_id_end"])),
    Rule("merged_at", "merged_at_status", lambda c: merged_at_consistent(c["status"], c["merged_at"])),
]
STATUS_RULES = [
    Rule("merged_at", "merged_at_status", lambda c: merged_at_consistent(c["status"], c["merged_at"])),
]


def at_rest_violations(mrs: DataFrame) -> DataFrame:
    """V14 over a merge-request table: (id, check) for each failed constraint, plus
    one row per duplicated ``mr_url`` (check ``unique_mr_url``)."""
    checks = [
        ("not_null", F.col("mr_url").isNotNull() & F.col("title").isNotNull()
         & F.col("head_commit_hash").isNotNull() & F.col("opened_at").isNotNull()),
        ("iteration_type", F.col("iteration_type").isin("minor", "major")),
        ("status", F.col("status").isin("open", "merged", "closed")),
        ("range_order", F.col("feedback_id_start") <= F.col("feedback_id_end")),
    ]
    per_row = mrs.select(F.col("id"), F.explode(compact([(~F.coalesce(ok, F.lit(False)), F.lit(name))
                                                         for name, ok in checks], "string")).alias("check"))
    dups = (mrs.groupBy("mr_url").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
            .filter(F.col("n") > 1).select("id", F.lit("unique_mr_url").alias("check")))
    return per_row.unionByName(dups)


def correction_violations(corrections: DataFrame) -> DataFrame:
    """V14 over a corrections table: confidence inside [0, 1], text fields present."""
    c = F.col("classification_confidence")
    checks = [
        ("confidence_range", F.coalesce(c.between(0.0, 1.0) & ~F.isnan(c), F.lit(False))),
        ("not_null", F.col("skill_name").isNotNull() & F.col("created_at").isNotNull()
         & F.col("needs_batch_review").isNotNull()),
    ]
    return corrections.select(F.col("id"), F.explode(compact([(~ok, F.lit(name)) for name, ok in checks],
                                                              "string")).alias("check"))


def orphan_audit_rows(audit: DataFrame, mrs: DataFrame) -> DataFrame:
    """Audit rows whose merge request does not exist."""
    return audit.join(mrs.select(F.col("id").alias("merge_request_id")), "merge_request_id", "left_anti")
