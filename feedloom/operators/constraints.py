"""The stored tables' constraints as one list, checked in one pass per table.

NOT NULL follows from the table schemas; checks, keys and references are stated below. As in SQL a check
fails only where it is false (a NULL is for NOT NULL to report), and NULL keys never repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.arrays import compact
from ..schemas import CORRECTIONS, INVOCATION_STATUSES, INVOCATIONS, ITERATION_TYPES, MERGE_REQUESTS, MR_STATUSES, PURGE_AUDIT

SCHEMAS = {"invocations": INVOCATIONS, "corrections": CORRECTIONS, "merge_requests": MERGE_REQUESTS, "purge_audit": PURGE_AUDIT}


def _one_of(col: str, values: list[str]) -> str:
    return f"{col} IN ({', '.join(repr(v) for v in values)})"


CHECKS = {
    "invocations": {"status": _one_of("status", INVOCATION_STATUSES)},
    "corrections": {"confidence_range": "classification_confidence >= 0 AND classification_confidence <= 1"},
    "merge_requests": {"iteration_type": _one_of("iteration_type", ITERATION_TYPES), "status": _one_of("status", MR_STATUSES),
                       "range_order": "feedback_id_start <= feedback_id_end"},
    "purge_audit": {},
}
UNIQUE = {"invocations": ["id"], "corrections": ["id"], "merge_requests": ["id", "mr_url"], "purge_audit": ["id"]}
REFERENCES = {("purge_audit", "merge_request_id"): ("merge_requests", "id")}


def row_violations(table: str, rows: DataFrame) -> DataFrame:
    """(table_name, id, check): failed NOT NULLs and checks, one pass without a shuffle."""
    failed = [(F.col(f.name).isNull(), F.lit(f"not_null:{f.name}")) for f in SCHEMAS[table].fields if not f.nullable]
    failed += [(~F.expr(cond), F.lit(f"check:{name}")) for name, cond in CHECKS[table].items()]
    return rows.select(F.lit(table).alias("table_name"), "id", F.explode(compact(failed, "string")).alias("check"))


def key_violations(table: str, rows: DataFrame) -> DataFrame:
    """One row per repeated key, with its smallest id (a combinable count per key)."""
    parts = [rows.filter(F.col(k).isNotNull()).groupBy(F.col(k).alias("_key")).agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("id"))
             .filter("_n > 1").select(F.lit(table).alias("table_name"), "id", F.lit(f"unique:{k}").alias("check")) for k in UNIQUE[table]]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def reference_violations(tables: dict[str, DataFrame]) -> list[DataFrame]:
    """Rows that name a row which does not exist."""
    out = []
    for (table, col), (target, key) in REFERENCES.items():
        if table in tables and target in tables:
            known = tables[target].select(F.col(key).alias(col))
            lost = tables[table].filter(F.col(col).isNotNull()).join(known, col, "left_anti")
            out.append(lost.select(F.lit(table).alias("table_name"), "id", F.lit(f"references:{col}").alias("check")))
    return out


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, id, check) of every constraint that the tables (by name) break."""
    parts = [f(name, rows) for name, rows in tables.items() for f in (row_violations, key_violations)] + reference_violations(tables)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
