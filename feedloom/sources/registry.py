"""Registry files: scope manifests (S6), skill lists (S7), skill catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.names import is_reserved_skill
from ..functions.scopes import js_trim
from ..schemas import SCOPES

# Fixed value: a skill file names itself on a line ``name: <skill>``.
NAME_LINE_PATTERN = r"(?m)^name:\s*(.+)$"


def read_scopes(spark: SparkSession, glob: str) -> DataFrame:
    """One manifest JSON object per file -> (feedback_scope, feedback_server_url,
    reportable_skills, file_path)."""
    return (spark.read.option("multiLine", True).schema(SCOPES).json(glob)
            .select("*", F.col("_metadata.file_path").alias("file_path")))


def skill_list_from_text(text_col: str = "value"):
    """A JSON array of strings, or an object with a ``skills`` array of strings.

    Anything else (or a list holding a non-string) gives NULL, so the caller
    can reject it; an empty array stays an empty array.
    """
    v = F.try_parse_json(F.col(text_col))
    top = F.schema_of_variant(v)
    inner = F.schema_of_variant(F.try_variant_get(v, "$.skills", "variant"))

    def as_list(kind, path):
        return (F.when(kind == "ARRAY<STRING>", F.try_variant_get(v, path, "array<string>"))
                .when(kind == "ARRAY<VOID>", F.when(F.size(F.try_variant_get(v, path, "array<string>")) == 0,
                                                    F.array().cast("array<string>"))))

    return (F.when(top.startswith("ARRAY"), as_list(top, "$"))
            .when(top.startswith("OBJECT"), as_list(inner, "$.skills")))


def read_skill_lists(spark: SparkSession, glob: str) -> DataFrame:
    """S7 over files: (file_path, skills)."""
    raw = spark.read.text(glob, wholetext=True).select("value", F.col("_metadata.file_path").alias("file_path"))
    return raw.select("file_path", skill_list_from_text("value").alias("skills"))


def skill_names(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """(path, name) from the first ``name:`` line of each skill file, trimmed;
    files without a name and reserved names are dropped."""
    name = js_trim(F.regexp_extract(F.col(content_col), NAME_LINE_PATTERN, 1))
    out = files.select(F.col(path_col).alias("path"), name.alias("name"))
    return out.filter((F.col("name") != "") & ~is_reserved_skill(F.col("name")))


def read_skill_catalog(spark: SparkSession, root: str) -> DataFrame:
    """S8 over a folder tree of ``<dir>/SKILL.md`` files."""
    files = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "SKILL.md")
             .text(root, wholetext=True)
             .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")))
    return skill_names(files)
