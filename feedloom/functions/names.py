"""Skill-name rules."""

from pyspark.sql import Column, functions as F

# Fixed value: the reserved rule-package skill name pattern. ``\z`` instead of
# ``$`` so a name with a final newline is not taken for a reserved one.
RESERVED_SKILL_PATTERN = r"^feedback-rules(?:-.+)?\z"


def is_reserved_skill(name: Column) -> Column:
    """V9: ``feedback-rules`` and ``feedback-rules-<x>`` are reserved."""
    return F.coalesce(name.rlike(RESERVED_SKILL_PATTERN), F.lit(False))
