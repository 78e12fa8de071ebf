"""Scope registry rules: URL normalising (F6), skill-list split (F7),
registry field checks (V17) and the upgrade decision (F17)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import urls
from .names import is_reserved_skill
from .text import js_trim

# Fixed value: scope names are lower-case words joined by single hyphens.
SCOPE_PATTERN = r"^[a-z0-9]+(?:-[a-z0-9]+)*\z"
# Fixed value: the listen-only address that must not be a request target.
UNROUTABLE_HOST = "0.0.0.0"


def canonical_server_url(url: Column) -> Column:
    """the URL's standard form with one trailing slash removed."""
    return F.regexp_replace(urls.canonical(url), "/\\z", "")


def endpoint_base(url: Column) -> Column:
    """F6, second form: every trailing slash dropped."""
    return F.regexp_replace(url, "/+\\z", "")


def split_skills(text: Column) -> Column:
    """split on commas, trim, drop empties."""
    return F.filter(F.transform(F.split(text, ","), js_trim), lambda x: x != "")


def scope_errors(scope: Column, url: Column, skills: Column) -> Column:
    """Every failing registry check of a manifest row, as codes in check order."""
    host, query, ref = urls.host(url), urls.query(url), urls.fragment(url)
    cleaned = F.array_distinct(F.filter(F.transform(F.coalesce(skills, F.array().cast("array<string>")), js_trim),
                                        lambda x: x != ""))
    # something that is not http(s) parses if it has a scheme; an http(s) URL needs a host
    parsed = urls.is_http_url(url) | F.coalesce(~urls.scheme(url).isin("http", "https"), F.lit(False))
    checks = [
        (F.coalesce(scope.rlike(SCOPE_PATTERN), F.lit(False)), "scope_format"),
        (parsed, "url_invalid"),
        (~parsed | urls.is_http_url(url), "url_scheme"),
        (~parsed | F.coalesce(host != UNROUTABLE_HOST, F.lit(True)), "url_unroutable_host"),
        (~parsed | F.coalesce(query.isNull() | (query == ""), F.lit(True)), "url_query"),
        (~parsed | F.coalesce(ref.isNull() | (ref == ""), F.lit(True)), "url_fragment"),
        (F.coalesce(F.size(cleaned) > 0, F.lit(False)), "skills_empty"),
        (F.coalesce(F.forall(cleaned, lambda x: ~x.rlike("[\n\r]")), F.lit(False)), "skills_multiline"),
        (F.coalesce(F.forall(cleaned, lambda x: ~is_reserved_skill(x)), F.lit(False)), "skills_reserved"),
    ]
    return F.filter(F.array(*[F.when(~ok, F.lit(code)) for ok, code in checks]), lambda x: x.isNotNull())


def upgrade_decision(latest_exists: Column, latest_hash: Column, latest_status: Column, last_seen: Column) -> Column:
    """F17, in order: no MR -> none; hash missing -> error; same hash -> skip;
    not merged -> refuse; else sync."""
    return (F.when(~F.coalesce(latest_exists, F.lit(False)), F.lit("none"))
            .when(latest_hash.isNull() | (latest_hash == ""), F.lit("error_missing_hash"))
            .when(F.coalesce(last_seen == latest_hash, F.lit(False)), F.lit("skip"))
            .when(F.coalesce(latest_status != "merged", F.lit(True)), F.lit("refuse"))
            .otherwise(F.lit("sync")))
