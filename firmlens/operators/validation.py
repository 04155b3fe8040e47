"""Checks that yield flags and message lists instead of failing."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmlens.functions import text, urls
from firmlens.operators.durable import computed_once


def messages(*checks: tuple[Column, str]) -> Column:
    """Messages of the checks that fail; a null check counts as failed."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(msg)) for ok, msg in checks]))


def with_errors(df: DataFrame, errors: Column) -> DataFrame:
    return df.withColumn("errors", errors).withColumn("is_valid", F.size("errors") == 0)


def check_search_requests(requests: DataFrame) -> DataFrame:
    c = F.col
    return with_errors(requests, messages(
        (F.length("query") >= 1, "query is empty"), (c("country").rlike("^[A-Z]{2}$"), "country is not two capitals"),
        (c("language").rlike("^[a-z]{2}$"), "language is not two small letters"),
        (c("page").between(1, 100), "page is not 1..100"),
        (c("results_per_page").between(1, 100), "results per page is not 1..100"),
        (c("max_pages").isNull() | c("max_pages").between(1, 10), "max pages is not 1..10"),
        (c("start_page").isNull() | (c("start_page") >= 1), "start page is below 1"),
        (c("start_page").isNull() | c("max_pages").isNotNull(), "start page needs max pages")))


def check_company_requests(requests: DataFrame) -> DataFrame:
    """Service entry rules."""
    c = F.col
    return with_errors(requests, messages(
        (F.length(F.trim("company_name")) >= 2, "name is too short"), (F.length("company_name") <= 100, "name is too long"),
        (c("domain").isNull() | (F.length("domain") <= 100), "domain is too long"),
        (c("max_pages_to_crawl") <= 20, "too many pages"), (c("timeout_seconds") <= 120, "timeout is too long"),
        (~((c("extraction_mode") == "basic") & ~c("include_contact_info") & ~c("include_social_media")
           & ~c("include_financial_data")), "nothing to extract")))


def check_company_requests_strictly(requests: DataFrame) -> DataFrame:
    """Data model and extraction service rules."""
    c = F.col
    name = F.trim("company_name")
    return with_errors(requests, messages(
        (F.length(name) >= 2, "name is too short"), (F.length(name) <= 200, "name is too long"),
        ((F.length(name) < 2) | name.rlike(text.NAME_RULE), "name has invalid characters"),
        (c("domain").isNull() | urls.is_domain(c("domain")), "domain is malformed"),
        (c("country").rlike("^[A-Z]{2}$"), "country is not two capitals"),
        (c("language").rlike("^[a-z]{2}$"), "language is not two small letters"),
        ((c("timeout_seconds") > 0) & (c("timeout_seconds") <= 300), "timeout is not 1..300"),
        ((c("max_pages_to_crawl") > 0) & (c("max_pages_to_crawl") <= 20), "pages is not 1..20")))


def check_page_requests(requests: DataFrame) -> DataFrame:
    """Multi-page limits; the start page falls back to the page."""
    c = F.col
    start = F.coalesce("start_page", "page")
    return with_errors(requests, messages(
        (start >= 1, "page is below 1"), (start <= 100, "page is above 100"),
        (c("results_per_page") >= 1, "results per page is below 1"), (c("results_per_page") <= 100, "results per page is above 100"),
        (c("max_pages") <= 10, "more than 10 pages"), (start + c("max_pages") - 1 <= 100, "end page is above 100"),
        (c("max_pages") * c("results_per_page") <= 1000, "more than 1000 results")))


def check_records(records: DataFrame, quality: Column, least_quality: float = 0.4) -> DataFrame:
    """Company record: a bad name is an error, other bad fields and low quality are warnings."""
    c = F.col
    blank = lambda f: c(f).isNull() | (c(f) == "")
    return (records.withColumn("errors", messages((text.is_company_name(c("name")), "name")))
            .withColumn("warnings", messages(
                (blank("domain") | urls.is_domain(c("domain")), "domain"), (blank("email") | text.is_email(c("email")), "email"),
                (blank("phone") | text.is_phone(c("phone")), "phone"),
                (blank("website") | urls.is_web_address(F.trim("website")), "website"), (quality >= least_quality, "low quality")))
            .withColumn("is_valid", F.size("errors") == 0))


# What injection, script, command and traversal attempts look like.
SQL_PATTERNS = [
    r"(\b(union|select|insert|update|delete|drop|create|alter|exec|execute)\b)",
    r"(--|#|\/\*|\*\/)",
    r"(\b(or|and)\b\s+\d+\s*=\s*\d+)",
    r"(\b(or|and)\b\s+['\"]\w+['\"]\s*=\s*['\"]\w+['\"]\])",
    r"(char|ascii|substring|length|mid|left|right)\s*\("]
SCRIPT_PATTERNS = [
    r"<script[^>]*>.*?</script>", r"javascript:", r"vbscript:", r"on\w+\s*=", r"<iframe[^>]*>.*?</iframe>",
    r"<object[^>]*>.*?</object>", r"<embed[^>]*>", r"<link[^>]*>"]
COMMAND_PATTERNS = [
    r"[;&|`$(){}\[\]\\]",
    r"\b(cat|ls|pwd|whoami|id|uname|ps|kill|rm|mv|cp|chmod|chown|sudo|su)\b",
    r"(\.\./|\.\.\\)", r"(/etc/passwd|/etc/shadow|/proc/)", r"(cmd|powershell|bash|sh|zsh)\s"]
TRAVERSAL_PATTERNS = [
    r"(\.\./|\.\.\\/)", r"(%2e%2e%2f|%2e%2e\/|\.\.%2f|%2e%2e%5c)", r"(\\\.\.\\|/\.\./)", r"(%252e%252e%252f|%c0%af)"]
HEADER_PATTERNS = [r"[<>\"'&]", r"\.\./", r"(http|https|ftp)://", r"\b(eval|exec|system|shell_exec)\b"]


def matches_any(value: Column, patterns: list[str]) -> Column:
    """Whether one of the patterns occurs, in one pass over the text."""
    return F.coalesce(value.rlike("(?iU)(?:" + "|".join(patterns) + ")"), F.lit(False))


def percent_decoded(value: Column) -> Column:
    """Percent sequences decoded; stray percent signs and plus signs stay."""
    safe = F.regexp_replace(value, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(F.replace(safe, F.lit("+"), F.lit("%2B"))), value)


def scan_text(df: DataFrame, column: str, max_length: int = 10000) -> DataFrame:
    """Attack flags per text and the text without script parts. The whole text is scanned."""
    value = F.col(column)
    clean = F.col("clean_text")
    df = df.withColumn("clean_text", value)
    for p in SCRIPT_PATTERNS:
        # A pattern is only tried where its one indispensable character occurs.
        sign = "<" if p.startswith("<") else ":" if p.endswith(":") else "="
        df = df.withColumn("clean_text", F.when(clean.contains(sign), F.regexp_replace(clean, "(?iU)" + p, "")).otherwise(clean))
    df = computed_once(df, clean_text=clean)
    decoded = percent_decoded(clean)
    return computed_once(
        df, too_long=F.length(value) > max_length, sql=matches_any(value, SQL_PATTERNS), script=clean != value,
        command=matches_any(clean, COMMAND_PATTERNS), traversal=matches_any(clean, TRAVERSAL_PATTERNS),
        evasion=clean.contains("%") & (decoded != clean) & matches_any(decoded, SQL_PATTERNS + SCRIPT_PATTERNS))


def scan_headers(df: DataFrame) -> DataFrame:
    """Odd user agents and header values (``user_agent``, ``header_value``)."""
    ua = F.coalesce("user_agent", F.lit(""))
    return df.withColumns({
        "odd_agent": (ua == "") | (F.length(ua) > 1000),
        "odd_header": F.col("header_value").isNotNull() & matches_any(F.col("header_value"), HEADER_PATTERNS)})


def response_flags(df: DataFrame) -> DataFrame:
    """Flags and distinct error types of a response with ``errors`` and ``warnings`` arrays."""
    return df.withColumns({
        "has_errors": F.size("errors") > 0, "has_warnings": F.size("warnings") > 0,
        "error_summary": F.array_join(F.array_sort(F.array_distinct(F.transform("errors", lambda e: e["error_type"]))), ", ")})
