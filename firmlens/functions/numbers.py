"""Number handling: rounding, paging arithmetic, counts and amounts in text."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int = 2) -> Column:
    """Rounding on the binary value, so that 0.575 (slightly below) gives 0.57."""
    scale = float(10 ** digits)
    return F.floor(x * scale + 0.5) / scale


def start_index(page: Column, per_page: Column) -> Column:
    return (page - 1) * per_page


def total_pages(total: Column, per_page: Column, most: int | None = None) -> Column:
    pages = F.ceil(total / per_page)
    return pages if most is None else F.when(pages.isNotNull(), F.least(pages, F.lit(most)))


def page_range(page: Column, per_page: Column, found: Column) -> tuple[Column, Column]:
    """First and last result number of a page; zeros when it is empty."""
    first = start_index(page, per_page) + 1
    return F.when(found == 0, 0).otherwise(first), F.when(found == 0, 0).otherwise(first + found - 1)


# How result pages state their number of results.
TOTAL_PATTERNS = [r"About\s+([\d,]+)\s+results", r"([\d,]+)\s+results", r"Showing\s+[\d,]+-[\d,]+\s+of\s+([\d,]+)",
                  r"Page\s+\d+\s+of\s+about\s+([\d,]+)"]


def stated_total(text: Column) -> Column:
    """Number of results a page claims, or null; absurd numbers are skipped."""
    found = [F.replace(F.nullif(F.regexp_extract(text, "(?i)" + p, 1), F.lit("")), F.lit(","), F.lit("")).try_cast("long")
             for p in TOTAL_PATTERNS]
    return F.coalesce(*[F.when(v.between(0, 10 ** 12), v) for v in found])


def people_count(text: Column, upper: bool = False) -> Column:
    """Head count from ``120`` or ``50-100``: the lower end (also of ``500+``), or the upper end."""
    parts = F.split(F.regexp_replace(text, "," if upper else "[,+]", ""), "-")
    ranged = F.contains(text, F.lit("-"))
    at = F.when(ranged, F.try_element_at(parts, F.lit(2))).otherwise(F.element_at(parts, 1)) if upper else F.element_at(parts, 1)
    return F.trim(at).try_cast("long")


def plain_number(text: Column) -> Column:
    t = F.trim(text)
    return F.when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"), t.try_cast("double"))


def money_worded(text: Column) -> Column:
    """Amount from texts such as ``$1.5 billion``, ``3B``, ``20 million`` or ``7M``."""
    t = F.lower(F.regexp_replace(text, "[$,]", ""))
    return (F.when(t.contains("b"), plain_number(F.regexp_replace(t, "billion|b", "")) * 1e9)
            .when(t.contains("m"), plain_number(F.regexp_replace(t, "million|m", "")) * 1e6).otherwise(plain_number(t)))


def money_suffixed(text: Column) -> Column:
    """Amount from texts ending in K, M or B."""
    t = F.upper(F.regexp_replace(text, "[$,]", ""))
    scale = F.when(t.endswith("K"), 1e3).when(t.endswith("M"), 1e6).when(t.endswith("B"), 1e9).otherwise(1.0)
    return plain_number(F.regexp_replace(t, "[KMB]$", "")) * scale
