"""Cleaning, checking and cutting of text fields."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted forms of an address, a phone number and a company name.
EMAIL_RULE = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
PHONE_RULE = r"^[\+]?[1-9]?[\d\s\-\(\)\.]{7,15}$"
NAME_RULE = r"(?U)^[\w\s\-\.,&()'\"]+$"


def squeezed(text: Column) -> Column:
    """Outer blanks removed, inner runs of white space made one blank."""
    one = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")
    return F.trim(one)


def sanitized(text: Column, max_length: int | None = None, allow_html: bool = False) -> Column:
    """Plain text without tags and control characters, cut at a word end."""
    t = squeezed(text)
    if not allow_html:
        t = F.regexp_replace(t, r"<[^>]+>", "")
    t = F.regexp_replace(t, r"[\x00-\x08\x0B-\x0C\x0E-\x1F\x7F]", "")
    return t if max_length is None else cut_at_word(t, max_length)


def cut_at_word(text: Column, max_length: int) -> Column:
    head = F.regexp_replace(F.substring(text, 1, max_length), r" [^ ]*$", "")
    return F.when(F.length(text) > max_length, F.concat(head, F.lit("..."))).otherwise(text)


def shortened(text: Column, n: int) -> Column:
    """First ``n`` characters followed by dots when something was cut."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def clean_email(email: Column) -> Column:
    return F.lower(F.trim(F.coalesce(email, F.lit(""))))


def clean_phone(phone: Column) -> Column:
    return F.regexp_replace(F.trim(F.coalesce(phone, F.lit(""))), r"[^\d\+\-\(\)\s\.]", "")


def is_email(email: Column) -> Column:
    return clean_email(email).rlike(EMAIL_RULE)


def is_phone(phone: Column) -> Column:
    return clean_phone(phone).rlike(PHONE_RULE)


def is_company_name(name: Column) -> Column:
    n = F.trim(F.coalesce(name, F.lit("")))
    return (F.length(n) >= 2) & (F.length(n) <= 200) & n.rlike(NAME_RULE)
