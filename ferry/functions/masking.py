"""Masking of sensitive values. Which rule applies is decided from the column's
name when the plan is built, so each masked column costs one codegen'd expression."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ferry.functions.text import normalise_name

# Name patterns and replacement texts.
SENSITIVE_PATTERNS = (
    "password", "pwd", "secret", "token", "apikey", "api_key",
    "email", "phone", "mobile", "contact", "ssn", "aadhaar", "pan",
    "credit", "card", "cvv", "otp", "dob", "salary", "address",
    "license", "passport",
)
REDACTED_PATTERNS = (
    "password", "pwd", "secret", "token", "apikey", "api_key",
    "cvv", "otp", "ssn", "aadhaar", "pan", "passport",
)
PHONE_PATTERNS = ("phone", "mobile", "contact")
NUMERIC_PATTERNS = ("salary", "credit", "card", "cvv")
EMAIL_SHAPE = r"\A[^@\s]+@[^@\s]+\.[^@\s]+\z"
PHONE_SHAPE = r"\A[0-9+\-\s()]{7,20}\z"
FULL_MASK = "********"
NUMERIC_MASK = "*****"
NULL_MASK = "NULL"


def _plain(name: str) -> str:
    return name.lower().replace("-", "_").replace(" ", "_")


def _names(name: str, patterns: tuple[str, ...], word_match: bool = False) -> bool:
    plain = _plain(name)
    if word_match:
        return any(f"_{p}_" in f"_{plain}_" for p in patterns)
    return any(p in plain for p in patterns)


def is_sensitive(name: str, extra: tuple[str, ...] = (), word_match: bool = False) -> bool:
    """True when the column name holds a sensitive pattern. The default is a
    substring test (it over-masks on purpose); ``word_match`` asks for whole words."""
    return _names(name, SENSITIVE_PATTERNS + tuple(extra), word_match)


def is_sensitive_name(name: Column) -> Column:
    """The same test over a column of names (catalog rows)."""
    return F.coalesce(normalise_name(name).rlike("|".join(SENSITIVE_PATTERNS)), F.lit(False))


def looks_like_email(text: Column) -> Column:
    return text.rlike(EMAIL_SHAPE)


def looks_like_phone(text: Column) -> Column:
    return (F.length(F.regexp_replace(text, "[^0-9]", "")) >= 7) & text.rlike(PHONE_SHAPE)


def mask_email(text: Column) -> Column:
    """First letter, stars, and all after the last ``@``."""
    domain = F.substring_index(text, "@", -1)
    local_chars = F.length(text) - F.length(domain) - F.lit(1)
    shown = F.when(local_chars <= 1, F.lit("")).otherwise(F.substring(text, 1, 1))
    return F.concat(shown, F.lit("***@"), domain)


def mask_phone(text: Column) -> Column:
    """Digits only; the first and last two stay."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    count = F.length(digits)
    return F.when(count <= 4, F.repeat(F.lit("*"), count)).otherwise(
        F.concat(F.substring(digits, 1, 2), F.repeat(F.lit("*"), count - 4), F.substring(digits, -2, 2))
    )


def mask_value(name: str, value: Column) -> Column:
    text = value.cast("string")
    if _names(name, REDACTED_PATTERNS):
        masked = F.lit(FULL_MASK)
    else:
        rest = F.lit(NUMERIC_MASK if _names(name, NUMERIC_PATTERNS) else FULL_MASK)
        masked = F.when(looks_like_email(text), mask_email(text))
        if _names(name, PHONE_PATTERNS):
            masked = masked.when(looks_like_phone(text), mask_phone(text))
        masked = masked.otherwise(rest)
    return F.when(value.isNull(), F.lit(NULL_MASK)).otherwise(masked)
