"""Text expressions: trimming, placeholders, integers and redaction of secrets."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The redaction rules in their order, as (pattern, replacement); groups are $1, $2.
REDACTIONS = (
    (r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", "[REDACTED]"),
    (r"(?i)\b(?:sk-[A-Za-z0-9_-]{12,}|AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9_]{20,})\b", "[REDACTED]"),
    (r"(?i)(https?://)[^/@\s:]+:[^/@\s]+@", "$1[REDACTED]@"),
    (r"(?i)(\b(?:bearer|basic)\s+)([^\s,;]+)", "$1[REDACTED]"),
    (r"(?i)(\b(?:password|passwd|pwd|token|api[_ -]?key|secret|cookie|authorization|proxy-authorization)\b\s*[:=]\s*)([\"']?)([^\s,;\"']+)", "$1$2[REDACTED]"),
    (r"(?i)([?&](?:token|access_token|api[_-]?key|password|secret|session(?:id)?|auth)=)[^&#\s]+", "$1[REDACTED]"),
)


#: What any text that a rule fits holds.
SUSPECT = r"(?i)-----BEGIN|sk-|AKIA|gh[pousr]_|https?://[^/@\s:]+:[^/@\s]+@|bearer|basic|passw|pwd|token|api[_ -]?key|secret|cookie|authorization|[?&](?:session|auth)"


def redact(c: Column) -> Column:
    """c is read more than once, so it should be a column or cheap."""
    out = c
    for pattern, to in REDACTIONS:
        out = F.regexp_replace(out, pattern, to)
    return F.when(c.rlike(SUSPECT), out).otherwise(c)


def redact_text(text: str) -> str:
    """The same rules for a string on the driver."""
    for pattern, to in REDACTIONS:
        text = re.sub(pattern, to.replace("$1", r"\1").replace("$2", r"\2"), text)
    return text


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapsed(c: Column) -> Column:
    return stripped(F.regexp_replace(c, r"(?U)\s+", " "))


def present(c: Column) -> Column:
    """Null where the text is empty or a lone dash."""
    return F.when((c != "") & (c != "-"), c)


def truthy(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def integer(c: Column) -> Column:
    """A decimal integer with optional sign and single underscores between digits; else, or beyond 64 bits, null."""
    return F.when(c.rlike(r"^\s*[+-]?\d+(?:_\d+)*\s*$"), F.regexp_replace(c, r"[_\s]", "").try_cast("bigint"))


def integer_any_base(c: Column) -> Column:
    """As text: 0x, 0o and 0b literals and plain decimals in decimal; anything else (a leading zero too) unchanged."""
    hexed = F.when(c.rlike(r"^0[xX][0-9A-Fa-f]{1,15}$"), F.conv(F.substring(c, 3, 64), 16, 10))
    octal = F.when(c.rlike(r"^0[oO][0-7]{1,20}$"), F.conv(F.substring(c, 3, 64), 8, 10))
    binary = F.when(c.rlike(r"^0[bB][01]{1,62}$"), F.conv(F.substring(c, 3, 64), 2, 10))
    plain = F.when(c.rlike(r"^[+-]?(?:0+|[1-9]\d*)$"), F.regexp_replace(F.regexp_replace(c, r"^[+]", ""), r"^-?0+$", "0"))
    return F.coalesce(hexed, octal, binary, plain, c)


def taken(text: Column, pattern: str, group: int) -> Column:
    """A group of the first match; null without a match or where the group took no part or is empty."""
    return F.when(text.rlike(pattern), F.nullif(F.regexp_extract(text, pattern, group), F.lit("")))


#: Set between groups by cut().
MARK = "\x00"


def cut(c: Column, pattern: str, n: int) -> Column:
    """The n groups of a pattern that starts with ^, and what follows its match, by one search; an array of one text
    where it doesn't match. A group that took no part is empty."""
    each = F.array(*(F.regexp_extract(c, pattern, i) for i in range(1, n + 1)), F.regexp_replace(c, pattern, ""))
    whole = F.split(F.regexp_replace(c, pattern, "".join(f"${i}{MARK}" for i in range(1, n + 1))), MARK, n + 1)
    return F.when(~c.contains(MARK), whole).when(c.rlike(pattern), each).otherwise(F.array(c))
