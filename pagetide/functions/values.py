"""Values: hashes, sizes, slugs, canonical identifiers and dates. All are expressions that Catalyst sees through."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocabulary import MONTHS


def sha256(c: Column) -> Column:
    """SHA-256 of UTF-8; null stays null."""
    return F.sha2(c.cast("binary"), 256)


def byte_size(c: Column) -> Column:
    return F.octet_length(c).cast("long")


def slug(name: Column) -> Column:
    """The name of a target's folder: lower case, blanks as underscores."""
    return F.replace(F.lower(name), F.lit(" "), F.lit("_"))


def target_key(county: Column, page_type: Column) -> Column:
    return F.concat_ws("/", F.trim(county), F.trim(page_type))


def squashed(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def hyphened(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def collapsed(c: Column) -> Column:
    """White space as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def text_lines(c: Column) -> Column:
    """Lines with collapsed blanks, without blank ones, joined; one line end behind them, or nothing."""
    kept = F.filter(F.transform(F.split(c, "\n"), collapsed), lambda x: x != "")
    return F.when(F.size(kept) > 0, F.concat(F.array_join(kept, "\n"), F.lit("\n"))).otherwise(F.lit(""))


# ---- fixed values: identifiers that pages make anew each time, in the order in which they are replaced ----
GUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
LONG_HEX = r"\b[0-9a-f]{10,}\b"
CANONICAL = [
    (GUID, "GUID"),
    (LONG_HEX, "HEX"),
    (r"--[A-Za-z0-9_-]{8,}(?=$|[\s\"'])", "--RANDOM"),
    (r"\b(pbckid|comp-|uid|guid|ctl)([0-9a-f]{10,})\b", "$1HEX"),
    (r"-(?=[A-Za-z0-9]*[A-Z])(?=[A-Za-z0-9]*[a-z])[A-Za-z0-9]{8,}\b", "-RANDOM"),
    (r"\b(wp-(?:child-)?theme-[a-z0-9-]+)_\d+\b", "$1_BUILD"),
    (r"\b(style|elementor|post|block|widget)-(?=[0-9a-f]*[a-f])[0-9a-f]{6,}\b", "$1-HEX"),
    (r"\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(\.\d+)?Z?", "TIMESTAMP"),
    (r"\b\d{1,2}/\d{1,2}/\d{4}\s+\d{1,2}:\d{2}:\d{2}\s*(?:AM|PM|am|pm)?\b", "TIMESTAMP"),
]
EDGE_REFERENCE = r"\b\d+\.[0-9a-f]{6,}\.\d+\.[0-9a-f]{6,}\b"
EMAIL_TOKEN = r"(/cdn-cgi/l/email-protection#)[0-9a-fA-F]+"
EPOCH = r"^\d{10,}(\.\d+)?$"
RAW_DATE = r"\b(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun) (Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) (\d{2}) \d{2}:\d{2}:\d{2} [A-Z]{2,5} (\d{4})\b"
# ---- end of fixed values ----


def canon_ids(c: Column) -> Column:
    """Placeholders for identifiers that are made anew on each request."""
    for pattern, to in CANONICAL:
        c = F.regexp_replace(c, pattern, to)
    return c


def edge_references(c: Column) -> Column:
    return F.regexp_replace(c, EDGE_REFERENCE, "EDGE_REF_REDACTED")


def plain_dates(c: Column) -> Column:
    """`Tue Jul 08 08:49:00 CDT 2026` as `July 8, 2026`: one replacement for each month, with the zero of a day outside of its group."""
    out = c
    for m in MONTHS:
        of_month = RAW_DATE.replace(ANY_MONTH, m[:3]).replace(r"(\d{2})", r"(?:0(\d)|([1-9]\d))", 1)
        out = F.regexp_replace(out, of_month, f"{m} $1$2, $3")
    return F.when(c.rlike(RAW_DATE), out).otherwise(c)


def python_plain_dates(text: str) -> str:
    """plain_dates() for the cleaning helper."""
    return DATE.sub(lambda m: f"{FULL[m[1]]} {int(m[2])}, {m[3]}", text)


def python_canon_ids(value: str) -> str:
    """canon_ids() for the cleaning helper."""
    for pattern, to in PATTERNS:
        value = pattern.sub(to, value)
    return value


PATTERNS = [(re.compile(p), t.replace("$1", r"\1")) for p, t in CANONICAL]
DATE, FULL = re.compile(RAW_DATE), {m[:3]: m for m in MONTHS}
ANY_MONTH = f"({'|'.join(FULL)})"
