"""Cleaning of catalog text. Every function takes and returns a Column, null-safe, and runs in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"\s\u00A0\uFEFF\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


def trimmed(c: Column) -> Column:
    """Without white space at either end, no-break space and byte-order mark included."""
    return F.regexp_replace(c, f"^[{BLANK}]+|[{BLANK}]+$", "")


def clean(c: Column) -> Column:
    """Trimmed; a dash or nothing is null."""
    text = trimmed(c)
    return F.when(~text.isin("", "-"), text)


def number(c: Column) -> Column:
    """The number that a text begins with, as double: 12.5kg is 12.5; text without one is null, and so is Infinity."""
    return F.regexp_extract(trimmed(c), r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", 0).try_cast("double")


def catalog_number(c: Column) -> Column:
    """The integer that a text begins with; 0 and text without one are null."""
    return F.nullif(F.regexp_extract(trimmed(c), r"^[+-]?\d+", 0).try_cast("bigint"), F.lit(0).cast("bigint"))


#: Codes of operational orbits by class, in the order of the rules.
ORBIT_RULES = (
    ("LEO", r"^[LVEP]?LEO|^EEO$"),
    ("GTO", r"^GTO"),
    ("GEO", r"^GEO"),
    ("MEO", r"^MEO"),
    ("HEO", r"^HEO|^MOLNIYA$|^TUNDRA$"),
    ("SSO", r"^SSO$"),
    ("Deep Space", r"^DSO|^(HELIO|ESCAPE|LLO|HCO)$"),
)


def orbit_class(c: Column) -> Column:
    """The class of an orbit code without its /X suffix; codes of no class stay as they are, in upper case."""
    base = F.split_part(F.upper(clean(c)), F.lit("/"), F.lit(1))
    out = F.nullif(base, F.lit(""))
    for label, pattern in reversed(ORBIT_RULES):
        out = F.when(base.rlike(pattern), F.lit(label)).otherwise(out)
    return out


def object_class(c: Column) -> Column:
    """First letter of a type, upper case; a dash stays, nothing is null."""
    return F.nullif(F.upper(F.substring(trimmed(c), 1, 1)), F.lit(""))


def vehicle_family(c: Column) -> Column:
    """A vehicle without its version, block or variant: the first match of each is taken off, in this order. A name
    of which nothing is left stays as it is."""
    out = F.regexp_replace(c, r"(?i)\s+v\d+(\.\d+)*[a-z]?$", "")
    out = F.regexp_replace(out, r"(?i)^(.*?)\s+(Block|Blk)\s+\d+[A-Z]?", "$1")
    out = F.regexp_replace(out, r"(?i)\s+(ECA|ES|G\+|EL|EC|Plus)\s*$", "")
    return F.coalesce(F.nullif(trimmed(out), F.lit("")), c)


def is_orbital(code: Column) -> Column:
    """Whether a launch code stands for an orbital or deep-space attempt; null doesn't."""
    return F.coalesce(F.upper(F.substring(trimmed(code), 1, 1)).isin("O", "D"), F.lit(False))


def key_prefix(key: Column) -> Column:
    return F.substring(key, 1, 1)


def key_rest(key: Column) -> Column:
    return F.substring(key, 2, 1 << 30)


def half_up(x: Column) -> Column:
    """Nearest integer, halves upward (-2.5 gives -2)."""
    return F.floor(x + F.lit(0.5).cast("decimal(2,1)")).cast("long")


def half_up_at(x: Column, digits: int) -> Column:
    """Nearest at so many decimals, halves upward, as double."""
    scale = float(10**digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def tonnes(kg: Column) -> Column:
    return kg / F.lit(1000)
