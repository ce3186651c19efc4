"""Indicators of compromise in cells, and colours for cells by what they contain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import contains, fold

#: The starting colour rules, first match wins.
COLOURS = [("critical", "red"), ("error", "red"), ("denied", "red"), ("fail", "orange"), ("warn", "yellow"), ("success", "green"), ("allow", "green")]
_OCTET = r"(?:0{0,2}\d|0?\d\d|1\d\d|2[0-4]\d|25[0-5])"
_LOOKUP = "https://www.virustotal.com/gui/"


def indicator(c: Column) -> Column:
    """``struct(type, value)`` of a hash or an address that fills a cell, else null; hashes in lower case.

    The test for IPv6 is loose on purpose: two colons and nothing but hexadecimal digits and colons.
    """
    v = F.regexp_replace(c, r"^[ \t]+|[ \t]+$", "")
    kind = F.lit(None).cast("string")
    for size, name in ((64, "sha256"), (40, "sha1"), (32, "md5")):
        kind = F.when(v.rlike(f"^[0-9A-Fa-f]{{{size}}}$"), name).otherwise(kind)
    kind = kind_or(kind, v.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), "ipv4")
    kind = kind_or(kind, v.rlike("^[0-9A-Fa-f:]+$") & v.rlike(":[^:]*:"), "ipv6")
    return F.when(kind.isNotNull(), F.struct(kind.alias("type"), F.when(kind.isin("ipv4", "ipv6"), v).otherwise(fold(v)).alias("value")))


def kind_or(kind: Column, test: Column, name: str) -> Column:
    return F.coalesce(kind, F.when(test, name))


def lookup_url(found: Column) -> Column:
    """The public look-up page of an indicator; the text only, nothing is fetched."""
    return F.concat(F.lit(_LOOKUP), F.when(found["type"].isin("ipv4", "ipv6"), "ip-address").otherwise("file"), F.lit("/"), found["value"])


def colour(c: Column, rules: list[tuple[str, str]] = COLOURS) -> Column:
    """The colour of the first rule whose needle a cell contains, else null."""
    out = F.lit(None).cast("string")
    for needle, name in reversed(rules):
        out = F.when(contains(c, needle), name).otherwise(out)
    return out
