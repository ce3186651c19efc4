"""Timestamps in text columns: what form they have, and their display in a time zone."""

from __future__ import annotations

from datetime import datetime
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds of 2000-01-01 and 2100-01-01; numbers outside aren't taken for times.
FIRST, LAST = 946_684_800, 4_102_444_800
ISO, SECONDS, MILLIS = "iso8601", "epochSeconds", "epochMillis"
#: What begins like a time, and a whole time.
_PREFIX = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}"
_WHOLE = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}(?::?\d{2})?)?$"


def _bare(c: Column) -> Column:
    return F.regexp_replace(c, r"^[ \t]+|[ \t]+$", "")


def detect(c: Column) -> Column:
    """``iso8601``, ``epochSeconds``, ``epochMillis`` or null."""
    v = _bare(c)
    n, size = v.try_cast("double"), F.length(v)
    digits = v.rlike(r"^\d+$")
    return (
        F.when(digits & size.between(9, 11) & n.between(FIRST, LAST), SECONDS)
        .when(digits & size.between(12, 14) & (n / 1000).between(FIRST, LAST), MILLIS)
        .when(~digits & v.rlike(_PREFIX), ISO)
    )


def instant(c: Column, form: str) -> Column:
    """The time that a cell of a column of ``form`` states; null if it states none. No zone means UTC."""
    v = _bare(c)
    if form in (SECONDS, MILLIS):
        n = F.when(v.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"), v.try_cast("double"))
        return F.timestamp_seconds(n / (1000 if form == MILLIS else 1))
    if form != ISO:
        raise ValueError(f"unknown form {form}")
    v = F.replace(F.regexp_replace(v, r"(?i)(?:[ T]?(?:UTC|GMT))+$", ""), F.lit(" "), F.lit("T"))
    v = F.when(v.rlike(_WHOLE), v)
    bare = F.regexp_replace(v, r"\.\d+", "")
    zone = F.regexp_extract(bare, r"(?:Z|[+-]\d{2}(?::?\d{2})?)$", 0)
    zone = F.when(v.rlike(r"T\d{2}:\d{2}:\d{2}$") | bare.rlike(r"T\d{2}:\d{2}:\d{2}$"), "").otherwise(zone)
    digits = F.regexp_replace(zone, "[Z:]", "")
    minutes = F.when(digits == "", 0).otherwise(
        F.when(F.substring(digits, 1, 1) == "-", -1).otherwise(1)
        * (F.coalesce(F.substring(digits, 2, 2).try_cast("int"), F.lit(0)) * 60 + F.coalesce(F.substring(digits, 4, 2).try_cast("int"), F.lit(0)))
    )
    local = F.try_to_timestamp(F.concat(F.substring(bare, 1, 19), F.lit("Z")), F.lit("yyyy-MM-dd'T'HH:mm:ssX"))
    return F.timestamp_seconds(F.unix_seconds(local) - minutes * 60)


def abbreviation(zone: str) -> str:
    """What a zone is called now, such as ``CET``; zones without letters as ``GMT+3``."""
    name = datetime.now(ZoneInfo(zone)).tzname()
    if name[0] in "+-":
        hours, minutes = int(name[1:3]), name[3:]
        return f"GMT{name[0]}{hours}" + (f":{minutes}" if minutes else "")
    return name


def shown(c: Column, form: str, zone: str | None) -> Column:
    """A cell as display text: ``yyyy-MM-dd HH:mm:ss`` and the zone's abbreviation; the cell itself without a zone or a time."""
    if zone is None:
        return c
    utc = F.to_utc_timestamp(instant(c, form), F.current_timezone())
    there = F.from_utc_timestamp(utc, zone)
    return F.coalesce(F.concat(F.date_format(there, "yyyy-MM-dd HH:mm:ss"), F.lit(f" {abbreviation(zone)}")), c)


def column_forms(head: DataFrame, columns: list[str]) -> dict[str, str]:
    """The form of each column of times: of ``head`` (a first page of rows) three cells or more aren't empty and 70 % share it.

    One aggregation for all columns; of forms met equally often the first of ISO, seconds, millis.
    """
    aggs = []
    for i, c in enumerate(columns):
        aggs.append(F.count_if(_bare(F.col(f"`{c}`")) != "").alias(f"n{i}"))
        aggs += [F.count_if(detect(F.col(f"`{c}`")) == f).alias(f"{f}{i}") for f in (ISO, SECONDS, MILLIS)]
    row = head.agg(*aggs).first() if aggs else {}
    out = {}
    for i, c in enumerate(columns):
        best = max((ISO, SECONDS, MILLIS), key=lambda f: row[f"{f}{i}"])
        if row[f"n{i}"] >= 3 and row[f"{best}{i}"] >= 0.7 * row[f"n{i}"]:
            out[c] = best
    return out
