"""Views as CSV, TSV, JSON and HTML text: one line a row, written as ordered part files.

The part files of a folder, joined in the order of their names, are the exact file; no task holds more than
its own rows.
"""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import csv_cell
from ..operators.timeline import ROW, View

FORMATS = ("csv", "tsv", "json", "html")


def _cell(c: str) -> Column:
    return F.coalesce(F.col(f"`{c}`"), F.lit(""))


def _quoted(c: Column) -> Column:
    """JSON text: ``\\`` and quotes escaped, control characters as ``\\n``, ``\\r``, ``\\t`` or ``\\u00xx``, the rest as it is."""
    for old, new in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(old), F.lit(new))
    rest = [i for i in range(32) if chr(i) not in "\n\r\t"]
    odd = c
    for i in rest:
        odd = F.replace(odd, F.lit(chr(i)), F.lit(f"\\u{i:04x}"))
    return F.concat(F.lit('"'), F.when(c.rlike(r"[\x00-\x1f]"), odd).otherwise(c), F.lit('"'))


def _escaped(c: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def line(columns: list[str], form: str) -> Column:
    """A row as text, without what stands between rows."""
    if form in ("csv", "tsv"):
        sep = "," if form == "csv" else "\t"
        return F.concat_ws(sep, *(csv_cell(_cell(c), sep) for c in columns))
    if form == "json":
        return F.concat(F.lit("  {"), F.concat_ws(", ", *(F.concat(F.lit(json.dumps(c, ensure_ascii=False) + ": "), _quoted(_cell(c))) for c in columns)), F.lit("}"))
    if form == "html":
        return F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), _escaped(_cell(c)), F.lit("</td>")) for c in columns), F.lit("</tr>"))
    raise ValueError(f"unknown export format {form}")


def frame(columns: list[str], form: str) -> tuple[str, str]:
    """What stands before and after the rows."""
    quote = lambda c, sep: '"' + c.replace('"', '""') + '"' if any(x in c for x in (sep, '"', "\n", "\r")) else c
    if form in ("csv", "tsv"):
        sep = "," if form == "csv" else "\t"
        return sep.join(quote(c, sep) for c in columns), ""
    if form == "json":
        return "[", "]"
    return "<table>\n<thead><tr>" + "".join(f"<th>{html.escape(c).replace('&#x27;', '&#39;')}</th>" for c in columns) + "</tr></thead>\n<tbody>", "</tbody>\n</table>"


def lines(view: View, form: str, columns: list[str] | None = None) -> DataFrame:
    """``(_row_id, line)`` in the view's order; no or only unknown ``columns``: all."""
    columns = [c for c in columns or [] if c in view.columns] or view.columns
    return view.ordered().select(ROW, line(columns, form).alias("line"))


def write(view: View, folder: str, form: str, columns: list[str] | None = None) -> None:
    """Write the view to ``folder`` as text parts, in order; an existing folder is replaced.

    Only the id of the last row is fetched, for JSON, whose rows are parted by commas: a maximum, not a second sort.
    """
    if form not in FORMATS:
        raise ValueError(f"unknown export format {form}")
    spark = view.df.sparkSession
    columns = [c for c in columns or [] if c in view.columns] or view.columns
    head, tail = frame(columns, form)
    own = line(columns, form)
    if form == "json":  # the last row has no comma; its place is the greatest
        last = view.df.agg(F.max(view.place_key()).alias("k")).select("k.row").first()[0]
        if last is None:
            head = "[\n"
        own = F.concat(own, F.when(F.col(ROW) == F.lit(last), "").otherwise(",")) if last is not None else own
    rows, keys, _ = view.keyed()
    rows = rows.select("*", F.lit(1).alias("_part"), own.alias("_line"))
    edge = lambda part, text: spark.range(1).select(F.lit(part).alias("_part"), F.lit(text).alias("_line"))
    out = rows.unionByName(edge(0, head), allowMissingColumns=True)
    out = out.unionByName(edge(2, tail), allowMissingColumns=True) if tail else out
    out.orderBy("_part", *keys).select(F.col("_line").alias("value")).write.mode("overwrite").text(folder)


def plain_tsv(view: View, header: bool = False) -> DataFrame:
    """``(line)``: rows as tab-joined cells without quoting, in the view's order, as for a clipboard; the header first."""
    if not header:
        return view.ordered().select(F.concat_ws("\t", *map(_cell, view.columns)).alias("line"))
    rows, keys, _ = view.keyed()
    rows = rows.select("*", F.lit(1).alias("_part"), F.concat_ws("\t", *map(_cell, view.columns)).alias("_line"))
    top = view.df.sparkSession.range(1).select(F.lit(0).alias("_part"), F.lit("\t".join(view.columns)).alias("_line"))
    return rows.unionByName(top, allowMissingColumns=True).orderBy("_part", *keys).select(F.col("_line").alias("line"))
