"""A folder to which log files are added, as a stream of matching rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import csv_cell
from ..operators.search import RAW, term
from ..operators.timeline import ROW


def follow(spark: SparkSession, folder: str, columns: list[str], condition: Column | str = "", delimiter: str = ",", header: bool = True) -> DataFrame:
    """Rows of new files that meet a condition, without state; quoted line ends are read, row ids aren't known (null)."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    rows = spark.readStream.schema(schema).options(sep=delimiter, header=header, multiLine=True, escape='"', enforceSchema=True).csv(folder)
    raw = F.concat_ws(delimiter, *(csv_cell(F.col(f"`{c}`"), delimiter) for c in columns))
    rows = rows.select(F.lit(None).cast("long").alias(ROW), *(f"`{c}`" for c in columns), raw.alias(RAW))
    return rows.where(term(condition, columns) if isinstance(condition, str) else condition)
