"""A timeline: a table of text columns with row ids, and ordered views of it as lazy DataFrames."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass, field, replace
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import csv_cell, forward_fields, key_fields
from . import search as s

ROW, RAW, WRITTEN, BYTES = "_row_id", s.RAW, s.WRITTEN, s.BYTES
#: The flag of :func:`flagged`.
TAGGED = "_tagged"
#: Places from the beginning of an order up to which a page is taken by keeping that many rows a task.
NEAR = 10_000
#: Characters of a list of values that is shipped to the workers at once.
MOST_LISTED = 1 << 25


class UnknownColumn(ValueError):
    """A column that a view hasn't."""


@dataclass(frozen=True)
class View:
    """Rows of a timeline and their order: ``keys`` (column, ascending), later sorts in front, row id last."""

    df: DataFrame
    columns: list[str]
    keys: tuple[tuple[str, bool], ...] = field(default=())
    #: How the file was read, with the delimiter that was guessed; None for views of tables.
    schema: object = None

    def resolve(self, column: int | str) -> str:
        """A column by its number or its name; the first of equal names, ASCII case aside."""
        if isinstance(column, int):
            at = column if 0 <= column < len(self.columns) else None
        else:
            at = self.columns.index(column) if column in self.columns else s.named(column, self.columns)
        if at is None:
            raise UnknownColumn(f"no column {column!r}")
        return self.columns[at]

    # --- reading ---------------------------------------------------------

    def keyed(self) -> tuple[DataFrame, list[Column], list[str]]:
        """The rows with the fields of their keys as plain columns, made once a row; the order by these; their names."""
        mark = "_key"
        while any(c.startswith(mark) for c in self.df.columns):
            mark += "_"
        made: dict[str, Column] = {}
        order: list[Column] = []
        for i, (c, up) in enumerate(self.keys):
            for j, field_ in enumerate(key_fields(F.col(f"`{c}`"))):
                made[f"{mark}{i}{'nt'[j]}"] = field_
                order.append(F.col(f"{mark}{i}{'nt'[j]}").asc() if up else F.col(f"{mark}{i}{'nt'[j]}").desc())
        return self.df.withColumns(made) if made else self.df, [*order, F.col(ROW).asc()], list(made)

    def ordered(self) -> DataFrame:
        """The rows in order: a range-partitioned sort on the cluster, by plain columns."""
        rows, order, made = self.keyed()
        return rows.orderBy(*order).drop(*made)

    def place_key(self) -> Column:
        """One value a row, unique, whose ascending order is the view's; its last field is ``row``, the row id."""
        parts = [x for c, up in self.keys for x in forward_fields(F.col(f"`{c}`"), up)]
        return F.struct(*(x.alias(f"p{i}") for i, x in enumerate(parts)), F.col(ROW).alias("row"))

    def page(self, offset: int = 0, limit: int = 50, most: int = 1000, near: int = NEAR) -> DataFrame:
        """Rows ``offset`` to ``offset + limit`` of the order, ``most`` at most, as the visible columns.

        Up to place ``near`` each task keeps ``offset + limit`` rows. Beyond, :meth:`picked` finds the page's rows by jobs that
        count, and these, ``limit`` at most, are joined to the table.
        """
        offset, limit = max(0, offset), max(0, min(limit, most))
        if offset + limit <= near or not limit:
            return self.ordered().offset(offset).limit(limit)
        place = "_place"
        while place in self.df.columns:
            place += "_"
        some = self.picked(offset, limit, near).select(F.col("k").alias(place), F.col("k.row").alias(ROW))
        return self.df.join(F.broadcast(some), ROW).orderBy(place).select(*(f"`{c}`" for c in self.df.columns))

    def picked(self, offset: int, limit: int, near: int = NEAR, parts: int = 32) -> DataFrame:
        """``(k)``: :meth:`place_key` of the rows at the places from ``offset`` on, ``limit`` at most.

        The keys are written once, without a shuffle. Each turn takes ``parts`` boundaries from a sample of the keys inside, counts
        the keys between them, and goes on with the ranges that hold the places, until these have ``near`` keys: only they are
        sorted. The result is exact whatever was sampled; the driver sees ``parts`` boundaries and counts a turn.
        """
        spark, path = self.df.sparkSession, new_path(self.df.sparkSession, "places")
        self.df.select(self.place_key().alias("k")).write.parquet(path)
        inside, skipped = spark.read.parquet(path), 0
        form, size = inside.schema["k"].dataType, inside.count()
        while size > max(near, limit):
            drawn = inside.sample(min(1.0, 32.0 * parts / size), seed=size % 2**31)
            numbered = drawn.select("k", F.ntile(parts).over(Window.orderBy("k")).alias("part"))  # some 32 rows a part
            edges = [r["k"] for r in numbered.groupBy("part").agg(F.min("k").alias("k")).orderBy("part").collect()[1:]]
            edges = [e for i, e in enumerate(edges) if i == 0 or e != edges[i - 1]]
            if not edges:
                break
            literal = [F.struct(*(F.lit(x).cast(f.dataType).alias(f.name) for x, f in zip(e, form))) for e in edges]
            part = F.size(F.filter(F.array(*literal), lambda e: e <= F.col("k")))
            counted = dict(inside.groupBy(part.alias("part")).count().collect())
            sizes = [counted.get(i, 0) for i in range(len(edges) + 1)]
            ends = list(accumulate(sizes))
            first = next((i for i, e in enumerate(ends) if e > offset - skipped), None)
            if first is None:  # behind the last row
                return inside.where(F.lit(False))
            last = next((i for i, e in enumerate(ends) if e >= offset - skipped + limit), len(edges))
            kept = sum(sizes[first : last + 1])
            if kept == size:
                break
            skipped, size = skipped + (ends[first - 1] if first else 0), kept
            if first:
                inside = inside.where(F.col("k") >= literal[first - 1])
            if last < len(edges):
                inside = inside.where(F.col("k") < literal[last])
        return inside.orderBy("k").offset(offset - skipped).limit(limit)

    def row_at(self, pos: int, near: int = NEAR) -> DataFrame:
        """``(_row_id)`` of the row at a place of the order, from 0; no row outside."""
        return self.page(pos, 1 if pos >= 0 else 0, near=near).select(ROW)

    def cell_at(self, pos: int, column: int | str, near: int = NEAR) -> DataFrame:
        """The cell at a place of the order, in one row; empty text outside and for absent cells."""
        name = self.resolve(column)
        own = self.page(pos, 1 if pos >= 0 else 0, near=near)
        return own.agg(F.coalesce(F.first(f"`{name}`"), F.lit("")).alias(name))

    def placed(self) -> DataFrame:
        """All rows with ``pos``, their place in the order from 0: sorted by range, written, and numbered by partition.

        The driver sees one row a partition. The written table stays in the shared folder, until :func:`drop_tables`.
        """
        spark = self.df.sparkSession
        path = new_path(spark, "ordered")
        ids = self.ordered().withColumn("_part", F.spark_partition_id())
        ids.withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).write.parquet(path)
        rows = spark.read.parquet(path)
        before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        first = rows.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", before.alias("_first"))
        return rows.join(F.broadcast(first), "_part").withColumn("pos", F.col("_first") + F.col("_at")).drop("_part", "_at", "_first")

    def count(self) -> int:
        return self.df.count()

    def cells(self) -> DataFrame:
        """Row id and cells; an absent cell is empty text."""
        return self.df.select(ROW, *(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in self.columns))

    def cell(self, row: int, column: int | str) -> DataFrame:
        """The cell of a row, by its id, in one row; empty text outside and for absent cells. Columns by name or number."""
        name = self.resolve(column)
        return self.df.where(F.col(ROW) == row).agg(F.coalesce(F.first(f"`{name}`"), F.lit("")).alias(name))

    def joined_cells(self, separator: str = "\x01") -> DataFrame:
        """``(_row_id, cells)``: a row's cells as one text, the separator in a cell replaced by a blank."""
        own = (F.translate(F.coalesce(F.col(f"`{c}`"), F.lit("")), separator, " ") for c in self.columns)
        return self.df.select(ROW, F.concat_ws(separator, *own).alias("cells"))

    def detail(self, row: int) -> DataFrame:
        """One line for each column of a row, names padded to the longest."""
        width = max(map(len, self.columns), default=0)
        lines = (F.concat(F.lit(f"{c:<{width}}   "), F.coalesce(F.col(f"`{c}`"), F.lit(""))) for c in self.columns)
        return self.df.where(F.col(ROW) == row).select(F.concat_ws("\n", *lines).alias("detail"))

    def line_numbers(self) -> DataFrame:
        return self.df.select((F.col(ROW) + 1).alias("line"), *(f"`{c}`" for c in self.columns))

    # --- other views -----------------------------------------------------

    def where(self, condition: Column | str) -> View:
        """Rows that meet a condition, a search term if it is text; order kept."""
        condition = self.term(condition) if isinstance(condition, str) else condition
        return replace(self, df=self.df.where(condition))

    @property
    def written(self) -> bool:
        """Whether rows know how the file writes their cells, and the bytes of those that aren't plain text."""
        return WRITTEN in self.df.columns and BYTES in self.df.columns

    def term(self, text: str) -> Column:
        return s.term(text, self.columns, self.written)

    def among(self, values: DataFrame, column: int | str | None = None, most: int = MOST_LISTED) -> View:
        """Rows whose record, or whose cell of ``column``, contains any text of the only column of ``values``, ASCII case aside.

        A list of up to ``most`` characters is shipped to the workers. A longer one is dealt into parts of that size by hash; one pass
        for each writes the ids it finds, so memory stays within the bound. Null values find nothing.
        """
        spark, name = self.df.sparkSession, values.columns[0]
        listed = values.select(F.col(f"`{name}`").cast("string").alias("v")).dropna().distinct()
        meets = s.Place(None if column is None else self.columns.index(self.resolve(column)), self.columns, self.written).contains_any
        parts = 1 + (listed.agg(F.sum(F.length("v") + 8)).first()[0] or 0) // most
        own = lambda i: [r[0] for r in listed.where(F.pmod(F.xxhash64("v"), F.lit(parts)) == i).collect()]
        if parts == 1:
            return replace(self, df=self.df.where(meets(own(0))))
        path = new_path(spark, "listed")
        for i in range(parts):
            self.df.where(meets(own(i))).select(ROW).write.mode("append").parquet(path)
        return self.tagged(spark.read.parquet(path))

    def sort(self, *keys: tuple[int | str, bool]) -> View:
        """Stable: rows equal under the new keys keep the order they have. Columns by name or number."""
        new = tuple((self.resolve(c), up) for c, up in keys)
        taken = {c for c, _ in new}
        return replace(self, keys=(*new, *((c, up) for c, up in self.keys if c not in taken)))

    def project(self, *columns: int | str) -> View:
        """Other visible columns, in this order, by name or number; row id, raw record and the columns of the order stay in the rows."""
        return replace(self, columns=[self.resolve(c) for c in columns])

    def tagged(self, tags: DataFrame) -> View:
        """Rows whose id is among ``tags`` (_row_id); order kept, repeated tags don't matter."""
        return replace(self, df=self.df.join(tags.select(ROW), ROW, "left_semi"))

    def untagged(self, tags: DataFrame) -> View:
        return replace(self, df=self.df.join(tags.select(ROW), ROW, "left_anti"))

    def tags(self) -> DataFrame:
        """The row ids of this view, to be kept as marks."""
        return self.df.select(ROW)


def shared_dir(spark) -> str:
    """``spark.checkpoint.dir``, or a folder of this machine, set once, where the master is local and it isn't set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Tables that views have written in this process, for :func:`drop_tables`.
_written_tables: list[str] = []


def new_path(spark, name: str) -> str:
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    _written_tables.append(path)
    return path


def drop_tables(spark) -> None:
    """Delete the tables that :meth:`View.placed`, far pages and long lists of :meth:`View.among` have written; nothing may read them afterwards."""
    context = spark.sparkContext
    while _written_tables:
        at = context._jvm.org.apache.hadoop.fs.Path(_written_tables.pop())
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def add_tags(tags: DataFrame, view: View) -> DataFrame:
    """Marks together with the rows of a view."""
    return tags.select(ROW).union(view.tags()).distinct()


def remove_tags(tags: DataFrame, view: View) -> DataFrame:
    return tags.select(ROW).join(view.tags(), ROW, "left_anti")


def flagged(view: View, tags: DataFrame) -> View:
    """The view with ``_tagged``: whether a row's id is among ``tags``; repeated tags don't matter."""
    own = tags.select(ROW).distinct().withColumn(TAGGED, F.lit(True))
    return replace(view, df=view.df.join(own, ROW, "left").withColumn(TAGGED, F.coalesce(TAGGED, F.lit(False))))


def tag_ids(tags: DataFrame) -> DataFrame:
    """The marked row ids, each once, in ascending order."""
    return tags.select(ROW).distinct().orderBy(ROW)


def tagged_count(tags: DataFrame) -> DataFrame:
    """``(tagged)``: how many rows are marked."""
    return tags.agg(F.count_distinct(ROW).alias("tagged"))


def clear_tags(tags: DataFrame) -> DataFrame:
    """No marks."""
    return tags.select(ROW).where(F.lit(False))


def from_table(df: DataFrame, row_id: str | Column, columns: list[str] | None = None) -> View:
    """A view of any table: all columns as text, ``row_id`` (unique, long) names the rows, nothing is shuffled.

    The raw record is the row as a line of a CSV file; it is computed only where it is searched.
    """
    columns = columns or df.columns
    own = [F.col(f"`{c}`").cast("string").alias(c) for c in columns]
    row = F.col(row_id) if isinstance(row_id, str) else row_id
    raw = F.concat_ws(",", *(csv_cell(F.col(f"`{c}`").cast("string")) for c in columns))
    return View(df.select(row.cast("long").alias(ROW), *own, raw.alias(RAW)), list(columns))
