"""Groups of a view: counts by the cells' keys, on one level or nested."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import key_fields, value_key
from .timeline import View


def level(view: View, columns: list[int | str], path: list[str] | None = None) -> DataFrame:
    """``(key1.., label1.., n)``: the groups of all ``columns``, the last of them nested in the others.

    A label is the cell of the group's first row in the view's order. Rows are counted with map-side
    combining, so a hot group costs one row a task. ``path``: cells of outer groups to stay in.
    """
    df, columns = view.df, [view.resolve(c) for c in columns]
    for c, cell in zip(columns, path or []):
        df = df.where(value_key(F.col(f"`{c}`")) == value_key(F.lit(cell)))
    depth = len(columns)
    out = _rows(df, view, columns).groupBy(*(x for i in range(1, depth + 1) for x in _fields(i))).agg(F.count("*").alias("n"), F.min_by("cells", "place").alias("first"))
    return out.select(*(_key(i) for i in range(1, depth + 1)), *(F.col(f"first.label{i}") for i in range(1, depth + 1)), "n")


def _fields(i: int) -> tuple[str, str]:
    return f"number{i}", f"text{i}"


def _key(i: int) -> Column:
    return F.struct(F.col(f"number{i}").alias("number"), F.col(f"text{i}").alias("text")).alias(f"key{i}")


def _rows(df: DataFrame, view: View, columns: list[str]) -> DataFrame:
    """Of each row the fields of its keys as plain columns, its cells, and its place in the view's order."""
    fields = [f.alias(n) for i, c in enumerate(columns, 1) for n, f in zip(_fields(i), key_fields(F.col(f"`{c}`")))]
    cells = F.struct(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(f"label{i}") for i, c in enumerate(columns, 1)))
    return df.select(*fields, cells.alias("cells"), view.place_key().alias("place"))


def tree(view: View, columns: list[str]) -> list[DataFrame]:
    """One table for each level; a child belongs to the parent whose keys it begins with."""
    return [level(view, columns[:d]).orderBy(*(f"key{i}" for i in range(1, d + 1))) for d in range(1, len(columns) + 1)]


def nodes(view: View, columns: list[int | str]) -> DataFrame:
    """``(depth, key1.., label, n)``: the groups of all levels at once, from one aggregation over the prefixes of ``columns``.

    Each row is counted on every level before anything is shuffled, so there is one shuffle, of a row a group and task. Keys
    deeper than a node are null; a node's parent has its keys but the last. ``label`` is the node's own cell, of its first row.
    """
    columns = [view.resolve(c) for c in columns]
    names = [_fields(i) for i in range(1, len(columns) + 1)]
    flat = [x for pair in names for x in pair]
    prefixes = [[x for pair in names[:d] for x in pair] for d in range(1, len(columns) + 1)]
    out = _rows(view.df, view, columns).groupingSets(prefixes, *flat).agg(F.grouping_id(*flat).alias("id"), F.count("*").alias("n"), F.min_by("cells", "place").alias("first"))
    depth = F.lit(len(columns)) - (F.bit_count("id") / 2).cast("int")
    keys = [F.when(depth >= i, _key(i)).alias(f"key{i}") for i in range(1, len(columns) + 1)]
    label = F.element_at(F.array(*(F.col(f"first.label{i}") for i in range(1, len(columns) + 1))), depth)
    return out.select(depth.alias("depth"), *keys, label.alias("label"), "n")


def with_children(found: DataFrame, columns: int) -> DataFrame:
    """:func:`nodes` of so many columns with ``n_children``, the number of groups right below each; a leaf has none.

    Counted from the nodes, not from the rows; a row a node is shuffled.
    """
    keys = [f"key{i}" for i in range(1, columns + 1)]
    parent = [F.when(F.col("depth") > i, F.col(k)).alias(k) for i, k in enumerate(keys, 1)]
    below = found.where("depth > 1").select((F.col("depth") - 1).alias("depth"), *parent).groupBy("depth", *keys).agg(F.count("*").alias("n_children"))
    same = [F.col("a.depth") == F.col("b.depth"), *(F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys)]
    joined = found.alias("a").join(below.alias("b"), same, "left")
    return joined.select("a.*", F.coalesce("b.n_children", F.lit(0)).alias("n_children"))


def leaves(view: View, path: dict[str, str]) -> View:
    """The rows of one group, in the view's order."""
    condition = F.lit(True)
    for c, cell in path.items():
        condition &= value_key(F.col(f"`{view.resolve(c)}`")) == value_key(F.lit(cell))
    return view.where(condition)


def distribution(view: View, column: int | str, limit: int | None = 20) -> DataFrame:
    """``(value, n)``: the commonest values of a column, by count, then by the value's bytes; None: all."""
    out = level(view, [column]).select(F.col("label1").alias("value"), "n").orderBy(F.desc("n"), "value")
    return out if limit is None else out.limit(limit)


def distinct_total(view: View, column: int | str) -> DataFrame:
    """``(distinct_total)``: the exact number of groups of a column."""
    return view.df.agg(F.count_distinct(value_key(F.col(f"`{view.resolve(column)}`"))).alias("distinct_total"))
