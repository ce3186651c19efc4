"""Queries over the driver's tables, each beside the SQL that says the same.

Views of tables take the table's unique key as row id, so nothing is shuffled to number rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import indicators, times
from ..functions.text import LOWER, NUMBER, UPPER, single_line
from ..operators import grouping, search
from ..operators.timeline import ROW, View, add_tags, clear_tags, flagged, from_table, remove_tags, shared_dir, tag_ids, tagged_count
from ..sources import delimited, export

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Tables with a unique key, and their columns.
TABLES = {
    "events": ("event_id", ["event_id", "ts", "user_id", "event_type", "value", "props"]),
    "orders": ("o_orderkey", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]),
    "customer": ("c_custkey", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]),
    "part": ("p_partkey", ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]),
    "documents": ("doc_id", ["doc_id", "text", "lang", "source", "n_chars"]),
    "pages": ("page_id", ["page_id", "url", "html"]),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> View:
    key, columns = TABLES[name]
    return from_table(spark.read.parquet(f"{sf_dir}/{name}.parquet"), key, columns)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# --- SQL of the shared rules ---------------------------------------------


def _fold(c: str) -> str:
    return f"translate({c}, '{UPPER}', '{LOWER}')"


def _text(c: str) -> str:
    return f"coalesce(CAST({c} AS VARCHAR), '')"


def _csv(c: str, sep: str = ",") -> str:
    t = _text(c)
    return f"""CASE WHEN contains({t}, '{sep}') OR contains({t}, '"') OR contains({t}, chr(10)) OR contains({t}, chr(13)) THEN '"' || replace({t}, '"', '""') || '"' ELSE {t} END"""


def _raw(table: str) -> str:
    return "concat_ws(',', " + ", ".join(map(_csv, TABLES[table][1])) + ")"


def _key(c: str) -> tuple[str, str, str, str]:
    v = rf"regexp_replace({_text(c)}, '^\s+|\s+$', '', 'g')"
    number = f"CASE WHEN regexp_matches({v}, '{NUMBER}') THEN TRY_CAST({v} AS DOUBLE) END"
    return (f"CASE WHEN ({number}) IS NULL THEN 1 ELSE 0 END", number, f"CASE WHEN ({number}) = 0 AND starts_with({v}, '-') THEN 0 ELSE 1 END", f"CASE WHEN ({number}) IS NULL THEN {_fold(v)} END")


def _order(keys: list[tuple[str, bool]], key: str) -> str:
    return ", ".join([f"{k} {'ASC NULLS FIRST' if up else 'DESC NULLS LAST'}" for c, up in keys for k in _key(c)] + [key])


def _cells(table: str, columns: list[str] | None = None) -> str:
    key, own = TABLES[table]
    return f"SELECT {key} AS _row_id, " + ", ".join(f"{_text(c)} AS {c}" for c in columns or own) + f" FROM {table}"


# --- search ---------------------------------------------------------------


def _search(name: str, table: str, condition, sql: str) -> None:
    query(name, f"{_cells(table)} WHERE {sql}")(lambda spark, d: (v := view(spark, d, table)).where(condition(v)).cells())


_has = lambda c, x: f"contains({_fold(_text(c))}, '{x}')"
_raw_has = lambda t, x: f"contains({_fold(_raw(t))}, '{x}')"

_search("search_global_substring", "events", lambda v: v.term("ERROR"), _raw_has("events", "error"))
_search("search_scoped_substring", "part", lambda v: v.term("P_Type:small"), _has("p_type", "small"))
_search("search_scope_by_index", "part", lambda v: v.term("#2:Brand#1"), _has("p_brand", "brand#1"))
_search("search_phrase", "part", lambda v: v.term('p_name:"Red Widget"'), _has("p_name", "red widget"))
_search("search_regex_global", "events", lambda v: v.term(r'/"k""?: [0-9]{2}\D+$/'), rf"""regexp_matches({_raw('events')}, '"k""?: [0-9]{{2}}\D+$')""")
_search("search_regex_scoped", "customer", lambda v: v.term(r"c_name:/#0+[12]\d\d$/"), r"regexp_matches(c_name, '#0+[12]\d\d$')")
_search("search_boolean_and_or_not", "events", lambda v: (v.term("event_type:error") | v.term("event_type:click")) & ~v.term(r'props:/"k": 6\d/'), r"""event_type IN ('error', 'click') AND NOT regexp_matches(props, '"k": 6\d')""")
_search("search_implicit_and", "orders", lambda v: search.all_of(v.term("o_orderstatus:F"), v.term("urgent")), f"{_has('o_orderstatus', 'f')} AND {_raw_has('orders', 'urgent')}")
_search("search_empty_all", "orders", lambda v: v.term("  "), "TRUE")
_search("search_literal_colon", "orders", lambda v: v.term("00:00:00"), _raw_has("orders", "00:00:00"))
_search("search_ascii_fold_only", "documents", lambda v: v.term("text:É") | v.term("text:THE"), f"{_has('text', 'É')} OR {_has('text', 'the')}")
_search("column_filters_composed", "orders", lambda v: search.filters(v.columns, {"o_orderstatus": "o", "o_orderpriority": '"high"', "o_custkey": " "}, v.term("199")), f"{_has('o_orderstatus', 'o')} AND {_has('o_orderpriority', 'high')} AND {_raw_has('orders', '199')}")
_search("smart_paste_or", "part", lambda v: search.any_pasted('Brand#11\n"Brand#22",\tBrand#11\r\n', v.columns), f"{_raw_has('part', 'brand#11')} OR {_raw_has('part', 'brand#22')}")


_search("search_phrase_with_scope", "part", lambda v: v.term('"P_NAME:Red Widget"'), _has("p_name", "red widget"))
_search("search_regex_backtracking", "documents", lambda v: v.term(r"text:/([a-z]+[ ,]*)+\.\n([A-Z][a-z]+ ?)+ is/"), r"regexp_matches(text, '([a-z]+[ ,]*)+\.\n([A-Z][a-z]+ ?)+ is')")


@query("listed_in_record", f"WITH o AS MATERIALIZED (SELECT o_orderkey AS k, {_fold(_raw('orders'))} AS x FROM orders), h AS (SELECT DISTINCT k FROM o JOIN customer ON contains(x, ',' || c_custkey || ',o,') WHERE c_acctbal > 0) {_cells('orders')} WHERE o_orderkey IN (SELECT k FROM h)")
def listed_in_record(spark, d):
    """Open orders of customers with money: a list of values made from a table, looked for in the whole record."""
    listed = spark.read.parquet(f"{d}/customer.parquet").where("c_acctbal > 0").select(F.concat(F.lit(","), F.col("c_custkey").cast("string"), F.lit(",O,")))
    return view(spark, d, "orders").among(listed).cells()


@query("listed_in_column", f"WITH o AS MATERIALIZED (SELECT doc_id AS k, {_fold(_text('text'))} AS x FROM documents), h AS (SELECT DISTINCT k FROM o JOIN benchmark b ON contains(x, {_fold('b.text[20:50]')})) {_cells('documents')} WHERE doc_id IN (SELECT k FROM h)")
def listed_in_column(spark, d):
    """Documents that hold some characters of a benchmark item, in one column."""
    return view(spark, d, "documents").among(spark.read.parquet(f"{d}/benchmark.parquet").select(F.substring("text", 20, 31)), "text").cells()


# --- order ----------------------------------------------------------------


def _sorted(name: str, table: str, sorts: list[list[tuple[str, bool]]], limit: int = 1000) -> None:
    """The first rows of an order, with their place: a page is a report of the top rows."""
    key, columns = TABLES[table]
    keys: list[tuple[str, bool]] = []
    for new in sorts:
        keys = [*new, *(k for k in keys if k[0] not in {c for c, _ in new})]

    def run(spark, d):
        v = view(spark, d, table)
        for new in sorts:
            v = v.sort(*new)
        return _with_places(v.page(0, limit), v).select("pos", ROW, *columns)

    query(name, f"SELECT row_number() OVER (ORDER BY {_order(keys, key)}) - 1 AS pos, {key} AS _row_id, {', '.join(f'{_text(c)} AS {c}' for c in columns)} FROM {table} QUALIFY pos < {limit}")(run)

    # the whole order beside its first page
    def whole(spark, d):
        v = view(spark, d, table)
        for new in sorts:
            v = v.sort(*new)
        return v.placed().select("pos", ROW, *columns)

    query(f"{name}_whole", f"SELECT row_number() OVER (ORDER BY {_order(keys, key)}) - 1 AS pos, {key} AS _row_id, {', '.join(f'{_text(c)} AS {c}' for c in columns)} FROM {table}")(whole)


def _with_places(page: DataFrame, v: View) -> DataFrame:
    """Places of the rows of one page, which is bounded by its limit."""
    from pyspark.sql import Window

    rows, order, _ = replace(v, df=page).keyed()
    return rows.withColumn("pos", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))


_sorted("sort_numeric_aware", "orders", [[("o_totalprice", True)]])
_sorted("sort_desc", "part", [[("p_type", False)]])
_sorted("sort_multi_key_stable", "customer", [[("c_mktsegment", True), ("c_acctbal", False)]])
_sorted("sort_composed", "orders", [[("o_custkey", True)], [("o_orderpriority", False)]])


# --- groups ---------------------------------------------------------------


def _grouped(name: str, table: str, columns: list[str], sort: list[tuple[str, bool]] | None = None) -> None:
    key, _ = TABLES[table]
    names = [f"k{i}_{j}" for i in range(len(columns)) for j in range(4)]
    parts = [k for c in columns for k in _key(c)]
    labels = ", ".join(f"arg_min({_text(c)}, o) AS label{i}" for i, c in enumerate(columns, 1))
    select = ", ".join(f"{k} AS {n}" for k, n in zip(parts, names))
    order = _order(sort or [], key)

    def run(spark, d):
        v = view(spark, d, table)
        v = v.sort(*sort) if sort else v
        return grouping.level(v, columns).select(*(f"label{i}" for i in range(1, len(columns) + 1)), "n")

    query(name, f"WITH r AS (SELECT *, {select}, row_number() OVER (ORDER BY {order}) AS o FROM {table}) SELECT {labels}, count(*) AS n FROM r GROUP BY {', '.join(names)}")(run)


_grouped("group_one_level", "events", ["event_type"])
_grouped("group_numeric_key", "part", ["p_size"])
_grouped("group_two_level", "orders", ["o_orderstatus", "o_orderpriority"])
_grouped("group_three_level", "orders", ["o_orderstatus", "o_orderpriority", "o_custkey"])
_grouped("group_labels_of_sorted_view", "part", ["p_brand", "p_size"], [("p_type", False), ("p_retailprice", True)])


def _nodes(name: str, table: str, columns: list[str], sort: list[tuple[str, bool]]) -> None:
    key, _ = TABLES[table]
    names = [[f"k{i}_{j}" for j in range(4)] for i in range(len(columns))]
    select = ", ".join(f"{k} AS {n}" for c, own in zip(columns, names) for k, n in zip(_key(c), own))
    flat = [", ".join(own) for own in names]
    sets = ", ".join(f"({', '.join(flat[:i])})" for i in range(1, len(columns) + 1))
    depth = " + ".join(f"(1 - grouping(k{i}_0))" for i in range(len(columns)))
    label = "CASE " + depth + " " + " ".join(f"WHEN {i} THEN arg_min({_text(c)}, o)" for i, c in enumerate(columns, 1)) + " END"
    below = "CASE " + depth + " " + " ".join(f"WHEN {i} THEN count(DISTINCT ({flat[i]}))" for i in range(1, len(columns))) + " ELSE 0 END"

    def run(spark, d):
        v = view(spark, d, table).sort(*sort)
        return grouping.with_children(grouping.nodes(v, columns), len(columns)).select("depth", "label", "n", "n_children")

    query(name, f"WITH r AS (SELECT *, {select}, row_number() OVER (ORDER BY {_order(sort, key)}) AS o FROM {table}) SELECT CAST({depth} AS INTEGER) AS depth, {label} AS label, count(*) AS n, {below} AS n_children FROM r GROUP BY GROUPING SETS ({sets})")(run)


_nodes("tree_two_levels", "part", ["p_brand", "p_size"], [("p_type", False)])
_nodes("tree_three_levels", "orders", ["o_orderstatus", "o_orderpriority", "o_custkey"], [("o_totalprice", True)])


@query("group_leaf_rows", f"{_cells('orders')} WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'")
def group_leaf_rows(spark, d):
    return grouping.leaves(view(spark, d, "orders"), {"o_orderstatus": "p", "o_orderpriority": "1-urgent"}).cells()


@query("column_distribution", "SELECT CAST(user_id AS VARCHAR) AS value, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, value LIMIT 20")
def column_distribution(spark, d):
    return grouping.distribution(view(spark, d, "events"), "user_id")


@query("distribution_of_filtered_view", "SELECT CAST(user_id AS VARCHAR) AS value, count(*) AS n FROM events WHERE event_type = 'error' AND NOT regexp_matches(props, '\"k\": 6[0-9]') GROUP BY user_id ORDER BY n DESC, value LIMIT 20")
def distribution_of_filtered_view(spark, d):
    """The flagship: a boolean search and the commonest values of what it leaves."""
    v = view(spark, d, "events")
    return grouping.distribution(v.where(v.term("event_type:error") & ~v.term(r'props:/"k": 6\d/')), "user_id")


@query("distinct_total", "SELECT count(DISTINCT l_quantity) AS distinct_total FROM lineitem")
def distinct_total(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    return grouping.distinct_total(from_table(li, F.lit(0), ["l_quantity"]), "l_quantity")


# --- rows -----------------------------------------------------------------


@query("page_offset_limit", f"SELECT * FROM ({_cells('orders')}) WHERE contains(o_orderpriority, 'HIGH') ORDER BY _row_id LIMIT 50 OFFSET 100")
def page_offset_limit(spark, d):
    return view(spark, d, "orders").where("o_orderpriority:high").page(100, 50).select(ROW, *TABLES["orders"][1])


@query("view_cell_lookup", "SELECT o_orderpriority FROM orders WHERE o_orderkey = 7")
def view_cell_lookup(spark, d):
    return view(spark, d, "orders").cell(7, "o_orderpriority")


_BY_PRICE = _order([("o_totalprice", False)], "o_orderkey")


@query("view_row_at_position", f"SELECT o_orderkey AS _row_id FROM orders WHERE o_orderstatus = 'F' ORDER BY {_BY_PRICE} LIMIT 1 OFFSET 41")
def view_row_at_position(spark, d):
    """The row id at a place of a filtered and sorted view."""
    return view(spark, d, "orders").where("o_orderstatus:f").sort(("o_totalprice", False)).row_at(41)


@query("view_cell_at_position", f"SELECT coalesce((SELECT CAST(o_orderpriority AS VARCHAR) FROM orders WHERE o_orderstatus = 'F' ORDER BY {_BY_PRICE} LIMIT 1 OFFSET 41), '') AS o_orderpriority")
def view_cell_at_position(spark, d):
    """The cell at a place of a filtered and sorted view; the column by its number."""
    return view(spark, d, "orders").where("o_orderstatus:f").sort(("o_totalprice", False)).cell_at(41, 5)


@query("view_cell_outside", f"SELECT coalesce((SELECT o_orderpriority FROM orders WHERE {_has('o_orderstatus', 'nothing')} LIMIT 1), '') AS o_orderpriority")
def view_cell_outside(spark, d):
    """Empty text at a place behind the last row."""
    return view(spark, d, "orders").where("o_orderstatus:nothing").cell_at(0, "O_OrderPriority")


_MIDDLE = "(SELECT count(*) // 2 FROM orders)"


@query("page_in_the_middle", f"SELECT * FROM ({_cells('orders')}) JOIN (SELECT o_orderkey FROM orders ORDER BY {_order([('o_orderpriority', False), ('o_totalprice', True)], 'o_orderkey')} LIMIT 500 OFFSET {_MIDDLE}) AS p ON p.o_orderkey = _row_id".replace("SELECT * FROM (", f"SELECT _row_id, {', '.join(f'c.{x}' for x in TABLES['orders'][1])} FROM (", 1).replace(") JOIN", ") AS c JOIN"))
def page_in_the_middle(spark, d):
    """A page from the middle of an order with many equal keys, found by counting ranges."""
    v = view(spark, d, "orders").sort(("o_orderpriority", False), ("o_totalprice", True))
    return v.page(v.count() // 2, 500, near=1000).select(ROW, *v.columns)


@query("view_row_in_the_middle", f"SELECT o_orderkey AS _row_id FROM orders ORDER BY {_BY_PRICE} LIMIT 1 OFFSET {_MIDDLE}")
def view_row_in_the_middle(spark, d):
    v = view(spark, d, "orders").sort(("o_totalprice", False))
    return v.row_at(v.count() // 2, near=500)


@query("cell_outside", "SELECT coalesce((SELECT o_orderpriority FROM orders WHERE o_orderkey < 0 LIMIT 1), '') AS o_orderpriority")
def cell_outside(spark, d):
    """Empty text for a row that isn't there; the column by its number."""
    return view(spark, d, "orders").cell(-1, 5)


@query("columns_by_number_and_any_case", "SELECT CAST(o_orderstatus AS VARCHAR) AS value, count(*) AS n FROM orders GROUP BY 1")
def columns_by_number_and_any_case(spark, d):
    v = view(spark, d, "orders").project("O_ORDERSTATUS", 0)
    return grouping.distribution(v, 0, None)


@query("project_reorder_columns", _cells("orders", ["o_orderpriority", "o_orderkey"]))
def project_reorder_columns(spark, d):
    return view(spark, d, "orders").project("o_orderpriority", "o_orderkey").cells()


@query("row_cells_joined", "SELECT o_orderkey AS _row_id, concat_ws(chr(1), " + ", ".join(map(_text, TABLES["orders"][1])) + ") AS cells FROM orders")
def row_cells_joined(spark, d):
    return view(spark, d, "orders").joined_cells()


@query("line_numbers", "SELECT o_orderkey + 1 AS line, o_orderpriority FROM orders")
def line_numbers(spark, d):
    return view(spark, d, "orders").project("o_orderpriority").line_numbers()


@query("row_detail", "SELECT 'o_orderkey        ' || o_orderkey || chr(10) || 'o_orderpriority   ' || o_orderpriority AS detail FROM orders WHERE o_orderkey = 9")
def row_detail(spark, d):
    return view(spark, d, "orders").project("o_orderkey", "o_orderpriority").detail(9)


# --- marks ----------------------------------------------------------------

_URGENT, _OPEN = "o_orderpriority = '1-URGENT'", "o_orderstatus = 'O'"


@query("tagged_view", f"{_cells('orders')} WHERE {_URGENT}")
def tagged_view(spark, d):
    v = view(spark, d, "orders")
    return v.tagged(v.where("o_orderpriority:urgent").tags()).cells()


@query("intersect_tags", f"{_cells('orders')} WHERE {_URGENT} AND {_OPEN}")
def intersect_tags(spark, d):
    v = view(spark, d, "orders")
    return v.where("o_orderstatus:o").tagged(v.where("o_orderpriority:urgent").tags()).cells()


@query("tags_added_and_removed", f"SELECT o_orderkey AS _row_id FROM orders WHERE ({_URGENT} OR {_OPEN}) AND o_custkey % 10 <> 0")
def tags_added_and_removed(spark, d):
    v = view(spark, d, "orders")
    tags = add_tags(v.where("o_orderpriority:urgent").tags(), v.where("o_orderstatus:o"))
    return remove_tags(tags, v.where("o_custkey:/0$/"))


@query("tags_flag_column", f"SELECT o_orderkey AS _row_id, ({_URGENT}) AS _tagged FROM orders")
def tags_flag_column(spark, d):
    v = view(spark, d, "orders")
    tags = v.where("o_orderpriority:urgent").tags()
    return flagged(v, tags.union(tags)).df.select(ROW, "_tagged")


@query("tags_count", f"SELECT count(*) AS tagged FROM orders WHERE {_URGENT}")
def tags_count(spark, d):
    tags = view(spark, d, "orders").where("o_orderpriority:urgent").tags()
    return tagged_count(tags.union(tags))


@query("tags_cleared", "SELECT count(*) FILTER (o_orderkey IS NULL) AS tagged FROM orders")
def tags_cleared(spark, d):
    return tagged_count(clear_tags(view(spark, d, "orders").tags()))


@query("tags_as_ids", f"SELECT o_orderkey AS _row_id FROM orders WHERE {_URGENT} ORDER BY 1")
def tags_as_ids(spark, d):
    tags = view(spark, d, "orders").where("o_orderpriority:urgent").tags()
    return tag_ids(tags.union(tags))


@query("untagged_rows", f"{_cells('orders')} WHERE NOT ({_URGENT})")
def untagged_rows(spark, d):
    v = view(spark, d, "orders")
    return v.untagged(v.where("o_orderpriority:urgent").tags()).cells()


# --- export ---------------------------------------------------------------


def _json(c: str) -> str:
    t = _text(c)
    for old, new in (("'\\'", "'\\\\'"), ("'\"'", "'\\\"'"), ("chr(10)", "'\\n'"), ("chr(13)", "'\\r'"), ("chr(9)", "'\\t'")):
        t = f"replace({t}, {old}, {new})"
    return f"'\"{c}\": \"' || {t} || '\"'"


def _html(c: str) -> str:
    t = _text(c)
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#39;")):
        t = f"replace({t}, '{old}', '{new}')"
    return f"'<td>' || {t} || '</td>'"


def _exported(form: str, table: str, sql: str) -> None:
    query(f"export_{form}_lines", f"SELECT {TABLES[table][0]} AS _row_id, {sql} AS line FROM {table}")(lambda spark, d: export.lines(view(spark, d, table), form))


_exported("csv", "events", "concat_ws(',', " + ", ".join(_csv(c) for c in TABLES["events"][1]) + ")")
_exported("tsv", "events", "concat_ws(chr(9), " + ", ".join(_csv(c).replace("','", "chr(9)") for c in TABLES["events"][1]) + ")")
_exported("json", "pages", "'  {' || " + " || ', ' || ".join(map(_json, TABLES["pages"][1])) + " || '}'")
_exported("html", "pages", "'<tr>' || " + " || ".join(map(_html, TABLES["pages"][1])) + " || '</tr>'")


@query("csv_roundtrip", f"SELECT event_id - (SELECT min(event_id) FROM events) AS _row_id, {', '.join(f'{_text(c)} AS {c}' for c in TABLES['events'][1])}, {_raw('events')} AS _raw FROM events")
def csv_roundtrip(spark, d):
    """Events written as CSV parts in order, and read back as one file of records with dense row ids."""
    folder = f"{shared_dir(spark)}/tables/csv-{uuid.uuid4().hex}"
    export.write(view(spark, d, "events"), folder, "csv")
    columns = TABLES["events"][1]
    back = delimited.read(spark, folder, delimited.Schema(has_header=False, columns=tuple(columns)))
    rows = back.df.where(f"{ROW} > 0")  # the header is the first record of the first part
    return rows.select((F.col(ROW) - 1).alias(ROW), *columns, "_raw")


# --- cells ----------------------------------------------------------------


@query("ts_detect", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'iso8601' WHEN event_id % 3 = 1 THEN 'epochSeconds' ELSE 'epochMillis' END AS form FROM events")
def ts_detect(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    ms = (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long")
    text = F.when(F.col("event_id") % 3 == 0, F.col("ts").cast("string")).when(F.col("event_id") % 3 == 1, F.floor(ms / 1000).cast("string")).otherwise(ms.cast("string"))
    return e.select("event_id", times.detect(text).alias("form"))


@query("ts_convert_utc", "SELECT event_id, strftime(ts - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') || ' UTC' AS shown, CAST(event_type AS VARCHAR) AS kept FROM events")
def ts_convert_utc(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", times.shown(F.concat(F.col("ts").cast("string"), F.lit("+02:00")), times.ISO, "UTC").alias("shown"), times.shown(F.col("event_type"), times.ISO, "UTC").alias("kept"))


@query("ts_column_detection", "SELECT 'ts' AS name, 'iso8601' AS form")
def ts_column_detection(spark, d):
    v = view(spark, d, "events")
    found = times.column_forms(v.page(0, 100), v.columns)
    return spark.createDataFrame(sorted(found.items()), "name string, form string")


_HASHES = "md5(CAST(event_id AS VARCHAR))", "sha256(CAST(event_id AS VARCHAR))"
_IOC = f"CASE event_id % 4 WHEN 0 THEN {_HASHES[0]} WHEN 1 THEN {_HASHES[1]} WHEN 2 THEN '10.0.' || (event_id % 256) || '.7' ELSE event_type END"


def _indicators(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    i = F.col("event_id")
    text = F.when(i % 4 == 0, F.upper(F.md5(i.cast("string")))).when(i % 4 == 1, F.sha2(i.cast("string"), 256)).when(i % 4 == 2, F.concat(F.lit(" 10.0."), (i % 256).cast("string"), F.lit(".7"))).otherwise(F.col("event_type"))
    return e.select("event_id", indicators.indicator(text).alias("found"))


@query("ioc_detect", f"SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'md5' WHEN 1 THEN 'sha256' WHEN 2 THEN 'ipv4' END AS type, CASE WHEN event_id % 4 < 3 THEN {_IOC} END AS value FROM events")
def ioc_detect(spark, d):
    return _indicators(spark, d).select("event_id", "found.type", "found.value")


@query("ioc_lookup_url", f"SELECT event_id, 'https://www.virustotal.com/gui/' || CASE WHEN event_id % 4 < 2 THEN 'file' ELSE 'ip-address' END || '/' || {_IOC} AS url FROM events WHERE event_id % 4 < 3")
def ioc_lookup_url(spark, d):
    return _indicators(spark, d).where("found IS NOT NULL").select("event_id", indicators.lookup_url(F.col("found")).alias("url"))


@query("ioc_detect_sha1_ipv6", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'sha1' WHEN 1 THEN 'ipv6' END AS type, CASE event_id % 3 WHEN 0 THEN sha1(CAST(event_id AS VARCHAR)) WHEN 1 THEN 'FE80::' || (event_id % 10) END AS value FROM events")
def ioc_detect_sha1_ipv6(spark, d):
    e, i = spark.read.parquet(f"{d}/events.parquet"), F.col("event_id")
    text = F.when(i % 3 == 0, F.upper(F.sha1(i.cast("string")))).when(i % 3 == 1, F.concat(F.lit("FE80::"), (i % 10).cast("string"))).otherwise(F.lit("12:34"))
    return e.select("event_id", indicators.indicator(text).alias("found")).select("event_id", "found.type", "found.value")


@query("clipboard_tsv", "SELECT concat_ws(chr(9), o_orderstatus, o_orderpriority) AS line FROM orders UNION ALL SELECT 'o_orderstatus' || chr(9) || 'o_orderpriority'")
def clipboard_tsv(spark, d):
    """Rows and header without quoting."""
    return export.plain_tsv(view(spark, d, "orders").project("o_orderstatus", "o_orderpriority"), header=True)


@query("conditional_format", "SELECT event_id, CASE WHEN contains(event_type, 'error') THEN 'red' END AS colour FROM events")
def conditional_format(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", indicators.colour(F.col("event_type")).alias("colour"))


@query("single_line", "SELECT doc_id, replace(replace(replace(text, chr(13) || chr(10), ' ⏎ '), chr(10), ' ⏎ '), chr(13), ' ⏎ ') AS line FROM documents")
def one_line(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", single_line(F.col("text")).alias("line"))
