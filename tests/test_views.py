"""Views, marks, export, sessions, times and indicators."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tracewright.functions import indicators, times
from tracewright.operators import grouping, timeline
from tracewright.operators.timeline import UnknownColumn, add_tags, clear_tags, flagged, from_table, remove_tags, tag_ids, tagged_count
from tracewright.session import Session
from tracewright.sources import export


@pytest.fixture(scope="module")
def rows(spark):
    data = [(0, "b", "1", 'say "hi"'), (1, "a", "5", "has,comma"), (2, "b", "9", "tab\there\nline"), (3, "a", "5", "<i>&'"), (4, "a", "2", None)]
    return from_table(spark.createDataFrame(data, "id long, grp string, value string, note string"), "id", ["grp", "value", "note"])


def ids(view):
    return [r[0] for r in view.ordered().select("_row_id").collect()]


def test_sorts_compose_and_are_stable(rows):
    assert ids(rows.sort(("grp", True), ("value", False))) == [1, 3, 4, 2, 0]
    assert ids(rows.sort(("value", False)).sort(("grp", True))) == [1, 3, 4, 2, 0]
    assert ids(rows.sort()) == [0, 1, 2, 3, 4] and ids(rows.sort((0, True), ("VALUE", False))) == [1, 3, 4, 2, 0]
    assert [r[0] for r in rows.sort(("value", True)).page(1, 2).select("_row_id").collect()] == [4, 1]
    assert rows.page(99, 5).count() == 0 and rows.page(-3, 2000).count() == 5


def test_columns_by_name_and_number(rows):
    assert rows.project(2, "GRP").columns == ["note", "grp"] and rows.resolve("Value") == "value"
    for column in ("gone", 3, -1):
        for use in (lambda c: rows.sort((c, True)), rows.project, lambda c: grouping.distribution(rows, c), lambda c: grouping.level(rows, [c])):
            with pytest.raises(UnknownColumn):
                use(column)


def test_places(rows):
    v = rows.sort(("value", False))
    assert [r[0] for p in (-1, 0, 4, 5) for r in v.row_at(p).collect()] == [2, 0]
    assert [v.cell_at(p, c).first()[0] for p, c in ((0, "note"), (3, "note"), (5, "grp"), (-1, 0))] == ["tab\there\nline", "", "", ""]


@pytest.mark.parametrize("sorts", [[], [("y", True), ("x", False)]])
def test_far_places_equal_near_ones(spark, sorts):
    """Pages by counting, with hot keys, both zeros, infinities, texts and ties, from the beginning to behind the end."""
    df = spark.range(700).selectExpr("id", "CASE WHEN id % 3 = 0 THEN '7' WHEN id % 7 = 0 THEN concat('t', id % 10) WHEN id % 11 = 0 THEN '-0' WHEN id % 13 = 0 THEN 'inf' WHEN id % 17 = 0 THEN null ELSE cast(id % 100 AS string) END AS x", "'same' AS y")
    view = from_table(df, "id", ["x", "y"]).sort(*sorts)
    want = ids(view)
    for offset, limit in ((333, 20), (690, 50), (700, 5)):
        assert [r["_row_id"] for r in view.page(offset, limit, near=30).collect()] == want[offset : offset + limit]
    assert [r[0] for r in view.row_at(350, near=1).collect()] == [want[350]] and view.cell_at(9999, "x", near=1).first()[0] == ""
    timeline.drop_tables(spark)


def test_clipboard(rows):
    v = rows.where("grp:a").sort(("value", True)).project("value", "grp")
    assert [r[0] for r in export.plain_tsv(v, header=True).collect()] == ["value\tgrp", "2\ta", "5\ta", "5\ta"]
    assert [r[0] for r in export.plain_tsv(v).collect()] == ["2\ta", "5\ta", "5\ta"]


def test_projection_and_cells(rows):
    v = rows.project("value", "grp")
    assert v.cells().columns == ["_row_id", "value", "grp"]
    assert rows.cell(4, "note").first()[0] == "" and rows.cell(77, "note").first()[0] == "" and rows.cell(1, 2).first()[0] == "has,comma"
    assert rows.joined_cells().where("_row_id = 4").first()["cells"] == "a\x012\x01"
    assert rows.detail(0).first()[0] == 'grp     b\nvalue   1\nnote    say "hi"'
    assert rows.line_numbers().agg(F.max("line")).first()[0] == 5


def test_marks(spark, rows):
    tags = rows.where("grp:a").tags()
    assert ids(rows.tagged(tags.union(tags)).sort(("value", True))) == [4, 1, 3]
    assert ids(rows.untagged(tags)) == [0, 2]
    more = add_tags(tags, rows.where("value:9"))
    assert sorted(r[0] for r in remove_tags(more, rows.where("value:5")).collect()) == [2, 4]
    assert ids(rows.tagged(spark.createDataFrame([], "_row_id long"))) == []
    assert {r["_row_id"]: r["_tagged"] for r in flagged(rows, more.union(more)).df.collect()} == {0: False, 1: True, 2: True, 3: True, 4: True}
    assert tagged_count(more.union(more)).first()[0] == 4 and clear_tags(more).count() == 0 and [r[0] for r in tag_ids(more.union(more)).collect()] == [1, 2, 3, 4]


def written(view, tmp_path, form, columns=None):
    export.write(view, str(tmp_path / form), form, columns)
    parts = sorted(f for f in os.listdir(tmp_path / form) if f.startswith("part"))
    return b"".join((tmp_path / form / f).read_bytes() for f in parts).decode()


def test_exact_files(rows, tmp_path):
    some = rows.sort(("grp", True))
    assert written(some, tmp_path, "csv") == 'grp,value,note\na,5,"has,comma"\na,5,<i>&\'\na,2,\nb,1,"say ""hi"""\nb,9,"tab\there\nline"\n'
    assert written(rows.where("value:1"), tmp_path, "tsv", ["note", "grp", "gone"]) == 'note\tgrp\n"say ""hi"""\tb\n'
    text = written(some, tmp_path, "json")
    assert text.startswith('[\n  {"grp": "a", "value": "5", "note": "has,comma"},\n') and text.endswith('"}\n]\n')
    assert [r["note"] for r in json.loads(text)] == ["has,comma", "<i>&'", "", 'say "hi"', "tab\there\nline"]
    assert written(rows.where("value:2"), tmp_path, "html") == "<table>\n<thead><tr><th>grp</th><th>value</th><th>note</th></tr></thead>\n<tbody>\n<tr><td>a</td><td>2</td><td></td></tr>\n</tbody>\n</table>\n"
    assert written(rows.where("value:nothing"), tmp_path / "none", "json") == "[\n\n]\n"
    with pytest.raises(ValueError):
        export.write(rows, str(tmp_path / "x"), "xml")


def test_json_control_characters(spark, tmp_path):
    view = from_table(spark.createDataFrame([(0, "a\x01b\\é\r")], "id long, v string"), "id", ["v"])
    assert written(view, tmp_path, "json") == '[\n  {"v": "a\\u0001b\\\\é\\r"}\n]\n'


def test_session(spark, rows, tmp_path):
    rows.where("grp:a").tags().write.parquet(str(tmp_path / "tags"))
    s = Session(search="value:5", filters={"grp": "a"}, sort=[("note", False)], hidden=["grp"], tags_table=str(tmp_path / "tags"), tagged_only=True)
    back = Session.from_json(s.to_json())
    assert back == s
    v = back.apply(rows)
    assert v.columns == ["value", "note"] and ids(v) == [1, 3]
    again = Session.capture(v, rows, search="value:5", filters={"grp": "a"}, tags_table=str(tmp_path / "tags"), tagged_only=True)
    assert again == s and Session.capture(rows, rows) == Session()
    grouped = Session(search="grp:/./", group=["GRP", "gone", "value"], sort=[("note", False)]).groups(rows)
    assert sorted((r["depth"], r["label"], r["n"]) for r in grouped.collect()) == [(1, "a", 3), (1, "b", 2), (2, "1", 1), (2, "2", 1), (2, "5", 2), (2, "9", 1)]
    assert Session(group=["gone"]).groups(rows) is None


@pytest.mark.parametrize("value, form", [("2031-02-18T09:21:40ZTUTC", "iso8601"), (" 2031-02-18 09:21:40", "iso8601"), ("1717777777", "epochSeconds"), ("1717777777123", "epochMillis"), ("svchost.exe", None), ("12345", None), ("", None), (None, None), ("99999999999", None)])
def test_detect(spark, value, form):
    assert spark.createDataFrame([(value,)], "v string").select(times.detect(F.col("v"))).first()[0] == form


@pytest.mark.parametrize("value, form, want", [
    ("2031-02-18T09:21:40ZTUTC", "iso8601", "2031-02-18 09:21:40 UTC"), ("2031-02-18T09:21:40.250ZTUTC", "iso8601", "2031-02-18 09:21:40 UTC"),
    ("2031-02-18T09:21:40Ztutc", "iso8601", "2031-02-18 09:21:40 UTC"), ("2031-02-18T09:21:40TUTC", "iso8601", "2031-02-18 09:21:40 UTC"), ("2031-02-18T09:21:40GMT", "iso8601", "2031-02-18 09:21:40 UTC"),
    ("2031-02-18T09:21:40Z UTC", "iso8601", "2031-02-18 09:21:40 UTC"), ("2031-02-18T09:21:40+02:00", "iso8601", "2031-02-18 07:21:40 UTC"), ("2031-02-18 09:21:40-0130", "iso8601", "2031-02-18 10:51:40 UTC"),
    ("2031-02-18T09:21:40", "iso8601", "2031-02-18 09:21:40 UTC"), ("2031-02-18T09:21:40XYZ", "iso8601", None), ("2031-02-18T09:21:40UTCX", "iso8601", None), ("2031-02-18T09:21:40 EST", "iso8601", None),
    ("2031-13-18T09:21:40Z", "iso8601", None), ("not a date", "iso8601", None), ("946684800", "epochSeconds", "2000-01-01 00:00:00 UTC"), ("946684800000", "epochMillis", "2000-01-01 00:00:00 UTC"), ("x", "epochSeconds", None),
])
def test_convert(spark, value, form, want):
    assert spark.createDataFrame([(value,)], "v string").select(times.shown(F.col("v"), form, "UTC")).first()[0] == (want or value)


def test_other_zone_and_raw(spark):
    df = spark.createDataFrame([("2031-02-18T09:21:40Z",)], "v string")
    assert df.select(times.shown(F.col("v"), "iso8601", "Europe/Paris"), times.shown(F.col("v"), "iso8601", None)).first() == (f"2031-02-18 10:21:40 {times.abbreviation('Europe/Paris')}", "2031-02-18T09:21:40Z")
    assert times.abbreviation("Europe/Paris") in ("CET", "CEST") and times.abbreviation("Asia/Kathmandu") == "GMT+5:45" and times.abbreviation("Asia/Dubai") == "GMT+4"


def test_column_forms(spark):
    df = spark.createDataFrame([("2026-01-01 00:00:00", "1717777777", "x", "")] * 3 + [("", "", "y", "2026-01-01 00:00:00")], "a string, b string, c string, d string")
    assert times.column_forms(df, df.columns) == {"a": "iso8601", "b": "epochSeconds"}
    assert times.column_forms(df.limit(0), []) == {}


@pytest.mark.parametrize("value, want", [("D41D8CD98F00B204E9800998ECF8427E", ("md5", "d41d8cd98f00b204e9800998ecf8427e")), (" 10.0.0.255\t", ("ipv4", "10.0.0.255")), ("010.001.0.1", ("ipv4", "010.001.0.1")), ("1.2.3.256", None), ("1.2.3", None), ("a" * 40, ("sha1", "a" * 40)), ("b" * 64, ("sha256", "b" * 64)), ("fe80::1", ("ipv6", "fe80::1")), ("12:34:56", ("ipv6", "12:34:56")), ("explorer.exe", None), ("", None), (None, None)])
def test_indicators(spark, value, want):
    got = spark.createDataFrame([(value,)], "v string").select(indicators.indicator(F.col("v")).alias("i")).first()["i"]
    assert (tuple(got) if got else None) == want


def test_colours(spark):
    df = spark.createDataFrame([("Login FAILED with error",), ("failed",), ("ok",), (None,)], "v string")
    assert [r[0] for r in df.select(indicators.colour(F.col("v"))).collect()] == ["red", "orange", None, None]


def test_follow(spark, tmp_path):
    from tracewright.streaming.follow import follow

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text('host,msg\nweb01,"disk\nerror"\nweb02,ok\n')
    q = follow(spark, str(tmp_path / "in"), ["host", "msg"], "msg:ERROR").writeStream.format("memory").queryName("followed").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    (tmp_path / "in/b.csv").write_text("host,msg\nweb03,an error\n")
    q.processAllAvailable()
    q.stop()
    assert {r["host"] for r in spark.table("followed").collect()} == {"web01", "web03"}


def test_places_of_the_whole_order(spark):
    """Every row has its place, beyond a page and over several partitions: hot keys, text after numbers, both zeros."""
    df = spark.range(5000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN '7' WHEN id % 7 = 0 THEN concat('t', id % 10) WHEN id % 11 = 0 THEN if(id % 2 = 0, '-0.0', '0.0') ELSE cast(id % 100 AS string) END AS x").repartition(7)
    view = from_table(df, "id", ["x"]).sort(("x", False))
    got = {r["pos"]: r["_row_id"] for r in view.placed().collect()}
    assert [got[i] for i in range(5000)] == [r["_row_id"] for r in view.ordered().collect()]
