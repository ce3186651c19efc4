"""Cells' keys, terms and patterns, on the cases that plain Spark functions get wrong."""

import itertools
import pickle
import random
import re
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewright.functions import needles
from tracewright.functions.text import InvalidPattern, backtracks, contains, contains_any, either, fold_text, java_pattern, linear_pattern, matches, single_line, value_key
from tracewright.operators import grouping, search
from tracewright.operators.timeline import from_table


@pytest.fixture(scope="module")
def logs(spark):
    rows = [(0, "web01", "disk error here"), (1, "web02", "web01 in message"), (2, "web 01", "event at 12:34:56"), (3, "x", "ERR42 raised\r"), (4, None, "Kelvin K É"), (5, "a", "done by worker 3 now")]
    return from_table(spark.createDataFrame(rows, "id long, host string, message string"), "id", ["host", "message"])


@pytest.mark.parametrize("term, want", [
    ("DISK", [0]), ("host:web01", [0]), ("HOST:WEB01", [0]), ("#0:web01", [0]), ("#1:web01", [1]), ("#7:web01", []), ("12:34:56", [2]),
    ('host:"web 01"', [2]), ("", [0, 1, 2, 3, 4, 5]), ("   ", [0, 1, 2, 3, 4, 5]), (r"message:/err\d+/", []), (r"message:/(?i)err\d+/", [3]), ("/worker 3/", [5]),
    ('"host:web01"', [0]), ('"host:web 01"', [2]), ('"disk error"', [0]), (r'"message:/work\w+ 3/"', [5]), ('"12:34:56"', [2]), ("//", [0, 1, 2, 3, 4, 5]), ("kelvin k", []), ("é", []), ("É", [4]), ("host:", []), ("nothing:web01", []), ('message:/raised.$/', [3]),
])
def test_terms(logs, term, want):
    assert [r[0] for r in logs.where(term).ordered().select("_row_id").collect()] == want


def test_a_missing_cell_does_not_match_and_its_negation_does(logs):
    assert [r[0] for r in logs.where(~logs.term("host:e")).ordered().select("_row_id").collect()] == [3, 4, 5]


@pytest.mark.parametrize("bad", ["(", "a(?=b)", "(?<!a)b", r"(a)\1", "(?U)a", "[[:nope:]]"])
def test_refused_patterns_raise_at_once(logs, bad):
    with pytest.raises(InvalidPattern):
        logs.term(f"/{bad}/")


@pytest.mark.parametrize("pattern, text, hit", [(r"[[:alpha:]]+z", "mz", True), (r"(?P<n>a)", "a", True), (r"a$", "a\n", False), (r"(?m)a$", "a\nb", True), (r"^\d$", "٣", True), (".", "\r", True), ("[]$]", "$", True)])
def test_dialect(spark, pattern, text, hit):
    assert spark.range(1).select(F.lit(text).rlike(java_pattern(pattern))).first()[0] is hit


def test_filters_and_pasted_values(logs):
    assert logs.where(search.filters(logs.columns, {"host": '"web"', "message": " ", "gone": "x"}, logs.term("error"))).count() == 1
    assert search.pasted(' a \n"b",\ta\r\n,') == ["a", "b"]
    assert logs.where(search.any_pasted("raised\nworker", logs.columns)).count() == 2
    assert logs.where(search.any_pasted("", logs.columns)).count() == 0


VALUES = ["10", "2", "1", "100", "-0", "0", " 1 ", "1.0", "1e0", "nan", "NaN", "inf", "-inf", "1d", "0x1p3", "1_0", "Bravo", "alpha", "bravo", "", None, " x", "9007199254740993", "9007199254740992"]


def test_order_of_keys(spark):
    view = from_table(spark.createDataFrame(list(enumerate(VALUES)), "id long, v string"), "id", ["v"])
    up = [VALUES[r[0]] for r in view.sort(("v", True)).ordered().select("_row_id").collect()]
    assert up == ["-inf", "-0", "0", "1", " 1 ", "1.0", "1e0", "2", "10", "100", "9007199254740993", "9007199254740992", "inf", "", None, "0x1p3", "1_0", "1d", "alpha", "Bravo", "bravo", "nan", "NaN", " x"]
    down = [VALUES[r[0]] for r in view.sort(("v", False)).ordered().select("_row_id").collect()]
    assert down[0] == " x" and down[-1] == "-inf" and down[-3:-1] == ["0", "-0"]


def test_groups_follow_the_keys(spark):
    view = from_table(spark.createDataFrame(list(enumerate(VALUES)), "id long, v string"), "id", ["v"])
    got = {r["label1"]: r["n"] for r in grouping.level(view, ["v"]).collect()}
    assert got["1"] == 4 and got["0"] == got["-0"] == 1 and got["Bravo"] == 2 and got[""] == 2 and got["9007199254740993"] == 2
    assert grouping.distinct_total(view, "v").first()[0] == len(got)


def test_labels_come_from_the_first_row_of_the_view(spark):
    rows = [(0, "info", "b"), (1, "INFO", "c"), (2, "Info", "a"), (3, "x", "a")]
    view = from_table(spark.createDataFrame(rows, "id long, sev string, k string"), "id", ["sev", "k"])
    label = lambda v: {r["label1"] for r in grouping.level(v, ["sev"]).collect()}
    assert label(view) == {"info", "x"} and label(view.sort(("k", True))) == {"Info", "x"} and label(view.sort(("k", False))) == {"INFO", "x"}
    one, two = grouping.tree(view, ["sev", "k"])
    assert [r["n"] for r in one.collect()] == [3, 1] and two.count() == 4
    assert grouping.leaves(view, {"sev": "INFO"}).count() == 3
    assert [tuple(r) for r in grouping.distribution(view, "sev", 1).collect()] == [("info", 3)]
    assert grouping.level(view, ["sev", "k"], ["info"]).count() == 3


def test_all_levels_at_once(spark):
    """The nodes of every depth equal the levels one by one; one shuffle; children are the next level's groups."""
    rows = [(i, VALUES[i % len(VALUES)], "xY"[i % 2] + str(i % 3), None if i % 4 else "n") for i in range(200)]
    view = from_table(spark.createDataFrame(rows, "id long, a string, b string, c string"), "id", ["a", "b", "c"]).sort(("b", False), ("c", True))
    columns = ["b", "A", 2]
    found = grouping.nodes(view, columns)
    assert plan(found).count("Exchange hashpartitioning") == 1
    got = grouping.with_children(found, 3).collect()
    for depth in (1, 2, 3):
        keys = [f"key{i}" for i in range(1, depth + 1)]
        own = {tuple(str(r[k]) for k in keys): (r[f"label{depth}"], r["n"]) for r in grouping.level(view, columns[:depth]).collect()}
        assert {tuple(str(r[k]) for k in keys): (r["label"], r["n"]) for r in got if r["depth"] == depth} == own
        assert all(r[f"key{i}"] is None for r in got if r["depth"] == depth for i in range(depth + 1, 4))
        for r in got:
            if r["depth"] == depth:
                below = [x for x in got if x["depth"] == depth + 1 and all(str(x[k]) == str(r[k]) for k in keys)]
                assert r["n_children"] == len(below)
    assert grouping.with_children(grouping.nodes(view.where(F.lit(False)), columns), 3).count() == 0


def test_empty_view(spark):
    view = from_table(spark.createDataFrame([], "id long, v string"), "id", ["v"])
    assert grouping.level(view, ["v"]).count() == 0 and view.page().count() == 0 and view.sort(("v", True)).count() == 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sorts_have_plain_columns(spark):
    """No pattern or cast is left in the order itself, and a page is a top-k."""
    view = from_table(spark.range(50).selectExpr("id", "cast(id AS string) AS v", "'x' AS w"), "id", ["v", "w"]).sort(("v", False), ("w", True))
    for df in (view.ordered(), view.page(5, 5)):
        line = next(x for x in plan(df).split("\n") if "Sort [" in x or "TakeOrderedAndProject(" in x)
        order = line[line.index("[") : line.index("]")] if "Sort [" in line else re.search(r"orderBy=\[([^\]]*)", line)[1]
        assert "CASE" not in order and "RLIKE" not in order and "_key0n" in order, line
    assert "TakeOrderedAndProject" in plan(view.page(5, 5))


def test_many_values_equal_one_by_one(spark):
    """10,000 needles: the same rows as a search for each, from a plan that doesn't hold them."""
    rows = [(i, None if i % 50 == 7 else f"host{i * 37 % 9973} É-{i % 13:02d} K {'Q' * (i % 3)}") for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, v string")
    needles = [f"HOST{i}1 " for i in range(9000)] + [f"é-{i}" for i in range(500)] + [f"É-{i:02d} k qq" for i in range(5, 505)]
    folded = [re.sub("[A-Z]", lambda m: m[0].lower(), n) for n in needles]
    want = {i for i, v in rows if v and any(n in re.sub("[A-Z]", lambda m: m[0].lower(), v) for n in folded)}
    found = df.where(contains_any(F.col("v"), needles))
    assert {r["id"] for r in found.collect()} == want and 0 < len(want) < 3000
    assert len(plan(found)) < 2000 and found.where(~contains_any(F.col("v"), needles)).count() == 0
    few = needles[:3] + ["É-05"]
    assert df.where(contains_any(F.col("v"), few)).count() == df.where(either(*(contains(F.col("v"), n) for n in few))).count()
    assert df.where(contains_any(F.col("v"), ["", "x"])).count() == df.where("v IS NOT NULL").count() and df.where(contains_any(F.col("v"), [])).count() == 0


@pytest.mark.parametrize("step", [7, 64, 1 << 18])
@pytest.mark.parametrize("hashed", [4, 13, 1024])
def test_needles_equal_brute_force(monkeypatch, step, hashed):
    """Needles over the ends of steps and cells, longer than what is hashed of them, beginnings of one another, of several bytes a character."""
    monkeypatch.setattr(needles, "STEP", step)
    monkeypatch.setattr(needles, "HASHED", hashed)
    needles._powers.cache_clear()
    r = random.Random(step * hashed)
    try:
        for letters, longest in itertools.product(("ab", "abCé漢", "0123456789,oO"), (3, 40)):
            word = lambda least, most: "".join(r.choices(letters, k=r.randint(least, most)))  # noqa: B023, E731
            wanted = sorted({fold_text(word(1, longest)) for _ in range(30)})
            cells = [None, "", *(word(0, 100) for _ in range(60))]
            want = [c is not None and any(n in fold_text(c) for n in wanted) for c in cells]
            index = pickle.loads(pickle.dumps(needles.Needles([n.encode() for n in wanted])))
            assert index.inside(pa.array(cells, pa.string())).tolist() == want
            assert index.inside(pa.array(cells, pa.string()).slice(9, 20)).tolist() == want[9:29]
    finally:
        needles._powers.cache_clear()


def test_long_lists_are_shipped_small(spark, monkeypatch):
    """What each worker keeps of 50,000 needles of 10 bytes is under 40 bytes a needle."""
    shipped = []
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, x: shipped.append(x))
    contains_any(F.col("v"), [f",{i:06d},O," for i in range(50_000)])
    assert len(pickle.dumps(shipped[0])) < 40 * 50_000 and shipped[0].inside(pa.array(["x,000017,o,", "x,000017,", None])).tolist() == [True, False, False]


def test_pasted_lists_keep_scopes_and_patterns(spark):
    view = from_table(spark.range(2000).selectExpr("id", "concat('h', id) AS host", "concat('m', id % 7) AS msg"), "id", ["host", "msg"])
    text = "\n".join([*(f"host:h{i}9" for i in range(0, 60)), *(f"gone{i}" for i in range(2000)), "/^h1\\d.m/", "#1:m3"])
    want = {i for i in range(2000) if any(f"h{k}9" in f"h{i}" for k in range(60)) or i in range(10, 20) or i % 7 == 3}
    assert {r[0] for r in view.where(search.any_pasted(text, view.columns)).df.select("_row_id").collect()} == want


@pytest.mark.parametrize("most", [1 << 25, 40])
def test_lists_in_tables(spark, most):
    """A list over the bound is looked for in parts; null and repeated values and rows without the cell don't matter."""
    view = from_table(spark.range(300).selectExpr("id", "if(id % 10 = 0, null, concat('A', id)) AS a", "'b7' AS b"), "id", ["a", "b"])
    listed = spark.createDataFrame([("a1",), ("A25",), (None,), ("a1",), ("b",), ("zz",)], "x string")
    want = {i for i in range(300) if i % 10 and (str(i).startswith("1") or str(i).startswith("25"))}
    assert {r["_row_id"] for r in view.among(listed, "A", most=most).df.collect()} == want
    assert view.among(listed, most=most).count() == 300 and view.among(listed.limit(0), most=most).count() == 0


LINEAR = [r"[\w.]+@\w+", r"^\d+$", r"(?i)É|x\S", r"a.c$", r"(?m)^b$", r"[^\d\s]z", r"\W\D", r"(?P<n>a+)b", "[]$]", r"\p{Lu}+", "x{2,3}y", r"\Z", "(?s)a.b"]
CELLS = ["a.b@c", "٣٤", "éx", "É", "aéc", "a\nb", "b", "\u2028z", "Ⓐ@é", "xxy", "xxxxy", "", "a\u00a0z", "]", "aab", "ǅ", "K", " \t", "a\nc", "dz"]


@pytest.mark.parametrize("pattern", LINEAR)
def test_both_matchers_agree(spark, pattern):
    import pyarrow as pa
    import pyarrow.compute as pc

    java = [r[0] for r in spark.createDataFrame([(c,) for c in CELLS], "v string").coalesce(1).select(F.col("v").rlike(java_pattern(pattern))).collect()]
    assert pc.match_substring_regex(pa.array(CELLS), linear_pattern(pattern)).to_pylist() == java


def test_patterns_that_java_would_backtrack_over(spark):
    assert all(map(backtracks, [r"(a+)+$", r"(\w+\s?)*;", r"(a|aa)+b", r"((x*)y){2,}z", r".*a.*b.*c"])) and not any(map(backtracks, [r"\d+[(+*)]+", r"(ab)+c", r"a\+\+\+b", "err[0-9]{2,4}$"]))
    assert linear_pattern(r"(a+)+\b") is None and linear_pattern(r"[\W]+") is None
    df = spark.createDataFrame([(0, "a" * 100_000 + "b"), (1, "b" + "a" * 100_000), (2, None)], "id long, v string")
    began = time.perf_counter()
    assert [r["id"] for r in df.where(matches(F.col("v"), "(a+)+$")).collect()] == [1] and [r["id"] for r in df.where(~matches(F.col("v"), "(a+)+$")).collect()] == [0, 2]
    assert time.perf_counter() - began < 20


def test_single_line(spark):
    assert spark.range(1).select(single_line(F.lit("a\r\nb\nc\rd"))).first()[0] == "a ⏎ b ⏎ c ⏎ d"


def test_key_is_one_expression(spark):
    assert "Python" not in spark.range(1).select(value_key(F.lit("1")))._jdf.queryExecution().executedPlan().toString()
