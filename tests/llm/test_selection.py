"""Operators 11 to 13: learned rules, fill-in-middle, resampling; against brute force, exact round trips and held-out rows."""

import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import SMALL
from tracewright.llm import fim, ordinal, queries, resample, rules, toxicity
from tracewright.llm.common import table

MIDDLE = "/root/testdata/sf0.01"


# --- 11 ------------------------------------------------------------------


def plain_counts(text):
    """The contract's numbers, word by word."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    repeated = {i + k for i, w in enumerate(windows) if w in often for k in range(3)}
    lines, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(repeated)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab é#|\n\t\x0b\x85 漢", max_size=80))
def test_counts_equal_brute_force(text):
    assert rules.counts(text)[:5] == plain_counts(text)


def test_query_of_rules(spark):
    texts = {r["doc_id"]: r["text"] for r in table(spark, SMALL, "documents").collect()}
    got = queries.op11_rules(spark, SMALL).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        own = plain_counts(texts[r["doc_id"]])
        assert tuple(r[c] for c in rules.COUNTS[:5]) == own
        assert r["base_failed"] == (own[0] < 50 or 100 * own[4] > 50 * own[0])
        assert r["kept"] == (not r["base_failed"] and r["rule"] is None)


def test_rules_judge_held_out_rows(spark):
    """Of rows that taught nothing and pass the base rules, poor ones are rejected and good ones kept."""
    labels = table(spark, MIDDLE, "labels").where(toxicity.held_out())
    got = queries.op11_rules(spark, MIDDLE).join(labels, "doc_id").where("NOT base_failed")
    good, bad = (got.where(f"quality = {q}").agg(F.avg(F.col("kept").cast("double"))).first()[0] for q in (1, 0))
    assert good > 0.95 and bad < 0.1, (good, bad)


def planted(n, seed):
    rng = np.random.default_rng(seed)
    t = np.zeros((n, len(rules.NAMES)))
    t[:, 0], t[:, 2], t[:, 7] = rng.integers(1, 900, n), rng.random(n), rng.random(n)
    return t, rng


def test_covering_finds_planted_conjunctions():
    """Two conjunctions and noise in the labels: the list holds both and little else, and judges new rows by the truth."""
    t, rng = planted(6000, 1)
    truth = lambda t: ((t[:, 2] > 0.7) & (t[:, 0] > 300)) | (t[:, 7] > 0.9)
    bad = truth(t) ^ (rng.random(6000) < 0.03)
    found = rules.cover(t, bad, rng.integers(0, 3, 6000))
    fresh, _ = planted(4000, 2)
    said = np.logical_or.reduce([r.covers(fresh) for r in found])
    assert (said == truth(fresh)).mean() > 0.99 and 2 <= len(found) <= 6
    assert all(1 <= len(r.conditions) <= 4 for r in found)


def test_pruning_drops_conditions_of_noise():
    t, rng = planted(900, 3)
    bad = t[:, 2] > 0.5
    grown = rules.Rule((("symbols", True, 0.5), ("upper_words", True, 0.3)))
    assert rules.prune(grown, t, bad) == rules.Rule((("symbols", True, 0.5),))


def test_covering_without_anything_to_learn():
    t, rng = planted(500, 4)
    fold = rng.integers(0, 3, 500)
    assert rules.cover(t, np.zeros(500, bool), fold) == [] == rules.cover(np.ones_like(t), rng.random(500) < 0.5, fold)
    assert rules.cover(t, rng.random(500) < 0.5, fold) == []  # labels are noise: no rule has the precision
    assert rules.cover(t[:0], np.zeros(0, bool), fold[:0]) == []


def test_list_is_one_ordered_expression(spark):
    first, second = rules.Rule((("words", False, 10.0), ("symbols", True, 0.5))), rules.Rule((("words", False, 10.0),))
    df = spark.createDataFrame([(5.0, 0.6), (5.0, 0.1), (50.0, 0.9)], "words double, symbols double")
    assert [r[0] for r in df.select(rules.fired([first, second])).collect()] == [1, 2, None]
    assert [r[0] for r in df.select(rules.fired([])).collect()] == [None] * 3
    t = np.zeros((3, len(rules.NAMES)))
    t[:, 0], t[:, 2] = [5, 5, 50], [0.6, 0.1, 0.9]
    assert first.covers(t).tolist() == [True, False, False] and str(first) == "words < 10 and symbols >= 0.5"


def test_rules_over_odd_tables(spark, odd, none):
    labels = spark.createDataFrame([(0, 1), (4, 0), (4, 0), (7, None), (None, 1), (8, 7)], "doc_id long, quality int")
    stats = rules.statistics(odd)
    got = rules.judge(stats, rules.learn(stats, labels)).collect()
    assert len(got) == 13 and {r["n_words"] for r in got if r["id"] == 6} == {120_000} and not any(r["kept"] for r in got if r["id"] in (0, 1, 2, 3))
    empty = rules.statistics(none)
    assert rules.learn(empty, labels) == [] and rules.learn(stats, labels.limit(0)) == []
    assert rules.judge(empty, []).count() == 0 and rules.judge(stats, []).where("kept").select("id").collect() == []


# --- 12 ------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="a\n \r<>PSM漢𝄞", max_size=40), st.integers(0, 10**6))
def test_cuts_round_trip(text, i):
    for unit, pattern in (("line", r"[^\n]*\n|[^\n]+"), ("char", r"(?s)."), ("word", r"[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")):
        units = re.findall(pattern, text)
        n, form, p, m, output = fim.cut_text(text, f"7:{i}", 100, 50, unit, fim.MARKS)
        assert n == len(units)
        x = hashlib.sha256(f"7:{i}".encode()).hexdigest()
        h = [int(x[k : k + 8], 16) for k in (0, 8, 16, 24)]
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        pre, mid, suf = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
        if not text or any(k in text for k in fim.MARKS):
            assert (form, p, m, output) == ("plain", None, None, text)
        else:
            assert (p, m) == (len(pre), len(mid)) and form == ("spm" if h[3] % 100 < 50 else "psm")
            assert output == (f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}")


def test_restored_texts_and_odd_rows(spark, odd, none):
    tricky = ["<\n<P\n", "<S", "ends in <", "<P> is here", "\n\n\n", "P>\nS>\nM>\n", "𝄞\n𝄞", "\r\n"]
    more = odd.select("doc_id", "text").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(tricky)], "doc_id long, text string"))
    for unit in fim.UNITS:
        for rate in (100, 50, 0):
            got = fim.transform(more, rate=rate, unit=unit).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
            want = sorted(((r["doc_id"], r["text"] or "") for r in more.collect()), key=str)
            assert sorted(((r["id"], r["back"]) for r in got), key=str) == want
            assert all((r["form"] == "plain") == (r["prefix_chars"] is None) for r in got)
            assert rate or {r["form"] for r in got} == {"plain"}
    assert fim.transform(none).count() == 0


def test_other_marks(spark):
    df = spark.createDataFrame([(i, "a.b|c\n" * (i % 5 + 1)) for i in range(60)], "doc_id long, text string")
    marks = ("[.*", "|^", "$(\\")
    out = fim.transform(df, marks=marks, spm=30).withColumn("back", fim.restored(F.col("output"), F.col("form"), marks)).join(df, F.col("id") == F.col("doc_id"))
    assert out.where("back = text AND form <> 'plain'").count() == 60 and out.select("form").distinct().count() == 2
    for bad in (("a", "b", ""), ("ab", "bc", "x"), ("aa", "b", "c"), ("x", "axb", "c"), ("<P>", "<P>", "<M>")):
        with pytest.raises(ValueError):
            fim.transform(df, marks=bad)


# --- 13 ------------------------------------------------------------------


def brute_resample(docs, target, dims, longest, percent, least, seed):
    def features(text):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return len(w), [crc32(" ".join(w[i : i + k]).encode()) % dims for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    made = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for *_, f in made for b in f), Counter(b for x in target for b in features(x)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + dims) / ((s[b] + 1) * (sum(t.values()) + dims)))) for b in range(dims)]
    rows = []
    for i, n, f in made:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        rows.append([i, n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    may = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(may[: percent * len(may) // 100], 1):
        r[5] = k
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("dims, longest, percent", [(50, 1, 30), (1000, 3, 100), (7, 2, 0)])
def test_resampling_equals_brute_force(spark, odd, dims, longest, percent):
    rng = np.random.default_rng(dims)
    words = ["alpha", "Beta", "gamma", "é", "漢字", "x1", "42"]
    texts = [" ".join(rng.choice(words, rng.integers(0, 60))) for _ in range(80)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(r["doc_id"], r["text"]) for r in odd.collect()]
    target = [None, "", "alpha beta beta", "漢字 42, 42."]
    own = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rank", F.lit("x")).repartition(5)
    got = resample.resample(own, spark.createDataFrame([(t,) for t in target], "text string"), dims, longest, percent, 5, 99).collect()
    assert sorted(map(tuple, got), key=str) == brute_resample(docs, target, dims, longest, percent, 5, 99)


def test_matrix_is_sparse_rows_in_blocks(spark):
    """Every row's words come back from the blocks, and the sums of its columns are those of the features."""
    docs = table(spark, SMALL, "documents").select("doc_id", "text")
    blocks = resample.matrix(docs, 97).cache()
    seen, total = {}, Counter()
    for r in blocks.collect():
        starts, slots, counts = np.frombuffer(r["starts"], np.int64), np.frombuffer(r["slots"], np.int32), np.frombuffer(r["counts"], np.int64)
        assert len(starts) == len(r["ids"]) + 1 and starts[-1] == len(slots) == len(counts)
        for i, d in enumerate(r["ids"]):
            own = slots[starts[i] : starts[i + 1]]
            assert (np.diff(own) > 0).all()
            seen[d] = int(counts[starts[i] : starts[i + 1]].sum())
            total.update(dict(zip(own.tolist(), counts[starts[i] : starts[i + 1]].tolist())))
    assert seen == {r["doc_id"]: len(resample.WORD.findall((r["text"] or "").encode().lower())) for r in docs.collect()}
    assert {r["bucket"]: r["n"] for r in resample.column_sums(blocks, 97).collect()} == dict(total)


def test_resampling_of_empty_tables(spark, odd, none):
    target = spark.createDataFrame([("one word",)], "text string")
    assert resample.resample(none, target).count() == 0
    got = resample.resample(odd, target.limit(0), percent=50, least_words=0)
    assert got.count() == 13 and got.where("rank IS NOT NULL").count() == 6


def test_draw_leans_to_the_target(spark):
    """Documents of the target's words make a tenth of the table and most of what is drawn."""
    rows = [(i, " ".join(f"{'t' if i % 10 == 0 else 'o'}{(i * 7 + k) % 40}" for k in range(30))) for i in range(1000)]
    target = spark.createDataFrame([(" ".join(f"t{k}" for k in range(40)),)] * 20, "text string")
    got = resample.resample(spark.createDataFrame(rows, "doc_id long, text string"), target, dims=500).where("rank IS NOT NULL").collect()
    assert len(got) == 100 and sum(r["id"] % 10 == 0 for r in got) == 100 and sorted(r["rank"] for r in got) == list(range(1, 101))


# --- 3 -------------------------------------------------------------------


def test_grades_of_the_query_follow_the_formula(spark):
    """``expected_grade``, ``p_tail`` and ``keep`` of every document, from the fitted weights and thresholds, one feature at a time."""
    docs, ratings = table(spark, SMALL, "documents"), queries.grades(table(spark, SMALL, "labels"))
    w, theta = ordinal.fit(docs, ratings.where(~toxicity.held_out()), queries.GRADES)
    assert list(theta) == sorted(theta)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r for r in queries.op3_quality(spark, SMALL).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        slots, values = ordinal.Hasher()(text)
        z = sum(float(w[s]) * float(v) for s, v in zip(slots, values))
        above = [1 / (1 + math.exp(t - z)) for t in theta]  # P(grade > k)
        p = [1 - above[0], above[0] - above[1], above[1]]
        assert got[i]["expected_grade"] == pytest.approx(sum(k * x for k, x in enumerate(p)), abs=1e-4)
        assert got[i]["p_tail"] == pytest.approx(p[1] + p[2], abs=1e-4) and got[i]["keep"] == (got[i]["p_tail"] >= 0.5)
