"""Toxicity, quality and personal data: decoding, learning on rows not held out, spans against a second reading."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import SMALL
from tracewright.llm import ordinal, pii, queries, toxicity

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def channel():
    counts = np.zeros(toxicity.SLOTS)
    text = " the silly goose is a total idiot and the idiot lies about the goose " * 50
    c = np.array([ord(x) if x.isalpha() else 0 for x in text])
    np.add.at(counts, toxicity._slot(c[:-2], c[1:-1], c[2:]), 1)
    return toxicity.Channel(counts)


def all_readings(channel, token, runs):
    """Every way through the lattice of a token with its cost, none left out; ``runs``: with word edges."""
    from tracewright.llm.toxicity import DROP, EDGE, GLUED, LEET, LITERAL, MORE, STAND_IN, TWICE, _SEPARATORS

    def go(i, a, b, before, run, gap, cost, text):
        if i == len(token):
            yield cost - channel._next(a, b, 0), text
            return
        ch = token[i]
        if runs and ch in _SEPARATORS:
            yield from go(i + 1, a, b, before, run, True, cost, text)
            return
        run = run + 1 if ch == before else 1
        starts = [(a, b, cost, text)]
        if runs and b:
            starts.append((b, 0, cost + (EDGE if gap else GLUED) - channel._next(a, b, 0), text + " "))
        for x, y, paid, said in starts:
            for c, price in [*((c, STAND_IN) for c in LEET.get(ch, "")), (ch, 0.0) if ch.isalpha() else ("", DROP if ch in _SEPARATORS and not runs else LITERAL)]:
                if c:
                    yield from go(i + 1, y, ord(c), ch, run, False, paid + price - channel._next(x, y, ord(c)), said + c)
                else:
                    yield from go(i + 1, x, y, ch, run, False, paid + price, said)
                if c and run > 1 and y == ord(c):
                    yield from go(i + 1, x, y, ch, run, False, paid + (TWICE if run == 2 and ch.isalpha() else MORE), said)

    return go(0, 0, 0, "", 0, True, 0.0, "")


@pytest.mark.parametrize("token", ["1d10t", "idiiot", "i.d.i.0t", "iidd", "g00se", "llie", "1|1", "a!!s", "goo-se", "t0tal1"])
def test_decoding_is_the_best_of_all_readings(channel, token):
    best = min(all_readings(channel, token, False))
    got = channel._decode(token)
    assert got in {text for cost, text in all_readings(channel, token, False) if cost <= best[0] + 1e-9}


@pytest.mark.parametrize("token", ["id 1ot", "a id10t", "i d i o", "the g00", "li es", "aa b"])
def test_words_are_the_best_of_all_readings(channel, token):
    best = min(all_readings(channel, token, True))
    assert channel.words(token) in {text.strip() for cost, text in all_readings(channel, token, True) if cost <= best[0] + 1e-9}


@pytest.mark.parametrize("text, hit", [("you id iot there", True), ("you 1d iot there", True), ("total idi ot", True), ("idiiot", True), ("iddiot", True), ("the goose", False), ("id", False)])
def test_parted_and_doubled_words_count(channel, text, hit):
    scorer = toxicity.Scorer(np.zeros(1), {"idiot": 5.0}, 1.0, 0.0)
    scorer.channel = channel
    assert (scorer.evidence(text) > 0) is hit


@pytest.mark.parametrize("noisy, plain", [("1d10t", "idiot"), ("i.d.i.o.t", "idiot"), ("g00se", "goose"), ("idiiiiiot", "idiot"), ("idiot!!!", "idiot"), ("goose", "goose"), ("2024", "2024"), ("", "")])
def test_restored_words(channel, noisy, plain):
    assert toxicity.restore(noisy, channel) == plain


@pytest.mark.parametrize("k", range(1, 14))
def test_tokens_are_read_alike_at_any_length(channel, k):
    """5 to 65 characters and one more, glued or parted by signs: no length at which the reading changes."""
    scorer = toxicity.Scorer(np.zeros(1), {"idiot": 5.0}, 1.0, 0.0)
    scorer.channel = channel
    for token in ("1d10t" * k, "1d10t" * k + "1", "1.d.1.0.t." * k, "idiiot" * k):
        assert scorer.evidence(token) > 0, (k, token)
    assert toxicity.restore("g00se." * k, channel).split() == ["goose"] * k


@pytest.mark.parametrize("n", [39, 40, 41, 42])
def test_long_tokens_of_other_words_stay_clean(channel, n):
    scorer = toxicity.Scorer(np.zeros(1), {"idiot": 5.0}, 1.0, 0.0)
    scorer.channel = channel
    assert scorer.evidence(("th3goosel1es" * 5)[:n]) == 0 and scorer.evidence(("24be64439e3e49cf" * 5)[:n]) == 0


@pytest.mark.parametrize("text", ["i,d,i,o,t", "i/d/i/o/t", "i;d;i;0;t", "id\u200biot", "i\u00add\u00adi\u00adot", "\ufeffidiot", "|d|0+", "!d!0+", "1d!0+"])
def test_signs_and_unseen_marks_hide_nothing(channel, text):
    scorer = toxicity.Scorer(np.zeros(1), {"idiot": 5.0}, 1.0, 0.0)
    scorer.channel = channel
    assert scorer.evidence(f"a {text} here") > 0


def test_stand_ins_alone(channel):
    """They are read where one of them isn't a digit; numbers stay numbers."""
    assert toxicity.restore("900$3", channel) == "goose" and toxicity.restore("90053", channel) == "90053" and toxicity.restore("1,005.30", channel) == "1,005.30"


def test_spaced_letters_are_one_token():
    assert "idiot" in toxicity.tokens("you i d i o t there") and "a" in toxicity.tokens("a word")


@pytest.mark.parametrize("text", ["you are a i d i o t", "i s a y y o u a r e a n i d i o t", "y o u a r e a 1 d 1 0 t", "".join(c * 9 for c in "idiot"), "i.......d.......i........o........t.....", " ".join("thegooseisthegooseisthegooseisthegooseandanidiot"), "the.silly.goose.is.a.t0tal.id10t.and.lies.about"])
def test_insults_in_long_and_spaced_runs_count(channel, text):
    scorer = toxicity.Scorer(np.zeros(1), {"idiot": 5.0}, 1.0, 0.0)
    scorer.channel = channel
    assert scorer.evidence(text) > 0
    assert scorer.evidence("a b c d e f g h i j k l m n o p and 24be64439e3e49cf46b2d7c90f3602a3d0b907ffaa") == 0


def test_scores_of_held_out_rows(spark):
    got = queries.op1_toxicity(spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").where("held_out").collect()
    hits = [(r["score"], r["toxic"]) for r in got]
    assert all(0 <= s <= 1 for s, _ in hits)
    toxic, clean = [s for s, y in hits if y], [s for s, y in hits if not y]
    assert len(toxic) > 5 and len(clean) > 50
    # some rows are labelled toxic without an insult in them, so full recall can't be had
    assert np.mean([(a > b) + (a == b) / 2 for a in toxic for b in clean]) > 0.85
    assert np.mean([s >= 0.7 for s in toxic]) > 0.75
    assert np.mean([s < 0.7 for s in clean]) > 0.97


def test_toxicity_learns_nothing_from_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r["doc_id"]: r["tox_score"] for r in toxicity.score(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_the_gradient_is_that_of_the_likelihood():
    """Against differences of a likelihood written out grade by grade."""
    import math

    rng = np.random.default_rng(8)
    n, size, grades = 40, 7, 4
    row, idx = np.repeat(np.arange(n), 3), rng.integers(0, size, 3 * n)
    val, grade = rng.normal(size=3 * n), rng.integers(0, grades, n)
    w, t = rng.normal(size=size), np.array([-1.0, 0.2, -0.3])

    def plain(x):
        w, t = x[:size], x[size:]
        cut, total = [t[0], t[0] + math.exp(t[1]), t[0] + math.exp(t[1]) + math.exp(t[2])], 0.0
        below = lambda k, s: 0.0 if k < 0 else 1.0 if k >= len(cut) else 1 / (1 + math.exp(-(cut[k] - s)))
        for i in range(n):
            s = sum(w[j] * v for r, j, v in zip(row, idx, val) if r == i)
            total -= math.log(below(grade[i], s) - below(grade[i] - 1, s))
        return total / n + 0.01 * sum(w * w) / 2

    x = np.concatenate([w, t])
    loss, got = ordinal.loss_and_gradient(w, t, row, idx, val, grade, 0.01)
    assert loss == pytest.approx(plain(x))
    step = np.eye(len(x)) * 1e-6
    assert got == pytest.approx([(plain(x + h) - plain(x - h)) / 2e-6 for h in step], abs=1e-6)


def test_ordered_thresholds():
    rng = np.random.default_rng(0)
    x = rng.normal(size=300)
    grade = np.clip(np.round(x + 1 + rng.normal(size=300) * 0.2), 0, 2).astype(int)
    slots = [np.array([0 if v > 0 else 1], np.int32) for v in x]
    w, theta = ordinal.fit_arrays(slots, [np.array([abs(v)], np.float32) for v in x], grade, 3)
    assert theta[0] < theta[1] and w[0] > 0 > w[1]
    up = ordinal.probabilities(np.array([-2.0, 0.0, 2.0]), theta)
    assert (np.diff(up, axis=1) < 0).all() and (np.diff(up[:, 0]) > 0).all()


def test_quality_of_held_out_rows(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").where(toxicity.held_out())
    got = queries.op3_quality(spark, DATA).join(labels, "doc_id").collect()
    good, poor = ([r["expected_grade"] for r in got if r["quality"] == y] for y in (1, 0))
    assert np.mean([a > b for a in good for b in poor]) > 0.9
    assert np.mean([r["keep"] == (r["quality"] == 1) for r in got]) > 0.85
    assert all(0 <= r["expected_grade"] <= 2 and 0 <= r["p_tail"] <= 1 for r in got)


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def plain_spans(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")) or kind == "card" and not (16 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_base_spans_of_all_documents(spark):
    for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect():
        assert pii.base_spans(r[0] or "") == plain_spans(r[0] or "")


@pytest.mark.parametrize("seed", range(6))
def test_base_spans_of_random_soup(seed):
    rng = random.Random(seed)
    for alphabet in ("a@.-_ ", "0123.+ ()-", "a1@.", "4 -0+", "1.2 3"):
        for _ in range(400):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
            assert pii.base_spans(text) == plain_spans(text), text


def test_segments_are_a_best_segmentation():
    """The dynamic program's score and marginals are those of all segmentations."""
    import itertools
    import math

    text, found = "call 555 0100 200 now", [("phone", 5, 13), ("phone", 9, 17), ("phone", 5, 17), ("card", 5, 8), ("ip", 9, 13)]
    rng = random.Random(4)
    field = pii.Field({f: rng.uniform(-1, 2) for c in found for f in pii.features(text, *c)})
    score = field.scores(text, found)
    sets = [s for n in range(len(found) + 1) for s in itertools.combinations(range(len(found)), n) if all(found[a][2] <= found[b][1] or found[b][2] <= found[a][1] for a, b in itertools.combinations(s, 2))]
    total = {s: sum(score[k] for k in s) for s in sets}
    assert sum(score[found.index(c)] for c in field.best(text, found)) == pytest.approx(max(total.values()))
    z = sum(map(math.exp, total.values()))
    want = [sum(math.exp(v) for s, v in total.items() if k in s) / z for k in range(len(found))]
    assert field.marginals(text, found) == pytest.approx(want)


def test_the_field_adds_respelled_spans():
    rng = random.Random(2)
    number = lambda n: "".join(str(rng.randint(0, 9)) for _ in range(n))
    texts = [f"write to user{i}@mail{i % 7}.example.com or call +{number(2)} {number(3)} {number(3)} {number(4)} from 10.{i}.3.{i % 200}; the year 2024 and {number(5)} units" for i in range(120)]
    field = pii.train(texts)
    base, spans = pii.find("reach ann [at] mail3 [dot] example [dot] com today, in 2019", field)
    assert base == [] and [s[0] for s in spans] == ["email"]
    text = "bob@site.example.com, see chapter 12 of 400 pages"
    base, spans = pii.find(text, field)
    assert spans == base == [("email", 0, 20)]
    assert pii.redact(text, spans).startswith("[EMAIL], see")


def test_base_spans_stay(spark):
    """All columns of the query against the plain patterns; no added span meets another span."""
    import hashlib

    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in queries.op5_pii(spark, DATA).collect():
        base = plain_spans(texts[r["doc_id"]])
        written = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(written).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(s[0] == k for s in base) for k in PATTERNS]
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r["spans"].split(",") if s)]
        assert spans == sorted(spans, key=lambda s: (list(PATTERNS).index(s[0]), s[1]))
        added = [s for s in spans if s not in base]
        assert len(added) == len(spans) - len(base)
        assert not [1 for s in added for o in spans if s is not o and s[1] < o[2] and o[1] < s[2]]


def free_field():
    """A field that likes every candidate, the longer the better."""

    class Any(pii.Field):
        def scores(self, text, found):
            return [float(b - a) for _, a, b in found]

    return Any({})


@pytest.mark.parametrize("text", ["0" * 5000 + "1.2.3.4", "(" * 100_000 + "555 0100 200", "+" * 100_000, "a" * 100_000 + "[at]" + "b" * 100_000, "a [at] " * 20_000, "@" * 100_000, "a@" * 50_000, "a." * 50_000 + "@x", "1." * 50_000, "+1(" * 30_000, " at a" * 20_000, "4 " * 10_000, "\n".join(f"u{i}@mail.example.com, +1 555 010 {i:04}, {i}" for i in range(8000))], ids=lambda t: t[:9])
def test_odd_texts_take_time_in_proportion(text):
    import time

    began = time.process_time()
    base, spans = pii.find(text, free_field())
    assert time.process_time() - began < 2
    assert set(base) <= set(spans)
    assert pii.redact(text, spans) is not None


def test_added_spans_keep_clear_of_far_base_spans():
    """A base span may begin far before a candidate and still reach over it; a name may be long."""
    text = "+1" + " " * 600 + "555 0100 200 3"
    base, spans = pii.find(text, free_field())
    assert base == spans == [("phone", 0, len(text))]
    name = "n" * 200
    assert pii.find(f"see {name} [at] site [dot] com", free_field())[1] == [("email", 4, 4 + 200 + 6 + 4 + 7 + 3)]
    base, spans = pii.find("mail ann at 555 010 2000 dot com", free_field())
    assert all(a[2] <= b[1] for a, b in zip(sorted(spans, key=lambda s: s[1]), sorted(spans, key=lambda s: s[1])[1:]))


def test_long_texts_teach_in_pieces(spark):
    long = "lorem ipsum " * 5000 + " ".join(f"ann{i}@mail.example.com +1 555 010 {i:04}" for i in range(3000))
    df = spark.createDataFrame([(1, long), (2, None), (None, ""), (3, "x" * 9000)], "doc_id long, text string")
    assert any(f.startswith("phone:") for f in pii.fit(df, sample_pieces=40))
    assert pii.fit(df.limit(0)) == {}
