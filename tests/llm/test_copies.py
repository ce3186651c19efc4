"""SimHash, repeated passages, components and the pipeline, against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from helpers import SMALL
from tracewright.llm import queries, simhash, substring, toxicity
from tracewright.llm.common import Scratch
from tracewright.llm.graph import components


def plain_fingerprint(text, n=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    grams = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h)) if h else 0


def roots(n, linked):
    p = list(range(n))

    def f(x):
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for a, b in linked:
        x, y = f(a), f(b)
        p[max(x, y)] = min(x, y)
    return [f(i) for i in range(n)]


def test_fingerprints_and_components(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()
    fps = [plain_fingerprint(r["text"]) for r in docs]
    root = roots(len(docs), [(i, j) for i in range(len(docs)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    want = {r["doc_id"]: (f"{fps[i]:016x}", docs[root[i]]["doc_id"]) for i, r in enumerate(docs)}
    assert {r[0]: (r[1], r[2]) for r in queries.op6_simhash(spark, SMALL).collect()} == want


def test_links_lose_nothing(spark):
    """Chains of small steps around a few centres; large keys take the way without pairs."""
    rng = random.Random(9)
    fps = set()
    for _ in range(4):
        x = rng.getrandbits(64)
        for _ in range(60):
            x ^= 1 << rng.randrange(64)
            if rng.random() < 0.5:
                x ^= 1 << rng.randrange(64)
            fps.add(x - (1 << 64) if x >> 63 else x)
    fps = sorted(fps)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    bits = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    want = roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if bits(fps[i], fps[j]) <= 2])
    for pairs_up_to in (2, 32):
        at = {x: i for i, x in enumerate(fps)}
        edges = [(at[r["a"]], at[r["b"]]) for r in simhash.links(df, pairs_up_to=pairs_up_to).collect()]
        assert all(bits(fps[i], fps[j]) <= 2 for i, j in edges)
        assert roots(len(fps), edges) == want


def test_components_of_long_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 180)] + [(200, 200), (300, 301), (301, 300)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 180)}, 300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def variants(seed=3):
    """Documents with copies, near copies at all distances, and one hot group of near copies."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = []
    for _ in range(25):
        base = [word() for _ in range(rng.randint(40, 300))]
        texts.append(base)
        for _ in range(rng.randint(0, 4)):
            own = list(base)
            for _ in range(rng.randint(0, 8)):
                own[rng.randrange(len(own))] = word()
            texts.append(own)
    hot = [word() for _ in range(200)]
    for _ in range(60):
        own = list(hot)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(len(own))] = word()
        texts.append(own)
    return [" ".join(t) for t in texts] + ["one two", "one two", "", None]


def test_similar_groups_equal_brute_force(spark):
    texts = variants()
    grams = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").split()) else {()} for t in texts]
    want = roots(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j])])
    got = {r["id"]: r["component"] for r in simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == want


def jaccard_roots(texts):
    grams = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").split()) else {()} for t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j])]
    return roots(len(texts), near), grams


def test_a_hot_group_alike_by_halves_loses_no_links(spark, monkeypatch):
    """Some 150 texts that are 0.75 to 0.85 alike, few of them linked to any one leader; and short texts at 0.8."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base, texts = [word() for _ in range(300)], []
    for _ in range(150):
        own = list(base)
        for at in rng.sample(range(5, 295), rng.randint(3, 8)):
            own[at] = word()
        texts.append(" ".join(own))
    for _ in range(60):
        own = [word() for _ in range(8)]
        texts += [" ".join(own), " ".join(own + [word()])]
    want, grams = jaccard_roots(texts)
    alike = [len(grams[i] & grams[j]) / len(grams[i] | grams[j]) for i in range(150) for j in range(i)]
    assert sum(0.75 <= x <= 0.85 for x in alike) > 1000 and len({*want[:150]}) > 1
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for rows, most in ((20, 0), (500, 1_000_000)):  # split and whole buckets; texts shuffled and not
        monkeypatch.setattr(simhash, "BROADCAST_UP_TO", most)
        got = {r["id"]: r["component"] for r in simhash.similar_groups(df.union(df) if most else df, part_rows=rows).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_the_fingerprints_throw_away_no_pairs_at_the_threshold():
    rng, radius = np.random.default_rng(2), simhash.radius_of(0.8)
    for a, b in ((64, 80), (80, 100), (200, 250)):
        for _ in range(200):
            h = rng.integers(0, 2**64, size=b, dtype=np.uint64)
            x, y = (np.array(simhash.wide(s)[0], np.int64).view(np.uint64) for s in (h[:a], h))
            assert np.bitwise_count(x ^ y).sum() <= radius


def kept_words(texts, window=35):
    """Words that a count of all windows leaves."""
    count = {}
    for t in texts:
        for i in range(len(t) - window + 1):
            count[tuple(t[i : i + window])] = count.get(tuple(t[i : i + window]), 0) + 1
    gone = [{i + j for i in range(len(t) - window + 1) if count[tuple(t[i : i + window])] > 1 for j in range(window)} for t in texts]
    return [" ".join(w for i, w in enumerate(t) if i not in g) for t, g in zip(texts, gone)]


def passages(seed):
    """Texts of passages that begin and end anywhere, overlap, repeat inside one text, branch and run in circles."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") * rng.randint(1, 3)
    pool, texts = [[word() for _ in range(rng.randint(30, 90))] for _ in range(5)], []
    for _ in range(40):
        t = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(pool)
            a = rng.randrange(len(p))
            t += p[a : a + rng.randint(1, 60)] + [word() for _ in range(rng.randint(0, 20))]
        texts.append(t)
    return [*texts, ["x"] * 80, ["y"] * 35, ["z"] * 34, [], ["p", "q"] * 100, ["q", "p"] * 60 + pool[0], ["p", "q", "r"] * 40 + ["s"] * 3, pool[0] + ["x"] * 50 + pool[1], pool[2], pool[2]]


@pytest.mark.parametrize("seed, most", [(5, 2_000_000), (6, 0)])
def test_repeats_equal_a_count_of_all_windows(spark, monkeypatch, seed, most):
    """Anchors and ends of paths by broadcast and by joins."""
    for bound in ("FILTER_UP_TO", "STOPS_UP_TO"):
        monkeypatch.setattr(substring, bound, most)
    texts = passages(seed)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["id"]: r["kept"] for r in substring.remove_repeats(df).collect()}
    assert [got[i] for i in range(len(texts))] == kept_words(texts)


def test_paths_are_whole_and_read_at_their_sources(spark):
    """A path met nowhere as a whole is put together from two sources; a circle is one path; a branch ends paths."""
    word = lambda c, n: [f"{c}{i}" for i in range(n)]
    long, stem, left, right = word("l", 200), word("s", 60), word("f", 60), word("r", 60)
    texts = [long[:120], long[20:110] + ["end"], long[60:200], ["up"] + long[80:190], ["o", "p", "q"] * 30, ["no"] + ["p", "q", "o"] * 30]
    texts += [stem + left, stem + right, ["1"] + stem + left, ["2"] + stem + right]
    df = spark.createDataFrame([(" ".join(t), bytes([i]) * 32) for i, t in enumerate(texts)], "text string, key binary")
    spans = [r.asDict() for r in substring.repeated_spans(df, 35, 17, Scratch(spark)).collect()]
    assert all(substring._holds([w.encode() for w in texts[s["key"][0]]], s, 35) for s in spans)
    of = lambda i: sorted((s["at"], s["n"], s["off"], s["cycle"]) for s in spans if s["key"] == bytes([i]) * 32)
    assert of(0) == [(20, 66, 0, 0)] and of(2) == [(0, 96, 40, 0)] and of(3) == [(1, 76, 60, 0)]  # from l20 to l189
    assert [s[3] for i in (4, 5) for s in of(i)] == [3, 3] and of(4)[0][:2] == (0, 56)
    assert [s[:3] for s in of(8)] == [(1, 26, 0), (27, 60, 0)] and {s["at"] for s in spans if s["key"] == bytes([9]) * 32} == {1, 27}
    wrong = dict(next(s for s in spans if not s["cycle"]), expected="other words")
    assert not substring._holds([w.encode() for w in texts[wrong["key"][0]]], wrong, 35)


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    data = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, ids = set(docs.columns), lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    first = p.drop_toxic(spark, docs, data)
    assert set(first.columns) == columns
    scores = toxicity.score(docs, spark.read.parquet(f"{data}/labels.parquet"))
    assert ids(first) == ids(scores.where("tox_score < 0.7"))

    second = p.drop_near_copies(spark, docs, data)
    rows = {r["doc_id"]: r["text"].lower().split() for r in docs.collect()}
    own = sorted(rows)
    grams = [{tuple(rows[i][k : k + 5]) for k in range(max(1, len(rows[i]) - 4))} for i in own]
    near = [(i, j) for i in range(len(own)) for j in range(i) if 0.8 * max(len(grams[i]), len(grams[j])) <= min(len(grams[i]), len(grams[j])) and len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j])]
    root = roots(len(own), near)
    assert ids(second) == {own[i] for i in range(len(own)) if root[i] == i or not rows[own[i]]}

    third = p.drop_contaminated(spark, docs, data)
    assert ids(third) == ids(queries.op10_decontamination(spark, data).where("not contaminated"))

    fourth = p.redact_pii(spark, docs, data)
    assert set(fourth.columns) == columns and fourth.count() == docs.count()
    assert fourth.where("text LIKE '%@%.com %'").count() == 0 and fourth.where("n_chars <> length(text)").count() == 0

    out = p.run(spark, data)
    assert {"doc_id", "bin_id"} <= set(out.columns)
    assert ids(out) < ids(docs) and out.groupBy("bin_id").agg(F.sum("n_tokens").alias("n")).where("n > 2048").count() == 0


def test_pairs_at_the_threshold_are_linked(spark):
    """500 pairs of texts that are 0.80 to 0.82 alike, each of them with words of its own: 0.99 of them or more link."""
    rng = random.Random(17)
    rows, pairs = [], []
    while len(pairs) < 500:
        n = rng.randint(60, 300)
        a = [f"{len(pairs)}x{rng.randrange(10**6)}" for _ in range(n)]
        b = list(a)
        for at in rng.sample(range(n), max(1, n // 45 + rng.randint(-1, 1))):
            b[at] = f"y{rng.randrange(10**6)}"
        x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
        if 0.80 <= len(x & y) / len(x | y) <= 0.82:
            pairs.append((len(rows), len(rows) + 1))
            rows += [" ".join(a), " ".join(b)]
    got = {r["id"]: r["component"] for r in simhash.similar_groups(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert sum(got[i] == got[j] for i, j in pairs) >= 495
    assert len(set(got.values())) >= 500


def test_stages_over_odd_and_empty_tables(spark, odd, none):
    """Every stage keeps its columns; repeated ids and rows, nulls and columns of other names do no harm."""
    import corpus_pipeline as p

    for name, stage in p.STAGES:
        out = stage(spark, odd, SMALL)
        kept = out.collect()
        if name == "packing":
            assert sum(r["piece"] == 0 for r in kept) == odd.count()
            continue
        assert out.columns == list(p.COLUMNS)
        if name == "pii":
            assert len(kept) == odd.count() and sum(r["text"] is None for r in kept) == 1
        if name == "simhash":  # blank texts are one group, and so are the four rows of one text
            assert sorted(str(r["doc_id"]) for r in kept) == ["0", "3", "4", "6", "7", "8", "9", "None"]
        assert stage(spark, none, SMALL).count() == 0


def test_tables_are_dropped(spark):
    from tracewright.llm import common

    since = common.tables_so_far()
    kept = common.cut(spark.range(3), "kept")
    path = common._named[-1]
    common.cut(spark.range(3), "gone")
    gone = common._named[-1]
    common.drop_tables(spark, since, keep=(path,))
    assert kept.count() == 3 and common._named[since:] == [path]
    with pytest.raises(Exception):
        spark.read.parquet(gone)


def test_blank_texts_and_copies_without_ids_leave_one(spark):
    import corpus_pipeline as p

    text, other = " ".join(f"w{i}" for i in range(30)), " ".join(f"v{i}" for i in range(30))
    rows = [(3, ""), (2, None), (9, " \t"), (None, ""), (None, text), (None, text), (None, other), (7, text), (7, other), (None, "alone"), (None, "alone")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"], r["text"]) for r in p.drop_near_copies(spark, df, SMALL).collect()), key=str)
    assert got == sorted([(2, None), (7, text), (7, other), (None, "alone")], key=str)


def test_sets_go_only_to_rows_that_may_be_alike(spark, monkeypatch):
    """Texts with a common passage share min-wise values but are far apart: no set is sent to their buckets, and few to those of a true group."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = [word() for _ in range(80)]
    texts = [" ".join(passage + [word() for _ in range(220)]) for _ in range(60)]
    tables, real = {}, simhash.cut
    monkeypatch.setattr(simhash, "cut", lambda df, name: tables.setdefault(name, []).append(real(df, name)) or tables[name][-1])
    got = simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), part_rows=20)
    assert {(r["id"], r["component"]) for r in got.collect()} == {(i, i) for i in range(60)}
    assert tables["wide-left"][-1].count() > 20 and tables["wide-likely"][0].count() == tables["wide-wanted"][0].count() == 0


def test_contaminated_documents_go_by_a_broadcast(spark):
    """Texts aren't shuffled to drop the few that hold a benchmark window."""
    import corpus_pipeline as p

    plan = p.drop_contaminated(spark, spark.read.parquet(f"{SMALL}/documents.parquet"), SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
