"""Near-duplicates by SimHash, with pigeonring filtering of the Hamming search.

Fingerprints that differ in at most ``radius`` of 64 bits link. The bits are dealt to ``segments``
consecutive segments on a ring. By the pigeonring principle (Qin and Xiao, VLDB 2018) two linked
fingerprints have a start on the ring from which every chain of j segments differs in at most
j * radius / segments bits. The chains whose budget is below one bit must be equal, so they are the
join key; the longer chains prune candidates before the full distance is taken.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches
from .graph import components

SEED = 42
#: bit k of byte b, for all 256 bytes
_BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1


def fingerprint(text: str | None, words_each: int = 3) -> int:
    """Signed 64-bit SimHash of the XXH64 (seed 42) of word shingles; no words: 0."""
    words = (text or "").encode().lower().split()  # bytes: folds A-Z only, splits at ASCII white space only
    if not words:
        return 0
    each = zip(*(words[i:] for i in range(words_each))) if len(words) >= words_each else [words]
    digest, join = xxhash.xxh64_intdigest, b" ".join
    h = np.array([digest(join(s), SEED) for s in each], dtype="<u8").view(np.uint8).reshape(-1, 8)
    ones = np.bincount((h + np.arange(8) * 256).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int(np.packbits(2 * ones.ravel() > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 3) -> DataFrame:
    """``(id, fp)`` for every row of ``docs``; a null text has the fingerprint of an empty one."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def each(batches):
        for b in batches:
            fp = [fingerprint(t, words_each) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["id", "fp"])

    return rows.mapInArrow(each, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def ring(segments: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each segment of 64 bits."""
    at = [64 * i // segments for i in range(segments + 1)]
    return [(at[i], at[i + 1] - at[i]) for i in range(segments)]


def _mask(parts: list[tuple[int, int]]) -> int:
    m = sum(((1 << n) - 1) << at for at, n in parts)
    return m - (1 << 64) if m >= 1 << 63 else m


def links(distinct: DataFrame, radius: int = 2, segments: int = 5, pairs_up_to: int = 32) -> DataFrame:
    """``distinct`` (fp: long, no repeats) to edges ``(a, b)`` that connect what links of at most ``radius`` bits connect.

    A key with at most ``pairs_up_to`` fingerprints compares its pairs: chains first, full distance
    last. A larger one takes no pairs (radius 2): each fingerprint goes to the bit patterns one bit
    away, outside the equal chain. The at most 65 fingerprints that meet at a pattern are within two
    bits of one another, and any two within two bits meet, so linking each to the least of them
    loses nothing.
    """
    if not 1 <= radius <= 2:
        raise ValueError("radius must be 1 or 2")
    parts = ring(segments)
    budget = [(j * radius) // segments for j in range(segments + 1)]
    equal = max(j for j in range(1, segments) if budget[j] == 0)
    chain = lambda i, j: [parts[(i + k) % segments] for k in range(j)]
    keys = F.array(*(F.struct(F.lit(i).alias("at"), F.col("fp").bitwiseAND(F.lit(_mask(chain(i, equal)))).alias("key")) for i in range(segments)))
    rows = distinct.select("fp", F.explode(keys).alias("k")).select("fp", "k.at", "k.key")
    met = cut(rows.groupBy("at", "key").agg(F.count("*").alias("n")).where("n > 1"), "ring-keys")
    rows = cut(rows.join(met, ["at", "key"]), "ring")

    a, b = (rows.where(f"n <= {pairs_up_to}").select("at", "key", F.col("fp").alias(x)) for x in "ab")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    within = F.lit(False)
    for i in range(segments):
        ok = F.col("at") == i
        for j in range(equal + 1, segments):
            ok &= F.bit_count(differ.bitwiseAND(F.lit(_mask(chain(i, j))))) <= budget[j]
        within |= ok
    pairs = a.join(b, ["at", "key"]).where("a < b").where(within).where(F.bit_count(differ) <= radius).select("a", "b")

    outside = F.lit(None).cast("array<long>")
    for i in range(segments):
        taken = _mask(chain(i, equal)) & (1 << 64) - 1
        flips = [0] + [_mask([(k, 1)]) for k in range(64) if not taken >> k & 1]
        outside = F.when(F.col("at") == i, F.array(*map(F.lit, flips))).otherwise(outside)
    near = rows.where(f"n > {pairs_up_to}").select("at", "fp", F.explode(outside).alias("flip"))
    near = near.groupBy("at", F.col("fp").bitwiseXOR(F.col("flip")).alias("z")).agg(F.sort_array(F.collect_list("fp")).alias("s")).where("size(s) > 1")
    stars = near.select(F.col("s")[0].alias("a"), F.explode("s").alias("b")).where("a <> b").where(F.bit_count(differ) <= radius)
    return pairs.union(stars).distinct()


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 3, radius: int = 2) -> DataFrame:
    """``(id, fp, component)`` for every row: component is the smallest id reachable over links.

    Rows with one fingerprint are one node, so groups of copies cost one row. Null ids keep their
    row and belong to the group of their fingerprint; a group without any id has a null component.
    Repeated ids are rows of their own. Other columns of ``docs`` aren't looked at.
    """
    fps = cut(fingerprints(docs, id_col, text_col, words_each), "fingerprints")
    nodes = fps.groupBy("fp").agg(F.min("id").alias("least"))
    found = components(links(nodes.select("fp"), radius), "simhash").withColumnRenamed("node", "fp")
    rooted = nodes.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    classes = cut(rooted.groupBy("root").agg(F.min("least").alias("component")), "classes")
    label = rooted.join(classes, "root").select("fp", "component")
    return fps.join(label, "fp").select("id", "fp", "component")


# --- similarities far below equality -----------------------------------------------------------

#: Words of 64 bits of a wide fingerprint; each is a segment of the ring, and each gives a min-wise value.
WIDE = 8
#: Shingles below which a fingerprint says too little: pairs with such a set skip its test.
FEW = 64
#: Texts whose sets are wanted (16 bytes each) up to this many are broadcast to where the texts are; beyond that texts are shuffled.
BROADCAST_UP_TO = 1_000_000
#: Rows of a bucket that meet in one task; a larger bucket is split and its parts meet two by two.
PART_ROWS = 500


def radius_of(least: float, bits: int = 64 * WIDE, deviations: float = 6.0) -> int:
    """Differing bits that two sets of a Jaccard similarity of ``least`` are expected to have, and some standard deviations more."""
    share = np.arccos(2 * least / (1 + least)) / np.pi
    return int(bits * share + deviations * np.sqrt(bits * share * (1 - share)))


def shingles(text: str, words_each: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles."""
    words = text.encode().lower().split()
    if not words:
        return np.array([], "<u8")
    each = zip(*(words[i:] for i in range(words_each))) if len(words) >= words_each else [words]
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return np.unique(np.array([digest(join(s), SEED) for s in each], dtype="<u8"))


def wide(h: np.ndarray) -> tuple[list[int], list[int]]:
    """(the words of a 512-bit SimHash, the least value of each word's hash) over a set of shingles; none: zeros."""
    if not len(h):
        return [0] * WIDE, [0] * WIDE
    fp, least = [], []
    for i in range(WIDE):
        x = (h ^ np.uint64(0x9E3779B97F4A7C15 * (i + 1) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        ones = np.bincount((x.view(np.uint8).reshape(-1, 8) + np.arange(8) * 256).ravel(), minlength=2048).reshape(8, 256) @ _BITS
        fp.append(int(np.packbits(2 * ones.ravel() > len(x), bitorder="little").view("<i8")[0]))
        least.append(int(x.min().view(np.int64)))
    return fp, least


def _within(a: str, b: str, radius: int):
    """Pigeonring test of two wide fingerprints: a start with short chains in their budgets, then the whole distance."""
    d = [F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(WIDE)]
    starts = F.lit(False)
    for i in range(WIDE):
        chain, so_far = F.lit(True), F.lit(0)
        for j in (1, 2, 3):
            so_far = so_far + d[(i + j - 1) % WIDE]
            chain &= so_far <= j * radius // WIDE
        starts |= chain
    return starts & (sum(d[1:], d[0]) <= radius)


def _may_be_alike(radius: int, least: float):
    """The cheap tests of a pair (na, fa), (nb, fb): sizes of the sets, then the fingerprints unless a set is small."""
    small, large = F.least("na", "nb"), F.greatest("na", "nb")
    return (small >= F.lit(least) * large - 1e-6) & ((small < FEW) | _within("fa", "fb", radius))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 5, least: float = 0.8, part_rows: int = PART_ROWS) -> DataFrame:
    """``(id, component)`` of every row with an id: the smallest id reachable over links.

    Links: sets of shingles that are alike to ``least`` or more, verified exactly, by the 64-bit hashes of
    the shingles, before anything depends on them. The ring's segments of a wide fingerprint can't be join keys at such radii (each would
    have few bits), so candidates share one of eight min-wise values of the same shingles; a pair at a similarity of
    0.8 shares none with a probability of 0.2 ** 8. Fingerprints only prune, at six standard deviations.

    Each row of a bucket meets the bucket's leader first, the text that shares values with most others. That
    joins most rows of a group of copies. Of buckets that still have rows of several components, all pairs of two
    components are compared: a bucket of more than ``part_rows`` rows is split, its largest component apart
    from the rest, and parts meet two by two in groups of their own. ``part_rows`` changes the cost, never the result.
    Equal sets are one node, texts without words another.
    """
    radius = radius_of(least)
    small_batches(docs.sparkSession)
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def each(batches):
        for b in batches:
            sets = [shingles(t, words_each) for t in b.column(1).to_pylist()]
            got = [wide(h) for h in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(_name, sets), pa.int64()), pa.array([len(h) for h in sets], pa.int32()), *(pa.array([g[k] for g in got], pa.list_(pa.int64())) for k in (0, 1))], ["id", "u", "size", "f", "m"])

    texts, rows = rows, cut(rows.mapInArrow(each, "id long, u long, size int, f array<long>, m array<long>"), "wide")
    nodes = rows.groupBy("u").agg(F.min("id").alias("node"), F.min_by(F.struct("size", "f", "m"), "id").alias("x"))
    nodes = cut(nodes.select("u", "node", "x.*"), "wide-nodes")

    keys = nodes.where("size > 0").select("u", F.posexplode("m").alias("at", "value")).select("u", "at", F.xxhash64("at", "value").alias("key"))
    n = cut(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "wide-keys")
    met = cut(keys.join(n, "key"), "wide-met")
    sets = _sets(met.select("u").distinct(), texts, nodes, words_each)
    repeated = rows.groupBy("u", "id").count().where("count > 1")
    sets = cut(sets if repeated.isEmpty() else sets.dropDuplicates(["u"]), "wide-sets")
    weight = cut(met.groupBy("u").agg(F.sum("n").alias("weight")), "wide-weights")
    left = cut(met.join(nodes.drop("node").join(weight, "u"), "u").select("u", "size", "f", "m", "weight", "at", "key", "n"), "wide-left")
    whole, linked = left.columns, None
    lead, others = left, left
    for turn in (1, 2):
        leader = lead.groupBy("key").agg(F.max_by(F.struct("u", "size", "f"), F.struct("weight", "u")).alias("x"))
        leader = cut(leader.select("key", F.col("x.u").alias("b"), F.col("x.size").alias("nb"), F.col("x.f").alias("fb")), "wide-leaders")
        near = others.withColumnsRenamed({"size": "na", "f": "fa"}).join(leader, "key").where("u <> b").where(_may_be_alike(radius, least))
        near = cut(near.select(F.least("u", "b").alias("a"), F.greatest("u", "b").alias("b")).distinct(), "wide-edges")
        new = cut(_verified(near, sets, least), "wide-links")
        linked = cut(components(_with(linked, new), "similar"), "similar")
        left = left.select(*whole).join(linked.withColumnRenamed("node", "u"), "u", "left").withColumn("comp", F.coalesce("root", "u")).drop("root")
        # of buckets of two, the only pair has met
        sizes = left.where("n > 2").groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("most"), F.max("c").alias("c"), F.count("*").alias("comps")).where("comps > 1").drop("comps")
        left = cut(left.join(cut(sizes, "wide-open"), "key"), "wide-left")
        lead = others = left.where(f"n > {part_rows}")
        lead = lead.where("comp <> most")
        if lead.isEmpty():
            break
    if not left.isEmpty():
        new = cut(_pairs_of_parts(left, sets, radius, least, part_rows), "wide-links")
        linked = cut(components(_with(linked, new), "similar"), "similar")
    rooted = nodes.join(linked.withColumnRenamed("node", "u"), "u", "left").select("u", "node", F.coalesce("root", "u").alias("root"))
    classes = cut(rooted.groupBy("root").agg(F.min("node").alias("component")), "similar-classes")
    label = cut(rooted.join(classes, "root").select("u", "component"), "similar-labels")
    return rows.select("id", "u").join(label, "u").select("id", "component")


def _with(linked: DataFrame | None, new: DataFrame) -> DataFrame:
    """Edges (a, b) that connect what ``new`` edges and the classes ``linked`` (node, root) connect."""
    return new if linked is None else linked.select(F.col("node").alias("a"), F.col("root").alias("b")).union(new)


def _name(h: np.ndarray) -> int:
    """The name of a node: a hash of its set."""
    return xxhash.xxh3_64_intdigest(h.tobytes()) - 2**63


def _sets(wanted: DataFrame, texts: DataFrame, nodes: DataFrame, words_each: int) -> DataFrame:
    """``(u, s)`` of the nodes ``wanted`` (u, no repeats): the set of a text of ``texts`` (id, text) that it stands for, made again from the text.

    Rows that repeat an id and a text give a set each.
    """
    ends = cut(wanted.join(nodes.select("u", F.col("node").alias("id")), "u"), "wide-ends")
    ends = F.broadcast(ends) if ends.count() <= BROADCAST_UP_TO else ends

    def each(batches):
        for b in batches:
            got = [(u, h.tobytes()) for u, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if _name(h := shingles(t, words_each)) == u]
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in got], pa.int64()), pa.array([s for _, s in got], pa.binary())], ["u", "s"])

    return texts.join(ends, "id").select("u", "text").mapInArrow(each, "u long, s binary")


def _alike(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= least * (len(x) + len(y) - both)


def _verified(edges: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Edges (a, b) whose ``sets`` (u, s) have a Jaccard similarity of ``least`` or more."""

    def alike(batches):
        for b in batches:
            ok = [_alike(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), least) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(b.columns[:2], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    small = F.broadcast if edges.count() <= BROADCAST_UP_TO else lambda df: df  # beyond that all sets are shuffled
    first = sets.toDF("a", "sa").join(small(edges), "a")
    pairs = first.join(sets.toDF("b", "sb").join(small(edges.select("b").distinct()), "b"), "b").select("a", "b", "sa", "sb")
    return pairs.mapInArrow(alike, "a long, b long")


def _pairs_of_parts(left: DataFrame, sets: DataFrame, radius: int, least: float, part_rows: int) -> DataFrame:
    """Links (a, b) that connect what the links between two components in a bucket of ``left`` connect.

    ``most`` is a bucket's largest component, of ``c`` rows: pairs inside it aren't looked at, so its parts meet only others.
    Parts meet twice: without ``sets``, which leaves the rows with a pair that may be alike, and with them.
    """
    apart = (F.col("n") > part_rows) & (F.col("comp") == F.col("most"))
    minor = F.when(F.col("n") > part_rows, F.ceil((F.col("n") - F.col("c")) / part_rows)).otherwise(1).cast("int")
    major = F.when(F.col("n") > part_rows, F.ceil(F.col("c") / part_rows)).otherwise(0).cast("int")
    sent = left.withColumns({"minor": minor, "major": major}).withColumn("h", F.xxhash64("u"))
    sent = sent.withColumn("mine", F.when(apart, F.col("minor") + F.pmod("h", F.greatest("major", F.lit(1)))).otherwise(F.pmod("h", "minor")).cast("int"))
    sent = sent.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(apart, F.col("minor") - 1).otherwise(F.col("minor") + F.col("major") - 1))))
    sent = sent.withColumns({"low": F.least("mine", "other"), "high": F.greatest("mine", "other")})
    tasks = 1 + left.where(f"n <= {part_rows}").count() // (2 * part_rows)
    bin_ = F.when(F.col("n") > part_rows, F.col("key")).otherwise(F.pmod(F.xxhash64("key"), F.lit(tasks)))
    sent = sent.select(bin_.alias("bin"), "key", "at", "low", "high", "mine", "u", "comp", "size", "f", "m")

    def buckets(t: pa.Table):
        """(rows of the lower part, rows of the higher part, ``tested``) of each bucket in ``t``."""
        groups: dict = {}
        for i, key in enumerate(t.column("key").to_pylist()):
            groups.setdefault(key, []).append(i)
        at, mine, size = (t.column(c).to_numpy() for c in ("at", "mine", "size"))
        low, high = (t.column(c)[0].as_py() for c in ("low", "high"))
        f, m = (np.array(t.column(c).to_pylist(), np.int64) for c in ("f", "m"))
        for g in groups.values():
            g = np.array(g)
            a, b = (g[mine[g] == x] for x in (low, high))

            def tested(x: int, ok: np.ndarray, a=a, b=b, k=at[g[0]]) -> np.ndarray:
                """Places in ``b``, of those that are ``ok``, that may be alike to the row ``a[x]`` and don't meet it elsewhere, likeliest first."""
                i = a[x]
                if low == high:
                    ok[: x + 1] = False
                j = np.flatnonzero(ok)
                large, small = np.maximum(size[b[j]], size[i]), np.minimum(size[b[j]], size[i])
                j = j[small >= least * large - 1e-6]
                j = j[(m[b[j], :k] != m[i, :k]).all(1)]  # others meet in an earlier bucket
                far = np.bitwise_count((f[b[j]] ^ f[i]).view(np.uint64)).sum(1, dtype=np.int64)  # of signed numbers it counts the absolute value
                near = (far <= radius) | (np.minimum(size[b[j]], size[i]) < FEW)
                return j[near][np.argsort(far[near], kind="stable")]

            yield a, b, tested

    def likely(t: pa.Table) -> pa.Table:
        comp, keep = t.column("comp").to_numpy(), np.zeros(len(t), bool)
        for a, b, tested in buckets(t):
            for x, i in enumerate(a):
                j = tested(x, comp[b] != comp[i])
                keep[b[j]] = True
                keep[i] |= len(j) > 0
        return t.filter(pa.array(keep))

    def meet(t: pa.Table) -> pa.Table:
        u, comp = (t.column(c).to_numpy() for c in ("u", "comp"))
        sets, out = [np.frombuffer(x, "<u8") for x in t.column("s").to_pylist()], []
        for a, b, tested in buckets(t):
            own_now, now = comp[a], comp[b]
            for x, i in enumerate(a):
                for y in tested(x, now != own_now[x]):
                    if now[y] != own_now[x] and _alike(sets[i], sets[b[y]], least):
                        out.append((u[i], u[b[y]]))
                        old, new = now[y], own_now[x]
                        now[now == old] = new
                        own_now[own_now == old] = new
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    # sets are large: they go only to rows with a pair that passes the other tests
    sent = cut(sent.groupBy("bin", "low", "high").applyInArrow(likely, sent.schema), "wide-likely")
    wanted = cut(sent.select("u").distinct(), "wide-wanted")
    sets = sets.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_UP_TO else wanted, "u")
    return sent.join(sets, "u").groupBy("bin", "low", "high").applyInArrow(meet, "a long, b long")
