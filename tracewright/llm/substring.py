"""Exact removal of long repeated passages, over a compacted de Bruijn graph of token k-mers.

A window of ``window`` words is an edge between the two (window - 1)-mers that it covers, its nodes. Edges that
start at two source coordinates or more are the graph. A node with one edge in and one out doesn't
branch; edges that meet at such nodes are one path. Compaction has two steps: edges that follow one
another at their first source coordinates are a segment, and segments are chained by joins that double the
distance looked back in every round. The words of a path are read at its segments' source coordinates. Each stretch of
repeated edges in a text is a walk on the graph; it is cut where paths end, placed on its path by a join of its
first edge, and its own words are compared with the words of the path before any of them goes.

Most windows are unique, and those needn't be edges. Equal windows have equal anchors, the k-mer in them with
the least hash; only windows whose anchor two texts share, or one text has twice, come to the graph.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, small_batches
from .graph import components

WINDOW, ANCHOR = 35, 17
#: Repeated anchors up to this many go to the tasks as a bitmap of 16 MB; beyond that they are joined by a shuffle.
FILTER_UP_TO = 4_000_000
FILTER_BITS = 1 << 27
#: Nodes where paths end (8 bytes each) up to this many are broadcast; beyond that walks are placed edge by edge, by a shuffle.
STOPS_UP_TO = 2_000_000
#: A source coordinate is the number of a stretch of candidate windows, and in the low bits the window in it.
PLACE_BITS, COUNT_BITS = 18, 24
_PLACE = (1 << PLACE_BITS) - 1
_B1 = 0x9E3779B97F4A7C15
_powers: dict = {}


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2**64."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = 1 << max(12, n.bit_length())
        each = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            each.append(np.cumprod(p, dtype=np.uint64))
        _powers[base] = tuple(each)
    return _powers[base][0][:n], _powers[base][1][:n]


def rolled(words: np.ndarray, k: int, base: int = _B1) -> np.ndarray:
    """Hashes of all runs of k word hashes."""
    n = len(words)
    up, down = _power(base, n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up, dtype=np.uint64)])
    return _mix((sums[k:] - sums[: n - k + 1]) * down[: n - k + 1])


def _slide(h: np.ndarray, w: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every w consecutive values."""
    done = 1
    while done * 2 <= w:
        h = pick(h[:-done], h[done:])
        done *= 2
    return pick(h[: len(h) - (w - done)], h[w - done :]) if w > done else h


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def anchors(h: np.ndarray, window: int = WINDOW, k: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """(the anchor of each window, the hashes of all positions that some window has as its anchor)."""
    kmers, w = rolled(h, k), window - k + 1
    least = _slide(kmers, w, np.minimum)
    wide = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
    return least, kmers[kmers == _slide(wide, w, np.maximum)]


def covered(n: int, starts: np.ndarray, lengths: np.ndarray, window: int) -> np.ndarray:
    """Flags of n words: those in any of ``lengths`` windows from ``starts`` on."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths + window - 1, -1)
    return np.cumsum(edge[:n]) > 0


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def _bitmap(twice: DataFrame) -> np.ndarray:
    """A bit for the low bits of each repeated anchor; the driver gets a row an anchor at most."""
    slot = F.col("h").bitwiseAND(F.lit(FILTER_BITS - 1))
    got = twice.groupBy(F.shiftright(slot, 6).alias("i")).agg(F.expr("bit_or(shiftleft(1L, cast(h & 63 as int)))").alias("b")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[got.column("i").to_numpy()] = got.column("b").to_numpy()
    return bits.view(np.uint64)


def _islands(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, length) of each run of true flags."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    first = np.flatnonzero(edge == 1)
    return list(zip(first.tolist(), (np.flatnonzero(edge == -1) - first).tolist()))


def _longs(x) -> pa.Array:
    return pa.array(np.asarray(x, np.uint64).view(np.int64))


def _fresh(batches, window: int):
    """(text number, key, words) of texts with a window, each batch as a list; a text met again in a task is left out."""
    seen: set = set()
    for b in batches:
        out = []
        for i, (t, key) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
            if key not in seen and len(w := _split(t)) >= window:
                seen.add(key)
                out.append((i, key, w))
        if len(seen) > 300_000:
            seen.clear()
        yield b, out


def repeated_anchors(texts: DataFrame, window: int, k: int) -> DataFrame:
    """``(h)``: anchors that two texts (text, key) have, or one has at two places. Copies are one text."""

    def each(batches):
        for _, found in _fresh(batches, window):
            h, own = [], []
            for _, key, w in found:
                u, n = np.unique(anchors(word_hashes(w), window, k)[1], return_counts=True)
                mark = np.frombuffer(key[:8], "<u8")[0]
                h += [u, u[n > 1]]
                own += [np.full(len(u), mark), np.full((n > 1).sum(), mark ^ np.uint64(1))]
            if h:
                yield pa.RecordBatch.from_arrays([_longs(np.concatenate(h)), _longs(np.concatenate(own))], ["h", "own"])

    met = texts.mapInArrow(each, "h long, own long").groupBy("h").agg(F.min("own").alias("lo"), F.max("own").alias("hi"))
    return met.where("lo <> hi").select("h")


def _stretch_rows(found, window: int):
    """Record batches of stretches (key, at, words) of at most 2**PLACE_BITS - 1 windows, numbered in the task."""
    task, n, out, held = TaskContext.get().partitionId(), 0, [], 0

    def batch():
        run, key, at, words = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(run, pa.int64()), pa.array(key, pa.binary()), pa.array(at, pa.int32()), pa.array(words, pa.string())], ["run", "key", "at", "words"])

    for key, w, islands in found:
        for first, size in islands:
            for a in range(first, first + size, _PLACE):
                if n >> COUNT_BITS:
                    raise ValueError("too many stretches in one task: use smaller partitions")
                own = b" ".join(w[a : min(first + size, a + _PLACE) + window - 1]).decode()
                out.append((task << COUNT_BITS | n, key, a, own))
                n, held = n + 1, held + len(own)
                if held > 1 << 22:
                    yield batch()
                    out, held = [], 0
    if out:
        yield batch()


def stretches(texts: DataFrame, window: int, k: int, scratch: Scratch) -> DataFrame:
    """``(run, key, at, words)``: the stretches of windows with repeated anchors in ``texts`` (text, key); at least one of equal texts' is there."""
    spark = texts.sparkSession
    twice = scratch.cut(repeated_anchors(texts, window, k), "anchors")
    form = "run long, key binary, at int, words string"
    if twice.count() <= FILTER_UP_TO:
        shared = spark.sparkContext.broadcast(_bitmap(twice))

        def known(h):
            return shared.value[(h & np.uint64(FILTER_BITS - 1)) >> np.uint64(6)] >> (h & np.uint64(63)) & np.uint64(1) > 0

        def by_filter(batches):
            yield from _stretch_rows(((key, w, _islands(known(anchors(word_hashes(w), window, k)[0]))) for _, found in _fresh(batches, window) for _, key, w in found), window)

        return scratch.cut(texts.mapInArrow(by_filter, form), "stretches")

    def places(batches):
        for _, found in _fresh(batches, window):
            for _, key, w in found:
                least, _ = anchors(word_hashes(w), window, k)
                first = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
                size = np.diff(np.concatenate([first, [len(least)]]))
                yield pa.RecordBatch.from_arrays([_longs(least[first]), pa.array([key] * len(first), pa.binary()), pa.array(first.astype(np.int32)), pa.array(size.astype(np.int32))], ["h", "key", "at", "n"])

    lists = texts.mapInArrow(places, "h long, key binary, at int, n int").join(twice, "h", "left_semi")
    lists = scratch.cut(lists.groupBy("key").agg(F.collect_set(F.struct("at", "n")).alias("places")), "candidates")

    def by_list(batches):
        def found():
            for b, texts_ in _fresh(batches, window):
                for i, key, w in texts_:
                    flags = np.zeros(len(w) - window + 1, bool)
                    for p in b.column(2)[i].as_py():
                        flags[p["at"] : p["at"] + p["n"]] = True
                    yield key, w, _islands(flags)

        yield from _stretch_rows(found(), window)

    return scratch.cut(texts.join(lists, "key").select("text", "key", "places").mapInArrow(by_list, form), "stretches")


def graph_edges(runs: DataFrame, window: int) -> DataFrame:
    """``(u, v, lo, again)``: each distinct edge, its first source coordinate, and whether it has another one."""

    def each(batches):
        for b in batches:
            out, held = [], 0
            for run, words in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                nodes = rolled(word_hashes(words.encode().split(b" ")), window - 1)
                out.append((nodes[:-1], nodes[1:], np.arange(len(nodes) - 1, dtype=np.int64) + (run << PLACE_BITS)))
                held += len(nodes)
                if held > 200_000:
                    yield _edge_batch(out)
                    out, held = [], 0
            if out:
                yield _edge_batch(out)

    met = runs.select("run", "words").mapInArrow(each, "u long, v long, pos long").groupBy("u", "v").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    return met.select("u", "v", "lo", (F.col("lo") < F.col("hi")).alias("again"))


def _edge_batch(out) -> pa.RecordBatch:
    u, v, pos = (np.concatenate(x) for x in zip(*out))
    return pa.RecordBatch.from_arrays([_longs(u), _longs(v), pa.array(pos)], ["u", "v", "pos"])


def ends_of_paths(repeated: DataFrame) -> DataFrame:
    """``(u)``: nodes of the ``repeated`` edges (u, v) that haven't one edge in and one out."""
    out_one, in_one = F.lit(1).cast("long"), F.lit(1 << 32).cast("long")
    ends = repeated.select(F.explode(F.array(F.struct(F.col("u").alias("node"), out_one.alias("x")), F.struct(F.col("v").alias("node"), in_one.alias("x")))).alias("e"))
    return ends.groupBy(F.col("e.node").alias("u")).agg(F.sum("e.x").alias("x")).where(F.col("x") != (1 << 32) + 1).select("u")


def segments(repeated: DataFrame, stops: DataFrame) -> DataFrame:
    """``repeated`` edges (u, v, lo) with ``seg``, the first coordinate of their segment, and ``head``: whether their first node is a stop.

    A segment's edges follow one another at their first coordinates and meet at nodes inside a path.
    """
    rows = repeated.join(stops.withColumn("head", F.lit(True)), "u", "left").withColumn("head", F.coalesce("head", F.lit(False)))
    rows = rows.withColumn("run", F.shiftright("lo", PLACE_BITS))  # a column, so that both windows share one shuffle
    order = Window.partitionBy("run").orderBy("lo")
    before = F.lag("lo").over(order)
    rows = rows.withColumn("begins", F.col("head") | before.isNull() | (before != F.col("lo") - 1))
    seg = F.max(F.when(F.col("begins"), F.col("lo"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("seg", seg).select("u", "v", "lo", "seg", "head")


def _chained(first: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """Rows (seg, to, off, done) with ``to`` moved to the first segment of the chain, by doubling; and how many never get there."""
    rows, left = first, first.where("not done").count()
    while left:
        ahead = rows.select(F.col("seg").alias("to"), F.col("to").alias("to_"), F.col("off").alias("off_"), F.col("done").alias("done_"))
        moved = rows.where("not done").join(ahead, "to").select("seg", F.col("to_").alias("to"), (F.col("off") + F.col("off_")).alias("off"), F.col("done_").alias("done"))
        rows = scratch.cut(rows.where("done").union(moved), "chains")
        now = rows.where("not done").count()
        if now == left:  # a chain that ends gets shorter in every round
            break
        left = now
    return rows, left


def chains(segs: DataFrame, scratch: Scratch) -> DataFrame:
    """``(seg, path, off, cycle)`` of segments (seg, n, u, v, head): the path is named by its first segment, ``off`` counts edges.

    ``cycle`` is the number of edges of a path that closes on itself, else 0; such a path begins at its least segment.
    """
    last = segs.select(F.col("v").alias("u"), F.col("seg").alias("to"), F.col("n").alias("off"))
    linked = segs.where("not head").select("seg", "u").join(last, "u").select("seg", "to", "off", F.lit(False).alias("done"))
    heads = segs.where("head").select("seg", F.col("seg").alias("to"), F.lit(0).cast("long").alias("off"), F.lit(True).alias("done"))
    first = scratch.cut(heads.union(linked), "chains")
    rows, round_ = _chained(first, scratch)
    open_ = rows.where("done").select("seg", F.col("to").alias("path"), "off", F.lit(0).cast("long").alias("cycle"))
    if not round_:
        return open_
    rest = first.join(rows.where("not done").select("seg"), "seg")
    least = components(rest.select(F.col("seg").alias("a"), F.col("to").alias("b")), "cycles").where("node = root").select(F.col("node").alias("seg"), F.lit(True).alias("least"))
    rest = rest.join(least, "seg", "left").withColumn("done", F.coalesce("least", F.col("seg") == F.col("to")))
    rest = rest.select("seg", F.when(F.col("done"), F.col("seg")).otherwise(F.col("to")).alias("to"), F.when(F.col("done"), 0).otherwise(F.col("off")).cast("long").alias("off"), "done")
    rows, _ = _chained(scratch.cut(rest, "chains"), scratch)
    rows = rows.join(segs.select("seg", "n"), "seg")
    total = rows.groupBy(F.col("to").alias("path")).agg(F.sum("n").alias("cycle"))
    return open_.union(rows.select("seg", F.col("to").alias("path"), "off").join(total, "path").select("seg", "path", "off", "cycle"))


def _read(runs: DataFrame, marks: DataFrame, window: int, stops=None) -> DataFrame:
    """At the source coordinates: the words of each segment (seg, words), and each walk over repeated edges (run, key, at, first, n, u, v).

    ``marks``: (run, segs, single), the segments (first, edges) that begin in a stretch and its windows that aren't repeated. A
    walk ends at the nodes ``stops`` (a broadcast of a sorted array), so it is on one path; (u, v) is its first edge.
    """
    form = "seg long, words string, run long, key binary, at int, first int, n int, u long, v long"
    schema = pa.schema([("seg", pa.int64()), ("words", pa.string()), ("run", pa.int64()), ("key", pa.binary()), ("at", pa.int32()), ("first", pa.int32()), ("n", pa.int32()), ("u", pa.int64()), ("v", pa.int64())])

    def each(batches):
        ends = stops.value if stops else np.array([], np.int64)
        for b in batches:
            out = []
            for r in b.to_pylist():
                w = r["words"].encode().split(b" ")
                nodes = rolled(word_hashes(w), window - 1).view(np.int64)
                for s in r["segs"] or ():
                    out.append({"seg": r["run"] << PLACE_BITS | s["first"], "words": b" ".join(w[s["first"] : s["first"] + s["n"] + window - 1]).decode()})
                flags = np.ones(len(nodes) - 1, bool)
                flags[r["single"] or []] = False
                cuts = np.flatnonzero(ends[np.minimum(np.searchsorted(ends, nodes[:-1]), len(ends) - 1)] == nodes[:-1]) if len(ends) else []
                for first, size in _islands(flags):
                    inner = [int(c) for c in cuts if first < c < first + size]
                    for a, z in zip([first, *inner], [*inner, first + size]):
                        out.append({"run": r["run"], "key": r["key"], "at": r["at"] + a, "first": a, "n": z - a, "u": int(nodes[a]), "v": int(nodes[a + 1])})
                if len(out) > 4096:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    return runs.join(marks, "run", "left").select("run", "key", "at", "words", "segs", "single").mapInArrow(each, form)


def _steps(runs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """``(key, at, walk, u, v)``: every edge of the walks ``wanted`` (run, at, first, n)."""
    lists = wanted.groupBy("run").agg(F.collect_list(F.struct("at", "first", "n")).alias("lists"))

    def each(batches):
        for b in batches:
            for r in b.to_pylist():
                nodes = rolled(word_hashes(r["words"].encode().split(b" ")), window - 1)
                for s in r["lists"]:
                    for a in range(0, s["n"], 100_000):
                        n = min(100_000, s["n"] - a)
                        own = nodes[s["first"] + a : s["first"] + a + n + 1]
                        at = np.arange(s["at"] + a, s["at"] + a + n, dtype=np.int32)
                        yield pa.RecordBatch.from_arrays([pa.array([r["key"]] * n, pa.binary()), pa.array(at), pa.array(np.full(n, s["at"], np.int32)), _longs(own[:-1]), _longs(own[1:])], ["key", "at", "walk", "u", "v"])

    return runs.join(lists, "run").select("run", "key", "words", "lists").mapInArrow(each, "key binary, at int, walk int, u long, v long")


def repeated_spans(texts: DataFrame, window: int, k: int, scratch: Scratch) -> DataFrame:
    """``(key, at, n, off, cycle, expected)``: spans of ``n`` repeated windows from word ``at`` on, and the words their path has there.

    Of a path that closes on itself ``expected`` is one round of ``cycle`` words, to be read from ``off`` on.
    """
    spark = texts.sparkSession
    runs = stretches(texts, window, k, scratch)
    edges = scratch.cut(graph_edges(runs, window), "edges")
    repeated = edges.where("again").select("u", "v", "lo")
    stops = scratch.cut(ends_of_paths(repeated), "stops")
    few = stops.count() <= STOPS_UP_TO
    placed = scratch.cut(segments(repeated, F.broadcast(stops) if few else stops), "placed")
    segs = placed.groupBy("seg").agg((F.max("lo") - F.col("seg") + 1).alias("n"), F.max(F.when(F.col("lo") == F.col("seg"), F.col("u"))).alias("u"), F.max_by("v", "lo").alias("v"), F.max(F.when(F.col("lo") == F.col("seg"), F.col("head"))).alias("head"))
    segs = scratch.cut(segs, "segments")
    chained = scratch.cut(chains(segs, scratch), "paths")

    place = lambda c: F.col(c).bitwiseAND(F.lit(_PLACE)).cast("int")
    own = segs.groupBy(F.shiftright("seg", PLACE_BITS).alias("run")).agg(F.collect_list(F.struct(place("seg").alias("first"), F.col("n").cast("int").alias("n"))).alias("segs"))
    single = edges.where("not again").groupBy(F.shiftright("lo", PLACE_BITS).alias("run")).agg(F.collect_list(place("lo")).alias("single"))
    marks = scratch.cut(own.join(single, "run", "full"), "marks")
    shared = spark.sparkContext.broadcast(np.sort(stops.toArrow().column("u").to_numpy())) if few else None
    read = scratch.cut(_read(runs, marks, window, shared), "read")

    pieces = read.where("seg is not null").select("seg", F.split("words", " ").alias("w")).join(chained, "seg")
    pieces = pieces.groupBy("path").agg(F.max("cycle").alias("cycle"), F.sort_array(F.collect_list(F.struct("off", "w"))).alias("p"))
    whole = F.flatten(F.transform("p", lambda x, i: F.when(i == 0, x["w"]).otherwise(F.slice(x["w"], window, F.size(x["w"])))))
    paths = scratch.cut(pieces.select("path", "cycle", whole.alias("w")), "path-words")

    walks = scratch.cut(read.where("seg is null").select("run", "key", "at", "first", "n", "u", "v").dropDuplicates(["key", "at"]), "walks")
    lookup = lambda df: df.join(placed.select("u", "v", "lo", "seg"), ["u", "v"]).join(chained, "seg").withColumn("off", F.col("off") + F.col("lo") - F.col("seg"))
    if few:
        spans = lookup(walks).select("key", "at", "n", "path", "off")
    else:
        turn = F.when(F.col("cycle") > 0, F.pmod(F.col("off") - F.col("at"), F.col("cycle"))).otherwise(F.col("off") - F.col("at"))
        steps = lookup(_steps(runs, walks, window)).groupBy("key", "walk", "path", turn.alias("turn"))
        spans = steps.agg(F.min("at").alias("at"), F.count("*").cast("int").alias("n"), F.min_by("off", "at").alias("off")).select("key", "at", "n", "path", "off")
    spans = scratch.cut(spans, "spans")
    words = F.when(F.col("cycle") == 0, F.slice("w", F.col("off").cast("int") + 1, F.col("n") + window - 1)).otherwise(F.slice("w", 1, F.col("cycle").cast("int")))
    return spans.join(paths, "path").select("key", "at", "n", "off", "cycle", F.array_join(words, " ").alias("expected"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, k: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text, n_words, n_removed, kept, kept_sha256)`` of every row; text is the input.

    Words are split at ASCII white space. A word goes if a window over it starts at two places or more,
    copies and the same document included. Texts are told apart by their SHA-256, so null and repeated ids
    keep their row; all windows of a text that two rows have are repeated. A null text has no words and
    stays null. Tables between the steps are deleted before this returns.
    """
    if k >= window:
        raise ValueError("an anchor must be shorter than a window")
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("key"))
    copies = scratch.cut(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "copies")
    spans = repeated_spans(rows.select("text", "key"), window, k, scratch).join(copies, "key", "left_anti")
    spans = spans.groupBy("key").agg(F.collect_list(F.struct("at", "n", "off", "cycle", "expected")).alias("spans"))
    known = scratch.keep(spans.unionByName(copies.withColumn("copied", F.lit(True)), allowMissingColumns=True), "spans-of-texts")
    scratch.drop()
    out = rows.join(known, "key", "left").select("id", "text", "spans", "copied")

    def remove(batches):
        for b in batches:
            got: list = [[] for _ in range(4)]
            for text, spans, copied in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                kept = words = _split(text)
                if copied and len(words) >= window:
                    kept = []
                elif spans:
                    true = [(s["at"], s["n"]) for s in spans if _holds(words, s, window)]
                    gone = covered(len(words), np.array([a for a, _ in true], np.int64), np.array([n for _, n in true], np.int64), window)
                    kept = [w for w, g in zip(words, gone.tolist()) if not g]
                joined = b" ".join(kept)
                for c, x in zip(got, (len(words), len(words) - len(kept), joined.decode(), hashlib.sha256(joined).hexdigest())):
                    c.append(x)
            cols = [pa.array(c, t) for c, t in zip(got, (pa.int64(), pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], ["id", "text", "n_words", "n_removed", "kept", "kept_sha256"])

    return out.mapInArrow(remove, f"id {rows.schema['id'].dataType.simpleString()}, text string, n_words long, n_removed long, kept string, kept_sha256 string")


def _holds(words: list[bytes], span: dict, window: int) -> bool:
    """Whether a text has the words of the path where the span says so; one that hasn't is a collision of hashes and stays."""
    own, want = words[span["at"] : span["at"] + span["n"] + window - 1], span["expected"].encode().split(b" ")
    if span["cycle"]:
        want = [want[(span["off"] + i) % span["cycle"]] for i in range(len(own))]
    return own == want
