"""Conflict-constrained best-fit packing of documents into bins of fixed capacity.

Open bins stand in order of residual capacity and carry two bitmaps: the sources and the duplicate
clusters in them. A piece goes to the tightest bin that holds it and has neither its source nor its
cluster: from the first bin with room the search goes on to the next larger residual until a
compatible one is found; failing that, a bin is opened. Pieces come in decreasing size.
"""

from __future__ import annotations

import bisect

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches

#: Rows that one task packs together. Bins don't cross shards, so the fill lost is about a bin a shard.
SHARD_ROWS = 8192


def best_fit(pieces: list[tuple[int, object, object]], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each piece (size, source, cluster), sizes of at most ``capacity``; None conflicts with nothing."""
    bit: tuple[dict, dict] = ({}, {})
    marks = []
    for _, s, c in pieces:
        marks.append(tuple(0 if x is None else 1 << d.setdefault(x, len(d)) for d, x in zip(bit, (s, c))))
    placed: list = [(0, 0)] * len(pieces)
    order: list[tuple[int, int]] = []  # (residual, bin), ascending
    bins: list[list[int]] = []  # source and cluster bitmaps
    for i in sorted(range(len(pieces)), key=lambda i: (-pieces[i][0], i)):
        size, (source, cluster) = pieces[i][0], marks[i]
        at = bisect.bisect_left(order, (size, -1))
        while at < len(order) and (bins[order[at][1]][0] & source or bins[order[at][1]][1] & cluster):
            at += 1
        left, b = order.pop(at) if at < len(order) else (capacity, len(bins))
        if b == len(bins):
            bins.append([0, 0])
        bins[b][0] |= source
        bins[b][1] |= cluster
        placed[i] = (b, capacity - left)
        bisect.insort(order, (left - size, b))
    return placed


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(id, source, size, cluster)``: words of a text, and a hash that texts equal but for case and white space share.

    Texts without words are in no cluster.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))

    def each(batches):
        for b in batches:
            words = [(t or "").lower().split() for t in b.column(2).to_pylist()]
            keys = [xxhash.xxh3_128_hexdigest(" ".join(w)) if w else None for w in words]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(w) for w in words], pa.int64()), pa.array(keys, pa.string())], ["id", "source", "size", "cluster"])

    return rows.mapInArrow(each, "id long, source string, size long, cluster string")


def pack(sized: DataFrame, capacity: int = 2048, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``sized`` (id, source, size, cluster) to ``(id, piece, bin, offset, n_tokens)``.

    A document longer than ``capacity`` is cut: whole pieces fill bins of their own, the rest is packed. Every row
    is packed, those of size 0 as well; a null size counts as 0. Rows are dealt to shards by a hash, repeated and null
    ids like others, so a hot source or cluster is spread evenly; within a shard no bin has two pieces of one source or cluster.
    """
    sized = cut(sized, "sizes")
    shards = max(1, -(-sized.count() // shard_rows))
    rows = sized.withColumn("size", F.coalesce("size", F.lit(0)).cast("long")).withColumn("shard", F.pmod(F.xxhash64("id", "cluster", F.monotonically_increasing_id()), F.lit(shards)))

    def each(t: pa.Table) -> pa.Table:
        t = t.sort_by([("id", "ascending"), ("cluster", "ascending"), ("size", "ascending"), ("source", "ascending")])
        size = t.column("size").to_pylist()
        whole = [max(0, n - 1) // capacity for n in size]
        rest = [n - k * capacity for n, k in zip(size, whole)]
        placed = best_fit(list(zip(rest, t.column("source").to_pylist(), t.column("cluster").to_pylist())), capacity)
        base = t.column("shard")[0].as_py() << 32 if len(t) else 0
        free = max((b for b, _ in placed), default=-1) + 1
        out: list = []
        for i, n, k, (b, at) in zip(t.column("id").to_pylist(), rest, whole, placed):
            for piece in range(k):
                out.append((i, piece, base + free, 0, capacity))
                free += 1
            out.append((i, k, base + b, at, n))
        names = ("id", "piece", "bin", "offset", "n_tokens")
        return pa.table({c: pa.array([r[j] for r in out], pa.int64()) for j, c in enumerate(names)})

    return rows.groupBy("shard").applyInArrow(each, "id long, piece long, bin long, offset long, n_tokens long")
