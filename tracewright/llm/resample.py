"""Resampling towards a target distribution: documents drawn by how their hashed features are spread in the target.

The counts of features by bucket are a sparse matrix, persisted as blocks in compressed sparse row form. Its column sums give
both distributions, a bucket's gain is the logarithm of their ratio, and the product of the matrix with the
gains is the weight of each document. Adding Gumbel noise and taking the highest draws without replacement in
proportion to the exponentials of the weights.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, small_batches

#: Words of UTF-8 bytes: digits, lower-case letters, everything beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Distinct features whose bucket a worker remembers.
MOST_KNOWN = 300_000


class Buckets(dict):
    """The bucket of a feature by its checksum; forgotten all at once when there are too many."""

    def __init__(self, dims: int):
        super().__init__()
        self.dims = dims

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= MOST_KNOWN:
            self.clear()
        got = self[feature] = crc32(feature) % self.dims
        return got


def row(text: str | None, of: Buckets, longest: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(words, buckets, counts) of one text: all runs of 1 to ``longest`` consecutive words; buckets ascend, each once."""
    words = WORD.findall((text or "").encode().lower())  # of bytes: A to Z only
    found: Counter = Counter(words)
    for k in range(2, longest + 1):
        found.update(b" ".join(x) for x in zip(*(words[i:] for i in range(k))))
    at = np.fromiter(map(of.__getitem__, found), np.int32, len(found))
    slots, back = np.unique(at, return_inverse=True)
    return len(words), slots, np.bincount(back, np.fromiter(found.values(), float, len(found)), len(slots)).astype(np.int64)


def matrix(docs: DataFrame, dims: int = 10_000, longest: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(ids, words, starts, slots, counts)``: a block of rows each, to be written. Row i has the entries ``starts[i]`` to ``starts[i + 1]``.

    Null texts are rows without entries; repeated rows are rows of their own.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def each(batches):
        of = Buckets(dims)
        for b in batches:
            if not b.num_rows:
                continue
            found = [row(t, of, longest) for t in b.column(1).to_pylist()]
            words = np.array([n for n, _, _ in found], np.int64)
            starts = np.concatenate([[0], np.cumsum([len(s) for _, s, _ in found])]).astype(np.int64)
            slots = np.concatenate([s for _, s, _ in found]).astype(np.int32)
            counts = np.concatenate([c for _, _, c in found])
            ids = pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(0))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([x.tobytes()], pa.binary()) for x in (words, starts, slots, counts))], names)

    names = ["ids", "words", "starts", "slots", "counts"]
    return rows.mapInArrow(each, f"ids array<{kind}>, words binary, starts binary, slots binary, counts binary")


def column_sums(blocks: DataFrame, dims: int = 10_000) -> DataFrame:
    """``(bucket, n)`` for buckets that are met: each task adds its blocks up first and sends ``dims`` rows at most."""

    def each(batches):
        total = np.zeros(dims, np.int64)
        for b in batches:
            for s, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                np.add.at(total, np.frombuffer(s, np.int32), np.frombuffer(c, np.int64))
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met])], ["bucket", "n"])

    return blocks.select("slots", "counts").mapInArrow(each, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the target's share over the own one) of each bucket, with one more of every bucket in both."""
    d, s_all, t_all = float(len(own)), float(own.sum()), float(target.sum())
    ratio = ((t + 1) * (s_all + d) / ((s + 1) * (t_all + d)) for s, t in zip(own.astype(float).tolist(), target.astype(float).tolist()))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def weights(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """``(id, n_words, n_features, weight)`` of every row: the product of its matrix row with the gains, in whole numbers."""
    shipped = blocks.sparkSession.sparkContext.broadcast(gain)  # as long as there are buckets
    kind = blocks.schema["ids"].dataType.elementType.simpleString()

    def each(batches):
        g = shipped.value
        for b in batches:
            for i in range(b.num_rows):
                words, starts, slots, counts = (np.frombuffer(b.column(c)[i].as_py(), t) for c, t in ((1, np.int64), (2, np.int64), (3, np.int32), (4, np.int64)))
                up = lambda x: np.concatenate([[0], np.cumsum(x)])[starts]  # noqa: E731  sums up to where rows begin
                yield pa.RecordBatch.from_arrays([b.column(0)[i].values, *(pa.array(x, pa.int64()) for x in (words, np.diff(up(counts)), np.diff(up(counts * g[slots]))))], names)

    names = ["id", "n_words", "n_features", "weight"]
    return blocks.mapInArrow(each, f"id {kind}, n_words long, n_features long, weight long")


def draw(weighed: DataFrame, scratch: Scratch, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """``weighed`` with ``score`` and ``rank``: of the rows with ``least_words``, ``percent`` in a hundred of the highest scores.

    A score is the weight and noise of the id's hash (null: no digits). Ranks go from 1, of equal scores to the smaller id first
    (null last). Rows are sorted by range on the cluster, written, and numbered by the sizes of the partitions, a row
    each for the driver.
    """
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    rows = weighed.select("*", (F.col("weight") + noise).alias("score"), (F.col("n_words") >= least_words).alias("may"))
    rows = rows.orderBy(F.desc("may"), F.desc("score"), F.asc_nulls_last("id")).withColumn("part", F.spark_partition_id())
    rows = scratch.keep(rows.withColumn("at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "drawn")
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"), F.count_if("may").alias("n_may"))
    drawn = percent * (sizes.agg(F.sum("n_may")).first()[0] or 0) // 100
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.col("first") + F.col("at") + 1
    out = rows.join(F.broadcast(sizes.select("part", before.alias("first"))), "part")
    return out.select(*weighed.columns, "score", F.when(F.col("may") & (place <= drawn), place).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, dims: int = 10_000, longest: int = 1, percent: int = 10, least_words: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """``(id, n_words, n_features, weight, score, rank)`` of every row of ``docs``; ``rank`` is null where it isn't drawn.

    Both tables are read whole. An empty target has equal shares in all buckets. Empty ``docs``: no rows.
    """
    scratch = Scratch(docs.sparkSession)
    blocks = scratch.cut(matrix(docs, dims, longest, id_col, text_col), "counts")
    wanted = matrix(target.select(F.lit(None).cast("long").alias("none"), F.col(target_text_col).alias("text")), dims, longest, "none", "text")

    def dense(df: DataFrame) -> np.ndarray:
        out = np.zeros(dims, np.int64)
        for bucket, n in column_sums(df, dims).collect():  # a row a bucket
            out[bucket] = n
        return out

    out = draw(weights(blocks, gains(dense(blocks), dense(wanted))), scratch, percent, least_words, seed)
    scratch.drop()
    return out
