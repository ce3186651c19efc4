"""Near-duplicate vectors by a subspace pigeonhole join.

For unit vectors cosine >= t means a squared distance of at most D = 2 - 2t. A rotation spreads the
energy evenly; split into blocks of equal width, at least one block of such a pair is within D / blocks. So
each block is range-joined on its own: a grid over its leading dimensions, cells twice as wide as the
block's radius, and a vector's block is sent to its own cell and to the later cells that its ball touches.
Only vectors that have another within the block's budget there are sent whole, to the same cells, and
pairs are verified exactly, in the first block that finds them.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches
from .graph import components

#: Rows of a cell that meet in one task; a larger cell is split and its parts meet two by two.
CELL_ROWS = 2000


def rotation(dim: int) -> np.ndarray:
    """A fixed orthogonal matrix for ``dim``."""
    q, r = np.linalg.qr(np.random.default_rng(7).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def spans(dim: int, width: int) -> list[slice]:
    return [slice(i, min(i + width, dim)) for i in range(0, dim, width)]


def budgets(dim: int, width: int, least: float) -> list[float]:
    """Squared distance of each block, in proportion to its width, with room for rounding."""
    return [(2 - 2 * least) * (s.stop - s.start) / dim + 1e-7 for s in spans(dim, width)]


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _probes(x: np.ndarray, dims: int, radius: float):
    """(row, cell coordinates, home) for the home cell and the later cells that a ball of ``radius`` touches."""
    side = 2 * radius
    cell = np.floor(x[:, :dims] / side)
    low = x[:, :dims] / side - cell  # 0 to 1 inside the cell
    for step in itertools.product((-1, 0, 1), repeat=dims):
        far = np.zeros(len(x))
        for d, s in enumerate(step):
            if s:
                far += ((low[:, d] if s < 0 else 1 - low[:, d]) * side) ** 2
        if step == (0,) * dims:
            yield np.arange(len(x)), cell, True
        elif step > (0,) * dims and len(hit := np.flatnonzero(far <= radius**2 * (1 + 1e-9) + 1e-12)):
            yield hit, cell[hit] + step, False


def _hash(cells: np.ndarray, seed: int) -> np.ndarray:
    h = np.full(len(cells), seed, np.uint64)
    for c in cells.astype(np.int64).T:
        h = (h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _meet(a, b, same: bool, block: int, width: int, least: float, rot: np.ndarray):
    """Indices of the linked pairs of two parts of a cell that this block is the first to find, one home row at least in each."""
    (ia, xa, ha), (ib, xb, hb) = a, b
    ra, rb, hits = xa @ rot, xb @ rot, [np.zeros((2, 0), np.int64)]  # a part may be empty
    for at in range(0, len(ia), 64):
        cut_ = slice(at, at + 64)
        ok = ha[cut_, None] | hb[None, :]
        for k, (s, most) in enumerate(zip(spans(len(rot), width)[: block + 1], budgets(len(rot), width, least))):
            p, q = ra[cut_, s], rb[:, s]
            near = (p * p).sum(1)[:, None] + (q * q).sum(1)[None, :] - 2 * p @ q.T <= most
            ok &= near if k == block else ~near
        if same:
            ok &= ia[cut_, None] < ib[None, :]
        i, j = np.nonzero(ok)
        true = np.einsum("ij,ij->i", xa[i + at], xb[j]) >= least
        hits.append(np.stack([i[true] + at, j[true]]))
    return np.concatenate(hits, 1)


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable, over edges (i, j) of 0..n-1."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def dealt(sent: DataFrame, sizes: DataFrame, cell_rows: int) -> DataFrame:
    """Rows (cell, node, ...) of the cells in ``sizes`` (cell, rows), once for each group (bin, low, high) they belong to.

    Whole cells share bins of some 2 * ``cell_rows`` rows; two parts of a split cell are a group of their own, so
    a group stays near that size whatever the size of the cell.
    """
    parts = F.ceil(F.col("rows") / cell_rows).cast("int")
    whole = sizes.where(parts == 1).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    sent = sent.join(sizes.select("cell", parts.alias("parts")), "cell").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    sent = sent.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    sent = sent.withColumn("low", F.least("mine", "other")).withColumn("high", F.greatest("mine", "other")).drop("other")
    bins = F.pmod(F.xxhash64("cell"), F.lit(max(1, whole // (2 * cell_rows))))
    return sent.withColumn("bin", F.when(F.col("parts") == 1, bins).otherwise(F.col("cell"))).drop("parts")


def _parts(t: pa.Table, key: list[str]):
    """(rows of one part, rows of the other, row) of each cell in a group of :func:`dealt`; ``row`` is one of its rows."""
    groups: dict = {}
    for i, k in enumerate(zip(*(t.column(c).to_pylist() for c in (*key, "low", "high")))):
        groups.setdefault(k, []).append(i)
    mine = t.column("mine").to_numpy()
    for k, at in groups.items():
        at = np.array(at)
        low, high = at[mine[at] == k[-2]], at[mine[at] == k[-1]]
        if len(at) > 1 and len(low) and len(high):
            yield low, high, at[0]


def near_duplicates(vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", width: int = 8, dims: int = 3, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``(id, n_links, component)`` of every row; component is the smallest id reachable.

    Only equal labels compare, and equal lengths; rows with a null id or label, a null or zero vector, or a
    component that is null or not finite have no link and are their own component. Equal vectors are
    one node that counts as many as it stands for; repeated ids are vectors of their own. ``width``, ``dims``
    and ``cell_rows`` change the cost, never the result: a cell of more than ``cell_rows`` rows is split by a
    hash, and every two of its parts meet in a group of their own.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    v = F.col(vector_col).cast("array<double>")
    fine = F.size(v) > 0
    fine &= ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0) & F.col(label_col).isNotNull()
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), v.alias("v"), F.coalesce(fine, F.lit(False)).alias("fine"))
    nodes = rows.where("fine and id is not null").groupBy("label", "v").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")

    def spread(batches):
        for b in batches:
            size = np.array(b.column("v").value_lengths())
            for dim in np.unique(size):
                part = b.take(pa.array(np.flatnonzero(size == dim)))
                r = _unit([np.array(x, "<f8").tobytes() for x in part.column("v").to_pylist()]) @ rotation(int(dim))
                seeds = np.array([hash_label(f"{x}/{dim}") for x in part.column("label").to_pylist()], np.uint64)
                node = part.column("node").to_numpy()
                for k, (s, most) in enumerate(zip(spans(int(dim), width), budgets(int(dim), width, least))):
                    own = np.ascontiguousarray(r[:, s], "<f4")
                    for hit, cell, home in _probes(r[:, s], min(dims, s.stop - s.start), math.sqrt(most)):
                        keys = _hash(np.column_stack([seeds[hit].view(np.int64), np.full(len(hit), k), cell]), 17)
                        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(hit), k, np.int32)), pa.array(np.full(len(hit), home)), pa.array(node[hit]), pa.array(np.full(len(hit), dim, np.int32)), pa.array([own[i].tobytes() for i in hit], pa.binary())], ["cell", "block", "home", "node", "dim", "part"])

    def mark(t: pa.Table) -> pa.Table:
        """Rows with another one within the block's budget, single precision aside; one home row at least in each two."""
        home, part, hit = t.column("home").to_numpy(zero_copy_only=False), t.column("part").to_pylist(), np.zeros(len(t), bool)
        for a, b, one in _parts(t, ["cell", "block", "dim"]):
            most = budgets(t.column("dim")[int(one)].as_py(), width, least)[t.column("block")[int(one)].as_py()] + 1e-5
            xa, xb = (np.frombuffer(b"".join([part[i] for i in x]), "<f4").reshape(len(x), -1) for x in (a, b))
            for k in range(0, len(a), 256):
                rows = slice(k, k + 256)
                near = (xa[rows] ** 2).sum(1)[:, None] + (xb**2).sum(1)[None, :] - 2 * xa[rows] @ xb.T <= most
                near &= (home[a[rows], None] | home[None, b]) & (a[rows, None] != b[None, :])
                hit[a[rows]] |= near.any(1)
                hit[b] |= near.any(0)
        return t.select(["cell", "block", "home", "node"]).filter(pa.array(hit))

    met = lambda df: cut(df.groupBy("cell").agg(F.count("*").alias("rows"), F.max("home").alias("any_home")).where("rows > 1 and any_home"), "cell-sizes")
    sent = cut(nodes.select("label", "v", "node").mapInArrow(spread, "cell long, block int, home boolean, node long, dim int, part binary"), "cells")
    near = dealt(sent, met(sent), cell_rows).groupBy("bin", "low", "high").applyInArrow(mark, "cell long, block int, home boolean, node long")
    near = cut(near.distinct(), "near-cells")
    whole = dealt(near.join(nodes.select("node", "label", "v", "copies", F.size("v").alias("dim")), "node"), met(near), cell_rows)

    def join(t: pa.Table) -> pa.Table:
        node, copies, home = (t.column(c).to_numpy(zero_copy_only=False) for c in ("node", "copies", "home"))
        lists = t.column("v").combine_chunks()
        start, values, out = lists.offsets.to_numpy(), lists.values.to_numpy(), []
        for a, b, one in _parts(t, ["cell", "label", "block", "dim"]):
            same = t.column("low")[int(one)].as_py() == t.column("high")[int(one)].as_py()
            at = a if same else np.concatenate([a, b])
            dim = t.column("dim")[int(one)].as_py()
            x = np.stack([values[start[i] : start[i] + dim] for i in at])
            x /= np.sqrt((x * x).sum(1, keepdims=True))
            p, q = (np.arange(len(a)), np.arange(len(at) - len(b), len(at)))
            i, j = _meet((node[at[p]], x[p], home[at[p]]), (node[at[q]], x[q], home[at[q]]), same, t.column("block")[int(one)].as_py(), width, least, rotation_of(dim))
            if len(i):
                i, j = p[i], q[j]
                n = np.bincount(i, copies[at[j]], len(at)) + np.bincount(j, copies[at[i]], len(at))
                order = np.argsort(node[at])
                place = np.argsort(order)
                root = node[at][order[_roots(len(at), place[i], place[j])[place]]]
                keep = n > 0
                out.append((node[at][keep], n[keep].astype(np.int64), root[keep]))
        cols = [np.concatenate([o[k] for o in out]) if out else np.array([], np.int64) for k in range(3)]
        return pa.table({"node": cols[0], "n": cols[1], "root": cols[2]})

    rotations: dict = {}

    def rotation_of(dim: int) -> np.ndarray:
        if dim not in rotations:
            rotations[dim] = rotation(dim)
        return rotations[dim]

    found = cut(whole.groupBy("bin", "low", "high").applyInArrow(join, "node long, n long, root long"), "links")
    linked = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), "vectors")
    stats = nodes.join(found.groupBy("node").agg(F.sum("n").alias("n")), "node", "left").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    stats = cut(stats.select("label", "v", "root", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "vector-classes")
    first = cut(stats.groupBy("root").agg(F.min("least").alias("component")), "first-of-classes")
    stats = stats.join(first, "root").select("label", "v", "n_links", "component")
    good = rows.where("fine and id is not null").join(stats, ["label", "v"]).select("id", "n_links", "component")
    return good.union(rows.where("not fine or id is null").select("id", F.lit(0).cast("long"), "id"))


def hash_label(label: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(label)
