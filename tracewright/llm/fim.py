"""Fill-in-middle: a text cut at two of its unit boundaries, its middle moved behind the rest.

A text is an array of code points. Comparing the classes of neighbours gives the boundaries of its units, two
hashes of the id choose among them, and the pieces are slices of the array.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: In front of the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
#: A unit: codes of class 1, and between which classes (left, right) a boundary lies. ``line``: behind each line
#: feed; ``word``: in front of each word; ``char``: everywhere.
UNITS = {
    "line": ((10,), ((False, False), (True, True))),
    "word": ((32, *range(9, 14)), ((False, False), (True, False))),
    "char": ((), ((True, True), (True, True))),
}


def boundaries(codes: np.ndarray, unit: str = "line") -> np.ndarray:
    """Where units end, the beginning included: of n units n + 1 places; 0 alone for no codes."""
    if not len(codes):
        return np.zeros(1, np.int64)
    ones, between = UNITS[unit]
    kind = np.isin(codes, np.array(ones, codes.dtype)).astype(np.int8)
    inner = np.flatnonzero(np.array(between)[kind[:-1], kind[1:]]) + 1
    return np.concatenate([[0], inner, [len(codes)]])


def check_marks(marks: tuple[str, str, str]) -> None:
    """Marks must be told apart wherever pieces stand between them: no mark in another, no end of one that begins another."""
    for i, a in enumerate(marks):
        for j, b in enumerate(marks):
            if not a or (i != j and a in b) or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)) + (i != j))):
                raise ValueError(f"marks {a!r} and {b!r} can't be told apart")


def cut_text(text: str, key: str, rate: int, spm: int, unit: str, marks: tuple[str, str, str]) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix, of the middle, output) of one text; ``key`` is what is hashed."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    ends = boundaries(codes, unit)
    n = len(ends) - 1
    digest = hashlib.sha256(key.encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    if not text or any(m in text for m in marks) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = int(ends[a]), int(ends[b])
    prefix, middle, suffix = (x.tobytes().decode("utf-32-le") for x in (codes[:a], codes[a:b], codes[b:]))
    p, s, m = marks
    if h[3] % 100 < spm:
        return n, "spm", a, b - a, s + suffix + p + prefix + m + middle
    return n, "psm", a, b - a, p + prefix + s + suffix + m + middle


def transform(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, unit: str = "line", marks: tuple[str, str, str] = MARKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n, form, prefix_chars, middle_chars, output)`` of every row's whole text, where it is.

    ``rate`` and ``spm`` are percentages: of texts that are cut, and of these that have the suffix first. Null texts
    are empty ones; empty texts and texts with a mark stay plain, without numbers of characters. The cut depends on the seed and
    the id alone (null: no digits), so repeated rows are cut alike.
    """
    check_marks(marks)
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("key"))
    names = ("n", "form", "prefix_chars", "middle_chars", "output")
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())

    def each(batches):
        for b in batches:
            found = [cut_text(t or "", k, rate, spm, unit, marks) for t, k in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            columns = list(zip(*found)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, columns, kinds)], ["id", *names])

    return rows.mapInArrow(each, f"id {rows.schema['id'].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text of an output: its three pieces, found between the marks, in their first order."""
    part = F.split(output, "|".join(map(re.escape, marks)), -1)
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)
