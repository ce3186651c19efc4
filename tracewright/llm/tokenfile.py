"""Token-id files: a Zstandard frame for each document and a trailing seek table.

A file is a run of frames in the public seekable Zstandard format: each holds the ids of one document
as little-endian uint32. Two skippable frames end it: the document ids, then the seek table with the
compressed size, size and checksum (low half of XXH64) of every frame. A reader takes the table from
the end of the file and decompresses only the frames that it wants.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, new_path, small_batches

#: Fixed values of the seekable Zstandard format.
SKIPPABLE, SEEK_MAGIC, DOCS_MAGIC = 0x184D2A5E, 0x8F92EAB1, 0x184D2A50
_FOOTER = struct.Struct("<IBI")
#: Distinct chunks (about 200 bytes each) that a Python worker remembers; beyond that it starts anew.
REMEMBER = 800_000


#: The steps before the model, and the split pattern, of a tokenizers file whose plain words may go to the model at once.
_STEPS = (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"])
_REPLACE = {"Regex": "\\s+"}
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


class Encoder:
    """Ids of whole texts, as bytes of little-endian uint32.

    The pre-tokenizer of a word-level vocabulary never joins text across white space, so each distinct
    chunk is encoded once and remembered. Where the file's normalizer and pre-tokenizer are of the
    kind named in ``_STEPS``, Latin letters followed by plain marks are two pieces for the model,
    which spares such chunks the steps before it; all others take the full way. Texts with
    separators that only Python counts as white space are encoded whole.
    """

    _odd = re.compile("[\x1c-\x1f]")
    _plain = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!#$%&*+,./:;=?^_~|-]*)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.of, self.known = Tokenizer.from_file(path), {}
        self.of.encode_special_tokens = False
        kind = json.loads(self.of.to_str())
        before, split = (kind.get(k) or {} for k in ("normalizer", "pre_tokenizer"))
        before, split = before.get("normalizers") or [], split.get("pretokenizers") or []
        self.direct = ([x["type"] for x in before], [x["type"] for x in split]) == _STEPS and (before[1]["pattern"], before[1]["content"]) == (_REPLACE, " ") and split[0]["pattern"] == {"Regex": _SPLIT} and not split[1]["add_prefix_space"]
        self.model = self.of.model
        #: Bytes above 126 of UTF-8, as the byte-level alphabet spells the letters that ``_plain`` has.
        spelled = {}
        if self.direct:
            for c in map(chr, range(0xC0, 0x100)):
                spelled[ord(c)] = self.of.pre_tokenizer.pre_tokenize_str(c)[0][0] if c.isalpha() else c
        self.spelled = spelled

    def _full(self, text: str) -> bytes:
        return np.array(self.of.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, chunk: str) -> bytes:
        m = self._plain.fullmatch(chunk) if self.direct else None
        if m:
            pieces = self.model.tokenize(m[1].lower().translate(self.spelled))
            if m[2]:
                pieces += self.model.tokenize(m[2])
            got = struct.pack(f"<{len(pieces)}I", *(t.id for t in pieces))
        else:
            got = self._full(chunk)
        self.known[chunk] = got
        return got

    def encode(self, text: str) -> bytes:
        if self._odd.search(text):
            return self._full(text)
        if len(self.known) > REMEMBER:
            self.known.clear()
        get, learn = self.known.get, self._learn
        chunks = text.split()
        out = [get(c) for c in chunks]
        if None in out:
            out = [learn(c) if x is None else x for c, x in zip(chunks, out)]
        return b"".join(out)


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """The encoder of a Python worker, which outlives the task."""
    return Encoder(path)


def _skippable(magic: int, body: bytes) -> bytes:
    return struct.pack("<II", magic, len(body)) + body


def seek_table(sizes: list[tuple[int, int, int]]) -> bytes:
    body = np.array(sizes, "<u4").reshape(-1, 3).tobytes() + _FOOTER.pack(len(sizes), 0x80, SEEK_MAGIC)
    return _skippable(SKIPPABLE, body)


def _filesystem(path: str):
    return pa.fs.FileSystem.from_uri(path)


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None, level: int = 3) -> DataFrame:
    """Write every document in ascending id order; returns the manifest ``(part, path, n_docs, n_tokens)``, one row a file.

    Rows go to files by range of id (null ids first, equal ids by text), one file a partition, each
    streamed, so a task holds one document and the table. A file has its attempt's name; only the
    files of the manifest count, what failed attempts left isn't read. An empty table gives no files;
    a null text has the end id only. ``tokenizer``: path of a tokenizers file on the executors.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(parts or int(spark.conf.get("spark.sql.shuffle.partitions")), "id").sortWithinPartitions("id", "text")

    def each(batches):
        task = TaskContext.get()
        part, encode, zip_one = task.partitionId(), encoder(tokenizer).encode, zstandard.ZstdCompressor(level=level, write_checksum=True).compress
        end, ids, sizes = struct.pack("<I", end_id), [], []
        fs, top = _filesystem(folder)
        fs.create_dir(top)
        path, out, total = f"{top}/part-{part:06d}-{task.taskAttemptId()}.tok.zst", None, 0
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out = out or fs.open_output_stream(path, compression=None)
                raw = encode(text) + end
                out.write(frame := zip_one(raw))
                ids.append(i)
                sizes.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
                total += len(raw) // 4
        if out:
            nulls = np.array([i is None for i in ids])
            out.write(_skippable(DOCS_MAGIC, zip_one(np.array([i or 0 for i in ids], "<i8").tobytes() + np.packbits(nulls).tobytes())))
            out.write(seek_table(sizes))
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [path], "n_docs": [len(ids)], "n_tokens": [total]})

    return cut(rows.mapInArrow(each, "part long, path string, n_docs long, n_tokens long"), "token-manifest")


class Reader:
    """One file: the tables from its end, and single documents."""

    def __init__(self, fs, path: str):
        self.file = fs.open_input_file(path)
        size = self.file.size()
        n, flags, magic = _FOOTER.unpack(self.file.read_at(9, size - 9))
        if magic != SEEK_MAGIC or not flags & 0x80:
            raise ValueError(f"{path}: no seek table")
        self.sizes = np.frombuffer(self.file.read_at(12 * n, size - 9 - 12 * n), "<u4").reshape(-1, 3).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes[:, 0])])
        head = int(self.starts[-1])
        magic, length = struct.unpack("<II", self.file.read_at(8, head))
        if magic != DOCS_MAGIC or head + 8 + length + 8 + 12 * n + 9 != size:
            raise ValueError(f"{path}: damaged")
        self.unzip = zstandard.ZstdDecompressor().decompress
        body = self.unzip(self.file.read_at(length, head + 8))
        nulls = np.unpackbits(np.frombuffer(body[8 * n :], np.uint8), count=n)
        self.ids = [None if gone else int(i) for i, gone in zip(np.frombuffer(body[: 8 * n], "<i8"), nulls)]

    def check(self, k: int, frame: bytes) -> bytes:
        raw = self.unzip(frame)
        if len(raw) != self.sizes[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sizes[k, 2]:
            raise ValueError(f"frame {k}: checksum")
        return raw

    def document(self, k: int) -> bytes:
        return self.check(k, self.file.read_at(int(self.sizes[k, 0]), int(self.starts[k])))

    def documents(self, step: int = 1 << 22):
        """All documents in order, read in runs of about ``step`` bytes."""
        k = 0
        while k < len(self.ids):
            last = max(k + 1, int(np.searchsorted(self.starts, self.starts[k] + step, "right")) - 1)
            run = self.file.read_at(int(self.starts[last] - self.starts[k]), int(self.starts[k]))
            for i in range(k, last):
                at = int(self.starts[i] - self.starts[k])
                yield self.ids[i], self.check(i, run[at : at + int(self.sizes[i, 0])])
            k = last


def read(manifest: DataFrame, folder: str, wanted: set[int] | None = None, with_ids: bool = True) -> DataFrame:
    """``(id, start, n_tokens, ids_crc32[, tokens])`` of every document, or of the ``wanted`` ids only.

    ``start`` counts the tokens of all documents before it; the totals of earlier files come from the manifest, whose
    rows, one a file, are added up in one task.
    """
    from pyspark.sql import Window

    files = manifest.select("path", (F.sum("n_tokens").over(Window.orderBy("part")) - F.col("n_tokens")).alias("base"))
    spark = manifest.sparkSession
    files = files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")

    def each(batches):
        fs, _ = _filesystem(folder)
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                file, out = Reader(fs, path), []
                if wanted is None:
                    found = file.documents()
                else:
                    found = ((i, file.document(k)) for k, i in enumerate(file.ids) if i in wanted)
                    skipped = base + np.concatenate([[0], np.cumsum(file.sizes[:, 1] // 4)])
                    starts = iter([int(skipped[k]) for k, i in enumerate(file.ids) if i in wanted])
                for i, raw in found:
                    start = base if wanted is None else next(starts)
                    out.append((i, start, len(raw) // 4, zlib.crc32(raw)) + ((np.frombuffer(raw, "<u4").tolist(),) if with_ids else ()))
                    base += len(raw) // 4
                    if len(out) >= (64 if with_ids else 4096):
                        yield _rows(out)
                        out = []
                if out:
                    yield _rows(out)

    def _rows(out):
        names = ["id", "start", "n_tokens", "ids_crc32", "tokens"][: len(out[0])]
        types = [pa.int64()] * 4 + [pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return files.mapInArrow(each, "id long, start long, n_tokens long, ids_crc32 long" + ", tokens array<long>" * with_ids)


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str, **more) -> DataFrame:
    """Write ``docs`` to a new shared folder and read every document back, without the ids themselves."""
    folder = new_path(spark, "tokens")
    return read(write(docs, folder, tokenizer, **more), folder, with_ids=False)
