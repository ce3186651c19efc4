"""WARC archives: segmented records out, reassembled payloads in.

Writing: one record for each page, HTTP head and payload in chunked transfer framing. A block longer
than ``segment_bytes`` becomes a first record and ``continuation`` records that name it as
``WARC-Segment-Origin-ID`` and count ``WARC-Segment-Number`` from 1; the last one states
``WARC-Segment-Total-Length``. A payload met before is a ``revisit`` record without payload that
names the response in ``WARC-Refers-To``.

Reading: every record of every archive becomes a row; rows are grouped by origin identifier,
ordered by segment number, joined and checked against the total length; then the chunked framing is
decoded. Both sides are one pass and shuffles; no task holds more than one archive member or one
page at a time besides the rows of a batch.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, new_path, small_batches

CRLF = b"\r\n"
#: Payloads below this are always written in full.
LEAST_BYTES = 100
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL name space of RFC 4122
_DATE = "2024-01-01T00:00:00Z"


def plan(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST_BYTES) -> DataFrame:
    """``(id, url, payload, digest, refers_to, named)``: of equal payloads of ``least`` bytes or more the smallest id is the response.

    Null payloads are empty, null urls are empty. Rows without an id are responses. Rows with an equal id and
    payload can't be told apart, and all of them get the same kind. ``named``: there is exactly one response.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    first = rows.where((F.length("payload") >= least) & F.col("id").isNotNull()).groupBy("digest", "id").agg(F.count("*").alias("n"))
    first = first.groupBy("digest").agg(F.min(F.struct("id", "n")).alias("x"), F.count("*").alias("ids")).where("ids > 1")
    first = cut(first.select("digest", F.col("x.id").alias("first"), (F.col("x.n") == 1).alias("named")), "first-payloads")  # so that a frequent payload's rows can be split in the join
    refers = F.when(F.col("first") != F.col("id"), F.col("first")).alias("refers_to")
    return rows.join(first, "digest", "left").select("id", "url", "payload", "digest", refers, (F.col("id").isNotNull() & F.coalesce("named", F.lit(False))).alias("named"))


def _identifier(*of) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, '|'.join(map(str, of)))}>"


def _record(kind: str, rid: str, block: bytes, more: dict) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": rid, "WARC-Date": _DATE, **more, "Content-Length": len(block)}
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + CRLF + block + CRLF + CRLF


def chunked(payload: bytes, size: int) -> bytes:
    out = [b"%x\r\n%b\r\n" % (len(c := payload[i : i + size]), c) for i in range(0, len(payload), size)]
    return b"".join(out) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """Decode chunked transfer framing; chunk extensions and trailers are dropped; damage raises ``ValueError``."""
    out, at = [], 0
    while True:
        end = body.index(CRLF, at)
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if n == 0:
            return b"".join(out)
        if body[at + n : at + n + 2] != CRLF:
            raise ValueError("chunk length")
        out.append(body[at : at + n])
        at += n + 2


def _uri(url: str) -> str:
    """A URL as a header may have it: white space and control characters are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f\x85\u2028\u2029]", lambda m: "".join(f"%{x:02X}" for x in m.group().encode()), url)


def records(row: dict, segment_bytes: int, chunk_bytes: int):
    """The WARC records of one planned row, in order."""
    response = _identifier("payload", row["digest"])  # of a payload with one response, for those that refer to it
    rid = response if row["named"] and row["refers_to"] is None else _identifier("page", row["id"], row["salt"])
    uri = {"WARC-Target-URI": _uri(row["url"])}
    digest = {"WARC-Payload-Digest": f"sha256:{row['digest']}", "Content-Type": "application/http; msgtype=response", "X-Page-ID": "" if row["id"] is None else row["id"], "X-Payload-Length": len(row["payload"])}
    if row["refers_to"] is not None:
        more = {"WARC-Profile": "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", "X-Refers-To-Page-ID": row["refers_to"]}
        if row["named"]:
            more["WARC-Refers-To"] = response
        yield _record("revisit", rid, b"HTTP/1.1 200 OK\r\n\r\n", uri | digest | more)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(row["payload"], chunk_bytes)
    pieces = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    last = {"WARC-Segment-Total-Length": len(block)}
    for k, piece in enumerate(pieces, 1):
        more = {"WARC-Segment-Number": k} if len(pieces) > 1 else {}
        if k == 1:
            yield _record("response", rid, piece, uri | digest | more)
        else:
            yield _record("continuation", _identifier("segment", rid, k), piece, uri | more | {"WARC-Segment-Origin-ID": rid} | (last if k == len(pieces) else {}))


def write(planned: DataFrame, folder: str, segment_bytes: int = 1 << 16, chunk_bytes: int = 1 << 13, level: int = 4) -> DataFrame:
    """Archives of ``planned`` rows, a gzip member for each record; returns ``(path, n_records)``.

    One archive a partition and attempt of its task; only those of the manifest count, what failed attempts left isn't read.
    """
    small_batches(planned.sparkSession)

    def each(batches):
        task = TaskContext.get()
        fs, top = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(top)
        path, out, n = f"{top}/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz", None, 0
        for b in batches:
            for row in b.to_pylist():
                out = out or fs.open_output_stream(path, compression=None)
                row["salt"] = f"{task.partitionId()}-{n}"
                for r in records(row, segment_bytes, chunk_bytes):
                    out.write(gzip.compress(r, level, mtime=0))
                    n += 1
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [n]})

    return cut(planned.mapInArrow(each, "path string, n_records long"), "warc-manifest")


def parse(stream) -> dict:
    """(headers, block) of every record of an uncompressed WARC byte stream."""
    while line := stream.readline():
        if line == CRLF:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        head = {}
        while (line := stream.readline()) not in (CRLF, b""):
            k, _, v = line.decode("utf-8", "replace").partition(":")
            head[k.strip().lower()] = v.strip()
        n = int(head["content-length"])
        block = stream.read(n)
        if len(block) != n:
            raise ValueError("truncated record")
        yield head, block


class _Members(io.RawIOBase):
    """A run of gzip members as one byte stream, read in pieces."""

    def __init__(self, source, step: int = 1 << 20):
        self.source, self.step, self.unzip, self.rest = source, step, zlib.decompressobj(31), b""

    def readable(self):
        return True

    def readinto(self, into):
        while True:
            data = self.rest or self.source.read(self.step)
            if not data:
                return 0
            out = self.unzip.decompress(data, len(into))
            self.rest = self.unzip.unconsumed_tail
            if self.unzip.eof:
                self.rest, self.unzip = self.unzip.unused_data, zlib.decompressobj(31)
            if out:
                into[: len(out)] = out
                return len(out)


_ROWS = "origin string, segment int, total long, kind string, page_id long, digest string, payload_length long, refers_to long, block binary"


def read_records(manifest: DataFrame, folder: str) -> DataFrame:
    """A row for each record; ``folder`` names the file system, the manifest the paths."""
    spark = manifest.sparkSession
    files = manifest.select("path").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    schema = pa.schema([("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("kind", pa.string()), ("page_id", pa.int64()), ("digest", pa.string()), ("payload_length", pa.int64()), ("refers_to", pa.int64()), ("block", pa.binary())])
    number = lambda s: int(s) if s else None

    def each(batches):
        fs, _ = pa.fs.FileSystem.from_uri(folder)
        for b in batches:
            for path in b.column(0).to_pylist():
                out, held = [], 0
                with fs.open_input_stream(path, compression=None) as raw:
                    for h, block in parse(io.BufferedReader(_Members(raw), 1 << 18)):
                        digest = h.get("warc-payload-digest", "")
                        out.append({"origin": h.get("warc-segment-origin-id", h["warc-record-id"]), "segment": int(h.get("warc-segment-number", 1)), "total": number(h.get("warc-segment-total-length")), "kind": h["warc-type"], "page_id": number(h.get("x-page-id")), "digest": digest.removeprefix("sha256:") or None, "payload_length": number(h.get("x-payload-length")), "refers_to": number(h.get("x-refers-to-page-id")), "block": block})
                        held += len(block)
                        if held > 1 << 23 or len(out) >= 4096:
                            yield pa.RecordBatch.from_pylist(out, schema)
                            out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)

    return files.mapInArrow(each, _ROWS)


def reassemble(rows: DataFrame) -> DataFrame:
    """Records to whole ones: ``(origin, kind, page_id, digest, payload_length, refers_to, blocks, whole)``.

    ``whole``: the segment numbers run from 1 without a gap and the lengths add up to the stated
    total, which only the last of several segments states. Segments of no first record keep a row
    with a null kind, not whole. ``blocks`` are in order; whoever reads them joins them.
    """
    first = lambda c: F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c)
    got = rows.groupBy("origin").agg(
        *(F.max(F.when(F.col("kind") != "continuation", F.col(c))).alias(c) for c in ("kind",)),
        *(first(c) for c in ("page_id", "digest", "payload_length", "refers_to")),
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("s"), F.max("total").alias("total"),
    )
    n, lengths = F.size("s"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.length(x["block"]))
    numbers = F.transform("s", lambda x: x["segment"]) == F.sequence(F.lit(1), n)
    whole = F.col("kind").isNotNull() & numbers & F.when(n > 1, F.coalesce(F.col("total") == lengths, F.lit(False))).otherwise(F.coalesce(F.col("total") == lengths, F.lit(True)))
    return got.select("origin", "kind", "page_id", "digest", "payload_length", "refers_to", F.col("s.block").alias("blocks"), whole.alias("whole"))


def payload(block: bytes) -> bytes:
    """The payload of an HTTP block, transfer framing decoded."""
    head, _, body = block.partition(b"\r\n\r\n")
    if any(x.lower().replace(b" ", b"") == b"transfer-encoding:chunked" for x in head.split(CRLF)):
        return unchunked(body)
    return body


def read_pages(manifest: DataFrame, folder: str) -> DataFrame:
    """``(page_id, kind, payload, payload_bytes, digest, refers_to)`` of every record, payloads checked.

    A response whose segments or digest don't hold raises, since its content can't be trusted. Size and digest
    of a response come from its decoded payload, those of a revisit from its header.
    """
    whole = reassemble(read_records(manifest, folder))
    schema = pa.schema([("page_id", pa.int64()), ("kind", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("digest", pa.string()), ("refers_to", pa.int64())])

    def each(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                if not r["whole"]:
                    raise ValueError(f"{r['origin']}: segments are missing")
                if r["kind"] == "revisit":
                    out.append({"payload": None, "payload_bytes": r["payload_length"], **{k: r[k] for k in ("page_id", "kind", "digest", "refers_to")}})
                    continue
                body = payload(b"".join(r["blocks"]))
                if (digest := hashlib.sha256(body).hexdigest()) != r["digest"]:
                    raise ValueError(f"{r['origin']}: digest")
                out.append({"page_id": r["page_id"], "kind": r["kind"], "payload": body, "payload_bytes": len(body), "digest": digest, "refers_to": None})
            yield pa.RecordBatch.from_pylist(out, schema)

    return whole.mapInArrow(each, "page_id long, kind string, payload binary, payload_bytes long, digest string, refers_to long")


def round_trip(spark: SparkSession, pages: DataFrame, **more) -> DataFrame:
    folder = new_path(spark, "warc")
    return read_pages(write(plan(pages), folder, **more), folder)
