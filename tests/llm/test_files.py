"""Token files, WARC archives, packing: round trips and rules."""

import os
import zlib

import numpy as np
import pyarrow.fs
import pytest

from helpers import SMALL
from tracewright.llm import packing, queries, tokenfile, warc


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_tokens_equal_whole_encoding(spark, tokenizer):
    from tokenizers import Tokenizer

    of, at, want = Tokenizer.from_file(tokenizer), 0, {}
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect():
        ids = [*of.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        want[r["doc_id"]] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert {r[0]: tuple(r)[1:] for r in queries.op4_tokens(spark, SMALL).collect()} == want


def test_encoder_on_random_text(tokenizer):
    import random

    e, rng = tokenfile.Encoder(tokenizer), random.Random(1)
    assert e.direct
    for _ in range(4000):
        x = "".join(rng.choice("abXYZéÉßÿÑ.,!?%'’01½ªº@_-~ \n\x1ć<|end>") for _ in range(rng.randint(0, 16)))
        assert e.encode(x) == np.array(e.of.encode(x, add_special_tokens=False).ids, "<u4").tobytes(), repr(x)


def test_wanted_documents_only_and_damage(spark, tokenizer, tmp_path):
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(40)] + [(None, "no id")], "doc_id long, text string")
    folder = f"file://{tmp_path}/tok"
    manifest = tokenfile.write(docs, folder, tokenizer, parts=3)
    whole = {r["id"]: (r["start"], r["tokens"]) for r in tokenfile.read(manifest, folder).collect()}
    some = {r["id"]: (r["start"], r["tokens"]) for r in tokenfile.read(manifest, folder, wanted={3, 39}).collect()}
    assert len(whole) == 41 and some == {k: whole[k] for k in (3, 39)} and whole[3][1][-1] == 2
    path = manifest.first()["path"]
    with open(path, "r+b") as f:
        f.seek(9)
        f.write(b"\xff\xff\xff")
    with pytest.raises(Exception):
        list(tokenfile.Reader(pyarrow.fs.LocalFileSystem(), path).documents())


def test_warc_records_are_standard(spark, tmp_path):
    big = "<p>" + "é" * 40_000
    pages = spark.createDataFrame([(3, "http://a/", big), (1, "http://b/", big), (2, None, None), (4, "http://c/", "small")], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/warc"
    manifest = warc.write(warc.plan(pages), folder, segment_bytes=1000, chunk_bytes=300)
    rows = warc.read_records(manifest, folder).collect()
    assert {r["kind"] for r in rows} == {"response", "revisit", "continuation"}
    got = {r["page_id"]: r for r in warc.read_pages(manifest, folder).collect()}
    assert bytes(got[1]["payload"]).decode() == big and got[3]["refers_to"] == 1 and got[3]["payload_bytes"] == len(big.encode())
    assert got[2]["payload_bytes"] == 0 and got[4]["kind"] == "response"
    assert not [f for f in os.listdir(f"{tmp_path}/warc") if f.startswith("_")]


def plain_records(data: bytes):
    """Records by the letter of the format, with the standard library alone."""
    import email.parser
    import email.policy

    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        version, _, lines = head.partition(b"\r\n")
        assert version == b"WARC/1.0"
        fields = email.parser.BytesParser(policy=email.policy.HTTP).parsebytes(lines)
        n = int(fields["Content-Length"])
        assert rest[n : n + 4] == b"\r\n\r\n"
        yield fields, rest[:n]
        data = rest[n + 4 :]


def test_another_reader_reads_the_archives(spark, tmp_path):
    import glob
    import gzip
    import hashlib
    import http.client
    import io
    import re

    big = "<p>" + "é" * 4000
    rows = [(3, "http://a/x y\n\u2028z", big), (1, "http://b/", big), (None, "http://n/", big), (2, None, None), (4, "http://c/", "small"), (4, "http://c/", "small"), (6, "http://d/", big[:200]), (6, "http://e/", big[:200]), (8, "http://f/", big[:200])]
    folder = f"{tmp_path}/warc"
    manifest = warc.write(warc.plan(spark.createDataFrame(rows, "page_id long, url string, html string")), f"file://{folder}", segment_bytes=1000, chunk_bytes=300)
    files = sorted(glob.glob(f"{folder}/*"))
    assert files == sorted(r["path"] for r in manifest.collect())
    records = [r for f in files for r in plain_records(gzip.decompress(open(f, "rb").read()))]
    ids = [h["WARC-Record-ID"] for h, _ in records]
    assert len(set(ids)) == len(ids) and all(re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", i) for i in ids)
    for h, _ in records:
        assert {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length", "WARC-Target-URI"} <= set(h.keys())
        assert (h["Content-Type"] is None) == (h["WARC-Type"] == "continuation")
    whole = {i: [h, b] for i, (h, b) in zip(ids, records) if h["WARC-Type"] != "continuation"}
    more = [(h["WARC-Segment-Origin-ID"], int(h["WARC-Segment-Number"]), h, b) for h, b in records if h["WARC-Type"] == "continuation"]
    for origin, n, h, b in sorted(more, key=lambda x: x[:2]):
        whole[origin][1] += b
        if h["WARC-Segment-Total-Length"]:
            assert int(h["WARC-Segment-Total-Length"]) == len(whole[origin][1])

    class Socket(io.BytesIO):
        def makefile(self, *_):
            return self

    got = []
    for h, block in whole.values():
        page = int(h["X-Page-ID"]) if h["X-Page-ID"] else None
        if h["WARC-Type"] == "revisit":
            of = h["WARC-Refers-To"] and whole[h["WARC-Refers-To"]][0]
            assert of is None or of["WARC-Payload-Digest"] == h["WARC-Payload-Digest"] and of["WARC-Type"] == "response"
            got.append((page, "revisit", None, of and int(of["X-Page-ID"])))
            continue
        answer = http.client.HTTPResponse(Socket(block))
        answer.begin()
        body = answer.read()
        assert "sha256:" + hashlib.sha256(body).hexdigest() == h["WARC-Payload-Digest"]
        got.append((page, "response", body.decode(), None))
    # rows 6 can't be told apart, so that row 8 has no single record to name
    want = [(3, "revisit", None, 1), (1, "response", big, None), (None, "response", big, None), (2, "response", "", None), (4, "response", "small", None), (4, "response", "small", None), (6, "response", big[:200], None), (6, "response", big[:200], None), (8, "revisit", None, None)]
    assert sorted(got, key=str) == sorted(want, key=str)
    back = {r["page_id"]: r["refers_to"] for r in warc.read_pages(manifest, f"file://{folder}").collect()}
    assert back == {3: 1, 1: None, None: None, 2: None, 4: None, 6: None, 8: 6}
    assert [h["WARC-Target-URI"] for h, _ in records if h["X-Page-ID"] == "3"] == ["http://a/x%20y%0A%E2%80%A8z"]


def test_missing_segments_are_found(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x" * 5000)], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/warc"
    rows = warc.read_records(warc.write(warc.plan(pages), folder, segment_bytes=1000), folder)
    assert [r["whole"] for r in warc.reassemble(rows).collect()] == [True]
    for gone in ("segment <> 3", "segment <> 1", "total IS NULL"):
        assert [r["whole"] for r in warc.reassemble(rows.where(gone)).collect()] == [False], gone


def test_chunked_framing():
    for n in (0, 1, 9, 10, 11, 100):
        assert warc.unchunked(warc.chunked(bytes(n), 10)) == bytes(n)
    assert warc.unchunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: z\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.unchunked(b"3\r\nabcd\r\n0\r\n\r\n")


def slow_best_fit(pieces, capacity):
    bins, placed = [], [None] * len(pieces)
    for i in sorted(range(len(pieces)), key=lambda i: (-pieces[i][0], i)):
        size, s, c = pieces[i]
        fits = [b for b in range(len(bins)) if capacity - bins[b][0] >= size and not (s is not None and s in bins[b][1]) and not (c is not None and c in bins[b][2])]
        b = min(fits, key=lambda b: (capacity - bins[b][0], b)) if fits else len(bins)
        if b == len(bins):
            bins.append([0, set(), set()])
        placed[i] = (b, bins[b][0])
        bins[b][0] += size
        bins[b][1].add(s)
        bins[b][2].add(c)
    return placed


def test_best_fit_equals_a_search_of_all_bins():
    import random

    rng = random.Random(7)
    for _ in range(40):
        pieces = [(rng.randint(0, 50), rng.choice([None, "a", "b", "c", "d"]), rng.choice([None, 1, 2, 3, 4, 5, 6])) for _ in range(rng.randint(0, 60))]
        assert packing.best_fit(pieces, 50) == slow_best_fit(pieces, 50)


def test_bins_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sized = {r["id"]: r for r in packing.sizes(docs).collect()}
    rows = queries.op2_packing(spark, "/root/testdata/sf0.01").collect()
    total, bins = {}, {}
    for r in rows:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["n_tokens"]
        bins.setdefault(r["bin_id"], []).append(r)
    assert total == {k: v["size"] for k, v in sized.items()}
    for own in bins.values():
        own.sort(key=lambda r: (r["offset"], r["n_tokens"]))
        assert all(a["offset"] + a["n_tokens"] == b["offset"] for a, b in zip(own, own[1:])) and own[-1]["offset"] + own[-1]["n_tokens"] <= 2048
        for column in ("source", "cluster"):
            marks = [x for r in own if (x := sized[r["doc_id"]][column]) is not None]
            assert len(marks) == len(set(marks))
