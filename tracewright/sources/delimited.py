"""Delimited text with quoted line ends, read by many tasks at once, with dense row ids.

Spark's text source deals lines to tasks in blocks of a file. Whether a line begins inside a quoted field
depends on all before it, but a block's effect on that is a function of one bit: a first pass gives each
block's function and its number of records, their composition gives where every block stands, and a
second pass parses. Records that cross blocks are few; their pieces meet by record id.

Such functions compose, so beyond ``FEW_BLOCKS`` blocks they are sorted and composed on the cluster, in parts of the square root of
their number: the driver sees one function a part and file, and gives back the state at its beginning; the states of
the blocks are expressions over these. Lines get their block's state by a broadcast join; more than ``MOST_STATES`` blocks are refused, and larger ones asked for.

A quoted field that runs on for more than ``most_quoted`` bytes is none: at the next line end its quote becomes text, and
the line ends in it end records. Whether that happens in a block may depend on how far back the quote is; the few blocks
where it does are measured again, once that is known. Records without quotes or odd bytes are split in the plan, where Catalyst
leaves out the columns that nothing reads; only the others get their cells in Python.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.timeline import BYTES, RAW, ROW, WRITTEN, View, new_path

#: Delimiters by name, and the columns of a body file.
DELIMITERS = {"comma": ",", "tab": "\t", "pipe": "|", "semicolon": ";", "space": " ", "\\t": "\t"}
BODYFILE = ("MD5", "name", "inode", "mode", "UID", "GID", "size", "atime", "mtime", "ctime", "crtime")
BOM = b"\xef\xbb\xbf"
#: Fixed value: the bytes that a quoted field may run on for across line ends.
MOST_QUOTED = 1 << 20
#: Blocks whose functions the driver composes itself, and blocks whose states may be broadcast (some 200 bytes each; 512 TB in blocks of 128 MB).
FEW_BLOCKS, MOST_STATES = 1000, 4_000_000
#: Bytes of a line at which the guess of a delimiter looks.
HEAD_BYTES = 1 << 16
#: Windows-1252 as browsers read it: the five unused codes are control characters.
_CP1252 = {i: bytes([i]).decode("cp1252") for i in range(0x80, 0xA0) if i not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


class EmptyInput(ValueError):
    """The input has no bytes."""


@dataclass(frozen=True)
class Schema:
    """How a file is read. ``skip_lines`` counts records in front of the header."""

    delimiter: str = "comma"
    quote: str = '"'
    has_header: bool = True
    columns: tuple[str, ...] = field(default=())
    skip_lines: int = 0
    name: str | None = None

    def bytes(self) -> tuple[bytes, bytes]:
        d = DELIMITERS.get(self.delimiter.lower(), self.delimiter)[:1] or ","
        return d.encode()[:1], self.quote.encode() if len(self.quote.encode()) == 1 else b'"'


PRESETS = {"csv": Schema(name="csv"), "tsv": Schema("tab", name="tsv"), "psv": Schema("pipe", name="psv"), "bodyfile": Schema("pipe", has_header=False, columns=BODYFILE, name="bodyfile"), "evtxecmd": Schema(name="evtxecmd")}


def schema_of(text: str) -> Schema:
    """A schema from JSON (beginning with a brace) or YAML text; missing keys have their defaults."""
    if text.lstrip().startswith("{"):
        got = json.loads(text)
    else:
        import yaml

        got = yaml.safe_load(text) or {}
    if not isinstance(got, dict):
        raise ValueError("a schema is a mapping")
    known = {k: got[k] for k in ("delimiter", "quote", "has_header", "skip_lines", "name") if k in got}
    return Schema(**known, columns=tuple(map(str, got.get("columns") or ())))


def sniff(lines: list[bytes]) -> Schema:
    """The delimiter met most often in the first lines; of equals the later of comma, tab, pipe, semicolon."""
    best, most = ",", 0
    for d in ",\t|;":
        n = sum(x.count(d.encode()) for x in lines[:16])
        if n and n >= most:
            best, most = d, n
    return Schema(best)


def inside_after(line: bytes, inside: bool, delimiter: bytes, quote: bytes) -> tuple[bool, int]:
    """Whether a quoted field is open after a line, given whether one is before it; and where in the line it was opened, else -1."""
    at, opener, opened = 0, delimiter + quote, -1
    if quote not in line:
        return inside, -1
    while True:
        if inside:
            at = line.find(quote, at)
            if at < 0:
                return True, opened
            if line[at + 1 : at + 2] == quote:
                at += 2
            else:
                inside, at = False, at + 1
        elif at == 0 and line.startswith(quote):
            inside, opened, at = True, 0, 1
        else:
            at = line.find(opener, at)
            if at < 0:
                return False, -1
            inside, opened, at = True, at + 1, at + 2


@dataclass
class Marked:
    """The lines of a block: which of them begin a record, and what is open at its end.

    ``tail``: lines at the end, inside a field that is open there (and begin records if its quote turns out to be text);
    ``since``: bytes from its quote to the end. ``head``: what became of a field open at the beginning,
    "closed", "text" or "open"; ``reach``: the last line end in it, -1 if there is none.
    """

    begins: list[bool]
    tail: int
    inside: bool
    since: int
    head: str
    reach: int


def mark(lines: list[bytes], inside: bool, since: int, most: int, delimiter: bytes, quote: bytes, like: list[bool] | None = None) -> Marked:
    """Mark the lines of a block that begins ``since`` bytes behind the quote of an open field, if ``inside``.

    ``like``: which lines begin a record if the block doesn't begin inside a field. Where both readings
    are outside at a line's beginning, the rest is the same and the marks end there.
    """
    begins: list[bool] = []
    waiting: list[int] = []
    opened, at, head, reach = -since, 0, "open" if inside else "", -1
    for i, x in enumerate(lines):
        if inside:
            waiting.append(i)
        elif like and like[i] and head:
            break
        elif quote not in x:
            begins.append(True)
            at += len(x) + 1
            continue
        begins.append(not inside)
        still, where = inside_after(x, inside, delimiter, quote)
        end = at + len(x)
        if head == "open":
            if still and where < 0:
                reach = end
            else:
                head = "closed"
        if where >= 0:
            opened, waiting = at + where, []
        elif not still:
            waiting = []
        inside = still
        if inside and end - opened > most:
            for k in waiting:
                begins[k] = True
            head = "text" if head == "open" else head
            inside, waiting = False, []
        at = end + 1
    return Marked(begins, len(waiting), inside, at - opened if inside else 0, head, reach)


def numbers(lines: list[bytes], since: int, most: int, delimiter: bytes, quote: bytes) -> dict:
    """What a block does if it begins outside of a field, and if it begins inside of one, ``since`` bytes behind its quote."""
    outside = mark(lines, False, 0, most, delimiter, quote) if any(quote in x for x in lines) else Marked([True] * len(lines), 0, False, 0, "", 0)
    inside = mark(lines, True, since, most, delimiter, quote, outside.begins)
    same = len(inside.begins) < len(lines)  # from there on
    end = outside if same else inside
    out = {"n_out": sum(outside.begins), "tail_out": outside.tail, "open_out": outside.inside, "since_out": outside.since}
    out |= {"n_in": sum(inside.begins) + sum(outside.begins[len(inside.begins) :]), "tail_in": end.tail, "open_in": end.inside}
    return out | {"since_in": end.since - (since if inside.head == "open" else 0), "head": inside.head, "reach": inside.reach}


def split(record: bytes, delimiter: bytes, quote: bytes) -> list[bytes]:
    """Fields, quotes included. A quote opens a field at its start only; text after a closing quote is literal."""
    if quote not in record:
        return record.split(delimiter)
    out, at, end = [], 0, len(record)
    while True:
        stop = at
        if record[at : at + 1] == quote:
            stop = at + 1
            while (stop := record.find(quote, stop)) >= 0 and record[stop + 1 : stop + 2] == quote:
                stop += 2
            stop = end if stop < 0 else stop + 1
        stop = record.find(delimiter, stop)
        if stop < 0:
            return [*out, record[at:]]
        out.append(record[at:stop])
        at = stop + 1


def text(raw: bytes) -> str:
    """NULs dropped; UTF-8, or else by the byte order mark at the beginning, or else the whole as Windows-1252."""
    raw = raw.replace(b"\0", b"")
    try:
        return raw.decode()
    except UnicodeDecodeError:
        for mark_, form in ((BOM, "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
            if raw.startswith(mark_):
                return raw.removeprefix(mark_).decode(form, "replace")
        return raw.decode("latin-1").translate(_CP1252)


def cell(raw: bytes, quote: bytes) -> str:
    """A field as shown: one trailing carriage return and the outer quotes go, doubled quotes are one."""
    raw = raw[:-1] if raw.endswith(b"\r") else raw
    if len(raw) >= 2 and raw[:1] == quote == raw[-1:]:
        raw = raw[1:-1].replace(quote + quote, quote)
    return text(raw)


def written(raw: bytes, quote: bytes) -> str | None:
    """A field without its outer quotes, doubled quotes kept, if that isn't what is shown."""
    if len(raw) > 3 and raw[:1] == quote == raw[-1:] and quote + quote in raw[1:-1]:
        return text(raw[1:-1])
    return None


def inner(raw: bytes, quote: bytes) -> bytes:
    """A field's bytes without its outer quotes, doubled quotes kept: what a search in its column looks at."""
    return raw[1:-1] if len(raw) >= 2 and raw[:1] == quote == raw[-1:] else raw


def _blocks(batches):
    """Runs of (path, block, state, lines) of a task, in file order; the state is None if there is no such column."""
    at, state, lines = None, None, []
    for b in batches:
        for i, (path, start, line) in enumerate(zip(*(b.column(c).to_pylist() for c in ("path", "block", "line")))):
            if (path, start) != at:
                if at:
                    yield (*at, state, lines)
                at, lines = (path, start), []
                state = b.column("state")[i].as_py() if "state" in b.schema.names else None
            lines.append(line)
    if at:
        yield (*at, state, lines)


_KINDS = ("out", "in")
_NUMBERS = (*(f"{x}_{k}" for k in _KINDS for x in ("n", "tail", "open", "since")), "head", "reach")
_SUMMARY = "path string, block long, " + ", ".join(f"n_{k} long, tail_{k} long, open_{k} boolean, since_{k} long" for k in _KINDS) + ", head string, reach long"


def read(spark: SparkSession, path: str | list[str], schema: Schema | None = None, most_quoted: int = MOST_QUOTED) -> View:
    """A view of one file, or of several of the same form, one after another in the order of their paths.

    Blank records are rows with one empty cell, short records have null cells, surplus fields stay in the raw record. Without
    a schema the delimiter is guessed from lines of the beginning and a header assumed. No bytes at all: :class:`EmptyInput`.
    Duplicate names get a number. A task holds the lines of one block (``spark.sql.files.maxPartitionBytes``), the driver
    a row of numbers for each block up to ``FEW_BLOCKS``, beyond that for each file and part of the blocks.
    """
    source = spark.read.option("lineSep", "\n").text(path)
    files = sorted(source.inputFiles())
    lines = source.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))
    head = _head(spark, files)
    if not head:
        raise EmptyInput(str(path))
    schema = schema or sniff([head[0].removeprefix(BOM), *head[1:]])
    delimiter, quote = schema.bytes()
    skip = schema.skip_lines + schema.has_header

    def measured(known: dict) -> DataFrame:
        """A row of numbers for each block, or for those in ``known``, of which the state at the beginning is known."""

        def each(batches):
            for p, start, _, own in _blocks(batches):
                if start == 0:
                    own[0] = own[0].removeprefix(BOM)
                _, since = known.get((p, start), (False, 0))
                row = [p, start, *numbers(own, since, most_quoted, delimiter, quote).values()]
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names)

        names = ["path", "block", *_NUMBERS]
        some = lines
        if known:  # a filter on the path alone would leave out files, and Spark then cuts the others into other blocks
            paths, starts = (list({k[i] for k in known}) for i in (0, 1))
            opaque = lambda c: F.when(F.col("line").isNotNull(), F.col(c))
            some = lines.where(opaque("path").isin(paths) & opaque("block").isin(starts))
        return some.mapInArrow(each, _SUMMARY)

    states, first, crossed = _placed(spark, measured, skip, most_quoted)

    def pieces(batches, whole: bool):
        """(rows, block, records) of the whole records of each block, or of the pieces of records that cross blocks."""
        for _, start, state, own in _blocks(batches):
            if start == 0:
                own[0] = own[0].removeprefix(BOM)
            inside, since, row, least, is_text = (state[k] for k in _STATE)
            begins, goes_on = [True] * len(own), False
            if inside or any(quote in x for x in own):
                m = mark(own, inside, since, most_quoted, delimiter, quote)
                begins, goes_on = m.begins, m.inside and not is_text
                if is_text:
                    begins[len(own) - m.tail :] = [True] * m.tail
            at, rows, found = 0, [], []
            while at < len(own):
                end = at + 1
                while end < len(own) and not begins[end]:
                    end += 1
                row += begins[at]
                if row >= least and (not begins[at] or (goes_on and end == len(own))) != whole:
                    rows.append(row)
                    found.append(b"\n".join(own[at:end]).removesuffix(b"\r") if whole else b"\n".join(own[at:end]))
                at = end
                if len(rows) >= 4096:
                    yield rows, start, found
                    rows, found = [], []
            if rows:
                yield rows, start, found

    def records(make, form: str, states: DataFrame) -> DataFrame:
        """What ``make(rows, records)`` gives for all records; those that cross blocks are put together first."""
        placed = lines.join(F.broadcast(states), ["path", "block"]).select("path", "block", "line", "state")

        def crossing(batches):
            for rows, start, found in pieces(batches, False):
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array([start] * len(rows), pa.int64()), pa.array(found, pa.binary())], ["row", "block", "raw"])

        def together(batches):
            for b in batches:
                yield make(b.column(0).to_pylist(), [b"\n".join(x["raw"] for x in r).removesuffix(b"\r") for r in b.column(1).to_pylist()])

        df = placed.mapInArrow(lambda bs: (make(rows, found) for rows, _, found in pieces(bs, True)), form)
        if crossed:
            parts = placed.mapInArrow(crossing, "row long, block long, raw binary").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("block", "raw"))).alias("pieces"))
            df = df.union(parts.mapInArrow(together, form))
        return df

    def parsed(rows, found):
        """``cells`` is null where the plan splits ``raw``; ``written`` and ``bytes`` are null where searches need only what is shown."""
        cells, as_written, odd = ([None] * len(found) for _ in range(3))
        raw = _plain(found, delimiter, quote)
        if raw is None:
            raw = pa.array(map(text, found), pa.string())
            for i, x in enumerate(found):
                dirty = not _is_text(x)
                if not (dirty or quote in x or b"\r" in x) and delimiter.isascii():
                    continue
                fields = split(x, delimiter, quote)[:width]
                cells[i] = [cell(f, quote) for f in fields]
                if quote + quote in x:
                    as_written[i] = [(c, w) for c, f in zip(columns, fields) if (w := written(f, quote)) is not None] or None
                if dirty:
                    odd[i] = [("", x), *((c, inner(f, quote)) for c, f in zip(columns, fields) if not _is_text(f))]
        arrays = [pa.array(rows, pa.int64()), pa.array(cells, pa.list_(pa.string())), raw, pa.array(as_written, pa.map_(pa.string(), pa.string())), pa.array(odd, pa.map_(pa.string(), pa.binary()))]
        return pa.RecordBatch.from_arrays(arrays, ["row", "cells", "raw", "written", "bytes"])

    columns = list(schema.columns)
    if not columns:
        wanted = -1 if schema.has_header else 0  # the header stands before row 0 of the first file
        least = F.when(F.col("path") == first, F.lit(wanted)).otherwise(F.lit(1 << 62)).cast("long")
        top = states.withColumn("state", F.col("state").withField("least", least))
        pick = lambda rows, found: pa.RecordBatch.from_arrays([pa.array([x for i, x in zip(rows, found) if i == wanted], pa.binary())], ["raw"])
        record = records(pick, "raw binary", top).take(1)
        if not record:
            raise ValueError("no columns")
        columns = [cell(f, quote) if schema.has_header else "" for f in split(bytes(record[0][0]), delimiter, quote)]
    columns, width = _names(columns), len(columns)
    df = records(parsed, "row long, cells array<string>, raw string, written map<string,string>, bytes map<string,binary>", states)
    if delimiter.isascii():
        df = df.withColumn("cells", F.coalesce("cells", F.split("raw", re.escape(delimiter.decode()), -1)))
    cells = (F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(columns))
    return View(df.select(F.col("row").alias(ROW), *cells, F.col("raw").alias(RAW), F.col("written").alias(WRITTEN), F.col("bytes").alias(BYTES)), columns, schema=schema)


def _head(spark: SparkSession, files: list[str]) -> list[bytes]:
    """The first lines of the first file that has any: 16 at most, of each what the guess of a delimiter looks at."""
    for start in range(0, len(files), 64):  # empty files are few; lines are fetched one file at a time
        some = spark.read.option("lineSep", "\n").text(files[start : start + 64]).select(F.col("_metadata.file_path").alias("path"))
        filled = {r[0] for r in some.distinct().collect()} if len(files) > 1 else set(files)
        for file in sorted(filled):
            line = F.substring(F.col("value").cast("binary"), 1, HEAD_BYTES)
            first = spark.read.option("lineSep", "\n").text(file).where("_metadata.file_block_start < 65536").select("_metadata.file_block_start", F.monotonically_increasing_id(), line)
            lines = [bytes(x) for *_, x in first.orderBy("file_block_start", F.col("monotonically_increasing_id()")).limit(16).collect()]
            if lines:
                return lines
    return []


_STATE = ("inside", "since", "row", "least", "is_text")
_PLACED = "path string, block long, state struct<inside boolean, since long, row long, least long, is_text boolean>"


def _placed(spark: SparkSession, measured, skip: int, most: int) -> tuple[DataFrame, str, bool]:
    """The states of all blocks as a table; the first path; whether some block begins inside a field.

    A state: inside, since, number of the record before, first number that counts, whether the open tail is text.
    """
    path = new_path(spark, "blocks")
    measured({}).write.parquet(path)
    blocks = spark.read.schema(_SUMMARY).parquet(path)
    n_blocks = blocks.count()
    if n_blocks > MOST_STATES:
        raise ValueError(f"{n_blocks} blocks: raise spark.sql.files.maxPartitionBytes so that there are {MOST_STATES} at most")
    if n_blocks > FEW_BLOCKS:
        path = new_path(spark, "composed")
        parts = max(1, int(n_blocks**0.5))
        ordered = blocks.repartitionByRange(parts, "path", "block").sortWithinPartitions("path", "block")
        ordered.mapInArrow(lambda batches: _scanned(batches, most), _SCANNED).write.parquet(path)
        scanned = spark.read.schema(_SCANNED).parquet(path)
        found = {(r["path"], r["unit"]): r["whole"].asDict() | {"size": r["size"]} for r in scanned.where("whole is not null").select("path", "unit", "size", "whole").collect()}
    else:
        found = {(r["path"], r["block"]): r.asDict() | {"size": 1} for r in blocks.collect()}
    exact: dict = {}
    alone: set = set()
    states, unknown = _states(found, exact, most)
    while unknown:
        parted = [k for k in unknown if found[k]["size"] > 1]  # a long quote runs into composed blocks: these one by one
        for key in parted:
            own = scanned.where((F.col("path") == key[0]) & (F.col("unit") == key[1])).select("path", "block", "own.*").collect()
            del found[key]
            found |= {(r["path"], r["block"]): r.asDict() | {"size": 1} for r in own}
            alone |= {(r["path"], r["block"]) for r in own}
        again = {k: v for k, v in unknown.items() if k not in parted}
        for r in measured(again).collect() if again else ():
            if (key := (r["path"], r["block"])) in again:
                exact[*key, again[key][1]] = r.asDict()
        states, unknown = _states(found, exact, most)
    placed, base, at, n = [], 0, None, 0
    for (p, start), (inside, since, rows, tail, is_text) in states.items():
        if p != at:
            base, at, n = base + max(0, n - skip), p, 0
        placed.append((p, start, (inside, since, base - skip + n - 1, base, is_text)))
        n += rows + tail * is_text
    table = spark.createDataFrame(placed, _PLACED)
    crossed = any(x[2][0] for x in placed)
    if len(placed) == n_blocks:
        return table, placed[0][0], crossed
    whole = F.broadcast(table.select("path", F.col("block").alias("unit"), F.col("state").alias("u")))
    chosen = lambda x: F.when(F.col("u.inside"), F.col(f"before.{x}_in")).otherwise(F.col(f"before.{x}_out"))
    since = F.when(F.col("u.inside") & (F.col("before.head") == "open"), F.col("u.since")).otherwise(0) + chosen("since")
    waits = F.when(F.col("u.inside"), F.col("waits_in")).otherwise(F.col("waits_out"))
    # lines in front, in a field that goes on from there to the unit's end, begin records if that turns out to be text
    text_before = F.when(F.col("u.is_text") & waits & chosen("open") & (F.col("own.head") == "open"), chosen("tail")).otherwise(0)
    state = F.struct(chosen("open").alias("inside"), since.alias("since"), (F.col("u.row") + chosen("n") + text_before).alias("row"), F.col("u.least").alias("least"), (F.col("u.is_text") & waits).alias("is_text"))
    each = scanned.join(whole, ["path", "unit"]).select("path", "block", state.alias("state"))
    if alone:  # these have states of their own
        own = F.broadcast(spark.createDataFrame([x for x in placed if x[:2] in alone], _PLACED))
        each = each.join(own.select("path", "block"), ["path", "block"], "left_anti").union(own)
    path = new_path(spark, "states")
    each.write.parquet(path)
    out = spark.read.schema(_PLACED).parquet(path)
    return out, placed[0][0], crossed or bool(out.where("state.inside").take(1))


_ROW = "struct<" + ", ".join(x.replace(" ", ": ", 1) for x in _SUMMARY.split(", ")[2:]) + ">"
_SCANNED = f"path string, block long, unit long, size long, own {_ROW}, before {_ROW}, waits_out boolean, waits_in boolean, whole {_ROW}"
#: What no blocks do.
_NOTHING = {"n_out": 0, "tail_out": 0, "open_out": False, "since_out": 0, "n_in": 0, "tail_in": 0, "open_in": True, "since_in": 0, "head": "open", "reach": -1}


def compose(a: dict, b: dict, most: int) -> dict | None:
    """The numbers of two neighbouring runs of blocks as one; None if what ``b`` does must be measured from an exact place.

    Where ``reach`` comes out above ``most``, what the run does from within a field is never used: its blocks are measured one by one.
    """
    out = {}
    for kind in _KINDS:
        passed = kind == "in" and a["head"] == "open"  # still the field that was open at the beginning
        if not a[f"open_{kind}"]:
            out |= {f"n_{kind}": a[f"n_{kind}"] + b["n_out"]} | {f"{x}_{kind}": b[f"{x}_out"] for x in ("tail", "open", "since")}
            continue
        if (0 if passed else a[f"since_{kind}"]) + b["reach"] > most or b["head"] == "text":
            return None
        on = b["head"] == "open"
        out |= {f"n_{kind}": a[f"n_{kind}"] + b["n_in"], f"tail_{kind}": b["tail_in"] + on * a[f"tail_{kind}"]}
        out |= {f"open_{kind}": b["open_in"], f"since_{kind}": b["since_in"] + on * a[f"since_{kind}"]}
    still = a["head"] == "open" and a["open_in"]
    reach = a["since_in"] + b["reach"] if still and b["reach"] >= 0 else -1
    return out | {"head": b["head"] if still else a["head"], "reach": max(a["reach"], reach)}


def _scanned(batches, most: int):
    """Of the sorted blocks of a part: the run ("unit") of blocks of a file that each belongs to, what the blocks of it before do, and, with its last block, what all do.

    ``waits_*``: whether a field that is open at the block's end is the one that is open at the unit's end.
    """
    form = None
    unit: list = []

    def rows():
        waits = dict.fromkeys(_KINDS, True)
        whole = unit[-1][4]
        made = []
        for i in range(len(unit) - 1, -1, -1):
            p, start, own, before, _ = unit[i]
            made.append({"path": p, "block": start, "unit": unit[0][1], "size": len(unit), "own": own, "before": before, "waits_out": waits["out"], "waits_in": waits["in"], "whole": whole if i == len(unit) - 1 else None})
            for k in _KINDS:
                waits[k] = waits[k] and before[f"open_{k}"] and own["head"] == "open"
        return pa.RecordBatch.from_pylist(made[::-1], form)

    one = pa.struct([(k, pa.bool_() if k.startswith("open") else pa.string() if k == "head" else pa.int64()) for k in _NUMBERS])
    form = pa.schema([("path", pa.string()), ("block", pa.int64()), ("unit", pa.int64()), ("size", pa.int64()), ("own", one), ("before", one), ("waits_out", pa.bool_()), ("waits_in", pa.bool_()), ("whole", one)])
    for b in batches:
        for r in b.to_pylist():
            p, start = r.pop("path"), r.pop("block")
            before = unit[-1][4] if unit and unit[-1][0] == p else _NOTHING
            after = compose(before, r, most) if before is not _NOTHING else r
            if after is None or before is _NOTHING:
                if unit:
                    yield rows()
                unit, before, after = [], _NOTHING, r
            unit.append((p, start, r, before, after))
    if unit:
        yield rows()


def _states(found: dict, exact: dict, most: int) -> tuple[dict, dict]:
    """Of each block in order [inside, since, records, tail, tail is text]; and blocks to be measured again, from (inside, since).

    A block that begins ``since`` bytes behind an open quote needs that if the quote may become text in it.
    """
    states: dict = {}
    unknown: dict = {}
    at, inside, since, waiting = None, False, 0, []
    for p, start in [*sorted(found), (None, 0)]:
        if p != at:
            if inside and since - 1 > most:  # the file ends in a field that is none
                for k in waiting:
                    states[k][4] = True
            at, inside, since, waiting = p, False, 0, []
        if p is None or (unknown and p == list(unknown)[-1][0]):
            continue
        r, kind = found[p, start], "in" if inside else "out"
        if inside and since + r["reach"] > most:
            r = exact.get((p, start, since))
            if r is None:
                unknown[p, start] = (True, since)
                inside = False
                continue
        states[p, start] = [inside, since, r[f"n_{kind}"], r[f"tail_{kind}"], False]
        passed = inside and r["head"] == "open"
        if inside and not passed:
            for k in waiting:
                states[k][4] = r["head"] == "text"
            waiting = []
        inside, since = r[f"open_{kind}"], r[f"since_{kind}"] + (since if passed else 0)
        if inside:
            waiting.append((p, start))
    return states, unknown


def _plain(raw: list[bytes], delimiter: bytes, quote: bytes) -> pa.Array | None:
    """The texts of records that have neither quotes nor bytes that need care; None if any has."""
    whole = b"\n".join(raw)
    if quote in whole or b"\0" in whole or b"\r" in whole or not (whole + delimiter).isascii():
        return None
    return pa.array(raw, pa.binary()).cast(pa.string())


def _is_text(raw: bytes) -> bool:
    """Whether bytes are UTF-8 without NULs, so that they are what is shown of them."""
    try:
        return b"\0" not in raw and (raw.isascii() or raw.decode() is not None)
    except UnicodeDecodeError:
        return False


def _names(names: list[str]) -> list[str]:
    """Column names: blank ones get their number, repeated ones a number behind."""
    names = [n if n.strip() else f"Column {i}" for i, n in enumerate(names, 1)]
    seen: dict[str, int] = {}
    for i, n in enumerate(names):
        k = n.lower()
        seen[k] = seen.get(k, 0) + 1
        if seen[k] > 1 or k in (ROW, RAW, WRITTEN, BYTES):
            names[i] = f"{n} ({seen[k]})"
    return names
