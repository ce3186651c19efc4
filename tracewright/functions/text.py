"""Text rules shared by search, order and groups: ASCII folding, the numeric-aware key, regular expressions."""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .needles import Needles

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: What counts as a number; a plain cast would also take ``1d``, ``0x1p3`` and ``nan``.
NUMBER = r"(?i)^[+-]?(?:inf|infinity|(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?)$"

_POSIX = {"alpha": "Alpha", "digit": "Digit", "alnum": "Alnum", "upper": "Upper", "lower": "Lower", "punct": "Punct", "space": "Space", "blank": "Blank", "cntrl": "Cntrl", "graph": "Graph", "print": "Print", "xdigit": "XDigit"}


class InvalidPattern(ValueError):
    """A regular expression that isn't accepted."""


def fold(c: Column) -> Column:
    """Lower case of ASCII letters only; ``lower`` would also fold É and the Kelvin sign."""
    return F.translate(c, UPPER, LOWER)


def fold_text(x: str) -> str:
    """:func:`fold` of one text."""
    return x.lower() if x.isascii() else x.encode().lower().decode()  # of bytes: ASCII letters only


def contains(c: Column, needle: str) -> Column:
    """ASCII-case-insensitive substring test; a null cell doesn't contain anything."""
    return F.coalesce(F.contains(fold(c), F.lit(fold_text(needle))), F.lit(False))


def trim(c: Column) -> Column:
    """Without Unicode white space at the ends; ``F.trim`` takes blanks only."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def key_fields(c: Column) -> tuple[Column, Column]:
    """Two plain columns, ``(number, text)``, whose order is that of the cells.

    Numbers come first, by value, with ``"-"`` for a negative zero and ``"0"`` for all others as text; then, with NaN, which Spark
    sorts behind all numbers and no cell is read as, texts, trimmed and folded. Null counts as empty text.
    """
    c = F.coalesce(c, F.lit(""))
    visible = lambda code: code.between(33, 126)  # noqa: E731  ASCII and no white space, so that patterns are spared
    v = F.when(visible(F.ascii(c)) & visible(F.ascii(F.right(c, F.lit(1)))), c).otherwise(trim(c))
    first = F.ascii(v)
    number = F.when((first.between(43, 57) | first.isin(73, 105)) & v.rlike(NUMBER), v.try_cast("double"))  # a sign, a point, a digit, or I
    text = F.when(number.isNull(), fold(v)).otherwise(F.when((number == 0) & v.startswith("-"), F.lit("-")).otherwise(F.lit("0")))
    return F.coalesce(number, F.lit(float("nan"))), text


def forward_fields(c: Column, up: bool) -> tuple[Column, ...]:
    """Columns whose ascending order is the order of the cells, or for ``up`` false the descending one: every part is turned round."""
    number, text = key_fields(c)
    if up:
        return number, text
    back = F.concat(F.translate(F.hex(F.encode(text, "UTF-8")), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("~"))
    return F.when(F.isnan(number), 0).otherwise(1), -number, back


def value_key(c: Column) -> Column:
    """The key by which cells are compared and grouped: :func:`key_fields` as one value."""
    number, text = key_fields(c)
    return F.struct(number.alias("number"), text.alias("text"))


def java_pattern(pattern: str) -> str:
    """``pattern``, in the linear-time dialect that log tools share, as Java reads it.

    Classes are Unicode, ``.`` matches all but line feeds, ``$`` is the very end (unless ``(?m)``), named
    groups may be ``(?P<n>``, POSIX classes work. Look-around, back-references and ``(?U)`` are refused.
    """
    out, i, in_class = [], 0, False
    lines = re.search(r"\(\?[a-z]*m", pattern) is not None
    while i < len(pattern):
        rest = pattern[i:]
        if rest[0] == "\\":
            if not in_class and len(rest) > 1 and (rest[1] in "123456789k"):
                raise InvalidPattern("back-references aren't accepted")
            out.append({r"\z": r"\z", r"\Z": r"\z"}.get(rest[:2], rest[:2]))
            i += 2
            continue
        posix = re.match(r"\[:(\^?)(\w+):\]", rest) if in_class else None
        if posix:
            if posix[2] not in _POSIX:
                raise InvalidPattern(f"unknown class {posix[2]}")
            out.append((r"\P{%s}" if posix[1] else r"\p{%s}") % _POSIX[posix[2]])
            i += posix.end()
            continue
        if in_class:
            in_class = rest[0] != "]" or out[-1] in ("[", "[^")
        elif rest.startswith("[^"):
            in_class = True
            out.append("[^")
            i += 2
            continue
        elif rest[0] == "[":
            in_class = True
        elif re.match(r"\(\?(<?[=!])", rest):
            raise InvalidPattern("look-around isn't accepted")
        elif re.match(r"\(\?[a-z]*U", rest):
            raise InvalidPattern("(?U) isn't accepted")
        elif rest.startswith("(?P<"):
            out.append("(?<")
            i += 4
            continue
        elif rest[0] == "$" and not lines:
            out.append(r"\z")
            i += 1
            continue
        out.append(rest[0])
        i += 1
    return "(?Ud)" + "".join(out)


#: Unicode classes as RE2 writes them within brackets; letters in circles and squares count as letters.
_CLASSES = {"d": r"\p{Nd}", "w": r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200C}\x{200D}\x{24B6}-\x{24E9}\x{1F130}-\x{1F149}\x{1F150}-\x{1F169}\x{1F170}-\x{1F189}", "s": r"\t-\r\x{85}\p{Z}"}


def backtracks(pattern: str) -> bool:
    """Whether a backtracking matcher may need far more than one look at each character: a repeated group with a choice or an unbounded repetition in it, or more than two unbounded repetitions."""
    bare = re.sub(r"\\.", "x", pattern)
    bare = re.sub(r"\[\^?\]?(?:\[:\^?\w+:\]|[^\]])*\]", "x", bare)  # classes are one character
    endless = r"(?:[*+]|\{\d*,\})"
    if len(re.findall(endless, bare)) > 2:
        return True
    open_at: list[int] = []
    for i, x in enumerate(bare):
        if x == "(":
            open_at.append(i)
        elif x == ")" and open_at:
            inside = bare[open_at.pop() : i]
            if re.match(endless + r"|\{\d+(?:,\d+)?\}", bare[i + 1 :]) and re.search(endless + r"|\|", inside):
                return True
    return False


def linear_pattern(pattern: str) -> str | None:
    """``pattern`` as RE2 reads it, with the meaning that :func:`java_pattern` gives it; None where RE2 can't say it.

    RE2 knows neither Unicode word edges nor ``(?x)``, and a negated class can't stand within brackets.
    """
    out, i, in_class = [], 0, False
    lines = re.search(r"\(\?[a-z]*m", pattern) is not None
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two[0] == "\\":
            kind = two[1:]
            if kind in ("b", "B", "G", "h", "H", "R", "X", "v", "V") or (in_class and kind in ("W", "S", "D")):
                return None
            if kind.lower() in _CLASSES:
                own = _CLASSES[kind.lower()]
                out.append(own if in_class else f"[{'^' if kind.isupper() else ''}{own}]")
            else:
                out.append(r"\z" if kind in ("z", "Z") else two)
            i += 2
            continue
        if in_class and two == "[:":
            return None
        if in_class:
            in_class = two[0] != "]" or out[-1] in ("[", "[^")
            if two[0] in ("&", "["):  # intersections and nested classes of the other dialect
                return None
        elif two == "[^":
            in_class = True
            out.append("[^")
            i += 2
            continue
        elif two[0] == "[":
            in_class = True
        elif re.match(r"\(\?[a-z]*x", pattern[i:]):
            return None
        elif two[0] == "$" and not lines:
            out.append(r"\z")
            i += 1
            continue
        out.append(two[0])
        i += 1
    return "".join(out)


def _found_by_re2(pattern: str):
    """A function of Arrow batches; RE2 looks at each character once. None where it refuses the pattern."""
    try:
        pc.match_substring_regex(pa.array(["x"]), pattern)
    except pa.ArrowInvalid:
        return None

    @F.arrow_udf("boolean")
    def found(cells: pa.Array) -> pa.Array:
        return pc.fill_null(pc.match_substring_regex(cells, pattern), False)

    return found


def matches(c: Column, pattern: str) -> Column:
    """Whether ``pattern`` is found in a cell; raises :class:`InvalidPattern` now, not when the plan runs.

    Java matches, within the plan; patterns over which it may backtrack go to RE2 in Arrow batches, in time linear in the text.
    """
    java = java_pattern(pattern)
    try:
        SparkSession.active().sparkContext._jvm.java.util.regex.Pattern.compile(java)
    except PySparkException as e:
        raise InvalidPattern(f"{pattern}: {str(e).splitlines()[0]}") from None
    if backtracks(pattern) and (linear := linear_pattern(pattern)) is not None and (found := _found_by_re2(linear)):
        return found(c)
    return F.coalesce(c.rlike(java), F.lit(False))


#: Needles that are looked for one by one, in the plan; more of them are looked for together.
FEW = 8


def contains_any(c: Column, needles: list[str]) -> Column:
    """ASCII-case-insensitive test for any of many substrings, in one pass over a cell; a null cell has none of them.

    The needles are shipped once, as arrays of their bytes and hashes, so neither the plan nor the time a character grows with
    their number, and a worker's memory only by some 30 bytes for a needle of ten.
    """
    needles = sorted({fold_text(x) for x in needles})
    if "" in needles:
        return c.isNotNull()
    if len(needles) <= FEW:
        return either(*(contains(c, x) for x in needles))
    shipped = SparkSession.active().sparkContext.broadcast(Needles([x.encode() for x in needles]))

    @F.arrow_udf("boolean")
    def found(cells: pa.Array) -> pa.Array:
        return pa.array(shipped.value.inside(cells))

    return found(c)


def either(*conditions: Column) -> Column:
    """Whether any condition holds, as a balanced tree: deep chains exhaust the planner."""
    if len(conditions) < 2:
        return conditions[0] if conditions else F.lit(False)
    half = len(conditions) // 2
    return either(*conditions[:half]) | either(*conditions[half:])


def single_line(c: Column) -> Column:
    """Line ends shown as a mark, for one-line display."""
    return F.regexp_replace(c, "\r\n|\n|\r", " ⏎ ")


def csv_cell(c: Column, delimiter: str = ",") -> Column:
    """A cell as a delimited file holds it: quoted only if it has the delimiter, a quote or a line end."""
    c = F.coalesce(c, F.lit(""))
    odd = F.contains(c, F.lit(delimiter)) | F.contains(c, F.lit('"')) | F.contains(c, F.lit("\n")) | F.contains(c, F.lit("\r"))
    return F.when(odd, F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
