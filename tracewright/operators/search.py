"""Search conditions: terms as columns, which Spark's own ``&``, ``|`` and ``~`` combine.

A term is a substring (ASCII-case-insensitive), ``"a phrase"``, ``/a regular expression/``, or one of
these behind a scope, ``column:`` or ``#index:``. Without a scope the whole raw record is searched.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import contains, contains_any, either, fold, matches

RAW = "_raw"
#: Cells that a file writes otherwise than they are shown, by column number: without the outer quotes, doubled quotes kept.
WRITTEN = "_written"
#: Bytes of records (key "") and cells (by column) that aren't plain UTF-8 or have NULs; null for the others.
BYTES = "_bytes"


def _index(name: str, columns: list[str]) -> int | None:
    """A scope's column: ``#index`` in range first, then the first equal name, ASCII case aside."""
    if re.fullmatch(r"#\d+", name) and int(name[1:]) < len(columns):
        return int(name[1:])
    return named(name, columns)


def named(name: str, columns: list[str]) -> int | None:
    """The first column of a name, ASCII case aside."""
    low = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)
    return next((i for i, c in enumerate(columns) if low(c) == low(name)), None)


def scoped(columns: list[str], at: int, written: bool) -> Column:
    """What a search in one column looks at: the cell as the file writes it, where the view knows that."""
    own = F.col(f"`{columns[at]}`")
    return F.coalesce(F.try_element_at(WRITTEN, F.lit(columns[at])), own) if written else own


@dataclass(frozen=True)
class Place:
    """Where a term looks: the record, or the cell of one column; in views of files by bytes.

    Bytes that aren't plain text are searched as they stand in the file, before NULs go and other encodings are decoded: as Latin-1,
    one character a byte, for the needle's UTF-8. Patterns see NULs there, and a replacement character for what isn't UTF-8.
    """

    at: int | None
    columns: list[str]
    written: bool

    def _either_way(self, plain: Column, by_bytes: Callable[[Column], Column]) -> Column:
        if not self.written:
            return plain
        own = F.try_element_at(BYTES, F.lit("" if self.at is None else self.columns[self.at]))
        return F.when(own.isNull(), plain).otherwise(by_bytes(own))

    @property
    def shown(self) -> Column:
        return F.col(RAW) if self.at is None else scoped(self.columns, self.at, self.written)

    def contains(self, value: str) -> Column:
        return self._either_way(contains(self.shown, value), lambda b: contains(_bytewise(b), _bytes_of(value)))

    def contains_any(self, values: list[str]) -> Column:
        return self._either_way(contains_any(self.shown, values), lambda b: contains_any(_bytewise(b), [_bytes_of(v) for v in values]))

    def matches(self, pattern: str) -> Column:
        return self._either_way(matches(self.shown, pattern), lambda b: matches(F.make_valid_utf8(b.cast("string")), pattern))


def _bytewise(b: Column) -> Column:
    return F.decode(b, "ISO-8859-1")


def _bytes_of(value: str) -> str:
    return value.encode().decode("latin-1")


def _parsed(text: str, columns: list[str]) -> tuple[int | None, str, bool]:
    """(column or None, what is looked for, whether that is a pattern) of one term; quotes around all of it or around its value go."""
    quoted = lambda x: x[1:-1] if len(x) >= 2 and x[0] == x[-1] == '"' else x
    text = quoted(text)
    scope, colon, value = text.partition(":")
    at = _index(scope, columns) if colon and value else None
    value = quoted(text if at is None else value)
    if len(value) >= 2 and value[0] == value[-1] == "/":
        return at, value[1:-1], True
    return at, value, False


def term(text: str, columns: list[str], written: bool = False) -> Column:
    """The condition of one term over ``columns``; ``written``: the rows have the columns ``_written`` and ``_bytes``.

    A colon is a scope only behind a known column and before a value, in quotes or not; else it is text, as in ``12:34:56``.
    A missing cell doesn't match, so its negation does. Blank text matches everything.
    """
    if not text.strip():
        return F.lit(True)
    at, value, pattern = _parsed(text, columns)
    place = Place(at, columns, written)
    return place.matches(value) if pattern else place.contains(value)


def all_of(*conditions: Column) -> Column:
    out = F.lit(True)
    for c in conditions:
        out &= c
    return out


def any_of(*conditions: Column) -> Column:
    return either(*conditions)


def filters(columns: list[str], wanted: dict[str, str], also: Column | None = None, written: bool = False) -> Column:
    """Column filters, all of them: each cell contains its value (``"`` left out; blank values don't filter)."""
    own = [Place(columns.index(c), columns, written).contains(v.replace('"', "")) for c, v in wanted.items() if c in columns and v.strip()]
    return all_of(*own, *([also] if also is not None else []))


def pasted(text: str) -> list[str]:
    """Values of pasted text: split at line ends, tabs and commas, trimmed, quotes left out, each once."""
    parts = (p.strip().replace('"', "") for p in re.split(r"[\n\r\t,]", text))
    return list(dict.fromkeys(p for p in parts if p))


def any_pasted(text: str, columns: list[str], written: bool = False) -> Column:
    """Rows with any of the pasted values; see :func:`any_value`."""
    return any_value(pasted(text), columns, written)


def any_value(values: Iterable[str], columns: list[str], written: bool = False) -> Column:
    """Rows that meet any of many terms. The plain ones of a column, or of the record, are looked for together, in one pass over it."""
    plain: dict[int | None, list[str]] = {}
    patterns: list[Column] = []
    for v in dict.fromkeys(values):
        if not v.strip():
            return F.lit(True)
        at, value, pattern = _parsed(v, columns)
        if pattern:
            patterns.append(Place(at, columns, written).matches(value))
        else:
            plain.setdefault(at, []).append(value)
    return any_of(*(Place(at, columns, written).contains_any(own) for at, own in plain.items()), *patterns)


__all__ = ["BYTES", "RAW", "WRITTEN", "Place", "all_of", "any_of", "any_pasted", "any_value", "filters", "fold", "pasted", "term"]
