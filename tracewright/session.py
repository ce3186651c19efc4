"""The state of an investigation as JSON: what is searched, filtered, ordered, grouped, hidden and marked."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame

from .operators import grouping, search
from .operators.timeline import UnknownColumn, View


@dataclass
class Session:
    """``tags_table`` names the table or folder that holds the marked row ids; ids themselves stay out of the file."""

    path: str = ""
    search: str = ""
    hidden: list[str] = field(default_factory=list)
    filters: dict[str, str] = field(default_factory=dict)
    sort: list[tuple[str, bool]] = field(default_factory=list)
    group: list[str] = field(default_factory=list)
    tags_table: str | None = None
    tagged_only: bool = False

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Session:
        """Unknown keys are left out."""
        got = json.loads(text)
        own = cls(**{k: got[k] for k in cls.__dataclass_fields__ if k in got})
        own.sort = [(c, bool(up)) for c, up in own.sort]
        return own

    def apply(self, view: View) -> View:
        """The view that this state describes, of the view of the whole file."""
        out = view.where(search.filters(view.columns, self.filters, view.term(self.search), view.written))
        if self.tagged_only and self.tags_table:
            out = out.tagged(view.df.sparkSession.read.parquet(self.tags_table))
        shown = [c for c in view.columns if c not in self.hidden]
        known = [(c, up) for c, up in self.sort if c in view.columns]  # a state may be older than the file
        return out.sort(*known).project(*(shown or view.columns))

    def groups(self, view: View) -> DataFrame | None:
        """The groups of all levels (:func:`grouping.nodes`) of the view that this state describes; None where it isn't grouped.

        Columns that the file hasn't are left out.
        """
        known = []
        for c in self.group:
            try:
                known.append(view.resolve(c))
            except UnknownColumn:
                continue
        return grouping.nodes(self.apply(view), known) if known else None

    @classmethod
    def capture(cls, view: View, whole: View, **state) -> Session:
        """The state of a view of ``whole``: its order and hidden columns; what conditions can't tell is given by name (search, filters, group, tags)."""
        return cls(**state, sort=list(view.keys), hidden=[c for c in whole.columns if c not in view.columns])
