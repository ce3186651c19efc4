"""Quality rules: a learned decision list over statistics of texts.

Sequential covering on labelled rows: a rule, a conjunction of thresholds, grows by the condition of the
greatest information gain on one part of the sample, is pruned from its end on the other part, and what it
covers leaves both. The list becomes one Spark conditional expression over the columns of the statistics.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, first_by_hash, small_batches

#: Labelled rows that a list is learned from, at most (the first by a hash of the id).
SAMPLE_ROWS = 20_000
#: What counts as a symbol, and ASCII punctuation that prose has.
SYMBOLS, MARKS, DIGITS = b"#*$%&|<>", b".,;:!?'\"()-", b"0123456789"
#: Words of a block, within which a word is fresh where it is the first of its kind; so the share doesn't fall with a text's length.
BLOCK = 64
#: Counts of a text, in the order in which they are made.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines", "n_fresh", "n_doubled", "n_upper", "n_marks", "n_digits")
#: What rules may ask for: a name, a count, and the count that it is a share of (None: the count itself).
MEASURES = (
    ("words", "n_words", None), ("word_length", "word_chars", "n_words"), ("symbols", "n_symbols", "n_chars"), ("repeated_lines", "n_dup_lines", "n_lines"),
    ("repeated_words", "n_repeat_words", "n_words"), ("fresh_words", "n_fresh", "n_words"), ("doubled_words", "n_doubled", "n_words"),
    ("upper_words", "n_upper", "n_words"), ("marks", "n_marks", "n_chars"), ("digits", "n_digits", "n_chars"), ("words_a_line", "n_words", "n_lines"),
)
NAMES = tuple(m[0] for m in MEASURES)


def counts(text: str | None) -> tuple[int, ...]:
    """The counts of one whole text, in the order of ``COUNTS``; null like an empty one.

    Words are parted by ASCII white space. A repeated line has a word and equals an earlier line; a repeated
    word lies in a window of three words that is met twice or more, its first place included.
    """
    text = text or ""
    raw = text.encode()
    words = raw.split()  # of bytes: at blanks and codes 9 to 13
    n, repeated, doubled, fresh = len(words), 0, 0, min(len(words), 1)
    known: dict[bytes, int] = {}
    for w in words:
        known.setdefault(w, len(known))
    if n > 1:
        ids = np.fromiter(map(known.__getitem__, words), np.int64, n)
        doubled = int((ids[1:] == ids[:-1]).sum())
        fresh = len(np.unique(np.arange(n) // BLOCK * len(known) + ids))
        if n > 2:
            _, pair = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)  # numbers stay below n * n
            _, at, times = np.unique(pair[:-1] * len(known) + ids[2:], return_inverse=True, return_counts=True)
            again, covered = times[at] > 1, np.zeros(n, bool)
            for k in range(3):
                covered[k : n - 2 + k] |= again
            repeated = int(covered.sum())
    seen: set[bytes] = set()
    lines = again_lines = 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            again_lines += line in seen
            seen.add(line)
    of = lambda some: len(raw) - len(raw.translate(None, some))
    blanks = of(b" \t\n\x0b\x0c\r")
    return n, len(text) - blanks, of(SYMBOLS), again_lines, repeated, len(text), lines, fresh, doubled, sum(map(bytes.isupper, words)), of(MARKS), of(DIGITS)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, counts.., measures..)`` of every row: one pass over the texts. A share of nothing is 0; repeated rows stay rows."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def each(batches):
        for b in batches:
            found = np.array([counts(t) for t in b.column(1).to_pylist()], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, found.T)], ["id", *COUNTS])

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(each, f"id {kind}, " + ", ".join(f"{c} long" for c in COUNTS))
    share = lambda of, whole: F.col(of).cast("double") / F.greatest(F.col(whole), F.lit(1)) if whole else F.col(of).cast("double")
    return out.select("*", *(share(of, whole).alias(name) for name, of, whole in MEASURES))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (measure, at least?, threshold): ``>=`` where the flag is true, ``<`` where not."""

    conditions: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, up, x in self.conditions:
            out &= F.col(name) >= x if up else F.col(name) < x
        return out

    def covers(self, table: np.ndarray) -> np.ndarray:
        out = np.ones(len(table), bool)
        for name, up, x in self.conditions:
            v = table[:, NAMES.index(name)]
            out &= v >= x if up else v < x
        return out

    def __str__(self) -> str:
        return " and ".join(f"{name} {'>=' if up else '<'} {x:.6g}" for name, up, x in self.conditions)


def fired(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1; null where none does. One ordered conditional expression."""
    out = None
    for i, r in enumerate(rules, 1):
        out = F.when(r.column(), i) if out is None else out.when(r.column(), i)
    return F.lit(None).cast("int") if out is None else out


def best_condition(table: np.ndarray, bad: np.ndarray) -> tuple[float, tuple[str, bool, float]] | None:
    """The condition of the greatest gain: rejected rows it keeps times the bits by which it makes them likelier.

    All thresholds halfway between neighbouring values of a measure are tried, both ways; of equals the first.
    """
    whole, best = bad.mean(), None
    for j, name in enumerate(NAMES):
        order = np.argsort(table[:, j], kind="stable")
        v, y = table[order, j], bad[order]
        cuts = np.flatnonzero(v[1:] > v[:-1]) + 1
        if not len(cuts):
            continue
        below = np.cumsum(y)[cuts - 1].astype(float)
        for up, hit, n in ((True, y.sum() - below, len(v) - cuts), (False, below, cuts)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(hit > 0, hit * (np.log2(hit / n) - np.log2(whole)), -1)
            k = int(np.argmax(gain))
            if best is None or gain[k] > best[0] + 1e-9:
                at = cuts[k]
                middle = (v[at - 1] + v[at]) / 2
                best = (float(gain[k]), (name, up, float(middle if v[at - 1] < middle else v[at])))
    return best


def grow(table: np.ndarray, bad: np.ndarray, longest: int) -> Rule:
    """Add conditions until only rejected rows are covered, nothing is gained, or there are ``longest``."""
    conditions: list[tuple[str, bool, float]] = []
    inside = np.ones(len(table), bool)
    while len(conditions) < longest and not bad[inside].all():
        found = best_condition(table[inside], bad[inside])
        if found is None or found[0] <= 0:
            break
        conditions.append(found[1])
        inside = Rule(tuple(conditions)).covers(table)
    return Rule(tuple(conditions))


def prune(rule: Rule, table: np.ndarray, bad: np.ndarray) -> Rule:
    """The beginning of a rule of the greatest (rejected - kept) / covered; of equals the shortest."""
    best, worth = rule, -2.0
    for n in range(1, len(rule.conditions) + 1):
        own = Rule(rule.conditions[:n])
        inside = own.covers(table)
        hit, n_in = bad[inside].sum(), inside.sum()
        value = (2 * hit - n_in) / n_in if n_in else -1.0
        if value > worth + 1e-9:
            best, worth = own, value
    return best


def by_chance(bad: np.ndarray, rate: float) -> float:
    """A bound (Chernoff's) of the probability of so many bad rows or more where each is bad at ``rate``."""
    share = bad.mean()
    if share <= rate:
        return 1.0
    bits = share * np.log(share / rate) + (1 - share) * np.log(max(1 - share, 1e-300) / (1 - rate))
    return float(np.exp(-len(bad) * bits))


def cover(table: np.ndarray, bad: np.ndarray, fold: np.ndarray, precision: float = 0.9, least: int = 3, longest: int = 4, most: int = 32) -> list[Rule]:
    """Rules for the rows that are ``bad``; each row has a ``fold`` of 0 to 2, one of which prunes while the others grow.

    A rule joins the list if ``precision`` of what it covers among the pruning rows is bad, which by chance would be so
    once in fifty times at most, and in all at least ``least`` bad rows are. The search ends when no fold leads to such a rule, or at ``most`` rules. At last rules go without which
    no more rows are judged wrongly, the later first.
    """
    rules: list[Rule] = []
    left = np.ones(len(table), bool)

    def next_rule() -> tuple[Rule, np.ndarray] | None:
        for k in range(3):
            growing, pruning = left & (fold != k), left & (fold == k)
            if not bad[growing].any() or not bad[pruning].any():
                continue
            rule = grow(table[growing], bad[growing], longest)
            if not rule.conditions:
                continue
            rule = prune(rule, table[pruning], bad[pruning])
            inside = rule.covers(table) & left
            tried = inside & pruning
            if tried.any() and bad[tried].mean() >= precision and by_chance(bad[tried], bad[left].mean()) <= 0.02 and bad[inside].sum() >= least:
                return rule, inside
        return None

    while len(rules) < most and (found := next_rule()):
        rules.append(found[0])
        left &= ~found[1]
    wrong = lambda some: (np.logical_or.reduce([r.covers(table) for r in some] or [np.zeros(len(table), bool)]) != bad).sum()
    for r in rules[::-1]:
        rest = [x for x in rules if x is not r]
        if wrong(rest) <= wrong(rules):
            rules = rest
    return rules


def learn(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """A decision list for rows labelled 0, from at most ``sample_rows`` labelled rows; none without both labels among them.

    ``stats`` is :func:`statistics` (written: it is read here and again where the list is used). Null ids and labels are
    left out. A hash of the id deals the rows to the folds.
    """
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).dropna().where("y IN (0, 1)").distinct()
    rows = F.broadcast(cut(first_by_hash(rows, sample_rows, "id", "y"), "rated"))
    found = stats.join(rows, "id").select(F.pmod(F.xxhash64(F.lit("fold"), "id"), F.lit(3)).alias("fold"), "y", *NAMES).toArrow()  # bounded by the sample
    found = found.sort_by([(c, "ascending") for c in ("fold", "y", *NAMES)])
    table = np.column_stack([found.column(c).to_numpy() for c in NAMES]) if len(found) else np.zeros((0, len(NAMES)))
    bad = found.column("y").to_numpy() == 0 if len(found) else np.zeros(0, bool)
    return cover(table, bad, found.column("fold").to_numpy()) if len(found) else []


def judge(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """``stats`` with ``base_failed`` (under 50 words, or over half of them repeated), ``rule`` (:func:`fired`) and ``kept``."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = stats.select("*", failed.alias("base_failed"), fired(rules).alias("rule"))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
