"""Toxicity of restored text: a noisy channel undoes leetspeak, spacing and repetition before scoring.

A character trigram model is counted over all documents. A suspicious token is a lattice: each
character may stand for itself or for letters it is used for, separators inside a word may be noise,
and so may repeated letters. Viterbi decoding takes the likeliest letters under the model and the
channel. Restored words and their beginnings are evidence; their weights are log-odds learned from
labelled documents, and a logistic curve, fitted on labelled documents apart from those, turns
the sum into a probability.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, first_by_hash, small_batches

#: Slots of the hashed trigram table: its size doesn't depend on the alphabets met.
SLOTS = 1 << 18
#: Labelled rows that the weights are learned from, at most (the first by a hash of the id).
SAMPLE_ROWS = 20_000
#: Letters that a character is used for (fixed values of the channel).
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
_SEPARATORS = set(".-_*~·,/;: ")
#: Natural-log costs of the channel: a stand-in, a dropped separator, a repetition of two and of more, a literal non-letter.
STAND_IN, DROP, TWICE, MORE, LITERAL = 0.7, 0.3, 5.0, 0.2, 9.0
#: Costs of a word's edge in a run of words: at a separator, and between two letters.
EDGE, GLUED = 0.5, 2.0
_STARTS = (4, 5, 6)


def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(1 << 16)])


def _slot(a, b, c):
    return (a * 7_368_787 + b * 1_299_709 + c * 15_485_863) % SLOTS


def trigram_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(slot, n)``: how often each hashed letter trigram occurs in all texts; anything else is a word's edge (0)."""

    def each(batches):
        alpha, total = _letters(), np.zeros(SLOTS, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    c = np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
                    c = np.where(alpha[np.minimum(c, 65535)], c, 0)
                    total += np.bincount(_slot(c[:-2], c[1:-1], c[2:]), minlength=SLOTS) if len(c) > 20_000 else 0
                    if len(c) <= 20_000:
                        np.add.at(total, _slot(c[:-2], c[1:-1], c[2:]), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["slot", "n"])

    small_batches(docs.sparkSession)
    return docs.select(text_col).mapInArrow(each, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))


class Channel:
    """Decodes tokens under a table of hashed trigram counts."""

    def __init__(self, counts: np.ndarray):
        total = max(1, int(counts.sum()))
        self.logp = np.log((counts + 0.1) / (total + 0.1 * SLOTS)).astype(np.float32)
        self.decode = lru_cache(200_000)(self._decode)
        self.words = lru_cache(200_000)(self._words)

    @lru_cache(200_000)  # noqa: B019  one channel a task
    def _next(self, a: int, b: int, c: int) -> float:
        return float(self.logp[_slot(a, b, c)]) - self._context(a, b)

    @lru_cache(100_000)  # noqa: B019  one channel a task
    def _context(self, a: int, b: int) -> float:
        """About the log of all that follows (a, b): the common letters and the edge stand for all."""
        return math.log(sum(math.exp(self.logp[_slot(a, b, c)]) for c in (0, *map(ord, "abcdefghijklmnopqrstuvwxyzäöüßéèêñóíçà"))))

    def _decode(self, token: str) -> str:
        """The likeliest reading of a token as one word; time in proportion to its length."""
        best = {(0, 0): (0.0, None)}  # state: cost, (before, letter)
        before, run = "", 0
        for ch in token:
            run = run + 1 if ch == before else 1
            options = [(c, STAND_IN) for c in LEET.get(ch, "")]
            options.append((ch, 0.0) if ch.isalpha() else ("", DROP if ch in _SEPARATORS else LITERAL))
            new: dict = {}
            for (a, b), (cost, text) in best.items():
                for c, price in options:
                    if c:
                        state, price, longer = (b, ord(c)), price - self._next(a, b, ord(c)), (text, c)
                    else:
                        state, longer = (a, b), text
                    if cost + price < new.get(state, (math.inf,))[0]:
                        new[state] = (cost + price, longer)
                    if c and run > 1 and b == ord(c):  # the same letter again, as noise
                        drop = cost + (TWICE if run == 2 and ch.isalpha() else MORE)
                        if drop < new.get((a, b), (math.inf,))[0]:
                            new[(a, b)] = (drop, text)
            best, before = new, ch
        return self._cheapest(best)

    def _cheapest(self, best: dict) -> str:
        """The text of the cheapest state, its end taken into account."""
        text, out = min(((cost - self._next(a, b, 0), text) for (a, b), (cost, text) in best.items()), key=lambda x: x[0])[1], []
        while text:
            text, c = text
            out.append(c)
        return "".join(reversed(out)).strip()

    def _words(self, token: str) -> str:
        """The likeliest words of a token or run, a blank between two; time in proportion to its length.

        A character stands for itself or for letters it is used for, repetitions may be noise, and a word may end before any
        letter, more cheaply at a separator. Separators are dropped and don't end a repetition.
        """
        best = {(0, 0): (0.0, None)}  # state: cost, (before, letter)
        before, run, gap = "", 0, True
        for ch in token:
            if ch in _SEPARATORS:
                gap = True
                continue
            run = run + 1 if ch == before else 1
            options = [(c, STAND_IN) for c in LEET.get(ch, "")]
            options.append((ch, 0.0) if ch.isalpha() else ("", LITERAL))
            edges = {}
            for (a, b), (cost, text) in best.items():
                ended = cost + (EDGE if gap else GLUED) - (self._next(a, b, 0) if b else math.inf)
                if b and ended < edges.get((b, 0), (math.inf,))[0]:
                    edges[(b, 0)] = (ended, (text, " "))
            new: dict = {}
            for (a, b), (cost, text) in [*best.items(), *edges.items()]:
                for c, price in options:
                    if c:
                        state, price, longer = (b, ord(c)), price - self._next(a, b, ord(c)), (text, c)
                    else:
                        state, longer = (a, b), text
                    if cost + price < new.get(state, (math.inf,))[0]:
                        new[state] = (cost + price, longer)
                    if c and run > 1 and b == ord(c):
                        drop = cost + (TWICE if run == 2 and ch.isalpha() else MORE)
                        if drop < new.get((a, b), (math.inf,))[0]:
                            new[(a, b)] = (drop, text)
            best, before, gap = new, ch, False
        return self._cheapest(best)


_DECOR = re.compile(r"^([^\w\s])\1+|([^\w\s])\2+$")
_EDGE = "\"'`.,;:?)]}[{<>=/\\%&#^~*_-"
#: What sends a token to the lattice: any character that the channel reads as something else or drops, a digit, or a doubled letter.
_NOISE = re.compile(r"[\d" + re.escape("".join(sorted({*LEET, *_SEPARATORS} - set("0123456789 ")))) + "]")
_TWICE = re.compile(r"([^\W\d_])\1")
_RUN = re.compile(r"(.)\1+")
_REPEATED = re.compile(r"([^\W_])\1{3,}")
_GAPS = re.compile("[" + re.escape("".join(sorted(_SEPARATORS - {" "}))) + "]{2,}")
_SPACED = re.compile(r"(?<!\S)[\w@$!|+](?:[ .*_-][\w@$!|+]){2,}(?!\S)")
#: Characters without a width, which part words unseen: soft hyphens, joiners, marks of direction and of byte order.
_UNSEEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]+")
#: A letter for each stand-in, to look for words that a blank parts; the lattice then decides.
_FOLD = str.maketrans({c: letters[0] for c, letters in LEET.items()})


def restore(token: str, channel: Channel) -> str:
    """The word or words that a lower-case token, or a run with blanks, stands for.

    Tokens of letters without a doubled one have one path through the lattice and are kept as they are, and so are numbers:
    tokens of digits and separators alone. Stand-ins without a letter are read if one of them isn't a digit.
    """
    core = token
    if not core.isalpha():
        if len(core) > 1 and (core[0] == core[1] or core[-1] == core[-2]):
            core = _DECOR.sub("", core)
        core = core.strip(_EDGE).rstrip("!")
    if len(core) < 3:
        return core
    if core.isalpha():
        return channel.decode(_REPEATED.sub(r"\1\1\1", core)) if _TWICE.search(core) else core
    if not (_NOISE.search(core) or _TWICE.search(core)) or not any(c.isalpha() or (c in LEET and not c.isdigit()) for c in core):
        return core
    return channel.words(_REPEATED.sub(r"\1\1\1", _GAPS.sub(lambda m: m.group()[0], core)))


def visible(text: str) -> str:
    """A text in lower case, without characters that have no width."""
    low = text.lower()
    return low if low.isascii() else _UNSEEN.sub("", low)


def tokens(low: str) -> set[str]:
    """Distinct tokens of a :func:`visible` text, runs of single characters as one token each and, with blanks, as a run of words."""
    runs = [m.group() for m in _SPACED.finditer(low)]
    return set(low.split()).union((r.replace(" ", "") for r in runs), (re.sub("[ .*_-]", " ", r) for r in runs))


def parted(low: str, whole: set[str]) -> set[tuple[str, str]]:
    """Neighbouring tokens of a :func:`visible` text that are one of the words ``whole`` without the blank between them."""
    plain = low.translate(_FOLD).split()
    found = set(map(str.__add__, plain, plain[1:])) & whole
    if not found:
        return set()
    own = low.split()
    return {(a, b) for a, b, x, y in zip(own, own[1:], plain, plain[1:]) if x + y in found}


def collapsed(word: str) -> str:
    """A word with one letter for each run of equal ones: the same whatever repetitions a reading drops."""
    return _RUN.sub(r"\1", word)


def features(words: str) -> list[str]:
    return [f for word in words.split() for f in [word, *(f"^{word[:n]}" for n in _STARTS if len(word) > n)]]


class Scorer:
    def __init__(self, counts: np.ndarray, weights: dict[str, float], slope: float, offset: float):
        self.channel, self.weights, self.slope, self.offset = Channel(counts), weights, slope, offset
        self.heads = tuple({collapsed(f.removeprefix("^")) for f in weights})
        self.whole = {f for f in weights if f[0] != "^" and len(f) > 3}
        self.known: set[str] = set()
        self.telling: dict[str, list[tuple[str, float]]] = {}

    def _weight(self, word: str) -> float:
        got, get = self.weights.get(word, 0.0), self.weights.get
        for n in _STARTS:
            if len(word) <= n:
                break
            got = max(got, get("^" + word[:n], 0.0))
        return got

    def _weights(self, token: str) -> list[tuple[str, float]]:
        """The restored words of a token that are evidence; in a run also those that its likeliest edges cut, and a token's if nothing else is in it."""
        if token.isalpha() and not (self.heads and collapsed(token).startswith(self.heads)):
            return []  # whatever repetitions go, no evidence begins like this
        text = restore(token, self.channel)
        found = {word: w for word in text.split() if (w := self._weight(word))}
        if " " in token or text not in token:  # more than its edges has changed
            cut, rest = self._cut(text.replace(" ", ""))
            if " " in token or not rest:
                found |= {word: self.weights[word] for word in cut}
        return list(found.items())

    def _cut(self, letters: str) -> tuple[set[str], int]:
        """Evidence words from left to right, the longest first, and how many letters are left over."""
        found, at, rest = set(), 0, 0
        while at < len(letters):
            word = next((x for n in range(24, 3, -1) if len(x := letters[at : at + n]) == n and x in self.weights), None)
            if word:
                found.add(word)
            rest += not word
            at += len(word) if word else 1
        return found, rest

    def evidence(self, text: str) -> float:
        if len(self.known) > 300_000:
            self.known.clear()
            self.telling.clear()
        low = visible(text)
        own = tokens(low)
        new = own - self.known
        for t in new:
            if w := self._weights(t):
                self.telling[t] = w
        self.known |= new
        found = {x: w for t in own & self.telling.keys() for x, w in self.telling[t]}
        for a, b in parted(low, self.whole):
            for word in self.channel.words(f"{a} {b}").split():
                if w := self._weight(word):
                    found[word] = w
        return sum(found.values())

    def score(self, text: str | None) -> float:
        z = self.slope * math.log1p(self.evidence(text or "")) + self.offset
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (never negative) and offset by Newton steps, with a weak pull to 0."""
    a, b = 1.0, -1.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((p - y) * x).sum() + 0.05 * a, (p - y).sum()])
        w = p * (1 - p) + 1e-6
        h = np.array([[(w * x * x).sum() + 0.05, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-6:
            break
    return max(float(a), 0.0), float(b)


def fit(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, least_docs: int = 4, least_odds: float = 3.0):
    """A scorer's parameters: trigram counts of all ``docs``, weights and curve from ``labelled`` (id, label) rows.

    At most ``sample_rows`` labelled rows, so the join's small side has a proven bound. Equal texts count once. Two
    of three of them, by a hash, give the weights; the others the curve. Null labels and ids are left out; without toxic
    examples every score is low.
    """
    spark = docs.sparkSession
    small_batches(spark)
    slots = trigram_counts(docs, text_col).collect()  # SLOTS rows at most
    counts = np.zeros(SLOTS)
    for r in slots:
        counts[r[0]] = r[1]
    rows = labelled.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).dropna().distinct()
    rows = cut(first_by_hash(rows, sample_rows, "id", "y"), "labelled")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").join(F.broadcast(rows), "id")
    texts = cut(texts.groupBy(F.md5("text").alias("key")).agg(F.first("text").alias("text"), F.max("y").alias("y")), "labelled-texts")
    share = F.pmod(F.crc32("key"), F.lit(3)) < 2
    shipped = spark.sparkContext.broadcast(counts)

    def count(batches):
        channel = Channel(shipped.value)
        for b in batches:
            got: tuple = ({}, {})
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for f in {f for w in {restore(x, channel) for x in tokens(visible(t))} if w for f in features(w)}:
                    got[y > 0][f] = got[y > 0].get(f, 0) + 1
            for y in (0, 1):
                yield pa.RecordBatch.from_pydict({"f": pa.array(list(got[y]), pa.string()), "y": pa.array([y] * len(got[y]), pa.int32()), "n": pa.array(list(got[y].values()), pa.int64())})

    learn = texts.where(share)
    sizes = {bool(y): n for y, n in learn.groupBy((F.col("y") > 0).alias("y")).count().collect()}
    odds = learn.select("text", "y").mapInArrow(count, "f string, y int, n long").groupBy("f").agg(F.sum(F.expr("if(y = 1, n, 0)")).alias("t"), F.sum(F.expr("if(y = 0, n, 0)")).alias("c"))
    odds = odds.where(F.col("t") >= least_docs).withColumn("w", F.log((F.col("t") + 0.5) / (sizes.get(True, 0) + 1)) - F.log((F.col("c") + 0.5) / (sizes.get(False, 0) + 1)))
    weights = {r[0]: r[1] for r in odds.where(F.col("w") >= least_odds).select("f", "w").collect()}  # bounded by the sample
    raw = Shipped(spark, counts, weights, 1.0, 0.0)
    curve = texts.where(~share).select(raw.apply("text").alias("p"), "y").collect()
    p = np.clip(np.array([r[0] for r in curve], float), 1e-13, 1 - 1e-13)
    slope, offset = _logistic(np.log(p / (1 - p)), np.array([r[1] > 0 for r in curve], float)) if len(curve) else (1.0, -3.0)
    return Shipped(spark, counts, weights, slope, offset)


class Shipped:
    """A scorer's parameters on the executors: the trigram table has a fixed size, the weights are bounded by the sample."""

    def __init__(self, spark, *parameters):
        self.parameters = parameters
        self.shared = spark.sparkContext.broadcast(parameters)

    def apply(self, column):
        shared = self.shared

        @F.arrow_udf("double")
        def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            scorer = Scorer(*shared.value)
            for b in batches:
                yield pa.array([scorer.score(t) for t in b.to_pylist()], pa.float64())

        return score(column)


def held_out(id_col: str = "doc_id"):
    """Rows that labels are never learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == 1, F.lit(False))


def score(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", at_least: float = 0.7, **more) -> DataFrame:
    """``docs`` with ``tox_score`` and ``tox_predicted``; rows held out by :func:`held_out` teach nothing.

    Every row is scored, null texts like empty ones. Columns of ``docs`` with these two names are replaced.
    """
    model = fit(docs, labelled.where(~held_out(id_col)), id_col, text_col, label_col, **more)
    out = docs.withColumn("tox_score", model.apply(F.col(text_col)))
    return out.withColumn("tox_predicted", (F.col("tox_score") >= at_least).cast("int"))
