"""Personal data: pattern matches, and a semi-Markov conditional random field that adds spans.

The patterns give e-mail addresses, IPv4 addresses, card and phone numbers. The field looks at whole
segments: around triggers (spelled-out addresses, groups of digits) it enumerates candidate segments
with a type, scores each by features of the whole span and its surroundings, and a dynamic program
over segment ends picks boundaries and types together. Segments hold at most ``GROUPS`` digit groups, so
the program is linear in the text. It is trained on matches of the patterns in a bounded sample and on
the same spans respelled, with all other candidates as the alternative.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches

KINDS = ("email", "ip", "card", "phone")
GROUPS = 8
#: Pieces of texts that the field is trained on, at most, and the characters of a piece, at most.
SAMPLE_PIECES, PIECE_CHARS = 3_000, 2_000
#: What a piece has that is of use: a sign of an address or a number.
_TRIGGER = r"@|[0-9]{4}|\+[0-9]"

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_GROUP = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _digits(s: str) -> str:
    return "".join(_GROUP.findall(s))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the patterns, by kind and start; each kind leftmost and without overlap, linear in the text.

    An e-mail match is found from its ``@``: its local part reaches back as far as allowed characters
    do, but not into the match before. A digit run can only start an IP match at its first digit.
    """
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        own = text[end:at]
        start = at - (len(own) - len(own.rstrip(_LOCAL)))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        end = m.end() if m else end
        if m:
            out.append(("email", start, end))
        else:
            end = at + 1
        at = text.find("@", end)
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m.group().split("."))):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if 16 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


_AT = re.compile(r" ?(?:\[at\]|\(at\)|\{at\}) ?| at (?=[A-Za-z0-9-]+ dot )", re.I)
_DOT_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:(?: ?(?:\[dot\]|\(dot\)|\{dot\}|\[\.\]) ?| dot |\.)[A-Za-z0-9-]+)+", re.I)
_ZONE = re.compile(r"(?:\+\(?|\(\+?)?[0-9](?:[ ().\-\[\]/]{0,3}[0-9])+")


def candidates(text: str) -> Iterator[list[tuple[str, int, int]]]:
    """Lists of candidates (kind, start, end), one for each zone: a respelled address, or digits near one another.

    Time and candidates are in proportion to the text. A number may begin with a plus, a bracket or both.
    """
    end = 0
    for m in _AT.finditer(text):
        own = text[end : m.start()]  # what a match holds isn't part of a name, so none reaches back further
        end, start = m.end(), m.start() - (len(own) - len(own.rstrip(_LOCAL)))
        d = _DOT_DOMAIN.match(text, m.end())
        if d and start < m.start():
            yield [("email", start, d.end())]
    for m in _ZONE.finditer(text):
        if m.end() - m.start() < 7:
            continue
        groups, found, free = [g.span() for g in _GROUP.finditer(text, *m.span())], [], m.start()
        for i, (start, stop) in enumerate(groups):
            signs = start
            while signs > free and start - signs < 2 and text[signs - 1] in "+(" and text[signs - 1] not in text[signs:start]:
                signs -= 1
            free, n = stop, 0
            for a, b in groups[i : i + GROUPS]:
                n += b - a
                if n > 19:
                    break
                if 7 <= n <= 15:
                    found += [("phone", s, b) for s in range(start, signs - 1, -1)]
                if n >= 16:
                    found.append(("card", start, b))
                if 4 <= n <= 12 and i + 3 < len(groups) and groups[i + 3] == (a, b):
                    found.append(("ip", start, b))
        if found:
            yield found


def features(text: str, kind: str, start: int, end: int) -> list[str]:
    """Features of a whole segment and what stands around it."""
    span = text[start:end]
    gaps = re.sub(r"[A-Za-z0-9]+", "x", span)
    sizes = ".".join(str(min(9, b - a)) for a, b in (g.span() for g in _GROUP.finditer(span)))
    digits = _digits(span)
    before = text[max(0, start - 24) : start]
    word = (re.findall(r"[^\W\d_]+", before) or [""])[-1].lower()
    glued = before[-1:].isalnum() or before[-1:] in set("=#_") or text[end : end + 1].isalnum()
    f = ["bias", f"gaps={gaps[:24]}", f"sizes={sizes}", f"n={len(digits)}", f"glued={glued}", f"word={word}", f"plus={span[:1] == '+'}", f"before={before[-1:] in ('+', '(', '.', '-')}", f"after={text[end : end + 2].strip()[:1] in '-./' and text[end + 1 : end + 2].isdigit()}"]
    if kind == "card":
        f.append(f"luhn={luhn(digits)}")
    if kind == "ip":
        f.append(f"octets={all(int(g) <= 255 for g in _GROUP.findall(span))}")
    return [f"{kind}:{x}" for x in f]


class Field:
    """Weights of a semi-Markov field; what lies between segments scores 0."""

    def __init__(self, weights: dict[str, float]):
        self.w = weights

    def scores(self, text: str, found: list[tuple[str, int, int]]) -> list[float]:
        return [sum(self.w.get(f, 0.0) for f in features(text, *c)) for c in found]

    @staticmethod
    def _places(found) -> tuple[list[int], list[tuple[int, int]]]:
        cuts = sorted({x for _, a, b in found for x in (a, b)})
        at = {x: i for i, x in enumerate(cuts)}
        return cuts, [(at[a], at[b]) for _, a, b in found]

    def best(self, text: str, found: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """Segments of the likeliest segmentation; the first of equals."""
        cuts, spans = self._places(found)
        ends = defaultdict(list)
        for k, s in enumerate(self.scores(text, found)):
            ends[spans[k][1]].append((k, s))
        score, back = [0.0] * len(cuts), [-1] * len(cuts)
        for j in range(1, len(cuts)):
            score[j] = score[j - 1]
            for k, s in ends[j]:
                if score[spans[k][0]] + s > score[j] + 1e-12:
                    score[j], back[j] = score[spans[k][0]] + s, k
        out, j = [], len(cuts) - 1
        while j > 0:
            if back[j] < 0:
                j -= 1
            else:
                out.append(found[back[j]])
                j = spans[back[j]][0]
        return out[::-1]

    def marginals(self, text: str, found: list[tuple[str, int, int]]) -> np.ndarray:
        """Probability of each candidate, by sums forward and backward over segment ends."""
        cuts, spans = self._places(found)
        s, n = np.array(self.scores(text, found)), len(cuts)
        ends, begins = defaultdict(list), defaultdict(list)
        for k, (a, b) in enumerate(spans):
            ends[b].append(k)
            begins[a].append(k)
        f, g = [0.0] * n, [0.0] * n
        for j in range(1, n):
            f[j] = _logsum([f[j - 1], *(f[spans[k][0]] + s[k] for k in ends[j])])
        for j in range(n - 2, -1, -1):
            g[j] = _logsum([g[j + 1], *(g[spans[k][1]] + s[k] for k in begins[j])])
        return np.array([math.exp(min(0.0, f[a] + x + g[b] - f[-1])) for (a, b), x in zip(spans, s)])


def _logsum(x: list[float]) -> float:
    m = max(x)
    return m + math.log(sum(math.exp(v - m) for v in x))


def respelled(text: str, turn: int) -> tuple[str, set[tuple[str, int, int]]]:
    """The text with its matches written in another way, and where they are then; turn 0 leaves it."""
    spans, kept, end = sorted(base_spans(text), key=lambda s: (s[1], -s[2])), [], 0
    for s in spans:
        if s[1] >= end:
            kept.append(s)
            end = s[2]
    out, gold, at, total = [], set(), 0, 0
    for kind, a, b in kept:
        own = text[a:b]
        if turn and kind == "email":
            own = own.replace("@", (" [at] ", " at ")[turn % 2]).replace(".", (" [dot] ", " dot ")[turn % 2]) if own.split("@")[0].isalnum() else own.replace("@", " (at) ")
        elif turn and kind == "ip":
            own = own.replace(".", ("[.]", " . ")[turn % 2])
        elif turn and kind == "card":
            d = _digits(own)
            own = (".", " . ")[turn % 2].join(d[i : i + 4] for i in range(0, len(d), 4))
        elif turn and kind == "phone":
            own = re.sub(r"^\+[0-9]+[ -]?", "", own) if turn % 2 else own.replace(" ", ".")
        out += [text[at:a], own]
        total += len(out[-2]) + len(own)
        gold.add((kind, total - len(own), total))
        at = b
    return "".join([*out, text[at:]]), gold


def train(texts: list[str], rounds: int = 4, rate: float = 0.3) -> Field:
    """Maximum conditional likelihood by AdaGrad over zones, texts as they are and respelled twice."""
    zone_data = []
    for t in texts:
        for turn in range(3):
            new, gold = respelled(t, turn)
            for z in candidates(new):
                at = max(0, min(a for _, a, _ in z) - 40)
                zone_data.append((new[at : max(b for _, _, b in z) + 40], [(k, a - at, b - at) for k, a, b in z], [c in gold for c in z]))
    w: dict[str, float] = defaultdict(float)
    seen: dict[str, float] = defaultdict(lambda: 1e-6)
    field = Field(w)
    order = np.random.default_rng(3)
    for _ in range(rounds):
        for i in order.permutation(len(zone_data)):
            text, found, gold = zone_data[i]
            for c, y, p in zip(found, gold, field.marginals(text, found)):
                if abs(y - p) > 1e-3:
                    for f in features(text, *c):
                        g = y - p
                        seen[f] += g * g
                        w[f] += rate * g / math.sqrt(seen[f]) - 1e-4 * w[f]
    return Field(dict(w))


def find(text: str, field: Field) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), by kind and start. Added spans overlap neither base ones nor one another.

    One program over all candidates of the text that are clear of base spans.
    """
    base = base_spans(text)
    begins: list[int] = []
    stops: list[int] = []
    for _, a, b in sorted(base, key=lambda s: s[1]):  # what base spans cover, as runs
        if stops and a < stops[-1]:
            stops[-1] = max(stops[-1], b)
        else:
            begins.append(a)
            stops.append(b)

    def clear(start: int, end: int) -> bool:
        i = bisect_left(begins, end) - 1  # the last run that begins before the end
        return i < 0 or stops[i] <= start

    free = [c for z in candidates(text) for c in z if clear(c[1], c[2])]
    if not free:
        return base, base
    return base, sorted(base + field.best(text, free), key=lambda s: (KINDS.index(s[0]), s[1]))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each span, or run of overlapping spans, as the kind of its first in brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_pieces: int = SAMPLE_PIECES, piece_chars: int = PIECE_CHARS) -> dict[str, float]:
    """Weights from at most ``sample_pieces`` pieces with triggers.

    Texts of any length are cut at white space into pieces of at most ``piece_chars`` characters, so that what the driver
    gets has a bound. Documents are taken by a hash of their id; where too few have triggers, more of them are.
    """
    rows = docs.select(F.xxhash64(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("h"), F.col(text_col).alias("text"))
    share = min(1.0, 2 * sample_pieces / max(rows.count(), 1))
    pieces = F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{piece_chars}}}(?!\S)|.{{1,{piece_chars}}}"), F.lit(0))
    while True:
        some = rows if share >= 1 else rows.where(F.col("h") < F.lit(int((share - 0.5) * 2**64)))
        found = cut(some.select("h", F.posexplode(pieces).alias("i", "piece")).where(F.col("piece").rlike(_TRIGGER)), "pii-pieces")
        if share >= 1 or (n := found.count()) >= sample_pieces:
            break
        share = min(1.0, share * max(2.0, 1.3 * sample_pieces / max(n, 1)))
    return train([r[0] for r in found.orderBy(F.xxhash64("h", "i"), "h", "i", "piece").limit(sample_pieces).select("piece").collect()]).w


def scan(docs: DataFrame, weights: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``pii_base`` and ``pii_spans`` (kind:start:end, comma-joined; code points, end exclusive) and ``pii_redacted``.

    Columns of ``docs`` with these names are replaced. A null text has no span and stays null when redacted.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(weights)
    schema = "struct<base:string,spans:string,redacted:string>"

    @F.arrow_udf(schema)
    def each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        field = Field(shared.value)
        join = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        for b in batches:
            out = []
            for t in b.to_pylist():
                base, spans = find(t or "", field)
                out.append((join(base), join(spans), redact(t, spans) if t is not None else None))
            yield pa.StructArray.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(3)], ["base", "spans", "redacted"])

    out = docs.withColumn("pii_found", each(F.col(text_col)))
    return out.withColumns({"pii_base": F.col("pii_found.base"), "pii_spans": F.col("pii_found.spans"), "pii_redacted": F.col("pii_found.redacted")}).drop("pii_found")
