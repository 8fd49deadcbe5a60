"""Personal data: fixed patterns, and candidates that boosted trees judge by their form and what stands around them."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Texts of the sample that the trees are fitted on, characters of each (a window of the text), and examples planted in each.
SAMPLE_TEXTS, SAMPLE_CHARS, PLANTED = 600, 1000, 6
TREES, DEPTH, RATE, BINS, LEAST_LEAF = 60, 3, 0.2, 32, 8
#: The share of redactions that must be right, on the part of the sample that the trees don't see.
PRECISION = 0.98
#: Characters before and after a candidate that count as its context.
BEFORE, AFTER = 40, 16

# Possessive forms of the patterns: a run of digits can only be left at its end, so no text is read twice.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: A wider net. Digits with what may stand between them; at signs and words for them; domains with words for their dots.
_CLUSTER = re.compile(r"[0-9](?:[\x20\xa0().,/·-]{0,3}[0-9]|\[\.\][0-9])++")
_AT = re.compile(r"[\x20]?[\[({<][\x20]?(?:at|AT|At|@|æt)[\x20]?[\])}>][\x20]?|[\x20](?:at|AT|@)[\x20]|＠|@")
_DOTTED = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?:[\x20]?[\[({<][\x20]?(?:dot|DOT|\.)[\x20]?[\])}>][\x20]?|[\x20](?:dot|DOT)[\x20]|\.)[A-Za-z0-9-]{1,63})+")

#: Groups of digits that a number has at most.
MOST_GROUPS = 6

#: Words that tell what a number or name is, fixed values.
CUES: Mapping[str, tuple[str, ...]] = {
    "email": ("mail", "contact", "write", "correo", "schreib", "courriel", "reach"),
    "ip": ("ip", "host", "server", "addr", "ping", "subnet", "login from"),
    "card": ("card", "visa", "credit", "payment", "karte", "carte", "tarjeta", "mastercard"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "cell", "ring", "whatsapp", "sms"),
    "none": ("version", "order", "invoice", "isbn", "price", "token", "id", "page", "section", "release", "sku", "build", "ref", "serial"),
}
_NUMBERS_OF = {k: re.compile("|".join(rf"\b{re.escape(w)}" for w in words)) for k, words in CUES.items()}
TOP_DOMAINS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "info", "eu")


class Span(NamedTuple):
    start: int
    kind: int
    end: int


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _is_byte(part: str) -> bool:
    return len(part.lstrip("0")) < 4 and int(part.lstrip("0") or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """What the fixed patterns find, in order: leftmost matches of each kind that don't overlap, without those that fail their check."""
    out: list[Span] = []
    at, floor = text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(Span(start, 0, m.end()))
        floor = m.end() if m else at + 1
        at = text.find("@", floor)
    out += [Span(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_is_byte, m.group().split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append(Span(m.start(), 2, m.end()))
    out += [Span(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return sorted(out)


def candidates(text: str) -> Iterator[Span]:
    """Overlapping spans that may be personal data: many are not."""
    if "@" in text or "＠" in text or "at" in text or "AT" in text:
        for m in _AT.finditer(text):
            d = _DOTTED.match(text, m.end())
            start = m.start()
            while start > max(0, m.start() - 64) and text[start - 1] in _LOCAL:
                start -= 1
            if d and start < m.start():
                yield Span(start, 0, d.end())
    for m in _CLUSTER.finditer(text):
        if m.end() - m.start() < 7:
            continue
        groups = [(m.start() + g.start(), m.start() + g.end()) for g in re.finditer("[0-9]+", m.group())]
        for i, (a, b) in enumerate(groups):
            n, short, gaps = b - a, b - a, set()
            for j in range(i, min(i + MOST_GROUPS, len(groups))):
                if j > i:
                    n, short = n + groups[j][1] - groups[j][0], min(short, groups[j][1] - groups[j][0])
                    gaps.add(text[groups[j - 1][1] : groups[j][0]])
                if n > 19 or short < 2 and j >= i + 4:
                    break
                end = groups[j][1]
                if j - i == 3 and len(gaps) == 1 and gaps.isdisjoint((".", " ")) and all(d - c <= 3 for c, d in groups[i : j + 1]):
                    yield Span(a, 1, end)
                if 12 <= n and short >= 3:
                    yield Span(a, 2, end)
                if 7 <= n <= 15 and short >= 2:
                    yield Span(a - 1 if a and text[a - 1] in "(+" else a, 3, end)


def _judged(text: str, base: Sequence[Span]) -> Iterator[Span]:
    """The candidates that overlap no base span, in order."""
    taken = iter(base)
    held = next(taken, None)
    for c in sorted(set(candidates(text))):
        while held and held.end <= c.start:
            held = next(taken, None)
        if not held or held.start >= c.end:
            yield c


def features(text: str, span: Span) -> list[float]:
    """The form of a candidate and what stands around it, as numbers."""
    start, kind, end = span
    form = text[start:end]
    digits = _digits(form)
    groups = [len(g) for g in re.findall("[0-9]+", form)]
    between = [c for c in form if not c.isalnum()]
    before, after = text[max(0, start - BEFORE) : start].lower(), text[end : end + AFTER]
    near = (before + " " + after).lower()
    last = re.findall("[A-Za-z]+", form)
    gaps = re.findall("[^0-9]+", form.strip("(+"))
    values = [int(g) for g in re.findall("[0-9]{1,3}", form)] if kind == 1 else [0]
    return [
        *(float(kind == k) for k in range(4)),
        len(form), len(digits), len(groups), max(groups, default=0), groups[0] if groups else 0, groups[-1] if groups else 0,
        float(luhn(digits)) if digits else 0.0, float(max(values) <= 255), float(min(values, default=0) == 0),
        len(between), len(set(between)), float("(" in form), float("." in form), float("-" in form), float("," in form), float("/" in form),
        float(form[0] == "(" or (bool(before) and before[-1] == "+")), float(digits[:2] == "00"), len(set(digits)),
        float(bool(last) and last[-1].lower() in TOP_DOMAINS), len(last[-1]) if last else 0, float("@" in form), float("dot" in form.lower() or "[" in form or "(" in form),
        float(bool(before) and (before[-1].isalnum() or before[-1] in "._@")), float(bool(after) and (after[0].isalnum() or after[0] == "@")), float(after[1:2].isdigit() and after[:1] in ".-,/ "),
        float(len(set(gaps)) == 1), float(len(set(groups)) == 1), groups[1] if len(groups) > 1 else 0, max(map(len, gaps), default=0), float("[.]" in form or "·" in form), float(before[-1:] in " .-,/" and before[-2:-1].isdigit()),
        float(bool(before) and before[-1] in "\"'=#$€£"), sum(c.isdigit() for c in near) / (len(near) or 1),
        *(float(bool(p.search(before))) for p in _NUMBERS_OF.values()),
    ]


class Trees:
    """Boosted trees of fixed depth on binned features for yes or no: leaves are Newton steps of the logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE):
        self.depth, self.bias = depth, 0.0
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(y) == 0:
            return
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.bias = float(np.log(share / (1 - share)))
        binned = self._bins(x)
        f = np.full(len(y), self.bias)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-f))
            grown = self._grow(binned, y - p, p * (1 - p), depth, rate)
            self.trees.append(grown)
            f += self._leaves(binned, grown)

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], 1) if x.size else np.zeros(x.shape, np.int64)

    @staticmethod
    def _grow(b: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """feature and bin of each inner node (rows at or below the bin go left; feature -1 sends all left), and the leaves."""
        feature, cut = np.full((1 << depth) - 1, -1), np.zeros((1 << depth) - 1, np.int64)
        node = np.zeros(len(b), np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            best = np.full(width, 1e-9)
            for j in range(b.shape[1]):
                at = node * BINS + b[:, j]
                gain_of = lambda gs, hs: gs * gs / (hs + 1.0)
                gs, hs, ns = (np.bincount(at, w, width * BINS).reshape(width, BINS).cumsum(1) for w in (g, h, np.ones(len(g))))
                gain = gain_of(gs, hs) + gain_of(gs[:, -1:] - gs, hs[:, -1:] - hs) - gain_of(gs[:, -1:], hs[:, -1:])
                gain[(ns < LEAST_LEAF) | (ns[:, -1:] - ns < LEAST_LEAF)] = 0
                top = gain.argmax(1)
                better = gain[np.arange(width), top] > best
                best = np.where(better, gain[np.arange(width), top], best)
                feature[first : first + width][better] = j
                cut[first : first + width][better] = top[better]
            f = feature[first + node]
            right = (f >= 0) & (b[np.arange(len(b)), np.maximum(f, 0)] > cut[first + node])
            node = node * 2 + right
        sums = [np.bincount(node, w, 1 << depth) for w in (g, h)]
        return feature, cut, rate * sums[0] / (sums[1] + 1.0)

    def _leaves(self, b: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        feature, cut, leaf = tree
        node = np.zeros(len(b), np.int64)
        for level in range(self.depth):
            at = (1 << level) - 1 + node
            f = feature[at]
            node = node * 2 + ((f >= 0) & (b[np.arange(len(b)), np.maximum(f, 0)] > cut[at]))
        return leaf[node]

    def scores(self, x: np.ndarray) -> np.ndarray:
        b = self._bins(x)
        return self.bias + sum((self._leaves(b, t) for t in self.trees), np.zeros(len(x)))


@dataclass
class Model:
    """Trees, the line that turns their scores into probabilities, and of each kind the least probability that is redacted."""

    trees: Trees
    slope: float
    offset: float
    thresholds: Sequence[float]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.trees.scores(x) + self.offset)))


def _planted(rng: random.Random) -> tuple[str, str, int]:
    """A phrase before, something that is personal data or looks like it, and its kind (-1: none)."""
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8)))
    cue = lambda k, often=0.5: rng.choice(CUES[k]) + rng.choice([" ", ": ", " is "]) if rng.random() < often else ""
    kind = rng.randrange(10)
    if kind == 0:
        at, dot = rng.choice([("(at)", "(dot)"), (" at ", " dot "), ("[at]", "[dot]"), (" (at) ", "."), ("@", " dot "), ("＠", "."), (" @ ", "."), ("{at}", ".")])
        return cue("email"), word() + rng.choice([".", "_", ""]) + word() + at + word() + dot + rng.choice(TOP_DOMAINS), 0
    if kind == 1:
        return cue("phone"), rng.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "({}) {} {}"]).format(number(3), number(3), number(4)), 3
    if kind == 2:
        return cue("phone", 0.8), f"00{rng.choice(['44', '46', '49', '33', '34'])} {number(rng.randint(2, 3))} {number(rng.randint(6, 7))}", 3
    if kind == 3:
        body = rng.choice("3456") + number(14)
        card = next(body + c for c in "0123456789" if luhn(body + c))
        return cue("card"), rng.choice([".", "\xa0", "  ", "/", " - "]).join(card[i : i + 4] for i in range(0, 16, 4)), 2
    if kind == 4:
        return cue("ip", 0.8), rng.choice(["[.]", "·"]).join(str(rng.randint(1, 255)) for _ in range(4)), 1
    if kind == 5:
        return cue("none"), rng.choice([number(9), number(10), number(16), f"{number(4)}-{number(2)}-{number(2)}", f"{number(3)}-{number(1)}-{number(5)}-{number(3)}"]), -1
    if kind == 6:
        return cue("none"), ".".join(number(rng.randint(1, 4)) for _ in range(rng.choice([3, 4, 5]))) + rng.choice(["-rc1", "", ".x"]), -1
    if kind == 7:
        return cue("none"), ",".join([number(3)] * rng.randint(3, 5)), -1
    if kind == 8:
        return "", f"{word()} at {word()} {rng.choice(['.', 'dot', 'and'])} {word()}", -1
    return cue("none"), rng.choice([" ", ".", "/"]).join(number(rng.randint(2, 5)) for _ in range(rng.randint(3, 5))), -1


def fit(texts: Sequence[str], seed: int = 7) -> Model:
    """A model from texts, with examples planted between their words.

    Labels come from the planting: of the candidates that no fixed pattern
    touches, which are those to be judged, planted data are right; parts of it,
    decoys, and all else in the texts are wrong. Every other text
    calibrates: a logistic line from scores to probabilities, and for each kind
    the least threshold from which on PRECISION of the candidates are right
    (none is redacted if there is no such threshold).
    """
    rng = random.Random(seed)
    rows: list[tuple[int, int, int, list[float]]] = []
    contexts = [t for t in texts if t.strip()] or ["some words before and some words after this"]
    while len(contexts) < 60:
        contexts = contexts * 2
    for at, text in enumerate(contexts):
        for _ in range(PLANTED):
            phrase, thing, kind = _planted(rng)
            place = rng.randrange(len(text) + 1)
            while 0 < place < len(text) and not text[place].isspace():
                place += 1
            before = text[:place] + " " + phrase
            whole, start = before + thing + rng.choice([" ", ". ", ", "]) + text[place:].lstrip(), len(before)
            planted = Span(start, kind, start + len(thing))
            rows += [(at, c.kind, int(c == planted), features(whole, c)) for c in _judged(whole, base_spans(whole))]
    of, kinds, y = (np.array([r[k] for r in rows]) for k in range(3))
    x = np.array([r[3] for r in rows], float)
    seen = of % 2 == 0
    trees = Trees(x[seen], y[seen])
    s, t, k = trees.scores(x[~seen]), y[~seen], kinds[~seen]
    slope, offset = 1.0, 0.0
    for _ in range(200):  # Newton steps would need care where the scores part the labels
        p = 1 / (1 + np.exp(-(slope * s + offset)))
        slope += 0.05 * float(np.mean((t - p) * s))
        offset += 0.05 * float(np.mean(t - p))
    model = Model(trees, slope, offset, [])
    p = model.probabilities(x[~seen])
    model.thresholds = [_threshold(p[k == j], t[k == j]) for j in range(len(KINDS))]
    return model


def _threshold(p: np.ndarray, right: np.ndarray) -> float:
    order = np.argsort(-p, kind="stable")
    shares = np.cumsum(right[order]) / np.arange(1, len(p) + 1)
    good = np.flatnonzero((shares >= PRECISION) & (np.append(p[order][1:], -1.0) < p[order]))
    return max(0.5, float(p[order][good[-1]])) if len(good) and right[order][: good[-1] + 1].any() else float("inf")


def sample_texts(docs: DataFrame, text: str = "text", texts: int = SAMPLE_TEXTS, chars: int = SAMPLE_CHARS) -> list[str]:
    """At most `texts` windows of `chars` characters, of the texts with the least hashes; the sample is the same however the rows are dealt."""
    rows = docs.where(F.length(text) > 0).withColumn("h", F.xxhash64(text))
    least = rows.select("h").distinct().orderBy("h").limit(texts)  # hashes first: copies count once, and texts stay where they are
    at = F.pmod(F.xxhash64(F.lit(1), text), F.greatest(F.length(text) - chars, F.lit(1))).cast("int")
    window = F.substring(F.col(text), at + 1, F.lit(chars))
    return [r.t for r in rows.join(F.broadcast(least), "h").groupBy("h").agg(F.min(window).alias("t")).orderBy("h").collect()]


def _added(model: Model, texts: Sequence[str], bases: Sequence[list[Span]]) -> list[list[tuple[Span, float]]]:
    """Candidates that reach their threshold, best first where they overlap, none over a base span."""
    found: list[tuple[int, Span]] = []
    rows: list[list[float]] = []
    for i, (text, base) in enumerate(zip(texts, bases, strict=True)):
        for c in _judged(text, base):
            found.append((i, c))
            rows.append(features(text, c))
    out: list[list[tuple[Span, float]]] = [[] for _ in texts]
    if not rows:
        return out
    p = model.probabilities(np.array(rows, float))
    reach = [j for j in np.argsort(-p, kind="stable") if p[j] >= model.thresholds[found[j][1].kind]]
    used: dict[int, list[Span]] = {}
    for j in reach:
        i, c = found[j]
        own = used.setdefault(i, [])
        if not any(c.start < s.end and s.start < c.end for s in own):
            own.append(c)
            out[i].append((c, float(p[j])))
    return out


SPANS = "array<struct<start:int,kind:int,end:int,base:boolean,score:double>>"


def find(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with `pii`: start, kind (place in KINDS), end, base, score of each span, by start and kind.

    Offsets are code points, ends exclusive. Spans of the fixed patterns have
    the score 1 and stay; the model adds spans that overlap neither these nor
    each other. Null and empty texts have none. Rows are judged one by one, in
    Arrow batches, whole; other columns are kept, and a column named pii is
    replaced.
    """

    @F.arrow_udf(SPANS)
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())]))
        for batch in batches:
            texts = [t or "" for t in batch.to_pylist()]
            bases = [base_spans(t) for t in texts]
            rows = []
            for base, more in zip(bases, _added(model, texts, bases), strict=True):
                both = [(s, True, 1.0) for s in base] + [(s, False, p) for s, p in more]
                rows.append([{"start": s.start, "kind": s.kind, "end": s.end, "base": b, "score": p} for s, b, p in sorted(both)])
            yield pa.array(rows, kind)

    return docs.withColumn("pii", judged(F.col(text)))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(found: DataFrame, text: str = "text") -> DataFrame:
    """What `find` gives, the text's spans replaced by [EMAIL], [IP], [CARD] or [PHONE]; of overlapping spans the first hides the rest up to its end."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    first = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def hide(state: Column, s: Column) -> Column:
        visible = F.substring(F.col(text), state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        mark = F.when(s["start"] >= state["at"], F.get(names, s["kind"])).otherwise("")
        return F.struct(F.concat(state["out"], visible, mark).alias("out"), F.greatest(state["at"], s["end"]).alias("at"))

    done = F.aggregate("pii", first, hide)
    hidden = F.concat(done["out"], F.substring(F.col(text), done["at"] + 1, F.length(text)))
    return found.withColumn(text, F.when(F.size("pii") > 0, hidden).otherwise(F.col(text)))


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_email, n_ip, n_card, n_phone and base_sha256 of the fixed patterns, spans (all) and n_added, with a model of the rows' own sample."""
    found = find(docs.select(key, text), fit(sample_texts(docs, text)), text)
    base = F.filter("pii", lambda s: s["base"])
    n_base = lambda k: F.size(F.filter("pii", lambda s: s["base"] & (s["kind"] == k)))
    counts = [n_base(k).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select(key, *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("pii")).alias("spans"), F.size(F.filter("pii", lambda s: ~s["base"])).alias("n_added"))
