"""Personal data by fixed patterns and a semi-Markov conditional random field.

The patterns give the base spans. The field adds spans that the patterns miss (written-out or bracketed addresses, numbers without their usual marks): text
around a digit, ``@`` or a written-out mark is cut into tokens, every run of at most ``MOST_TOKENS`` tokens is a candidate segment of each kind, its score is
linear in features of the whole span, and a dynamic programme over segments picks boundaries and kinds together. A chosen span is added if it touches
no base span and its score exceeds ``MARGIN``.

The weights are fitted on the corpus itself: up to ``TRAIN_REGIONS`` stretches of text around base spans, those of the smallest hash of their text, with the
base spans as labels, and rewritten copies of them as further examples. Fitting runs on the driver on that bounded sample; the weights are a few hundred
numbers. Without base spans nothing is added.

A null text has no spans. Empty tables give no rows; null and repeated ``doc_id`` rows are documents of their own. Positions are code points, end exclusive.
"""
from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmap.llm.arrow import arrow_schema

KINDS = ("email", "ip", "card", "phone")
MOST_TOKENS = 16
TRAIN_REGIONS = 150
MOST_REGION = 400                # tokens; a longer stretch is cut at its next blank
MARGIN = 2.0
ROUNDS, RATE, DECAY = 80, 0.1, 1e-3
Span = tuple[int, int, str]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"[^\W\d_]+|\d+|\s+|.", re.S)
_MARKS = (" dot ", "[at]", "(at)", "[dot]", "(dot)")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _octet(part: str) -> bool:
    return len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def base_spans(text: str) -> list[Span]:
    """The matches of the patterns, leftmost and non-overlapping per kind, by start and then kind; linear in the text."""
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        tail = _DOMAIN.match(text, at)
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        if tail and begin < at:
            out.append((begin, done := tail.end(), "email"))
        at = text.find("@", at + 1)
    if _DIGIT.search(text):
        out += [(*m.span(), "ip") for m in _IP.finditer(text) if all(map(_octet, m.group().split(".")))]
        out += [(*m.span(), "card") for m in _CARD.finditer(text) if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
        if "+" in text:
            out += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


class Region:
    """Tokens around a mark: their texts and where each begins; the end of the last token closes ``starts``."""

    def __init__(self, text: str, begin: int, end: int):
        found = list(_TOKEN.finditer(text, begin, end))
        self.text, self.tokens = text, [m.group() for m in found]
        self.starts = [m.start() for m in found] + [found[-1].end() if found else end]


_NEAR = 40


def regions(text: str) -> Iterator[Region]:
    """Stretches of text around digits, ``@`` and written-out marks, in order; they do not overlap."""
    if "@" not in text and not _DIGIT.search(text) and not any(m in text for m in _MARKS):
        return
    spots = sorted([m.start() for m in re.finditer(r"[0-9]+|@", text)] + [m.start() for w in _MARKS for m in re.finditer(re.escape(w), text)])
    begin = end = -1
    held: list[tuple[int, int]] = []
    for p in spots:
        if begin >= 0 and p - _NEAR <= end:
            end = p + _NEAR
        else:
            if begin >= 0:
                held.append((begin, end))
            begin, end = max(0, p - _NEAR), p + _NEAR
    held.append((begin, end))
    for a, b in held:
        b = min(b, len(text))
        while b - a > 4 * MOST_REGION:
            cut = text.find(" ", a + 3 * MOST_REGION, b)
            cut = cut if cut > 0 else min(b, a + 4 * MOST_REGION)
            yield Region(text, a, cut)
            a = cut
        if b > a:
            yield Region(text, a, b)


FEATURES = ["bias", "at", "written at", "dots0", "dots1", "dots2", "dots3+", "written dot", "plus first", "octets", "luhn12-19", "digits<7", "digits7-8", "digits9-11",
            "digits12-15", "digits16-19", "digits20+", "letters", "letters first", "letters last", "digit first", "digit last", "bracket first", "odd mark",
            "blank", "two blanks+", "dash", "bracket", "before joins", "after joins", "tokens1", "tokens2-4", "tokens5-8", "tokens9+"]
_PLACE = {f: i for i, f in enumerate(FEATURES)}


def _features(region: Region, a: int, b: int) -> list[str]:
    """Features of the whole span of tokens a..b-1."""
    own = region.text[region.starts[a]:region.starts[b]]
    low, digits = own.lower(), _digits(own)
    n, dots = len(digits), own.count(".")
    blanks = sum(c.isspace() for c in own)
    letters = any(c.isalpha() for c in own)
    out = ["bias", f"dots{dots}" if dots < 3 else "dots3+",
           "digits<7" if n < 7 else "digits7-8" if n < 9 else "digits9-11" if n < 12 else "digits12-15" if n < 16 else "digits16-19" if n < 20 else "digits20+",
           "tokens1" if b - a == 1 else "tokens2-4" if b - a < 5 else "tokens5-8" if b - a < 9 else "tokens9+"]
    parts = own.split(".")
    before = region.tokens[a - 1][-1] if a else " "
    after = region.tokens[b][0] if b < len(region.tokens) else " "
    follow = region.tokens[b + 1][0] if b + 1 < len(region.tokens) else " "
    for name, holds in (("at", own.count("@") == 1), ("written at", " at " in low or "[at]" in low or "(at)" in low), ("written dot", " dot " in low or "[dot]" in low),
                        ("plus first", own[0] == "+"), ("octets", len(parts) == 4 and all(p.isascii() and p.isdigit() and _octet(p) for p in parts)),
                        ("luhn12-19", 12 <= n <= 19 and luhn(digits)), ("letters", letters), ("letters first", own[0].isalpha()), ("letters last", own[-1].isalpha()),
                        ("digit first", own[0].isdigit()), ("digit last", own[-1].isdigit()), ("bracket first", own[0] == "("),
                        ("odd mark", any(not c.isalnum() and not c.isspace() and c not in ".@+-()[]" for c in own)), ("blank", blanks == 1), ("two blanks+", blanks > 1),
                        ("dash", "-" in own), ("bracket", "(" in own), ("before joins", before.isalnum() or before in "@+.-"),
                        ("after joins", after.isalnum() or after == "@" or after in ".-" and follow.isalnum())):
        if holds:
            out.append(name)
    return out


def candidates(region: Region) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start token, end token and feature rows of every candidate segment: bounded runs with a mark inside and no blank at either end."""
    marks = [t[0].isdigit() or t == "@" or t.lower() in ("at", "dot") for t in region.tokens]
    upto = np.concatenate([[0], np.cumsum(marks)])
    spans, rows = [], []
    for a, token in enumerate(region.tokens):
        if token.isspace() or not (token.isalnum() or token in "+("):
            continue
        for b in range(a + 1, min(len(region.tokens), a + MOST_TOKENS) + 1):
            last = region.tokens[b - 1]
            if "\n" in last:
                break
            if upto[b] > upto[a] and last.isalnum():
                spans.append((a, b))
                row = np.zeros(len(FEATURES))
                row[[_PLACE[f] for f in _features(region, a, b)]] = 1
                rows.append(row)
    if not spans:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, len(FEATURES)))
    start, end = np.array(spans).T
    return start, end, np.array(rows)


def decode(region: Region, weights: np.ndarray) -> list[Span]:
    """The segments of the best segmentation; a token outside of all segments scores 0."""
    start, end, rows = candidates(region)
    n = len(region.tokens)
    if not len(start):
        return []
    scores = rows @ weights - MARGIN
    kind = scores.argmax(1)
    gain = scores.max(1)
    best, back = np.zeros(n + 1), np.full(n + 1, -1)
    by_end = np.argsort(end, kind="stable")
    at = 0
    for b in range(1, n + 1):
        best[b] = best[b - 1]
        while at < len(by_end) and end[by_end[at]] == b:
            s = by_end[at]
            if best[start[s]] + gain[s] > best[b]:
                best[b], back[b] = best[start[s]] + gain[s], s
            at += 1
    out, b = [], n
    while b > 0:
        s = back[b]
        if s < 0:
            b -= 1
        else:
            out.append((region.starts[start[s]], region.starts[b], KINDS[kind[s]]))
            b = start[s]
    return out[::-1]


def _log_sum(x: np.ndarray) -> float:
    m = x.max()
    return m + np.log(np.exp(x - m).sum())


def fit(examples: list[tuple[str, list[Span]]]) -> np.ndarray | None:
    """Maximum likelihood weights by gradient steps over (text, spans) examples; forward and backward sums run over segments."""
    data = []
    for text, spans in examples:
        region = Region(text, 0, len(text))
        start, end, rows = candidates(region)
        places = {(region.starts[a], region.starts[b]): i for i, (a, b) in enumerate(zip(start.tolist(), end.tolist()))}
        gold = np.zeros((len(start), len(KINDS)))
        free = 0
        if len(start) and all((a, b) in places for a, b, _ in spans):
            for a, b, kind in spans:
                if a >= free:
                    gold[places[a, b], KINDS.index(kind)], free = 1, b
            data.append((start, end, rows, gold, len(region.tokens)))
    if not any(g.any() for *_, g, _ in data):
        return None
    weights, seen = np.zeros((len(FEATURES), len(KINDS))), np.ones((len(FEATURES), len(KINDS)))
    weights[0] = -4.0
    for _ in range(ROUNDS):
        slope = -DECAY * len(data) * weights
        for start, end, rows, gold, n in data:
            scores = rows @ weights
            total = np.logaddexp.reduce(scores, axis=1)
            ahead, behind = np.zeros(n + 1), np.zeros(n + 1)
            ends, begins = np.argsort(end, kind="stable"), np.argsort(start, kind="stable")
            cut_e, cut_s = np.searchsorted(end[ends], np.arange(n + 2)), np.searchsorted(start[begins], np.arange(n + 2))
            for b in range(1, n + 1):
                own = ends[cut_e[b]:cut_e[b + 1]]
                ahead[b] = _log_sum(np.append(ahead[start[own]] + total[own], ahead[b - 1]))
            for a in range(n - 1, -1, -1):
                own = begins[cut_s[a]:cut_s[a + 1]]
                behind[a] = _log_sum(np.append(behind[end[own]] + total[own], behind[a + 1]))
            share = np.exp(ahead[start][:, None] + scores + behind[end][:, None] - ahead[n])
            slope += rows.T @ (gold - share)
        seen = 0.9 * seen + 0.1 * slope ** 2
        weights += RATE * slope / np.sqrt(seen)
    return weights


def _rewritten(text: str, spans: list[Span]) -> Iterator[tuple[str, list[Span]]]:
    """Copies of an example in which spans are written another way."""
    forms = {"email": (lambda s: s.replace("@", " at ").replace(".", " dot "), lambda s: s.replace("@", "[at]")),
             "phone": (lambda s: s.split(" ", 1)[-1] if len(_digits(s.split(" ", 1)[-1])) >= 7 else s, lambda s: s.replace(" ", "-").replace("(", "").replace(")", "")),
             "card": (lambda s: " ".join(_digits(s)[i:i + 4] for i in range(0, len(_digits(s)), 4)),), "ip": ()}
    for form in range(2):
        out, at, found = "", 0, []
        for a, b, kind in spans:
            if a < at:
                return
            own = text[a:b] if form >= len(forms[kind]) else forms[kind][form](text[a:b])
            out += text[at:a]
            found.append((len(out), len(out) + len(own), kind))
            out, at = out + own, b
        yield out + text[at:], found


def train(docs: DataFrame) -> np.ndarray | None:
    """Fit on stretches of ``docs`` (text) around base spans."""
    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[bytes, str] = {}
            for text in batch.column(0).to_pylist():
                spans = base_spans(text or "")
                for region in regions(text) if spans else ():
                    a, b = region.starts[0], region.starts[-1]
                    if len(region.tokens) <= MOST_REGION // 2 and any(a <= s and e <= b for s, e, _ in spans):
                        own = text[a:b]
                        found[hashlib.md5(own.encode("utf-8", "surrogatepass")).digest()] = own
            best = sorted(found)[:TRAIN_REGIONS]
            yield pa.RecordBatch.from_arrays([pa.array(best, pa.binary()), pa.array([found[k] for k in best], pa.string())], names=["key", "own"])

    found = docs.select("text").mapInArrow(sample, "key binary, own string").groupBy("key").agg(F.min("own").alias("own"))      # a copied stretch counts once
    examples = [(r["own"], base_spans(r["own"])) for r in found.orderBy("key").limit(TRAIN_REGIONS).collect()]
    return fit(examples + [x for own, spans in examples for x in _rewritten(own, spans)])


def all_spans(text: str, weights: np.ndarray | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and these with the spans that the field adds."""
    base = base_spans(text)
    more = list(base)
    if weights is not None:
        fixed, reach = sorted((a, b) for a, b, _ in base), 0
        starts = [a for a, _ in fixed]
        longest = max((b - a for a, b in fixed), default=0)
        for region in regions(text):
            for a, b, kind in decode(region, weights):
                near = fixed[bisect_left(starts, a - longest):bisect_left(starts, b)]
                if a >= reach and not any(s < b and a < e for s, e in near):
                    more.append((a, b, kind))
                    reach = b
    return base, sorted(more, key=lambda s: (s[0], KINDS.index(s[2])))


def find_personal_data(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` (with text) and ``base``, ``spans``: arrays of (kind, start, stop)."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))
    types, names = dict(docs.dtypes), docs.columns
    span = "array<struct<kind: string, start: long, stop: long>>"
    ddl = ", ".join([*(f"`{n}` {types[n]}" for n in keep), f"base {span}, spans {span}"])
    schema = arrow_schema(ddl)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [all_spans(t or "", shared.value) for t in batch.column(names.index("text")).to_pylist()]
            columns = [pa.array([[{"kind": k, "start": a, "stop": b} for a, b, k in x[i]] for x in found], schema.field("base").type) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)).cast(schema.field(c).type) for c in keep), *columns], schema=schema)

    return docs.mapInArrow(find, ddl)


def redact(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in angle brackets; of spans that overlap the first one counts."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])
