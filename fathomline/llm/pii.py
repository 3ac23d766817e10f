"""Personal data in text: exact base patterns, and a span classifier trained from weak labels.

Candidates beyond the base patterns get votes from regex, gazetteer and context labelers.
Expectation-maximisation over the counts of all vote patterns in the corpus estimates how reliable each
labeler is and how likely each pattern is personal data; a logistic classifier over span features learns
from those estimates and decides which candidates become spans. Only pattern counts, a bounded number,
leave the executors.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fathomline.llm.minhash import slices
from fathomline.llm.words import map_batches

KINDS = ("email", "ip", "card", "phone")
# Kinds that only candidates have.
MORE_KINDS = ("secret", "account", "name", "address")
ALL_KINDS = KINDS + MORE_KINDS
# A candidate becomes a span from this probability on.
ACCEPT = 0.6
EM_ROUNDS = 50
# Code points before and after a span that context labelers read.
CONTEXT = 40

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match of these can only begin where a run of digits begins, so no run is scanned twice.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGITS = re.compile(r"[^0-9]+")
_DIGIT = re.compile("[0-9]")

_TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Señor", "Señora", "Monsieur", "Madame")
_STREETS = ("Street", "Road", "Avenue", "Lane", "Boulevard", "Strasse", "Straße")
# Kind, a cheap test that a text with a match passes, and the pattern; group 1 is the span if there is one.
_CANDIDATES = (
    ("secret", lambda t: '"' in t or "'" in t, re.compile(r"""["']([A-Za-z0-9_\-]{16,})(?=["'])""")),
    ("account", _DIGIT.search, re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")),
    ("phone", _DIGIT.search, re.compile(r"(?<![0-9+(])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")),
    ("account", _DIGIT.search, re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    (
        "email",
        re.compile(r"[\[({](?:at|AT)[\])}]").search,
        re.compile(
            r"\b[A-Za-z0-9._%+-]{1,64} ?[\[({](?:at|AT)[\])}] ?"
            r"[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[({](?:dot|DOT)[\])}]) ?[A-Za-z0-9-]{2,63}){1,4}"
        ),
    ),
    (
        "name",
        lambda t: any(x in t for x in _TITLES),
        re.compile(rf"\b(?:{'|'.join(_TITLES)})\.? [A-ZÀ-Þ][\w'-]{{1,30}}(?: [A-ZÀ-Þ][\w'-]{{1,30}})?"),
    ),
    (
        "address",
        lambda t: any(x in t for x in _STREETS),
        re.compile(rf"\b[0-9]{{1,5}} [A-ZÀ-Þ][\w'-]{{1,30}} (?:{'|'.join(_STREETS)})\b"),
    ),
)

# Gazetteers: fixed word lists that mark personal data, and others that mark its absence.
CUES = {
    "email": frozenset("email e-mail mail contact write correo courriel kontakt".split()),
    "ip": frozenset("ip host server address client addr adresse".split()),
    "card": frozenset("card credit visa mastercard pay payment karte tarjeta carte".split()),
    "phone": frozenset("phone tel call mobile fax contact telefon teléfono téléphone".split()),
    "secret": frozenset("token key secret password passwd api apikey auth bearer credential".split()),
    "account": frozenset("iban account konto cuenta compte ssn social bank security".split()),
    "name": frozenset("dear name contact signed regards sincerely".split()),
    "address": frozenset("address street live lives adresse dirección".split()),
}
PLAIN = frozenset("version license licence copyright isbn page figure chapter section release build revision".split())
_WORDS = re.compile(r"[\w-]+")
LABELERS = ("shape", "cue", "plain", "assigned", "mixed", "even")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by start and then by the order of ``KINDS``."""
    found = []
    at, done = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            done = domain.end()
            found.append((begin, 0, done))
        at = text.find("@", domain.end() if domain else at + 1)
    digits_at = _DIGIT.search(text)
    for m in _IP.finditer(text, digits_at.start()) if digits_at else ():
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text, digits_at.start()) if digits_at else ():
        digits = _NOT_DIGITS.sub("", m.group()) if m.end() - m.start() <= 40 else ""
        if 14 <= len(digits) <= 19 and _luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGITS.sub("", m.group())) <= 15:
                found.append((m.start(), 3, m.end()))
    return [(KINDS[kind], start, end) for start, kind, end in sorted(found)]


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans that may be personal data and overlap no base span; of overlapping ones the first."""
    found = []
    for kind, possible, pattern in _CANDIDATES:
        if possible(text):
            group = min(1, pattern.groups)
            found += [(m.start(group), ALL_KINDS.index(kind), m.end(group)) for m in pattern.finditer(text)]
    if not found:
        return []
    out, taken, done = [], [(s, e) for _, s, e in base], 0
    for start, kind, end in sorted(found):
        if start >= done and not any(s < end and start < e for s, e in taken):
            out.append((ALL_KINDS[kind], start, end))
            done = end
    return out


def _iban(text: str) -> bool:
    compact = text.replace(" ", "")
    moved = compact[4:] + compact[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def votes(text: str, kind: str, start: int, end: int, valid: bool) -> tuple[int, ...]:
    """One vote of each labeler: 1 personal data, -1 not, 0 no opinion."""
    span = text[start:end]
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    near = frozenset(_WORDS.findall(before.lower()))
    around = near | frozenset(_WORDS.findall(after.lower()))
    digits = sum(c.isdigit() for c in span)
    letters = sum(c.isalpha() for c in span)
    shape = 1 if valid else 0
    if not valid:
        if kind == "account" and letters:
            shape = 1 if _iban(span) else -1
        elif kind == "secret":
            shape = 1 if digits and letters else -1
        elif kind in ("name", "address", "email"):
            shape = 1
    even = -1 if digits >= 6 and len(set(c for c in span if c.isdigit())) <= 2 else 0
    return (
        shape,
        1 if near & CUES[kind] else 0,
        -1 if around & PLAIN else 0,
        1 if re.search(r"[:=]\s*[\"']?$", before) else 0,
        (1 if digits >= 3 and len(set(span)) >= 6 else -1) if kind in ("secret", "account", "card") else 0,
        even,
    )


def pattern(text: str, kind: str, start: int, end: int, valid: bool) -> tuple[int, ...]:
    """Kind, votes, and two coarse features of the span: a finite number of patterns."""
    span = text[start:end]
    share = int(4 * sum(c.isdigit() for c in span) / len(span))
    return (ALL_KINDS.index(kind), *votes(text, kind, start, end, valid), min(5, len(span) // 8), share)


@dataclass
class Model:
    """Log-odds of a span: the sum over its pattern's places of ``weights[place][value]``."""

    weights: list[dict[int, float]]
    reliability: dict[str, tuple[float, float]]

    def probability(self, found: tuple[int, ...]) -> float:
        z = sum(w.get(v, 0.0) for w, v in zip(self.weights, (1, *found)))
        return float(1 / (1 + np.exp(-z)))


def train(counts: dict[tuple[int, ...], int]) -> Model:
    """EM over vote patterns, then a logistic classifier on the posteriors, weighted by the counts."""
    if not counts:
        return Model([], {})
    rows = np.array(sorted(counts), dtype=np.int64)
    n = np.array([counts[tuple(r)] for r in rows.tolist()], dtype=np.float64)
    kinds, ballots = rows[:, 0], rows[:, 1 : 1 + len(LABELERS)]
    score = ballots.sum(axis=1)
    chance = np.where(score > 0, 0.9, np.where(score < 0, 0.1, 0.5))
    for _ in range(EM_ROUNDS):
        odds = np.zeros(len(rows))
        for kind in np.unique(kinds):
            own = kinds == kind
            prior = (1 + (n * chance)[own].sum()) / (2 + n[own].sum())
            odds[own] = np.log(prior / (1 - prior))
        for k in range(len(LABELERS)):
            for vote in (-1, 1):  # no opinion tells nothing about the class
                cast = ballots[:, k] == vote
                yes = (1 + (n * chance)[cast].sum()) / (3 + (n * chance)[ballots[:, k] != 0].sum())
                no = (1 + (n * (1 - chance))[cast].sum()) / (3 + (n * (1 - chance))[ballots[:, k] != 0].sum())
                odds[cast] += np.log(yes / no)
        # a labeler that votes for personal data is right more often than not: this names the classes
        chance = 1 / (1 + np.exp(-np.clip(odds, -8, 8)))
        if np.average(chance, weights=n * np.maximum(score, 0) + 1e-9) < 0.5:
            chance = 1 - chance
    reliability = {}
    for k, name in enumerate(LABELERS):
        yes, no = ballots[:, k] == 1, ballots[:, k] == -1
        right, wrong = (n * chance)[yes].sum() + (n * (1 - chance))[no].sum(), n[yes | no].sum()
        reliability[name] = (float((1 + right) / (2 + wrong)), float(wrong))
    # one weight for each place and value of a pattern, the first being the bias
    columns = [np.ones(len(rows), np.int64), *rows.T]
    values = [np.unique(c, return_inverse=True) for c in columns]
    parts = [np.zeros(len(v)) for v, _ in values]
    share = n / n.sum()
    for _ in range(500):
        z = sum(p[at] for p, (_, at) in zip(parts, values))
        pull = share * (1 / (1 + np.exp(-z)) - chance)
        for p, (v, at) in zip(parts, values):
            p -= 2.0 * (np.bincount(at, pull, minlength=len(v)) + 1e-4 * p)
    return Model([dict(zip(v.tolist(), p.tolist())) for p, (v, _) in zip(parts, values)], reliability)


def _count_patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    for batch in slices(batches):
        for text in batch.column(0).to_pylist():
            text = text or ""
            base = base_spans(text)
            seen.update(pattern(text, *s, True) for s in base)
            seen.update(pattern(text, *s, False) for s in candidates(text, base))
    yield pa.record_batch(
        [pa.array([list(k) for k in seen], pa.list_(pa.int64())), pa.array(list(seen.values()), pa.int64())],
        names=["pattern", "n"],
    )


def fit(docs: DataFrame) -> Model:
    """Train on the vote patterns of all texts; a corpus without candidates gives a model that adds nothing."""
    counts = docs.select(F.col("text").cast("string").alias("text")).transform(
        map_batches,
        _count_patterns, "pattern array<long>, n long"
    )
    rows = counts.groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    return train({tuple(r["pattern"]): r["n"] for r in rows})


def all_spans(text: str, model: Model) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and base and added spans together by start and kind."""
    base = base_spans(text)
    added = [s for s in candidates(text, base) if model.probability(pattern(text, *s, False)) >= ACCEPT]
    every = sorted([*base, *added], key=lambda s: (s[1], ALL_KINDS.index(s[0]))) if added else base
    return base, every


SPANS = "array<struct<kind:string,start:int,end:int>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, base, spans) for each row of ``docs``: base spans, and all spans with those the classifier adds.

    Positions are code points, ends exclusive. A null or empty text has none; rows without an id stay;
    other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            both = [all_spans(text or "", model) for text in batch.column(1).to_pylist()]
            columns = [
                pa.array([[dict(zip(("kind", "start", "end"), s)) for s in x[k]] for x in both], _SPAN) for k in (0, 1)
            ]
            yield pa.record_batch([batch.column(0), *columns], names=["doc_id", "base", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.transform(map_batches, run, f"doc_id long, base {SPANS}, spans {SPANS}")


def redact(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """``docs`` with every span of ``text_column`` replaced by its kind in brackets; null stays null.

    Of overlapping spans the replaced stretch is their union, named after the first.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text_column)
        for batch in slices(batches):
            texts = [None if t is None else _redacted(t, model) for t in batch.column(at).to_pylist()]
            columns = [pa.array(texts, pa.string()) if k == at else c for k, c in enumerate(batch.columns)]
            yield pa.record_batch(columns, names=names)

    rows = docs.withColumn(text_column, F.col(text_column).cast("string"))
    return rows.transform(map_batches, run, rows.schema)


def _redacted(text: str, model: Model) -> str:
    out, done, shown = [], 0, 0
    for kind, start, end in all_spans(text, model)[1]:
        if start >= done:
            out += [text[shown:start], f"[{kind.upper()}]"]
        done = shown = max(done, end)
    return "".join(out) + text[shown:]
