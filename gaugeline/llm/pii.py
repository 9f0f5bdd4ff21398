"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

Candidates are the base spans (email, ip, card, phone; fixed patterns that always stay) and looser ones: addresses
with "at" and "dot" spelled out (email_text), phone numbers without a country prefix (phone_text) and national identity
numbers (id_number). Six labelers vote +1, 0 or -1 on each: shape (regex checks), gazetteer (top-level domains, calling
codes, card prefixes, address ranges), context (cue words before the span), counter-context (words of other numbers),
boundary and size. Equal vote patterns of all documents are counted on the cluster, expectation-maximisation over the
counts estimates each labeler's reliability for spans and non-spans of each family, and a logistic classifier over
votes, family and shape is fitted to the posteriors. Looser candidates stay if its probability is at least `accept`.
Counts are bounded by the number of possible patterns, whatever the input.

A null text is an empty one; texts without candidates give no span. One row out for each row in, repeated rows too.
Null ids are kept. Whole texts are scanned; scanning is linear in the text's length. Of looser candidates that overlap the
first counts, of those that start together the longest. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "email_text", "phone_text", "id_number")
FAMILY = {"email": 0, "ip": 1, "card": 2, "phone": 3, "email_text": 0, "phone_text": 3, "id_number": 4}
ACCEPT = 0.5
LABELERS = 6

# The base patterns (the local part of an email is found from its @), with repeats that never give back.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# Looser patterns.
_SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?: at | ?[\[(]at[\])] ?)[A-Za-z0-9-]{1,63}(?:(?: dot | ?[\[(]dot[\])] ?|\.)[A-Za-z0-9-]{1,63}){1,4}", re.I)
_LOOSE_PHONE = re.compile(r"(?<![0-9+.-])\(?[0-9]{2,5}\)?(?:[ .-][0-9]{2,5}){2,4}(?![0-9])")
_IDENTITY = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
# What every match of a kind holds somewhere, for Arrow's matcher: a text without it is not scanned for the kind. (Where case
# is ignored, four letters beyond ASCII count as i, k and s.)
_NAME = r"[A-Za-z0-9\x{130}\x{131}\x{17F}\x{212A}-]"
_GATES = {
    "email": "@",
    "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]",
    "card": r"[0-9](?:[ -]?[0-9]){12}",
    "phone": r"\+[0-9]",
    "email_text": rf"(?i)(?: at |[\[(]at[\])] ?){_NAME}{{1,63}}(?: dot | ?[\[(]dot[\])] ?|\.){_NAME}",
    "phone_text": r"[0-9]{2}\)?[ .-][0-9]{2,5}[ .-][0-9]{2}",
    "id_number": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
# Gazetteers.
_TOP_LEVEL = frozenset("com org net edu gov io de fr es uk it nl eu info biz ch at be us ca".split())
_CALLING = tuple("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 61 62 63 64 65 66 81 82 84 86 90 91 92 351 352 353 358 420".split())
_CUES = (
    re.compile(r"\b(e-?mail|mail|contact|write|reach|correo|courriel|kontakt|schreib\w*)\b", re.I),
    re.compile(r"\b(ip|host|address|server|login|from|adresse|direcci[oó]n)\b", re.I),
    re.compile(r"\b(card|visa|master\w*|credit|payment|karte|carte|tarjeta)\b", re.I),
    re.compile(r"\b(phone|tel|telefon\w*|call|mobile|fax|cell|anruf\w*|t[eé]l[eé]phone|tel[eé]fono|appelez)\b", re.I),
    re.compile(r"\b(ssn|social|security|identity|passport|ausweis|identit[eé]|dni)\b", re.I),
)
_COUNTER = re.compile(r"\b(version|v|isbn|order|invoice|price|total|section|chapter|page|build|release|figure|fig|table)\b", re.I)


class Candidate(NamedTuple):
    kind: str
    start: int
    end: int


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str, among=KINDS) -> list[Candidate]:
    """The base spans of the kinds among these, by kind as listed, then start."""
    out, last, at = [], 0, text.find("@") if "email" in among else -1
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(Candidate("email", start, last := m.end()))
        at = text.find("@", last if m else at + 1)
    # the length is looked at first: int() of a long run of digits would be slow
    if "ip" in among:
        out += [Candidate("ip", *m.span()) for m in _IP.finditer(text) if all(len(p := g.lstrip("0")) <= 3 and int(p or "0") <= 255 for g in m.groups())]
    if "card" in among:
        out += [Candidate("card", *m.span()) for m in _CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and _luhn(d)]
    if "phone" in among:
        out += [Candidate("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def candidates(text: str, among=KINDS) -> list[Candidate]:
    """Base spans, then looser ones that overlap no base span; of the kinds among these."""
    base = base_spans(text, among)
    taken = sorted((c.start, c.end) for c in base)
    more = []
    for kind, pattern in (("email_text", _SPELLED), ("phone_text", _LOOSE_PHONE), ("id_number", _IDENTITY)):
        for m in pattern.finditer(text) if kind in among else ():
            if kind == "phone_text" and not 9 <= len(_digits(m[0])) <= 15:
                continue
            if kind == "email_text" and "@" in m[0]:
                continue
            more.append(Candidate(kind, *m.span()))
    out, k, reach = list(base), 0, -1
    for c in sorted(more, key=lambda c: (c.start, -c.end)):
        while k < len(taken) and taken[k][0] < c.end:
            reach = max(reach, taken[k][1])
            k += 1
        if c.start >= reach:
            out.append(c)
            reach = max(reach, c.end)
    return out


def features(text: str, c: Candidate) -> tuple[int, ...]:
    """Family, votes of the six labelers, size bucket, separator."""
    span, family = text[c.start : c.end], FAMILY[c.kind]
    digits = _digits(span)
    before = text[max(0, c.start - 48) : c.start]
    shape = 1 if c.kind in BASE else -1 if (family == 3 and len(set(digits)) < 3) else 0
    if family == 0:
        top = re.split(r"[.\s\])]+", span.lower().rstrip(")]. "))[-1]
        gazetteer, size = (1 if top in _TOP_LEVEL else -1), (1 if 6 <= len(span) <= 64 else -1)
    elif family == 1:
        first = int(digits[:0] or span.split(".")[0][-3:] or 0)
        gazetteer, size = (1 if 1 <= first <= 223 else -1), 1
    elif family == 2:
        gazetteer, size = (1 if digits[0] in "3456" else -1), (1 if len(digits) in (15, 16) else 0)
    elif family == 3:
        gazetteer, size = (1 if span[0] == "+" and digits.startswith(_CALLING) else 1 if digits[0] == "0" else 0), (1 if 10 <= len(digits) <= 13 else 0)
    else:
        gazetteer, size = (-1 if digits.startswith(("000", "666", "9")) or digits[3:5] == "00" else 1), 0
    context = 1 if _CUES[family].search(before) else 0
    counter = -1 if _COUNTER.search(before[-20:]) else 0
    left, right = before[-1:], text[c.end : c.end + 1]
    boundary = -1 if left.isalnum() or right.isalnum() or left in ("#", "$", "€") and left else 1
    separator = 2 if re.search(r"[ ()]", span) else 1 if re.search(r"[.-]", span) else 0
    return (family, shape, gazetteer, context, counter, boundary, size, min(3, len(digits) // 5), separator)


class Model(NamedTuple):
    """The final classifier: weights over one-hot features; and the reliabilities that EM found, by family."""

    weights: np.ndarray
    reliability: np.ndarray

    def probability(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(_design(rows) @ self.weights)))


def _design(rows: np.ndarray) -> np.ndarray:
    hot = [np.ones(len(rows))] + [rows[:, 0] == f for f in range(5)]
    for j in range(1, 1 + LABELERS):
        hot += [rows[:, j] > 0, rows[:, j] < 0]
    hot += [rows[:, 7] == b for b in range(4)] + [rows[:, 8] == s for s in range(3)]
    return np.stack(hot, 1).astype(float)


def estimate(rows: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each vote pattern being personal data, and P(vote | class) by family, labeler, class and vote."""
    family, votes = rows[:, 0], rows[:, 1 : 1 + LABELERS] + 1
    posterior = 1 / (1 + np.exp(-1.5 * (votes - 1).sum(1)))
    theta = np.zeros((5, LABELERS, 2, 3))
    for _ in range(rounds):
        prior = np.full(5, 0.5)
        for f in range(5):
            own = family == f
            mass = [(counts * (1 - posterior))[own], (counts * posterior)[own]]
            prior[f] = (mass[1].sum() + 1) / (counts[own].sum() + 2)
            for j in range(LABELERS):
                for y in (0, 1):
                    tally = np.bincount(votes[own, j], weights=mass[y], minlength=3) + np.array([1.0, 1.0, 2.0] if y else [2.0, 1.0, 1.0])
                    theta[f, j, y] = tally / tally.sum()
        logs = [np.log(p) + sum(np.log(theta[family, j, y, votes[:, j]]) for j in range(LABELERS)) for y, p in ((0, 1 - prior[family]), (1, prior[family]))]
        posterior = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
    return posterior, theta


def fit(rows: np.ndarray, counts: np.ndarray) -> Model:
    """Logistic regression (Newton steps, ridge 1) on the posteriors, each pattern weighing as often as it was seen."""
    if not len(rows):
        return Model(np.zeros(_design(np.zeros((1, 9), int)).shape[1]), np.zeros((5, LABELERS, 2, 3)))
    posterior, theta = estimate(rows, counts)
    x, w = _design(rows), np.zeros(_design(rows[:1]).shape[1])
    weight = counts / counts.mean()
    for _ in range(25):
        p = 1 / (1 + np.exp(-(x @ w)))
        step = np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + np.eye(len(w)), x.T @ (weight * (posterior - p)) - w)
        w += np.clip(step, -4, 4)
    return Model(w, theta)


def possible(column: pa.Array) -> list[list[str]]:
    """For each text of a column without nulls, the kinds that may be found in it."""
    out: list[list[str]] = [[] for _ in range(len(column))]
    for kind, gate in _GATES.items():
        for i in np.flatnonzero(pc.match_substring_regex(column, gate).to_numpy(zero_copy_only=False)).tolist():
            out[i].append(kind)
    return out


def _texts(batches, at: int):
    """Batches in slices, with the texts that may hold a candidate: place, text and the kinds to look for."""
    for batch in slices(batches, 512):
        column = pc.fill_null(batch.column(at).cast(pa.large_string()), "")
        yield batch, [(i, column[i].as_py(), kinds) for i, kinds in enumerate(possible(column)) if kinds]


def train(docs: DataFrame, *, text_col: str = "text") -> Model:
    """EM and the classifier over the vote patterns of all documents."""
    names = [f"f{k}" for k in range(9)]

    def run(batches):
        from collections import Counter

        seen: Counter = Counter()
        for _, texts in _texts(batches, 0):
            for _, text, kinds in texts:
                seen.update(features(text, c) for c in candidates(text, kinds))
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([*(pa.array([k[j] for k in keys], pa.int32()) for j in range(9)), pa.array(list(seen.values()), pa.int64())], [*names, "n"])

    got = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, ", ".join(f"{c} int" for c in names) + ", n long")
    rows = got.groupBy(*names).agg(F.sum("n").alias("n")).collect()
    rows = np.array(sorted(tuple(r) for r in rows), np.int64).reshape(-1, 10)
    return fit(rows[:, :9], rows[:, 9].astype(float))


def find(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """Each document's spans (kind, start, end; code points, end exclusive), by kind as listed, then start."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch, texts in _texts(batches, 1):
            out: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for i, text, kinds in texts:
                found = candidates(text, kinds)
                loose = [c for c in found if c.kind not in BASE]
                if loose:
                    keep = sent.value.probability(np.array([features(text, c) for c in loose])) >= accept
                    found = [c for c in found if c.kind in BASE] + [c for c, k in zip(loose, keep, strict=True) if k]
                out[i] = [c._asdict() for c in sorted(found, key=lambda c: (KINDS.index(c.kind), c.start))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, spans)], [id_col, "spans"])

    own = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op5_pii(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, train(docs))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def digest(text: str | None) -> str:
    """The base digest of one text, for tests."""
    return hashlib.sha256(",".join(f"{c.kind}:{c.start}:{c.end}" for c in base_spans(text or "")).encode()).hexdigest()
