"""Personal data in texts: labelers vote on candidate spans, their reliabilities are estimated, a span classifier decides."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import add_columns, expand_rows

#: In the order in which spans that start together are named. The last is the method's own.
KINDS = ("email", "ip", "card", "phone", "secret")
#: Characters before a span in which the context labeler looks for a cue.
CONTEXT = 32
#: Probability from which the classifier adds a span to the base ones.
ADD_FROM = 0.9
#: Hashed features of a span and of what stands around it, and the different spans that the classifier is fitted on at most.
FEATURES, SAMPLE = 512, 4000

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only begin where digits begin, and takes whole runs of them; so a long run of digits costs one look at each.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SECRET = re.compile(r"(?i)\b(?:password|passwd|secret|token|api[_-]?key|access[_-]?key)\b\s*[=:]\s*[\"']?([A-Za-z0-9_+/=-]{12,})|\b(AKIA[A-Z0-9]{12,})\b")

# Gazetteers.
TOP_DOMAINS = frozenset("com org net edu gov mil info io co de fr es uk eu it nl ch at be us ca au jp cn in br ru pl se no".split())
CALLING_CODES = tuple("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 98".split())
CARD_PREFIXES = tuple("4 51 52 53 54 55 34 37 6011 65 35 30 36 38".split())
UNUSED_NETWORKS = frozenset(["0", "127", "255"])
CUES = {
    "email": re.compile(r"(?i)mail|contact|write|schreib|escrib|écri"),
    "ip": re.compile(r"(?i)\bip\b|host|server|address|adress|direc|login|from\s*$"),
    "card": re.compile(r"(?i)card|visa|carte|tarjeta|karte|credit|pay"),
    "phone": re.compile(r"(?i)phone|tel|call|mobil|fax|whatsapp|ruf|llam|appel"),
    "secret": re.compile(r"(?i)pass|secret|token|key|login|auth"),
}
VERSION = re.compile(r"(?i)(?:version|release|\bv)\.?\s*$")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping; from each @ back over its local part, so a long text without one costs one search."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = start < at and _DOMAIN.match(text, at + 1)
        if found:
            done = found.end()
            out.append((start, done))
        at = text.find("@", max(at + 1, done))
    return out


def candidates(text: str) -> list[tuple[int, int, int, bool]]:
    """(start, kind, end, base) of everything that a pattern matches; base: the match passes its kind's check."""
    out = [(s, 0, e, True) for s, e in emails(text)]
    for m in _IP.finditer(text):
        out.append((m.start(), 1, m.end(), all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.group().split("."))))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if len(digits) >= 12:
            out.append((m.start(), 2, m.end(), len(digits) <= 19 and luhn(digits)))
    for m in _PHONE.finditer(text):
        digits = sum(c.isdigit() for c in m.group())
        out.append((m.start(), 3, m.end(), 9 <= digits <= 15))
    for m in _SECRET.finditer(text) if "=" in text or ":" in text or "AKIA" in text else ():
        i = 1 if m.group(1) else 2
        out.append((m.start(i), 4, m.end(i), False))
    return sorted(out)


def cast_votes(text: str, start: int, kind: int, end: int, base: bool) -> tuple[int, ...]:
    """1 (personal), -1 (not) or 0 of the pattern, gazetteer, context and shape labelers, and a bucket of the length."""
    body, name = text[start:end], KINDS[kind]
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + 1]
    digits = "".join(c for c in body if c in "0123456789")
    mixed = any(c.isdigit() for c in body) and any(c.isalpha() for c in body)
    pattern = (1 if mixed else -1) if name == "secret" else 1 if base else -1
    if name == "email":
        gazetteer = 1 if body.rpartition(".")[2].lower() in TOP_DOMAINS else 0
    elif name == "ip":
        gazetteer = -1 if body.split(".")[0] in UNUSED_NETWORKS else 0
    elif name == "card":
        gazetteer = 1 if digits.startswith(CARD_PREFIXES) else -1
    elif name == "phone":
        gazetteer = 1 if digits.startswith(CALLING_CODES) else -1
    else:
        gazetteer = 1 if len(set(body)) >= 8 else -1
    context = -1 if VERSION.search(before) else 1 if CUES[name].search(before) else 0
    joined = (before[-1:].isalnum() or after.isalnum()) or (name in ("ip", "card") and (before[-1:] == "." or before[-1:] == "-"))
    return pattern, gazetteer, context, -1 if joined else 1, min(len(body) // 8, 5)


def estimate(counts: dict[tuple, int], rounds: int = 100) -> dict[tuple, float]:
    """Probability that a candidate of each (kind, votes..., length) pattern is personal, by expectation-maximisation.

    Kinds have priors of their own; each labeler errs and abstains at rates of its own in either class, shared by the kinds.
    Begins with the majority of votes. Rates are smoothed by one vote.
    """
    keys = sorted(counts)
    if not keys:
        return {}
    n = np.array([counts[k] for k in keys], dtype=float)
    kind = np.array([k[0] for k in keys])
    cast = np.array([k[1:5] for k in keys])
    seen = np.stack([cast == v for v in (-1, 0, 1)], axis=2).astype(float)
    yes = 1 / (1 + np.exp(-(cast.sum(axis=1) + 1.5 * cast[:, 0])))
    for _ in range(rounds):
        logs = []
        for w in (1 - yes, yes):
            rate = np.einsum("p,plv->lv", n * w, seen) + 1
            rate /= rate.sum(axis=1, keepdims=True)
            prior = np.log(np.bincount(kind, n * w, minlength=len(KINDS)) + 1)
            logs.append(prior[kind] + np.einsum("plv,lv->p", seen, np.log(rate)))
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))
        if np.abs(new - yes).max() < 1e-9:
            break
        yes = new
    return dict(zip(keys, yes.tolist(), strict=True))


_WORD = re.compile(r"[^\W\d_]+")
_KINDS_OF_CHARACTERS = str.maketrans({**dict.fromkeys("0123456789", "9"), **dict.fromkeys("abcdefghijklmnopqrstuvwxyz", "a"), **dict.fromkeys("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "A")})
_REPEATED = re.compile(r"(.)\1+")


def features(text: str, start: int, kind: int, end: int) -> list[int]:
    """Hashed features that no labeler votes on: the span's shape, the signs next to it and the words around it."""
    before, after = text[max(0, start - CONTEXT) : start].lower(), text[end : end + CONTEXT].lower()
    shape = _REPEATED.sub(r"\1", text[start : min(end, start + 64)].translate(_KINDS_OF_CHARACTERS))[:24]
    near = _WORD.findall(before)[-2:] + [None] * 2
    found = (f"shape {shape}", f"left {before[-1:]}", f"right {after[:1]}", f"before {near[0]} {near[1]}", *(f"word {w}" for w in near if w), *(f"next {w}" for w in _WORD.findall(after)[:1]))
    return [zlib.crc32(f"{kind} {f}".encode()) % FEATURES for f in found]


def _inputs(patterns: list[tuple], hashed: list[list[int]]) -> np.ndarray:
    """One-hot kind, kind x pattern vote, the other votes and the length bucket, then the hashed features."""
    x = np.zeros((len(patterns), 38 + FEATURES))
    for i, ((kind, *cast, size), own) in enumerate(zip(patterns, hashed, strict=True)):
        x[i, kind] = 1
        x[i, 5 + 3 * kind + cast[0] + 1] = 1
        for j, v in enumerate(cast[1:]):
            x[i, 20 + 3 * j + v + 1] = 1
        x[i, 29 + size] = 1
        x[i, 37] = 1
        x[i, [38 + f for f in own]] = 0.5
    return x


class Classifier:
    """Logistic regression over votes and hashed features, fitted on estimated labels."""

    def __init__(self, patterns: list[tuple], hashed: list[list[int]], target: list[float], rounds: int = 100):
        x, y = _inputs(patterns, hashed), np.array(target, dtype=float)
        w = np.zeros(38 + FEATURES)
        for _ in range(rounds if len(y) else 0):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            bend = (x * (p * (1 - p) / len(y))[:, None]).T @ x + 1e-4 * np.eye(len(w))
            step = np.linalg.solve(bend, x.T @ (p - y) / len(y) + 1e-4 * w)
            w -= np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-6:
                break
        self.weights, self.fitted, self._votes = w, len(y) > 0, {}

    def __call__(self, pattern: tuple, hashed: list[int]) -> float:
        if not self.fitted:
            return 0.0
        if pattern not in self._votes:
            self._votes[pattern] = float(_inputs([pattern], [[]])[0] @ self.weights)
        score = self._votes[pattern] + 0.5 * sum(self.weights[38 + f] for f in set(hashed))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, score))))


def _count(texts: list) -> tuple[list, list]:
    seen = Counter((k, *cast_votes(t, s, k, e, b)) for t in texts if t for s, k, e, b in candidates(t))
    return [0] * len(seen), [[list(p) for p in seen], list(seen.values())]


def _list_candidates(texts: list) -> tuple[list, list]:
    rows = {}
    for t in texts:
        for s, k, e, b in candidates(t) if t else ():
            around = zlib.crc32(f"{k}{t[max(0, s - CONTEXT) : min(e, s + 64) + CONTEXT]}".encode())
            rows[around] = ([k, *cast_votes(t, s, k, e, b)], features(t, s, k, e))
    return [0] * len(rows), [list(rows), [r[0] for r in rows.values()], [r[1] for r in rows.values()]]


def fit(docs: DataFrame, sample: int = SAMPLE) -> Classifier:
    """The span classifier: labels from the vote patterns of all documents, weights from `sample` different spans at most.

    There are at most 5 x 81 x 6 patterns to collect. The sample holds the spans of least hash of what they are and stand in.
    """
    body = docs.select("text")
    counted = expand_rows(body, [], ["text"], _count, "pattern array<int>, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    known = estimate({tuple(r["pattern"]): r["n"] for r in counted})
    listed = expand_rows(body, [], ["text"], _list_candidates, "h long, pattern array<int>, features array<int>")
    rows = listed.groupBy("h").agg(F.min("pattern").alias("pattern"), F.min("features").alias("features")).orderBy("h").limit(sample).collect()
    patterns = [tuple(r["pattern"]) for r in rows]
    return Classifier(patterns, [r["features"] for r in rows], [known[p] for p in patterns])


def spans_of(text: str, model: Classifier) -> list[tuple[int, int, int, bool]]:
    """Base spans and those that the classifier adds, by start, then kind. An added span overlaps no other."""
    found = candidates(text)
    out = [c for c in found if c[3]]
    for s, k, e, b in found:
        if not b and not any(s < y and x < e for x, _, y, _ in out) and model((k, *cast_votes(text, s, k, e, b)), features(text, s, k, e)) >= ADD_FROM:
            out.append((s, k, e, b))
    return sorted(out)


def find(docs: DataFrame) -> DataFrame:
    """docs with pii: array of (kind, start, end, base), code points and exclusive end, by start and then kind.

    docs needs text; every column stays (one named pii is replaced). A null text has no spans. base marks the spans of the base
    patterns, which are always kept; the rest are those that the trained classifier adds. Scans of the texts, no shuffle of
    them: the first counts vote patterns, from which the driver estimates the labelers' reliabilities, and takes a sample of spans,
    on which the span classifier is fitted; the second decides.
    """
    model = fit(docs)

    def run(texts: list) -> list[list]:
        return [[[{"kind": KINDS[k], "start": s, "end": e, "base": b} for s, k, e, b in spans_of(t, model)] if t else [] for t in texts]]

    return add_columns(docs, ["text"], run, "pii array<struct<kind: string, start: int, end: int, base: boolean>>")


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span of personal data in text replaced by its kind in brackets; texts without any stay as they are."""
    model, columns = fit(docs), docs.columns

    def run(texts: list) -> list[list]:
        out = []
        for t in texts:
            at, parts = 0, []
            for s, k, e, _ in spans_of(t, model) if t else ():
                if e > at:
                    parts += [t[at : max(at, s)], f"[{KINDS[k].upper()}]"]
                    at = e
            out.append("".join(parts) + t[at:] if parts else t)
        return [out]

    return add_columns(docs, ["text"], run, "text string").select(*[F.col(f"`{c}`") for c in columns])
