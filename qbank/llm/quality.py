"""Quality classifier without hand-made labels: heuristic labellers, their estimated accuracies, and a linear scorer."""

from __future__ import annotations

import zlib
from collections import Counter
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import add_columns, expand_rows

#: A statistic of a text, the value from which its labeller votes "low", the range in which it votes "high" (None: never;
#: elsewhere it abstains), and the accuracy it is credited with before any text is seen. Kinds of bad text that are common on the
#: web have two labellers each, which overlap; a text that only differs from prose (verse, code, lists, other scripts) gets no
#: vote for that.
LABELLERS = (
    ("runs", 0.20, None, 0.9),  # of a doubled # $ % & * ~ ^, for each word
    ("symbols", 0.60, None, 0.9),  # of # $ % & * ~ ^ for each word
    ("capitals", 0.60, None, 0.9),  # share of ASCII letters
    ("shouts", 0.20, None, 0.9),  # of a doubled ! or ?, for each word
    ("echoes", 0.30, None, 0.9),  # share of words equal to the word before
    ("same_triples", 0.60, None, 0.9),  # share of three successive words that occur before
    ("bars", 0.20, None, 0.9),  # share of words that are a lone |
    ("wordless", 0.40, None, 0.9),  # share of words without a letter or digit
    ("same_lines", 0.60, None, 0.9),  # share of lines of two words and more that occur before
    ("odd", None, (0.0, 0.12), 0.8),  # echoes, plus bytes for each word that are no letters, digits or plain punctuation
    ("sentences", None, (0.5, 1.0), 0.7),  # share of bytes in sentences of plain words that end with a full stop, less echoes
)
#: Dimensions of the hashed scorer, the documents it is fitted on at most, and the score from which a document is kept.
DIMENSIONS, SAMPLE, KEEP_FROM = 1024, 4000, 0.5
#: Texts of fewer words give no vote: ratios of a handful of words say little.
FEWEST_WORDS = 4

_KIND = np.zeros(256, dtype=np.int16)  # lower, upper, digit, space, line end, stop, symbol, non-ASCII
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = 7 if _b >= 128 else 0 if _c.islower() else 1 if _c.isupper() else 2 if _c.isdigit() else 4 if _c == "\n" else 3 if _c.isspace() else 5 if _c in ".,;:'-" else 6


_ODD = bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'-()\"")
_PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
#: Bytes that a plain sentence does not hold become NUL; a sentence has this many bytes at the least.
_IN_SENTENCE = bytes(0 if b in _ODD or b < 9 else b for b in range(256))
_SENTENCE = 15
#: Full stops of other scripts.
_STOPS = ("。".encode(), "।".encode(), "۔".encode())
#: Bytes that make a word where a script puts no spaces; ASCII words are shorter on average.
_BYTES_A_WORD = 12


def statistics(data: bytes) -> tuple[float, ...] | None:
    """The statistics in the order of LABELLERS; None for a text of too few words. Shares of fewer than ten things are 0."""
    words = data.split()
    n = max(len(words), len(data) // _BYTES_A_WORD)
    if n < FEWEST_WORDS:
        return None
    of = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    count = lambda chars: int(of[list(chars)].sum())
    doubled = lambda chars: sum(data.count(bytes([c, c])) for c in chars if of[c] > 1)
    upper, lower = int(of[65:91].sum()), int(of[97:123].sum())
    lines = [line for line in data.split(b"\n") if len(line.split(None, 2)) > 1]
    triples = max(0, len(words) - 2)
    echoes = sum(map(eq, words, words[1:])) / n
    plain = data.translate(_IN_SENTENCE)
    for stop in _STOPS:
        plain = plain.replace(stop, b".") if of[stop[0]] else plain
    sentences = sum(len(x) + 1 for x in plain.split(b".")[:-1] if len(x) >= _SENTENCE and 0 not in x)
    return (
        doubled(b"#$%&*~^") / n, count(b"#$%&*~^") / n, upper / (upper + lower) if upper + lower >= 10 else 0.0, doubled(b"!?") / n, echoes,
        1 - len(set(zip(words, words[1:], words[2:]))) / triples if triples >= 10 else 0.0, words.count(b"|") / n,
        1 - len(data.translate(None, _PUNCTUATION).split()) / len(words) if len(words) >= 10 else 0.0,
        1 - len(set(lines)) / len(lines) if len(lines) >= 10 else 0.0, echoes + count(_ODD) / n, sentences / len(plain) - echoes,
    )


def votes(stats: tuple[float, ...] | None) -> tuple[int, ...]:
    """-1 (low), 1 (high) or 0 of each labeller."""
    if stats is None:
        return (0,) * len(LABELLERS)
    return tuple(
        -1 if low is not None and x >= low else 1 if high and high[0] <= x <= high[1] else 0
        for x, (_, low, high, _) in zip(stats, LABELLERS, strict=True)
    )


def estimate(counts: dict[tuple[int, ...], int], rounds: int = 200) -> dict[tuple[int, ...], float]:
    """Expectation-maximisation over vote patterns: the probability that a text with each pattern is high.

    Each labeller has one accuracy, the chance that a vote of its is right; whether it votes says nothing, because bad text comes
    in kinds and most labellers know one kind. The share of high texts is estimated too. Begins with the accuracies credited,
    which fixes which class is which. Accuracies are smoothed by two votes at 0.6, so that a labeller that hardly ever votes in this
    corpus carries little weight, and held within 0.55 and 0.999; the share is held at 0.8 at the most, or else a few bad texts
    among many good ones would be taken for slips of the labellers. 
    """
    if not counts:
        return {}
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], dtype=float)
    cast = np.array(patterns, dtype=float)
    start = [a for *_, a in LABELLERS] if cast.shape[1] == len(LABELLERS) else [0.8] * cast.shape[1]
    accuracy, share, high = np.array(start), 0.8, None
    for _ in range(rounds):
        odds = np.log(share / (1 - share)) + cast @ np.log(accuracy / (1 - accuracy))
        new = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
        if high is not None and np.abs(new - high).max() < 1e-9:
            break
        high = new
        right = n @ ((cast > 0) * high[:, None] + (cast < 0) * (1 - high)[:, None])
        accuracy = np.clip((right + 1.2) / (n @ (cast != 0) + 2), 0.55, 0.999)
        share = np.clip((n @ high + 8) / (n.sum() + 10), 0.2, 0.8)
    return dict(zip(patterns, high.tolist(), strict=True))


def features(data: bytes, stats: tuple[float, ...] | None) -> np.ndarray:
    """Hashed features: roots of the frequencies of byte-kind trigrams, and a bucket of each statistic."""
    out = np.zeros(DIMENSIONS, dtype=np.float32)
    kind = _KIND[np.frombuffer(data, dtype=np.uint8)]
    if len(kind) > 2:
        out[:512] = np.sqrt(np.bincount(kind[:-2] * 64 + kind[1:-1] * 8 + kind[2:], minlength=512) / len(kind))
    for (name, *_), x in zip(LABELLERS, stats or (), strict=False):
        out[512 + zlib.crc32(f"{name}={int(min(x, 1.0) * 10)}".encode()) % (DIMENSIONS - 512)] += 0.5
    return out


def fit_scorer(x: np.ndarray, target: np.ndarray, rounds: int = 400, rate: float = 2.0, decay: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels by full-batch gradient steps with momentum; the last weight is the offset."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=np.float32)])
    w, speed = np.zeros(x.shape[1], dtype=np.float32), 0.0
    for _ in range(rounds if len(x) else 0):
        slope = x.T @ (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - target) / len(x) + decay * w
        speed = 0.9 * speed - rate * slope
        w = w + speed
    return w.astype(np.float32)


def _count_patterns(texts: list) -> tuple[list, list]:
    seen = Counter(votes(statistics((t or "").encode())) for t in texts)
    return [0] * len(seen), [[list(p) for p in seen], list(seen.values())]


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple[dict[tuple[int, ...], float], np.ndarray]:
    """The probability of each vote pattern, from all documents, and the scorer's weights, from `sample` of them at most.

    The pattern counts are bounded by 2**11 whatever the corpus. The sample is the rows of least hash of doc_id and text.
    """
    body = docs.select("doc_id", "text")
    counted = expand_rows(body, [], ["text"], _count_patterns, "pattern array<int>, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    counts = {tuple(r["pattern"]): r["n"] for r in counted}
    known, total = estimate(counts), sum(counts.values())
    rank = F.xxhash64("doc_id", "text", F.lit(11))
    share = min(1.0, 1.5 * sample / max(1, total))
    some = body.withColumn("h", rank)
    if share < 1:
        some = some.where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)))

    def row(texts: list) -> list[list]:
        data = [(t or "").encode() for t in texts]
        stats = [statistics(d) for d in data]
        return [[features(d, s).tobytes() for d, s in zip(data, stats, strict=True)], [known[votes(s)] for s in stats]]

    picked = add_columns(some, ["text"], row, "x binary, target double", drop=("text",)).orderBy("h", "target").limit(sample).collect()
    x = np.array([np.frombuffer(r["x"], dtype=np.float32) for r in picked], dtype=np.float32).reshape(-1, DIMENSIONS)
    return known, fit_scorer(x, np.array([r["target"] for r in picked], dtype=np.float32))


def classify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs with n_low and n_high (votes), posterior (of the vote pattern), score (of the linear scorer) and keep.

    docs needs doc_id and text; every column stays, and a column that has one of these names is replaced. keep is score >= 0.5.
    A text of fewer than four words, an empty or null one gets no vote and is kept with score 1: nothing speaks against it.
    An empty table gives an empty result. Equal texts get equal scores.
    """
    known, weights = fit(docs, sample)

    def judge(texts: list) -> list[list]:
        data = [(t or "").encode() for t in texts]
        stats = [statistics(d) for d in data]
        cast = [votes(s) for s in stats]
        x = np.array([features(d, s) for d, s in zip(data, stats, strict=True)], dtype=np.float32).reshape(-1, DIMENSIONS)
        score = 1 / (1 + np.exp(-np.clip(x.astype(np.float64) @ weights[:-1].astype(np.float64) + float(weights[-1]), -30, 30)))
        score[[s is None for s in stats]] = 1.0
        return [
            [c.count(-1) for c in cast], [c.count(1) for c in cast], [known.get(c, 0.5) for c in cast], score, score >= KEEP_FROM
        ]

    return add_columns(docs, ["text"], judge, "n_low long, n_high long, posterior double, score double, keep boolean")
