"""The labelers' reliabilities against a plain version, what the classifier adds, and long texts."""

import random
import time
from collections import Counter

import numpy as np
from test_operators import frame, prose

from qbank.llm import pii


def test_estimate_over_spans():
    """Expectation-maximisation over single spans in place of counts of patterns."""
    rng = np.random.default_rng(3)
    spans = [(int(rng.integers(5)), *map(int, rng.choice([-1, 0, 1], 4, p=[0.2, 0.3, 0.5])), int(rng.integers(6))) for _ in range(400)]
    yes = [1 / (1 + np.exp(-(sum(s[1:5]) + 1.5 * s[1]))) for s in spans]
    for _ in range(100):
        logs = [[], []]
        for side in (0, 1):
            w = [y if side else 1 - y for y in yes]
            rate = {(j, v): 1 + sum(x for x, s in zip(w, spans, strict=True) if s[1 + j] == v) for j in range(4) for v in (-1, 0, 1)}
            whole = {j: sum(rate[j, v] for v in (-1, 0, 1)) for j in range(4)}
            prior = {k: 1 + sum(x for x, s in zip(w, spans, strict=True) if s[0] == k) for k in range(5)}
            logs[side] = [np.log(prior[s[0]]) + sum(np.log(rate[j, s[1 + j]] / whole[j]) for j in range(4)) for s in spans]
        yes = [1 / (1 + np.exp(a - b)) for a, b in zip(*logs, strict=True)]
    known = pii.estimate(Counter(spans))
    assert max(abs(known[s] - y) for s, y in zip(spans, yes, strict=True)) < 1e-5


def test_secrets_are_added_and_plain_assignments_are_not(spark):
    rng = random.Random(6)
    secret = lambda: "".join(rng.choice("abcdef0123456789") for _ in range(32))
    texts, want = [], []
    for i in range(300):
        text = prose(rng, 40)
        if i % 3 == 0:
            text += f' api_key = "{secret()}" ' + prose(rng, 5)
        elif i % 3 == 1:
            text += " token: " + "a" * rng.randint(12, 20) + " " + prose(rng, 5)
        texts.append(text), want.append(i % 3 == 0)
    got = {r["doc_id"]: any(s["kind"] == "secret" for s in r["pii"]) for r in pii.find(frame(spark, texts)).collect()}
    assert np.mean([got[i] == w for i, w in enumerate(want)]) > 0.98


def test_long_texts_take_linear_time():
    n = 300_000
    for text in ("1" * n, "1." * n, "+1 " * n, "+1" + " " * n, "a" * n + "@", "a@" * n, "1 " * n, "1-" * n, "token" + " " * n, "token = " * (n // 8), "A" * n, "." * n, "1.2.3" * n):
        began = time.time()
        pii.candidates(text)
        assert time.time() - began < 5, text[:10]


def test_model_from_nothing(spark):
    assert pii.find(frame(spark, ["no data", None, ""])).count() == 3
