"""The quality classifier on corpora of other scripts, code and verse, and its estimates against a plain version."""

import random
from collections import Counter

import numpy as np
import pytest
from test_operators import frame, prose

from qbank.llm import quality

HAN = "的一是了我不人在他有这个上们来到时大地为子中你说生国年着就那和要出也得里后自以会家可下而过天去能对小多然于心学么之都好看起"
CODE = (
    "def {0}({1}, {2}):", "    if {0} == {1} and not {2}[{1}]:", "    return {0} + {1} * ({2} - 1)", "for (int i = 0; i < {0}; ++i) {{",
    '    {0}->{1}(&{2}, *{0}, "%d\\n");', "}}", "", "# {0} {1}", "    x[{0}] |= {1} << 2; /* {2} */", "if ({0} && {1} || !{2}) {{",
)


def han(rng):
    clause = lambda: "".join(rng.choice(HAN) for _ in range(rng.randint(8, 20))) + rng.choice("，。。！")
    return "".join(clause() for _ in range(rng.randint(8, 40)))


def code(rng):
    return "\n".join(rng.choice(CODE).format(*prose(rng, 3).split()) for _ in range(rng.randint(15, 60)))


def verse(rng):
    return "\n".join(prose(rng, rng.randint(4, 8)) + rng.choice(["", ",", ";", "!"]) for _ in range(rng.randint(12, 40)))


def sentences(rng):
    return " ".join(prose(rng, 12).capitalize() + "." for _ in range(10))


def junk(rng):
    w = prose(rng, 80).split()
    return rng.choice([" ".join(x + "###" for x in w), " ".join(x.upper() + "!!" for x in w), " ".join([w[0]] * 60), " | ".join(w)])


@pytest.mark.parametrize("bad", [0, 20, 100])
def test_clean_text_of_other_kinds_stays(spark, bad):
    rng = random.Random(3 + bad)
    texts = [kind(rng) for kind in (han, code, verse, sentences) for _ in range(80)] + [junk(rng) for _ in range(bad)]
    keep = {r["doc_id"]: r["keep"] for r in quality.classify(frame(spark, texts)).select("doc_id", "keep").collect()}
    for first in range(0, 320, 80):
        assert np.mean([keep[i] for i in range(first, first + 80)]) >= 0.98, first
    if bad == 100:
        assert np.mean([keep[i] for i in range(320, 420)]) < 0.02


def test_only_texts_without_full_stops(spark):
    rng = random.Random(9)
    rows = quality.classify(frame(spark, [prose(rng, 150) for _ in range(60)])).collect()
    assert all(r["keep"] for r in rows)


def test_expectation_maximisation_over_documents():
    """Plain EM, one document after another, in place of counts of patterns."""
    rng = np.random.default_rng(5)
    cast = rng.choice([-1, 0, 1], size=(300, len(quality.LABELLERS)), p=[0.2, 0.5, 0.3])
    accuracy, share = [a for *_, a in quality.LABELLERS], 0.8
    for _ in range(300):
        high = []
        for row in cast:
            good, bad = share, 1 - share
            for v, a in zip(row, accuracy, strict=True):
                if v:
                    good, bad = good * (a if v > 0 else 1 - a), bad * (a if v < 0 else 1 - a)
            high.append(good / (good + bad))
        for j in range(cast.shape[1]):
            right = sum(h if v > 0 else 1 - h for h, v in zip(high, cast[:, j], strict=True) if v)
            accuracy[j] = min(max((right + 1.2) / (np.count_nonzero(cast[:, j]) + 2), 0.55), 0.999)
        share = min(max((sum(high) + 8) / (len(high) + 10), 0.2), 0.8)
    known = quality.estimate(Counter(map(tuple, cast.tolist())), rounds=300)
    assert max(abs(known[tuple(row)] - h) for row, h in zip(cast.tolist(), high, strict=True)) < 1e-5


def test_statistics_are_linear_on_long_texts():
    for text in (b"x" * 2_000_000, b"a " * 1_000_000, b"(" * 1_000_000, b". " * 1_000_000):
        assert len(quality.statistics(text)) == len(quality.LABELLERS)


def test_repeated_ids_and_clashing_names(spark):
    rng = random.Random(2)
    rows = [(i % 3, t, 1.5) for i, t in enumerate([sentences(rng) for _ in range(9)] + [None])]
    out = quality.classify(spark.createDataFrame(rows, "doc_id long, text string, Score double"))
    assert [c.lower() for c in out.columns].count("score") == 1 and out.count() == 10
