"""Repeated strings and passages against brute force, in buckets of every kind."""

import itertools
import random

import pytest
from test_operators import brute_repeats, corpus, frame, prose

from qbank.llm import suffix_dedup
from qbank.llm._common import words


def passages(texts):
    """Texts without their passages, and how many each has."""
    rest, counts = [], []
    for t, flags in zip(texts, brute_repeats(texts, suffix_dedup.PASSAGE)[1], strict=True):
        data, at, kept, n = (t or "").encode(), 0, b"", 0
        for on, run in itertools.groupby(flags):
            size = len(list(run))
            part = data[at : at + size]
            gone = bool(on) and len(words(part)) >= suffix_dedup.PASSAGE_WORDS
            kept, n, at = kept + (b"" if gone else part), n + gone, at + size
        rest.append(kept), counts.append(n)
    return rest, counts


def shared_corpus():
    rng = random.Random(14)
    shared = prose(rng, 160)
    texts = corpus(3, 15) + [prose(rng, 9) + shared[rng.randrange(200) :] + prose(rng, 20) for _ in range(10)]
    for _ in range(40):  # one byte of a passage changed, so that most of its suffixes tie in part
        at = rng.randrange(len(shared))
        texts.append(prose(rng, 3) + " " + shared[:at] + "#" + shared[at + 1 :])
    return [*texts, shared + shared, "é" * 400, prose(rng, 60), "w" * 300, "w" * 299]


@pytest.mark.parametrize("bucket", [4096, 4, 0])
def test_both_lengths(spark, monkeypatch, bucket):
    monkeypatch.setattr(suffix_dedup, "BUCKET", bucket)
    texts = shared_corpus()
    kept, flags = brute_repeats(texts)
    _, counts = passages(texts)
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(frame(spark, texts), passages=True).collect()}
    for i, (k, f, n) in enumerate(zip(kept, flags, counts, strict=True)):
        assert (bytes(got[i]["kept"]), got[i]["n_removed"], got[i]["n_passages"]) == (k, sum(f), n), i
    assert sum(counts) > 0


def test_passages(spark):
    texts = shared_corpus()
    long, short = brute_repeats(texts)[1], brute_repeats(texts, suffix_dedup.PASSAGE)[1]
    got = {r["doc_id"]: r for r in suffix_dedup.remove_passages(frame(spark, texts)).collect()}
    for i, (t, a, b) in enumerate(zip(texts, long, short, strict=True)):
        data, gone = (t or "").encode(), bytearray(a)
        for f in range(len(b)):
            if b[f] and (f == 0 or not b[f - 1]):
                e = f + len(list(itertools.takewhile(bool, b[f:])))
                if len(words(data[f:e])) >= suffix_dedup.PASSAGE_WORDS:
                    gone[f:e] = b"\1" * (e - f)
        want = bytes(x for x, g in zip(data, gone, strict=True) if not g)
        assert (bytes(got[i]["kept"]), got[i]["n_spans"]) == (want, len([1 for on, _ in itertools.groupby(gone) if on])), i


def test_repeated_ids_and_clashing_names(spark):
    rng = random.Random(1)
    t = prose(rng, 120)
    rows = [(1, t, 1), (1, t, 2), (1, prose(rng, 120), 3), (None, t, 4), (2, None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, Kept int")
    out = suffix_dedup.remove_repeats(df)
    assert [c for c in out.columns if c.lower() == "kept"] == ["kept"]
    assert sorted((r["n_bytes"] > 0, r["n_bytes"] == r["n_removed"]) for r in out.collect()) == [(False, True), (True, False), (True, True), (True, True), (True, True)]
