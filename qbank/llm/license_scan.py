"""License notices: exact phrases, and text blocks that contain a template's words (set-similarity join)."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import IS_WORD, WORD_BYTES, add_columns, expand_rows, words

# Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Templates by label. A block that holds THRESHOLD of a template's distinct words carries its label. Blocks are, line ends ignored,
#: all runs of as many words as the template has, divided by THRESHOLD: room for as many strange words.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2.0",
    "mit": "released under the mit license",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "cc-by-nc-4.0": "licensed under cc by-nc 4.0",
    "bsd-3-clause": "redistribution and use in source and binary forms with or without modification are permitted",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2.0",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "no-warranty": "the software is provided as is without warranty of any kind",
}
THRESHOLD = 0.8

_GAP = rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
_EDGE = rb"[0-9a-z\x80-\xff]"
_PHRASE = {label: re.compile(rb"(?<!" + _EDGE + rb")" + _GAP.join(p.encode().split()) + rb"(?!" + _EDGE + rb")") for p, label in PHRASES.items()}
_RAREST = {label: max(p.encode().split(), key=len) for p, label in PHRASES.items()}
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def template_words() -> dict[str, frozenset[bytes]]:
    return {label: frozenset(words(t.encode())) for label, t in TEMPLATES.items()}


def frequencies(docs: DataFrame) -> dict[bytes, int]:
    """Documents that hold each template word, over all documents. As many rows to collect as the templates have words."""
    vocabulary = frozenset().union(*template_words().values())

    def count(texts: list) -> tuple[list, list]:
        seen = Counter(w for t in texts if t for w in vocabulary.intersection(words(t.encode())))
        return [0] * len(seen), [list(seen), list(seen.values())]

    rows = expand_rows(docs.select("text"), [], ["text"], count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["word"]): r["n"] for r in rows}


class Index:
    """Inverted index over the prefixes of the templates, words in global order: rarest first, ties by the word."""

    def __init__(self, frequency: dict[bytes, int], threshold: float = THRESHOLD):
        self.rank = {w: i for i, w in enumerate(sorted(frozenset().union(*template_words().values()), key=lambda w: (frequency.get(w, 0), w)))}
        self.templates, self.postings = [], {}
        for label, held in template_words().items():
            ordered = sorted(held, key=self.rank.__getitem__)
            need = math.ceil(threshold * len(ordered) - 1e-9)
            # Whoever holds `need` of the words holds one of the first len - need + 1.
            for at, w in enumerate(ordered[: len(ordered) - need + 1]):
                self.postings.setdefault(w, []).append((len(self.templates), at))
            self.templates.append((label, ordered, need))
        self.spans = {label: math.ceil(len(words(t.encode())) / threshold - 1e-9) for label, t in TEMPLATES.items()}

    def matches(self, block: set[bytes]) -> dict[str, float]:
        """Templates that the block contains to the threshold, with their containment."""
        out, seen = {}, set()
        held = sorted((self.rank[w], w) for w in block if w in self.rank)
        for mine, (_, w) in enumerate(held):
            for t, at in self.postings.get(w, ()):
                if t in seen:
                    continue
                seen.add(t)
                label, ordered, need = self.templates[t]
                # Length filter; then, as both sides are in the same order and this is the first word they share, no more
                # than the rest of either side can follow.
                if len(held) < need or 1 + min(len(ordered) - at - 1, len(held) - mine - 1) < need:
                    continue
                common = sum(x in block for x in ordered[at:])
                if common >= need:
                    out[label] = common / len(ordered)
        return out

    def passages(self, text: list[bytes], among: dict[str, float]) -> dict[str, float]:
        """Those of the templates among that some run of the text's words contains to the threshold, with the greatest containment."""
        out = {}
        for label, ordered, need in self.templates:
            if label not in among:
                continue
            held, span, inside, first, best = frozenset(ordered), self.spans[label], Counter(), 0, 0
            places = [i for i, w in enumerate(text) if w in held]
            for i in places:
                inside[text[i]] += 1
                while places[first] <= i - span:
                    gone = text[places[first]]
                    inside[gone] -= 1
                    if not inside[gone]:
                        del inside[gone]
                    first += 1
                best = max(best, len(inside))
            if best >= need:
                out[label] = best / len(ordered)
        return out


def scan_text(text: str | None, index: Index) -> tuple:
    """(words, base places, first word, last word, base labels, labels, score) of one text."""
    data = (text or "").encode()
    low = data.translate(_LOWER)
    is_word = IS_WORD[np.frombuffer(data.translate(WORD_BYTES), dtype=np.uint8)]
    starts = np.flatnonzero(is_word & ~np.concatenate([[False], is_word[:-1]])) if len(data) else np.zeros(0, dtype=np.int64)
    places, base = [], set()
    for label, pattern in _PHRASE.items():
        if _RAREST[label] in low:
            for m in pattern.finditer(low):
                places.append(int(np.searchsorted(starts, m.start())))
                base.add(label)
    labels, score = set(base), 1.0 if base else 0.0
    if any(w in low for w in index.postings):
        text = words(low)
        # What the whole text does not hold, no block of it does.
        if among := index.matches(set(text)):
            found = index.passages(text, among)
            labels.update(found)
            score = max(score, *found.values(), 0.0)
    return (
        len(starts), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score
    )


def scan(docs: DataFrame) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels and score.

    docs needs text; every other column stays (those named as results are replaced). Words are runs of ASCII letters, digits and
    non-ASCII characters, A-Z lower-cased; a null text is empty: no words, no labels, score 0. n_base counts the places where
    the words of a base phrase stand one after another; first_word and last_word are their least and greatest first word.
    labels adds to the base labels each template of which some block holds at least 0.8 of the distinct words. Blocks are all
    runs of words of 1.25 times the template's length whatever line ends they cross, so that a notice counts however it is
    wrapped, and words scattered over a longer line are none.
    score is 1 for a text with a base phrase, else the greatest containment that reached 0.8, else 0.

    The templates are a fixed, short list, so their prefix index goes to every task and texts are joined to it without a shuffle.
    Its global order is by document frequencies counted over all of docs.
    """
    index = Index(frequencies(docs))

    def run(texts: list) -> list[list]:
        return [list(c) for c in zip(*(scan_text(t, index) for t in texts), strict=True)] or [[]] * 7

    return add_columns(docs, ["text"], run, "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
