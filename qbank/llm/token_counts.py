"""Token counts under a unigram model, by dynamic programming shared along a trie of distinct pre-tokens."""

from __future__ import annotations

import math
from collections import Counter
from os.path import commonprefix

from pyspark.sql import DataFrame

from ._common import add_columns

#: Pre-tokens whose counts a worker remembers; it forgets all when there are more.
REMEMBERED = 400_000
#: Added to the score for each byte of a character that no piece covers.
BYTE_SCORE = -30.0
SPACE = "▁"


class Unigram:
    """Pieces with log-probabilities, from a sentencepiece model file.

    The file has merge ranks, no probabilities, so a piece's is taken from Zipf's law over its rank: log(1 / (rank * H)), H the
    harmonic sum. A character without a piece counts as its UTF-8 bytes.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        pieces = [
            model.id_to_piece(i) for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
        ]
        total = math.log(sum(1 / (i + 1) for i in range(len(pieces))))
        self.score = {p: -math.log(i + 1) - total for i, p in enumerate(pieces)}
        self.longest = max(map(len, pieces))
        self.known: dict[str, tuple[int, int]] = {}

    def extend(self, word: str, path: list[tuple[float, int, int]]) -> None:
        """Forward scores of the prefixes of word that path does not hold yet: best (score, -tokens, -byte tokens)."""
        get, longest = self.score.get, self.longest
        for end in range(len(path), len(word) + 1):
            c = len(word[end - 1].encode())
            s, t, f = path[end - 1]
            best = (s + BYTE_SCORE * c, t - c, f - c)
            for start in range(max(0, end - longest), end):
                x = get(word[start:end])
                if x is not None:
                    s, t, f = path[start]
                    if (s + x, t - 1, f) > best:
                        best = (s + x, t - 1, f)
            path.append(best)

    def learn(self, words: set[str]) -> None:
        """Walks the trie of the words, each with its mark, in order: the path holds one forward score for each prefix, and is
        only taken back to the prefix shared with the next word. At a terminal the counts are stored under the word itself."""
        path, last = [(0.0, 0, 0)], ""
        for word in sorted(SPACE + w for w in words):
            if not word.startswith(last):
                del path[len(commonprefix((last, word))) + 1 :]
            self.extend(word, path)
            self.known[word[len(SPACE) :]] = (-path[-1][1], -path[-1][2])
            last = word

    def counts(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """(pre-tokens, tokens, byte tokens) of each text."""
        bags = [Counter(t.split()) for t in texts]
        new = set().union(*bags).difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = set().union(*bags)
        self.learn(new)
        out = []
        for bag in bags:
            tokens = spelt = 0
            for w, n in bag.items():
                a, b = self.known[w]
                tokens += a * n
                spelt += b * n
            out.append((sum(bag.values()), tokens, spelt))
        return out


_MODELS: dict[str, Unigram] = {}


def count_tokens(docs: DataFrame, model_path: str) -> DataFrame:
    """docs with n_pretokens, n_tokens and n_byte_tokens.

    docs needs text; every other column stays (those named as results are replaced). Pre-tokens are what white space leaves
    apart, each with a leading word mark; a null, empty or blank text has none. The tokens of a pre-token are those of its best
    path under the unigram model; of equally good paths the one with fewer tokens counts, then the one with fewer bytes.

    Nothing is shuffled: each batch inserts the distinct pre-tokens that its worker has not met into a trie (in sorted order, so
    only the current path is held) and computes one forward score for each shared prefix.
    """

    def run(texts: list) -> list[list]:
        model = _MODELS.setdefault(model_path, None) or Unigram(model_path)
        _MODELS[model_path] = model
        return [list(c) for c in zip(*model.counts([t or "" for t in texts]), strict=True)] or [[]] * 3

    return add_columns(docs, ["text"], run, "n_pretokens long, n_tokens long, n_byte_tokens long")
