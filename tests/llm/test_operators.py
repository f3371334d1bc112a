"""Each operator against a brute-force version on small tables with nulls, blanks, long texts, ties and repeated rows."""

import hashlib
import itertools
import math
import random
import re
import timeit
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import types as T

from qbank.llm import ann_pstable, license_scan, near_dup_vectors, ngram_join, packing, pii, piece_dropout, quality, suffix_dedup, token_counts
from qbank.llm._common import components
from qbank.llm.queries import op6_pii

DOCS = "doc_id long, text string, lang string, score string, n_chars long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeéou") for _ in range(rng.randint(1, 7))) for _ in range(n))


def corpus(seed=1, n=40):
    """Texts with copies, near copies, shared passages, blanks, nulls and one very long text."""
    rng = random.Random(seed)
    passage = prose(rng, 120)
    texts = [None, "", "   \n ", "one two", "one two", "ONE two!", "x" * 3000, "ab " * 900]
    for i in range(n):
        t = prose(rng, rng.randint(20, 200))
        texts.append(t)
        if i % 4 == 0:
            texts.append(t)
        if i % 3 == 0:
            w = t.split()
            w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
        if i % 5 == 0:
            texts.append(prose(rng, 30) + " " + passage + " " + prose(rng, 10))
    texts.append(prose(rng, 4000))
    return texts


def frame(spark, texts, ids=None):
    rows = [(i, t, None, "own", None) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, DOCS).repartition(5)


def classes(nodes, links):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def brute_jaccard(texts):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(low))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if sets[a] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    return links


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = classes({x for e in edges for x in e}, edges)
    assert {n: c for n, c in want.items() if any(n in e and e[0] != e[1] for e in edges)} == got


@pytest.mark.parametrize("block", [1024, 3])
def test_ngram_join(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(9)
    base = prose(rng, 150).split()
    near = []
    for _ in range(30):  # a group of near copies larger than a block
        w = list(base)
        w[rng.randrange(150)] = prose(rng, 1)
        near.append(" ".join(w))
    texts = corpus() + near
    links = brute_jaccard(texts)
    want = classes(range(len(texts)), links)
    count = {i: sum(i in e for e in links) for i in range(len(texts))}
    got = {r["doc_id"]: r for r in ngram_join.near_duplicates(frame(spark, texts)).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n_links"] for i, r in got.items()} == count
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_ngram_join_without_rows_or_ids(spark):
    assert ngram_join.near_duplicates(frame(spark, [])).count() == 0
    rows = ngram_join.near_duplicates(frame(spark, ["a b c d e f"] * 3, [None, 4, 4])).collect()
    assert sorted((r["doc_id"] is None, r["n_links"], r["kept"]) for r in rows) == [(False, 1, True), (False, 1, True), (True, 0, True)]


def test_forest_recall():
    rng = np.random.default_rng(2)
    assert ngram_join.recall_at(ngram_join.depth_for()) >= ngram_join.RECALL
    hits = 0
    for _ in range(200):
        common, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (160, 20, 20))
        x, y = (ngram_join.signature(np.concatenate([common, s])) for s in (a, b))
        hits += bool((x[:, : ngram_join.depth_for()] == y[:, : ngram_join.depth_for()]).all(axis=1).any())
    assert hits == 200


def vectors(seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(150):
        v = rng.normal(size=16)
        rows.append((len(rows), v.tolist(), i % 3))
        if i % 3 == 0:
            rows.append((len(rows), (3 * v + rng.normal(size=16) * 0.2).tolist(), int(i % 3 + (i % 9 == 0))))
        if i % 10 == 0:
            rows += [(len(rows) + k, v.tolist(), i % 3) for k in range(3)]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [1.0] * 8, [1.0] * 8 + [0.0] * 8, [float("inf")] * 16]
    rows += [(len(rows) + k, v, 0) for k, v in enumerate(odd)] + [(9000 + k, rows[0][1], None) for k in range(2)]
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]


VECTORS = "vec_id long, embedding array<float>, label int"


def good(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)


@pytest.mark.parametrize("block", [2048, 5])
def test_vector_near_dups(spark, monkeypatch, block):
    monkeypatch.setattr(near_dup_vectors, "BLOCK", block)
    rows = vectors()
    links = []
    for (a, x, m), (b, y, n) in itertools.combinations(rows, 2):
        if m is not None and m == n and good(x) and good(y) and len(x) == len(y):
            p, q = np.array(x), np.array(y)
            if p @ q / (np.sqrt(p @ p) * np.sqrt(q @ q)) >= 0.98:
                links.append((a, b))
    want = classes([r[0] for r in rows], links)
    got = {r["vec_id"]: r for r in near_dup_vectors.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n_links"] for i, r in got.items()} == {r[0]: sum(r[0] in e for e in links) for r in rows}
    assert near_dup_vectors.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def brute_search(rows, queries, k):
    out = {}
    for q, x, _ in queries:
        if good(x):
            found = []
            for i, y, _ in rows:
                if i != q and good(y):
                    n = max(len(x), len(y))
                    p, r = np.zeros(n), np.zeros(n)
                    p[: len(x)], r[: len(y)] = x, y
                    found.append((-float((p * r).sum()), i))
            out[q] = sorted(found)[:k]
    return out


def test_ann(spark):
    rng = np.random.default_rng(8)
    rows = vectors() + [(20000 + i, rng.normal(size=16).astype(np.float32).tolist(), 0) for i in range(4000)]
    df = spark.createDataFrame(rows, VECTORS)
    got = {}
    for r in ann_pstable.search(df, df.where("vec_id % 20 = 0")).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    want = brute_search(rows, [r for r in rows if r[0] % 20 == 0], 20)
    assert got.keys() == want.keys()
    hit = total = 0
    for q, best in want.items():
        mine = [got[q][i + 1] for i in range(20)]
        assert mine == sorted(mine, key=lambda t: (-t[1], t[0]))
        hit += sum(s >= -best[-1][0] - 1e-9 for _, s in mine)
        total += 20
    assert hit / total >= 0.9
    few = spark.createDataFrame(rows[:6], VECTORS)
    assert ann_pstable.search(few, few.where("vec_id = 0")).count() == 5
    assert ann_pstable.search(few.limit(0), few).count() == 0 and ann_pstable.search(few, few.limit(0)).count() == 0


def test_ann_ties(spark):
    rows = [(i, [1.0, 2.0, 3.0], None) for i in range(50)]
    df = spark.createDataFrame(rows, VECTORS)
    got = sorted((r["rank"], r["vec_id"]) for r in ann_pstable.search(df, df.where("vec_id = 3")).collect())
    assert [v for _, v in got] == [i for i in range(21) if i != 3]


def brute_repeats(texts, n=400):
    seen = {}
    data = [(t or "").encode() for t in texts]
    for d, b in enumerate(data):
        for i in range(len(b) - n + 1):
            seen.setdefault(hashlib.md5(b[i : i + n]).digest(), []).append((d, i))
    flags = [bytearray(len(b)) for b in data]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                flags[d][i : i + n] = b"\1" * n
    return [bytes(x for x, f in zip(b, fl, strict=True) if not f) for b, fl in zip(data, flags, strict=True)], flags


@pytest.mark.parametrize("bucket", [4096, 1])
def test_suffix_dedup(spark, monkeypatch, bucket):
    monkeypatch.setattr(suffix_dedup, "BUCKET", bucket)
    rng = random.Random(4)
    shared = prose(rng, 200)
    # The passage in different places of different texts, cut at different ends, twice in one text, and just too short.
    texts = corpus(2, 25) + [prose(rng, 9) + shared[rng.randrange(300) :] + prose(rng, 20) for _ in range(12)]
    texts += [shared + "é" + shared, "é" * 400 + "a", "b" + "é" * 400, prose(rng, 50)[:99] + "Q" * 399, "R" + "Q" * 399]
    kept, flags = brute_repeats(texts)
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(frame(spark, texts)).collect()}
    for i, (k, f) in enumerate(zip(kept, flags, strict=True)):
        assert bytes(got[i]["kept"]) == k, i
        assert got[i]["n_removed"] == sum(f) and got[i]["n_bytes"] == len(f)
        assert got[i]["n_spans"] == len([1 for on, _ in itertools.groupby(f) if on])
        assert got[i]["lang"] is None and got[i]["score"] == "own"
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0
    rows = suffix_dedup.remove_repeats(frame(spark, [shared, shared, "z"], [None, None, None])).collect()
    assert sorted(r["n_removed"] for r in rows) == [0, len(shared.encode()), len(shared.encode())]


def test_token_counts(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = token_counts.Unigram(path)

    def brute(word):
        best = {0: (0.0, 0, 0)}
        for end in range(1, len(word) + 1):
            c = len(word[end - 1].encode())
            s, t, f = best[end - 1]
            options = [(s + token_counts.BYTE_SCORE * c, t - c, f - c)]
            for start in range(end):
                if word[start:end] in model.score:
                    s, t, f = best[start]
                    options.append((s + model.score[word[start:end]], t - 1, f))
            best[end] = max(options)
        return -best[len(word)][1], -best[len(word)][2]

    texts = corpus(6, 10) + ["antidisestablishmentarianism 東京タワー 🙂", "a▁b c"]
    got = {r["doc_id"]: r for r in token_counts.count_tokens(frame(spark, texts), path).collect()}
    for i, t in enumerate(texts):
        each = [brute("▁" + w) for w in (t or "").split()]
        assert (got[i]["n_pretokens"], got[i]["n_tokens"], got[i]["n_byte_tokens"]) == (len(each), sum(a for a, _ in each), sum(b for _, b in each))
        assert got[i]["score"] == "own"
    assert token_counts.count_tokens(frame(spark, []), path).count() == 0


HARD = ["a  b   c", " lead", "trail ", "two\n\nlines \n x", "mark ▁ and ▁▁x", "nul \0 in", "\0", "\0a", "東京🙂", "▁", " ", "\n", "a\r\n\tb"]


def test_token_counts_of_marked_words():
    """A word that begins with the mark, met before or together with the same word without it."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    model, other = token_counts.Unigram(path), token_counts.Unigram(path)
    (marked,), ((plain,), (twice,)) = other.counts(["▁foo"]), (token_counts.Unigram(path).counts([t]) for t in ("foo", "▁▁foo"))
    assert model.counts(["▁foo"]) == [marked]
    assert model.counts(["▁foo foo"]) == [tuple(a + b for a, b in zip(marked, plain))]
    assert model.counts(["▁▁foo", "▁foo", "foo"]) == [twice, marked, plain]


def test_piece_dropout_cuts_and_agendas():
    """Chunks end only where no merge can cross, and both kinds of agenda give the same."""
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model, own = piece_dropout.pieces(path), sentencepiece.SentencePieceProcessor(model_file=path)
    marked = ['f(x);}, {"a": [1,2]}...', "e.g. 3.14, no.", "«mot», l'été?!", "a&&b || !c", "x='y';", "--(a)-- (b).c", ",", "a,b,,c , d", "http://a.b/c?d=e&f=g", "word,\nnext.\n\n(end)", "ab12,34;5:6", "“q”…"]
    for t in marked + [t for t in corpus(11, 40) if t and "▁" not in t and "\0" not in t]:
        assert model.encode(t, None)[0].tolist() == own.encode(t), t
        for chunk in {c.replace(" ", "▁") for c in t.split("\n")}:
            for key in (None, 5):
                assert model._merge_short(chunk, key, 2**30) == model._merge_long(chunk, key, 2**30)


def test_piece_dropout(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model, own = piece_dropout.pieces(path), sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [t or "" for t in corpus(7, 12)] + HARD
    for t in texts:
        if "▁" not in t and "\0" not in t:
            assert model.encode(t, None)[0].tolist() == own.encode(t), t
        for seed in (None, 1, 2):
            assert model.decode(model.encode(t, seed, 0.3)[0].tolist()) == t
    long = max(texts, key=len)
    a, b, again = (model.encode(long, s, 0.2)[0].tolist() for s in (1, 2, 1))
    assert a == again and a != b and len(a) > len(own.encode(long))
    rows = piece_dropout.round_trip(frame(spark, texts), path).collect()
    assert len(rows) == len(texts) and all(r["lossless"] for r in rows) and sum(r["n_skipped"] for r in rows) > 0
    coded = piece_dropout.encode(frame(spark, texts), path)
    crc = {r["doc_id"]: r["ids_crc32"] for r in rows}
    for r in piece_dropout.decode(coded, path).collect():
        assert r["decoded"] == texts[r["doc_id"]]
        assert zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == crc[r["doc_id"]]
    assert piece_dropout.round_trip(frame(spark, []), path).count() == 0


def test_piece_dropout_cuts_a_word_anew_each_time(spark):
    """Many segmentations of one word, in one document and over documents; skips at the rate asked for; memory changes nothing."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    model, n = piece_dropout.pieces(path), 3000
    coded = piece_dropout.encode(frame(spark, ["international\n" * n] + ["international"] * 400), path).collect()
    one = next(r for r in coded if r["doc_id"] == 0)
    line = model.encode("\n", None)[0].tolist()[-1]
    inside = {tuple(g) for end, g in itertools.groupby(one["ids"], lambda i: i == line) if not end}
    assert len(inside) > 10 and len({tuple(r["ids"]) for r in coded if r["doc_id"]}) > 10
    merges = model.merge("international", None, 0)[2]
    first = [model.merge("international", int(k), int(0.1 * 2**32))[1][:1] for k in np.random.default_rng(1).integers(0, 2**64, n, dtype=np.uint64)]
    for g in range(merges):
        assert sum(s == (g,) for s in first) / n == pytest.approx(0.1 * 0.9**g, abs=0.02)
    texts = [t for t in corpus(12, 20) if t] + HARD
    warm = [model.encode(t, 9, 0.3)[0].tolist() for t in texts]
    assert warm == [model.encode(t, 9, 0.3)[0].tolist() for t in texts] == [piece_dropout.Pieces(path).encode(t, 9, 0.3)[0].tolist() for t in texts]


def test_packing(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = packing.WordTokenizer(path)
    texts = corpus(8, 60) + HARD + ["ΣΑΣ İ <|endoftext|> x", "it's I'LL 12.5 ½ a.́b ..x. _.a", "ﬁ\x1cb"]
    rows = packing.pack(frame(spark, texts), path, with_ids=True).collect()
    docs, sequences = {}, {}
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) and len(r["ids"]) == r["length"]
        docs.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    for i, t in enumerate(texts):
        own = sorted(docs[i], key=lambda r: r["start"])
        ids = tok.whole.encode(t or "", add_special_tokens=False).ids + [1]
        assert [x for r in own for x in r["ids"]] == ids and all(r["doc_tokens"] == len(ids) for r in own)
        assert [r["start"] for r in own] == list(itertools.accumulate([0] + [r["length"] for r in own]))[:-1]
    for own in sequences.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == list(itertools.accumulate([0] + [r["length"] for r in own]))[:-1]
        assert sum(r["length"] for r in own) <= 2048
    assert packing.pack(frame(spark, []), path).count() == 0


def test_marks_beside_others_are_found_in_passing():
    rule = re.compile(r"[.,](?![\s\w])(?!\Z)|[^\w\s][.,]|[.,]_|_[.,]")
    rng = random.Random(4)
    for _ in range(20_000):
        text = "".join(rng.choices("a1_.,;é \n", k=rng.randrange(6)))
        assert bool(packing._CLUSTER.search(text)) == bool(rule.search(text)), text
    # The search only stops at marks, where the rule as written above tries all its branches at every character.
    prose = "some plain words of a text, and a full stop. " * 4000
    spent = lambda f: min(timeit.repeat(f, number=1, repeat=7))
    assert spent(lambda: packing._CLUSTER.search(prose)) < 0.6 * spent(lambda: rule.search(prose))


def test_packing_remembers_by_bytes(monkeypatch):
    """What a worker remembers is bounded in bytes, however long and however many its chunks are; forgetting changes no ids."""
    monkeypatch.setattr(packing, "REMEMBERED", 400_000)
    tok, rng = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json")), random.Random(5)
    for _ in range(40):
        texts = ["the first of " + " ".join("".join(rng.choices("abcdefgh12", k=rng.choice([4, 900]))) for _ in range(20)) for _ in range(2)]
        for t, ids in zip(texts, tok.encode_all(texts), strict=True):
            assert ids.tolist() == tok.whole.encode(t, add_special_tokens=False).ids
        kept = [(c, v) for d in vars(tok).values() if isinstance(d, dict) for c, v in d.items()]
        assert {"the", "first", "of"} <= {c for c, _ in kept}
        assert sum(len(c) + len(v) for c, v in kept) < 600_000


def test_differencing():
    rng = random.Random(1)
    for ways in (1, 2, 7, 40):
        sizes = [rng.randint(1, 512) for _ in range(ways * 6)]
        parts = packing.difference(sizes, ways)
        assert sorted(i for p in parts for i in p) == list(range(len(sizes)))
        sums = [sum(sizes[i] for i in p) for p in parts]
        assert len(parts) <= ways and max(sums) - min(sums) < 512
    assert len(packing.windows([1500] * 5)) == 5 and packing.difference([], 3) == []


def test_license_scan(spark):
    texts = corpus(3, 10) + [
        "cc-by: CC/BY and cc by by", "xcc by", "GENERAL  public\nlicense", "licensed, under the Apache License (version 2)", "All rights reserved. all rights",
        "released under mit license", "the mit released", "Licensed under CC BY-NC 4.0.\nx", "généralecc by",
    ]
    df = frame(spark, texts)
    index = license_scan.Index(license_scan.frequencies(df))
    templates = license_scan.template_words()
    got = {r["doc_id"]: r for r in license_scan.scan(df).collect()}
    for i, t in enumerate(texts):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = WORD.findall(low)
        places = [(k, lab) for p, lab in license_scan.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        base = {lab for _, lab in places}
        labels, score = set(base), 1.0 if base else 0.0
        for lab, tw in templates.items():
            span = math.ceil(len(license_scan.TEMPLATES[lab].replace(".", " ").replace("-", " ").split()) / 0.8 - 1e-9)
            for k in range(len(w)):
                if (c := len({x.encode() for x in w[k : k + span]} & tw) / len(tw)) >= 0.8 - 1e-9:
                    labels.add(lab)
                    score = max(score, c)
        r = got[i]
        at = [k for k, _ in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(at), min(at, default=None), max(at, default=None)), t
        assert (r["base_labels"], r["labels"], r["lang"]) == (",".join(sorted(base)), ",".join(sorted(labels)), None)
        assert license_scan.scan_text(t, index)[-1] == pytest.approx(score) == r["score"] or base
    assert license_scan.scan(frame(spark, [])).count() == 0


def test_license_scan_of_wrapped_notices(spark):
    rng = random.Random(4)
    bsd = "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that"
    mpl = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy */"
    grant = "\n".join(license_scan.TEMPLATES["mit-grant"].split())
    long = prose(rng, 20000) + " " + bsd.replace("\n", " ") + " " + prose(rng, 20000)
    apart = ("\n" + prose(rng, 5) + "\n").join(license_scan.TEMPLATES["mit-grant"].split())
    # One long line that holds all words of the template, but far from each other.
    scattered = prose(rng, 40).join([" released ", " under ", " the ", " mit ", " license ", ""])
    texts = [bsd, prose(rng, 50) + "\n" + mpl + "\n" + prose(rng, 50), grant, long, apart, scattered]
    got = {r["doc_id"]: r for r in license_scan.scan(frame(spark, texts)).collect()}
    assert [got[i]["labels"] for i in range(6)] == ["bsd-3-clause", "mpl-2.0", "mit-grant", "bsd-3-clause", "", ""]
    assert [got[i]["score"] for i in range(6)] == [1, 1, 1, 1, 0, 0]


def test_pii(spark, tmp_path):
    texts = [
        None, "", "a@b.c x@y z@@q.de mail: j.doe+1@ex-a.co.uk.", "1.2.3.4.5.6.7.8 and 256.1.1.1 v1.2.3.4", "card 4273 7339 4472 9324 and 4111-1111-1111-1111, 4111111111111112",
        "call +1 (555) 010-9999 or +49 30 1234567 +12", 'token = "5bbf0274eef70e05c644ebfa24be" password=hunter2', "a" * 5000 + "@", "@" * 3000, "é@x.yz ø1.1.1.1",
    ] * 3
    kinds = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def valid(kind, s):
        d = re.sub(r"[^0-9]", "", s)
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            return 12 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    for r in op6_pii(spark, str(tmp_path)).collect():
        t = texts[r["doc_id"]] or ""
        spans = [(m.start(), k, m.end()) for k, p in kinds.items() for m in re.finditer(p, t) if valid(k, m.group())]
        spans.sort(key=lambda s: (s[0], list(kinds).index(s[1])))
        named = [f"{k}:{s}:{e}" for s, k, e in spans]
        assert r["base_sha256"] == hashlib.sha256(",".join(named).encode()).hexdigest(), t
        assert [r[f"n_{k}"] for k in kinds] == [sum(s[1] == k for s in spans) for k in kinds]
        assert [x for x in r["spans"].split(",") if x and not x.startswith("secret")] == named or set(named) <= set(r["spans"].split(","))
    out = {r["doc_id"]: r["text"] for r in pii.redact(frame(spark, texts)).collect()}
    assert out[0] is None and out[1] == "" and out[5].startswith("call [PHONE] or [PHONE]")
    assert pii.find(frame(spark, [])).count() == 0


def test_quality(spark):
    rng = random.Random(12)
    texts, good_ = [None, "", "ok"], [True, True, True]
    for i in range(400):
        t = " ".join(prose(rng, rng.randint(5, 15)).capitalize() + "." for _ in range(rng.randint(3, 10)))
        kind = i % 8
        w = t.split()
        bad = {0: " ".join(x + "###" for x in w), 1: " ".join(x.upper() + "!!" for x in w), 2: " ".join([w[0]] * 60), 3: " | ".join(w)}.get(kind)
        texts.append(bad or t)
        good_.append(bad is None)
    df = frame(spark, texts)
    got = {r["doc_id"]: r for r in quality.classify(df).collect()}
    assert len(got) == len(texts)
    assert np.mean([got[i]["keep"] == g for i, g in enumerate(good_)]) > 0.99
    assert all(got[i]["keep"] for i in range(3))
    assert quality.classify(frame(spark, [])).count() == 0
    again = {r["doc_id"]: r["score"] for r in quality.classify(df.repartition(2)).collect()}
    assert all(abs(again[i] - r["score"]) < 1e-6 for i, r in got.items())


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.classify(docs).join(labels, "doc_id").select("keep", "quality").collect()
    assert np.mean([r["keep"] == (r["quality"] == 1) for r in rows]) > 0.95
    assert np.mean([r["keep"] for r in rows if r["quality"] == 1]) > 0.99


def test_expectation_maximisation_finds_the_better_labeller():
    rng = np.random.default_rng(0)
    truth = rng.random(20000) < 0.8
    cast = [np.where(rng.random(20000) < p, truth, ~truth) * 2 - 1 for p in (0.95, 0.9, 0.65)]
    seen = {}
    for p in zip(*cast, strict=True):
        seen[tuple(map(int, p))] = seen.get(tuple(map(int, p)), 0) + 1
    known = quality.estimate(seen)
    assert known[1, 1, -1] > 0.9 > known[-1, 1, 1] and known[-1, -1, 1] < 0.1


def test_types_pass_through(spark):
    kinds = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("m", T.MapType(T.StringType(), T.LongType()))])
    df = spark.createDataFrame([(2**60 + 1, "a b c d e", None, {"x": 1}), (None, None, None, None)], kinds)
    out = license_scan.scan(df)
    assert [f.dataType for f in out.schema.fields[:4:2]] == [T.LongType(), T.TimestampType()]
    assert {r["doc_id"] for r in out.collect()} == {2**60 + 1, None}


def test_lone_queries_among_groups_of_copies(spark):
    """Most rows are copies, which the first bucket answers; the others need many buckets and get all their rows."""
    rng = np.random.default_rng(12)
    lone, groups = rng.normal(size=(60, 24)), rng.normal(size=(20, 24))
    x = np.vstack([np.repeat(groups, 600, axis=0), lone]).astype(np.float32)
    asked = [*range(0, 12_000, 20), *range(12_000, 12_060)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(6)
    got = {}
    for r in ann_pstable.search(df, df.where("vec_id % 20 = 0 OR vec_id >= 12000")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert all(len(got[q]) == 20 for q in asked)
    scores = x[asked].astype(float) @ x.astype(float).T
    found = []
    for row, q in zip(scores, asked, strict=True):
        row[q] = -np.inf
        best = set(np.lexsort((np.arange(len(row)), -row))[:20].tolist())
        found.append(len(best & got[q]) / 20)
    assert np.mean(found[-60:]) >= 0.9 and np.mean(found) >= 0.9


def test_dropout_of_many_texts_is_that_of_each(monkeypatch):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rng, texts = random.Random(8), ["", "a", " ", "▁x ▁", "a\0b", "日本語 text 𝔘", "x" * 300, "\n\n Straße, naïve..."]
    texts += [" ".join("".join(rng.choices("abcdeénrst ,.", k=rng.randrange(1, 60))) for _ in range(20)) for _ in range(40)]
    seeds = [rng.randrange(-(2**63), 2**63) for _ in texts]
    one, many = piece_dropout.Pieces(path), piece_dropout.Pieces(path)
    want = [one.encode(t, s, 0.1) for t, s in zip(texts, seeds, strict=True)]
    for _ in range(2):
        got = many.encode_all(texts, seeds, 0.1)
        assert [(g[0].tolist(), g[1]) for g in got] == [(w[0].tolist(), w[1]) for w in want]
    # Words are merged together, not one agenda after another.
    fresh = piece_dropout.Pieces(path)
    monkeypatch.setattr(fresh, "_merge_short", None)
    assert fresh.encode_all(texts[8:], seeds[8:], 0.1)[0][0].tolist() == want[8][0].tolist()


def test_dropout_follows_the_skips_of_all_chunks_together(monkeypatch):
    """No step of Python for a skip that is remembered, whether chunks come in one lot or in many; a worker's memory is bounded in bytes."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    rng, plain, calls = random.Random(9), piece_dropout._next, []
    texts = [prose(rng, 300) for _ in range(20)] + ["", "\0", " \0\0▁a\0", "日本 \U0010ffff ퟿", "a" * 49 + " " + "b" * 48, "the cat sat.\n" * 400]
    seeds = [None, *(rng.randrange(-(2**63), 2**63) for _ in texts[1:])]
    one, many = piece_dropout.Pieces(path), piece_dropout.Pieces(path)
    want = {d: [one.encode(t, s, d) for t, s in zip(texts, seeds, strict=True)] for d in (0.0, 0.1, 0.5)}

    def same(model, d):
        got = model.encode_all(texts, seeds, d)
        return [(g[0].tolist(), g[1]) for g in got] == [(w[0].tolist(), w[1]) for w in want[d]]

    assert same(many, 0.1) and same(many, 0.0) and same(many, 0.5)
    words, own = ["the cat sat.\n" * 400] * 50, list(range(50))
    many.encode_all(words, own)
    monkeypatch.setattr(piece_dropout, "_next", lambda d: calls.append(d) or plain(d))
    assert sum(k for _, k in many.encode_all(words, own)) > 5000 and len(calls) <= 50
    draws = np.random.default_rng(9).integers(0, 2**64, 100, dtype=np.uint64)
    assert piece_dropout._next_all(draws).tolist() == [plain(d) for d in draws.tolist()]
    monkeypatch.setattr(piece_dropout, "TOGETHER", 101)
    assert same(many, 0.1)
    monkeypatch.setattr(piece_dropout, "REMEMBERED", 150_000)
    small = piece_dropout.Pieces(path)
    assert same(small, 0.1) and small.memory.nbytes() < 200_000 and same(small, 0.5)
