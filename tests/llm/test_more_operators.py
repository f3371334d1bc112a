"""The manifest, whitening and byte-level BPE against brute force and the library."""

import base64
import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_operators import corpus, frame

from qbank.llm import ann_pstable, byte_bpe, merkle, near_dup_vectors, whitening
from qbank.llm.queries import op12_whitening, op13_byte_bpe, oracle_sql, queries

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def entry(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    """The last node, and for each leaf the (left, right) siblings at each level."""
    sides, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, a in enumerate(at):
            run = nodes[a // 3 * 3 : a // 3 * 3 + 3]
            sides[i].append(("".join(run[: a % 3]), "".join(run[a % 3 + 1 :])))
            at[i] = a // 3
        nodes = [H(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], sides


def brute_manifest(rows, tampered):
    leaves = [H(*(entry(r[c]) for c in merkle.COLUMNS)) for r in rows]
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(r["source"], []).append(i)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    sides, subroots = {}, {}
    for s in names:
        members = sorted(groups[s], key=lambda i: (rows[i]["doc_id"] is not None, rows[i]["doc_id"] or 0, leaves[i]))
        subroots[s], found = tree([leaves[i] for i in members])
        sides |= dict(zip(members, found, strict=True))
    root, above = tree([subroots[s] for s in names])
    above = dict(zip(names, above, strict=True))
    for i, r in enumerate(rows):
        way = sides[i] + above[r["source"]]
        value = H(*(entry(r[c] if c != "text" else tampered(r)) for c in merkle.COLUMNS))
        for left, right in way:
            value = H(left, value, right)
        yield r["doc_id"], leaves[i], subroots[r["source"]], root, H(*(a + b for a, b in way)), value, value == root


def without_lines(r):
    hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and r["text"] is not None
    return r["text"].replace("\n", "") if hit else r["text"]


@pytest.mark.parametrize("depth", [1, 2, 6])
def test_manifest(spark, depth):
    rng = random.Random(4)
    rows = [(i, f"line {i}\nmore", rng.choice(["a", "é", "Z", None, "hot", "hot", "hot"]), None if i % 7 == 0 else "en", i) for i in range(90)]
    rows += [(500, "alone", "one", "en", 1), (None, "x\ny", "a", None, None), (None, None, None, None, None), (7, "", "hot", "", 0), (7, "", "hot", "", 0), (7, "other\n", "hot", "", 0)]
    rows += [(8, "y" * 100_000 + "\n", "hot", "de", -5)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, source string, lang string, n_chars long, leaf string, ROOT int").repartition(5)
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    got = merkle.manifest(df, F.when(chosen, F.replace("text", F.lit("\n"), F.lit(""))), depth=depth).collect()
    want = list(brute_manifest([r.asDict() for r in df.collect()], without_lines))
    assert sorted(repr((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"])) for r in got) == sorted(map(repr, want))
    assert all(H(*r["siblings"]) == r["proof_sha256"] for r in got) and 0 < sum(r["verified"] for r in got) < len(got)


def test_manifest_of_one_row_and_none(spark):
    df = spark.createDataFrame([(1, "t", "s", "l", 1)], "doc_id long, text string, source string, lang string, n_chars long")
    (r,) = merkle.manifest(df).collect()
    assert r["leaf"] == r["subroot"] == r["root"] == r["folded_root"] == H("1:1", "1:s", "1:l", "1:1", "1:t") and r["siblings"] == [] and r["verified"]
    assert merkle.manifest(df.limit(0)).collect() == []


def test_manifest_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(oracle_sql()["op11_merkle_manifest"]).df()
    got = queries()["op11_merkle_manifest"](spark, SF).toPandas()[list(want.columns)]
    assert sorted(map(repr, got.itertuples(index=False, name=None))) == sorted(map(repr, want.itertuples(index=False, name=None)))


def whole_numbers(vectors):
    return [[int(np.floor(1024 * float(c))) + 100_000 for c in v] for v in vectors]


def check_whitening(rows, vectors, width):
    x = whole_numbers(vectors)
    n, d = len(x), len(x[0])
    sums = [sum(v[j] for v in x) for j in range(d)]
    centred = np.array([[v[j] - sums[j] / n for j in range(d)] for v in x])
    values, vecs = np.linalg.eigh(centred.T @ centred / n)
    values, vecs = values[::-1], vecs[:, ::-1]
    assert len(rows) == n * width
    for i, v in enumerate(x):
        for k in range(width):
            r = rows[i, k + 1]
            assert r["n"] == n and int(r["deviation"]) == sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True))
            assert abs(abs(r["whitened"]) - abs(centred[i] @ vecs[:, k]) / np.sqrt(values[k])) < 1e-8
            assert abs(r["explained"] - values[k] / values.sum()) < 1e-9 and r["identity_error"] < 1e-9
    for k in range(width):  # one sign for all rows
        signs = {np.sign(rows[i, k + 1]["whitened"]) * np.sign(centred[i] @ vecs[:, k]) for i in range(n) if abs(rows[i, k + 1]["whitened"]) > 1e-6}
        assert len(signs) == 1


@pytest.mark.parametrize(("scale", "kind"), [(1.0, "float"), (1e6, "double")])
def test_whitening(spark, scale, kind):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(70, 11)) @ rng.normal(size=(11, 11)) * scale
    v = v.astype(np.float32 if kind == "float" else np.float64).tolist()
    bad = [None, [], [None] * 11, [float("nan")] + [0.0] * 10, [float("inf")] + [0.0] * 10, [1e30] + [0.0] * 10, [1.0, 2.0]]
    rows = [(i, x, "c", 3) for i, x in enumerate(v)] + [(1000 + i, x, "c", 3) for i, x in enumerate(bad)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, Whitened string, label int").repartition(5)
    got = {(r["vec_id"], r["component"]): r for r in whitening.whiten(df).collect()}
    check_whitening(got, v, 8)
    assert set(got[0, 1].asDict()) == {"vec_id", "label", "component", "n", "deviation", "whitened", "explained", "identity_error"}


def test_whitening_of_few_dimensions_and_none(spark):
    v = [[1.0, 0.5], [0.0, 0.5], [0.25, 0.5], [0.25, 0.5], [0.0, 0.0]]
    df = spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>")
    check_whitening({(r["vec_id"], r["component"]): r for r in whitening.whiten(df).collect()}, v, 2)
    flat = df.where("vec_id IN (2, 3)")
    assert whitening.whiten(flat).collect() == [] and whitening.whiten(df.limit(0)).collect() == []
    assert len(whitening.whiten(df.where("vec_id IN (0, 1)")).collect()) == 2  # one direction varies
    assert whitening.fit(df).covariance.shape == (2, 2)


def test_whitening_query(spark):
    got = op12_whitening(spark, SF)
    assert dict(got.dtypes)["deviation"] == "bigint"
    v = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    ids = sorted(v)[:]
    place = {i: k for k, i in enumerate(ids)}
    check_whitening({(place[r["vec_id"]], r["component"]): r for r in got.collect()}, [v[i] for i in ids], 8)


@pytest.fixture(scope="module")
def library():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rng = random.Random(8)
    some = ["a", "b", "ab", "the", " ", "  ", "\n", "\r\n", "é", "é", "北京", "x" * 7, "1", "!", "'s", "The", "ing", " of", "😀", "\x1c", "　", "<|endoftext|>", "\x00"]
    texts = ["".join(rng.choice(some) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += ["".join(chr(rng.choice([rng.randrange(0x20, 0x7F), rng.randrange(0xA0, 0x250), rng.randrange(0x4E00, 0x9FFF), rng.randrange(0x1F300, 0x1F700)])) for _ in range(300)) for _ in range(100)]
    return [*texts, "x" * 50_000, "ab" * 20_000, "北" * 20_000, " " * 30_000, "aaab" * 5_000 + "é"]


def test_pre_tokens_as_the_library(library):
    codec = byte_bpe.codec(RANKS, public_tokenizers.PATTERN)
    for t in odd_texts():
        ids = [i for part in codec.portions(t) for i in part]
        assert ids == library.encode_ordinary(t) and codec.decode(ids) == t.encode()


def test_merges_at_the_boundary():
    """Backtracking against merging pair by pair, over ranks that overlap in many ways."""
    rng, made = random.Random(2), 0
    pairs = byte_bpe.BytePairs(RANKS)
    for _ in range(2000):
        data = bytes(rng.choice(b"aelnorst") for _ in range(rng.randint(1, 14)))
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, i = min((pairs.ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
            if best == 1 << 40:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        made += len(parts) > 2
        assert pairs.encode(data) == [pairs.ranks[p] for p in parts]
    assert made > 100


def test_round_trip(spark, library, monkeypatch):
    texts = corpus(6, 10) + odd_texts()[:60]
    df = frame(spark, texts).withColumn("IDS_SHA256", F.lit("clash"))
    got = {r["doc_id"]: r for r in byte_bpe.round_trip(df, RANKS, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == want
    encoded = byte_bpe.encode(df, RANKS, public_tokenizers.PATTERN)
    back = {r["doc_id"]: (r["ids"], bytes(r["decoded"])) for r in byte_bpe.decode(encoded, RANKS, public_tokenizers.PATTERN).collect()}
    assert all(back[i] == (library.encode_ordinary(t or ""), (t or "").encode()) for i, t in enumerate(texts))
    assert byte_bpe.round_trip(df.limit(0), RANKS, public_tokenizers.PATTERN).collect() == []


def test_long_texts_and_small_memory(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "LONG_TEXT", 100)
    monkeypatch.setattr(byte_bpe, "PORTION", 7)
    monkeypatch.setattr(byte_bpe, "MEMORY", 5_000)
    monkeypatch.setattr(byte_bpe, "PAIRS", 3)
    codec = byte_bpe.Codec(RANKS, public_tokenizers.PATTERN)
    for t in corpus(9, 10):
        assert [i for part in codec.portions(t or "") for i in part] == library.encode_ordinary(t or "")
    assert codec.memory.used <= 5_000 and len(codec.pairs.pairs) <= 3


def test_byte_bpe_query(spark, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in op13_byte_bpe(spark, SF).collect():
        ids = library.encode_ordinary(texts[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_blocks_meet_in_one_place_without_broadcasts(spark):
    """op1 and op8 where all joins are sort-merge joins, so that both sides of a block are dealt alike before they are united."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(120, 16))
    x = np.vstack([base, base[:60] + rng.normal(size=(60, 16)) * 0.01, np.repeat(base[:1], 300, axis=0)])
    df = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x.astype(np.float32))], "vec_id long, embedding array<float>, label int").repartition(5)
    run = lambda: (
        sorted(map(tuple, near_dup_vectors.near_duplicates(df).collect())), sorted(map(tuple, ann_pstable.search(df, df.where("vec_id % 20 = 0")).collect())),
    )
    want = run()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert run() == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
