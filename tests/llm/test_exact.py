"""Token counts from a cache, exact clusters and hard negatives, against brute force: nulls, ties, repeated rows, other dimensions, empty tables, further columns."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loomtext.llm import kdtree, negatives, tokencache

VECTORS = "vec_id long, embedding array<double>, label int, node string, cluster string, x int, block int, `a.b` struct<`a-b`:int>"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, label, "n", "c", 1, 2, (3,)) for i, v, label in rows], VECTORS)


def integers(v):
    return [math.floor(256 * x) for x in v]


# --- token counts ---


def odd_texts():
    rng = random.Random(7)
    texts = [None, "", " ", "\n", "a", "A", "a \n b", "A\tB ", "<|startoftext|>", "<|STARTOFTEXT|> x", "x<|endoftext|>y  z", "<|endoftext|", "don't DON'T  's 're!'s", "Straße ẞ İ ΑΣ", "H̱ ẖ İ", "日本語 テキスト 😀", " a b\x0bc\x1cd\x85e"]
    texts += ["word  Word\n" * 20_000, "x" * 9000, ("ab́ " * 30_000), "q <|endoftext|> " * 9000]
    return texts + ["".join(rng.choice(" \n\t'abAB1.!<|>é́　ß") for _ in range(rng.randint(1, 60))) for _ in range(200)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts_match_the_library(spark, tmp_path, name):
    of = tokencache.tokenizer(public_tokenizers.path(name))
    assert of.folds == name.startswith("word")
    if of.library == "tokenizers":
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(public_tokenizers.path(name))
        count = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    else:
        import sentencepiece

        s = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        count = lambda x: len(s.encode(x))
    texts = odd_texts()
    d = spark.createDataFrame([*((i, x, 9, 9) for i, x in enumerate(texts)), (3, texts[3], 1, 1), (None, "a  b", 1, 1), (None, "c", 1, 1)], "doc_id long, text string, digest int, n_tokens int")
    got = tokencache.counted(d, of, f"{tmp_path}/cache", limit=100).collect()
    assert len(got) == len(texts) + 3 and sorted(r.n_tokens for r in got if r.doc_id is None) == sorted([count("a  b"), count("c")])
    for r in got:
        if r.doc_id is not None:
            x = texts[r.doc_id] or ""
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(x.encode()), count(x), count(x) > 100), x[:80]


def test_cache_is_read_and_appended_to(spark, tmp_path, monkeypatch):
    of = tokencache.tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    cache = f"{tmp_path}/cache"
    d = lambda *texts: spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert tokencache.counted(d().limit(0), of, cache).count() == 0 and tokencache.cached(spark, cache, of).count() == 0
    first = tokencache.counted(d("one two", "ONE  two\n", "three", "é"), of, cache)
    assert {r.doc_id: r.n_tokens for r in first.collect()} == {0: 2, 1: 2, 2: 1, 3: 1}
    assert tokencache.cached(spark, cache, of).count() == 3  # white space and case make no other content
    # what is stored is taken, not counted again
    other = spark.createDataFrame([(None, 77, of.digest)], "digest binary, n_tokens long, tokenizer string").withColumn("digest", F.unhex(F.sha2(tokencache.content(F.lit("known"), of).cast("binary"), 256)))
    other.write.mode("append").partitionBy("tokenizer").parquet(cache)
    assert [r.n_tokens for r in tokencache.counted(d("known", " Known", "new"), of, cache).orderBy("doc_id").collect()] == [77, 77, 1]
    assert tokencache.cached(spark, cache, of).count() == 5
    assert tokencache.counted(d("known", "one two"), of, cache).count() == 2 and tokencache.cached(spark, cache, of).count() == 5
    # two runs that counted the same at once do no harm; another version has counts of its own
    other.write.mode("append").partitionBy("tokenizer").parquet(cache)
    assert tokencache.counted(d("known"), of, cache).collect()[0].n_tokens == 77
    changed = tokencache.Tokenizer("tokenizers", of.content + b"\n")
    assert changed.digest != of.digest and tokencache.counted(d("known"), changed, cache).collect()[0].n_tokens == 1


@pytest.mark.parametrize("few", [0, 500_000])
def test_hot_and_many_missing_contents(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(tokencache, "FEW", few)
    of = tokencache.tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same text").otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    got = {r.doc_id: r.n_tokens for r in tokencache.counted(d, of, f"{tmp_path}/cache").collect()}
    assert got == {i: 3 if i % 3 == 0 else 1 + len(str(i)) for i in range(3000)}


@pytest.mark.parametrize("memo", [0, 1 << 20])
def test_words_are_remembered_within_bounds(monkeypatch, memo):
    monkeypatch.setattr(tokencache, "MEMO", memo)
    monkeypatch.setattr(tokencache, "BATCH", 100)
    words = tokencache.Words(tokencache.tokenizer(public_tokenizers.path("word_bpe_49k.json")))
    texts = [b"one two one", b"", b"x" * 300 + b" one", "é\u3000é\n<|endoftext|>one".encode()]
    whole = tokencache.in_batches([x.decode() for x in texts], words.of)
    assert words.lengths(texts) == whole == words.lengths(texts) and whole[:2] == [3, 0]
    monkeypatch.setattr(tokencache, "PART", 5)
    assert b"".join(tokencache.parts(texts[0])) == texts[0] and [len(p) for p in tokencache.parts(texts[0])] == [7, 4]
    assert words.lengths(texts) == whole
    assert set(words.memo) == (set() if memo == 0 else {b"one", b"two", "é\u3000é".encode(), b"<|endoftext|>one"})


# --- clusters ---


def brute_clusters(rows, k, rounds, dim):
    kept = [(i, integers(v)) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) and abs(x) < kdtree.LIMIT for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    z = [v for _, v in order[:k]]
    away = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    best = lambda v: min(range(len(z)), key=lambda c: (away(v, z[c]), c))
    for _ in range(rounds):
        own = [[] for _ in z]
        for _, v in kept:
            own[best(v)].append(v)
        z = [[sum(c) // len(o) for c in zip(*o)] if o else z[n] for n, o in enumerate(own)]
    out = [(i, best(v), away(v, z[best(v)])) for i, v in kept]
    inertia = Counter()
    for _, c, d in out:
        inertia[c] += d
    return sorted((str(i), c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, z[c])).encode()).hexdigest()) for i, c, d in out)


@pytest.mark.parametrize("case", ["plain", "clustered", "ties", "large", "few", "none"])
def test_clusters(spark, monkeypatch, case):
    monkeypatch.setattr(kdtree, "TREE", 300)
    monkeypatch.setattr(kdtree, "LEAF", 8)
    rng = np.random.default_rng(4)
    dim, k = 6, 7
    n = {"few": 4, "none": 0}.get(case, 1000)
    x = rng.normal(size=(n, dim))
    if case == "clustered":
        x = x * 0.02 + rng.normal(size=(9, dim))[np.arange(n) % 9]
    if case == "ties":
        x = rng.integers(-1, 2, (n, dim)) / 256
        x[::3] = x[0]
    if case == "large":
        x[::5] *= 2000
        x[::50] *= 200
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    if n:
        rows += [rows[3], rows[3], (3, rows[1][1]), (None, rows[2][1]), (n, None), (n + 1, []), (n + 2, [1.0]), (n + 3, [None] + [1.0] * (dim - 1)), (n + 4, [math.nan] * dim), (n + 5, [math.inf] * dim), (n + 6, [1e300] * dim)]
    table = vectors_of(spark, [(i, v, 1) for i, v in rows])
    got = kdtree.clustered(table, k=k, rounds=5, dim=dim)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((str(r.vec_id), *r[1:]) for r in got.collect()) == brute_clusters(rows, k, 5, dim)


def test_nodes_are_assigned_as_a_whole(spark):
    """Of groups that lie apart, most nodes are settled without their vectors."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-3000, 3000, (10, 16))
    tree, _ = kdtree.Tree.build(centres[np.arange(4000) % 10] + rng.integers(-20, 20, (4000, 16)))
    whole, owner, leaves, left = tree.split(centres.astype(float))
    assert (tree.end[leaves] - tree.begin[leaves]).sum() <= 10 * kdtree.LEAF  # a leaf where one group ends and the next begins
    assert (tree.end[whole] - tree.begin[whole]).sum() >= 4000 - 10 * kdtree.LEAF
    assert (tree.sums[0] == tree.x.sum(0)).all()


# --- hard negatives ---


def brute_negatives(rows, k=5, every=10):
    kept = {(i, label, tuple(integers(v))) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, label, v in kept:
        if i % every:
            continue
        dot = lambda w: sum(p * q for p, q in zip(v, w))  # noqa: B023, E731
        others = [(dot(w), j, m) for j, m, w in kept if j != i and len(w) == len(v)]
        for p, j, _ in sorted((s for s in others if s[2] == label), key=lambda s: (-s[0], s[1]))[:k]:
            fit = sorted((s for s in kept_negatives(kept, v, label, dot) if 80 * p <= 100 * s[0] <= 100 * p), key=lambda s: (-s[0], s[1]))[:k]
            out += [(i, j, r + 1, m, p, s) for r, (s, m) in enumerate(fit)]
    return sorted(out)


def kept_negatives(kept, v, label, dot):
    return [(dot(w), j) for j, m, w in kept if m != label and len(w) == len(v)]


@pytest.mark.parametrize("case", ["plain", "ties", "large", "none", "dimensions"])
def test_hard_negatives(spark, monkeypatch, case):
    monkeypatch.setattr(negatives, "BLOCK", 150)
    monkeypatch.setattr(negatives, "WORDS", 16)
    monkeypatch.setattr(negatives, "DIMENSIONS", 2)
    rng = np.random.default_rng(9)
    n, dim = 0 if case == "none" else 600, 10
    x = rng.normal(size=(n, dim)) + rng.normal(size=(4, dim))[np.arange(n) % 4] * 2
    if case == "ties":
        x = rng.integers(-1, 2, (n, dim)) / 256
    if case == "large":
        x *= 10.0 ** rng.integers(0, 6, (n, 1))
    label = rng.integers(0, 4, n).tolist()
    rows = [(i, v, m) for i, v, m in zip(range(n), x.tolist(), label)]
    if case == "dimensions":
        rows = [(i, v[: (10, 7, 3, 1, 0)[min(4, i % 9)]], m) for i, v, m in rows]
    if n:
        rows += [rows[20], rows[20], rows[33], rows[33], (20, rows[1][1], 2), (None, rows[0][1], 1), (n, rows[0][1], None), (n + 1, None, 1), (n + 2, [None] * dim, 1), (n + 10, [math.nan] * dim, 1), (n + 4, [-math.inf] * dim, 2), (n + 20, [0.0] * dim, 3), (n + 30, [], 1), (n + 31, [], 1), (n + 32, [], 2)]
    got = negatives.mine(vectors_of(spark, rows), F.col("vec_id") % 10 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows)


def test_bounds_hold_and_leave_out_most_rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = vectors_of(spark, [(i, v, 0) for i, v in enumerate(x.tolist())])
    ints = np.floor(256 * x)
    words = {64: negatives.codewords(ints[:1000])}
    block = negatives.Block(negatives.coded(rows, words).withColumn("dim", F.lit(64)).toArrow(), 64)
    a = ints[7]
    low, high = block.bounds(a, [w @ a[c] for w, c in zip(words[64], negatives.cuts(64))], slice(None))
    score = block.x @ a
    assert (low <= score).all() and (score <= high).all()
    assert (high >= negatives.kth(low, 6)).sum() < 300
