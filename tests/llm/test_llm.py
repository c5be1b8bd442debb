"""The dealt operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, further columns."""

import dataclasses
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomtext.llm import bpe, fingerprint, language, minhash, mixing, pivots, quality, toxicity, urlfilter, warc
from loomtext.llm.queries import MIX, URL_RULES, vocabulary
from loomtext.llm.shared import components, crc_held_out
from loomtext.llm.textbatch import Texts

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, component long"


def docs_of(spark, texts, lang="en"):
    return spark.createDataFrame([(i, x, lang, f"src{(i or 0) % 3}", len(x or ""), 0.5, 7) for i, x in texts], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 140)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for a, b in edges if a != b for x in (a, b)}


def thue_morse(n):
    """Two strings of 2 ** n letters that sums of powers modulo 2 ** 64 can't tell apart from n = 10 or so on."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return [a, b]


def test_hashes_tell_words_apart():
    words = [w for n in (10, 11, 12) for w in thue_morse(n)] + [f"{'ab' * k}c" for k in range(300)] + ["a\0", "a", "a\0\0"]
    t = Texts.of(pa.array([" ".join(words), " ".join(reversed(words))]))
    h = t.word_hashes
    assert len(set(h.tolist())) == len(words) and (h[: len(words)] == h[len(words) :][::-1]).all()
    x = minhash.sets(Texts.of(pa.array(["x y y y x", "y x y x y"])), 5)
    assert x[0][0] != x[1][0]


@pytest.mark.parametrize("shared", [False, True])
def test_fragments_are_told_apart_by_bytes(monkeypatch, shared):
    if shared:
        monkeypatch.setattr(Texts, "hashes", lambda self, begins, ends: np.zeros(len(begins), np.uint64))
    t = Texts.of(pa.array(["one", "two", "", "one", "three", "two"]))
    begins = np.unique(t.offsets)
    one, which = bpe.distinct(t, begins)
    data = t.buf.tobytes()
    parts = [data[x:y] for x, y in zip(begins, begins[1:])]
    assert len(one) == 3 and [parts[one[k]] for k in which] == parts


def test_bpe_matches_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [None, "", " ", "a", "don't DON'T a''s 's 're!'s", "x  y\n\n\nA  b\t\tc　é'll", "<|endoftext|>a  <|endoftext|>\n\n b<|endoftext", "<|<|endoftext|>|>", "日本語 テキスト 😀", "aaaaaaaaaa" * 50, "word " * 30_000, "#$%^&*()_+12345 67a8"]
    texts += [x for n in (10, 11, 12) for x in thue_morse(n)] + ["漢字仮名交じり文" * 4000, "x" * 9000]
    rng = random.Random(5)
    texts += ["".join(rng.choice(" \n'abcsdtÉß1.!<|>é　 ") for _ in range(rng.randint(1, 60))) for _ in range(200)]
    rows = docs_of(spark, list(enumerate(texts)) + [(3, "a")])
    got = bpe.digests(rows, vocabulary()).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        ids = t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()), texts[r.doc_id]
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    encoded = bpe.encode(rows, vocabulary(), proof=True)
    assert "text" not in encoded.columns and {"lang", "score"} <= set(encoded.columns)
    back = bpe.decode(encoded, vocabulary()).select("doc_id", "decoded").collect()
    assert {r.doc_id: r.decoded for r in back} == {i: x or "" for i, x in enumerate(texts)}
    assert bpe.digests(empty(spark), vocabulary()).count() == 0


def brute_paragraphs(text):
    """The paragraphs of a text as a multiset: lines, cut after words whose hash says so and after MOST words."""
    words = [(m.start(), m.group()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", text.encode())]
    b, cuts, run = text.encode(), [0], 0
    for k, (at, _) in enumerate(words):
        if k:
            before_at, before = words[k - 1]
            h = Texts.of(pa.array([before], pa.binary()), fold=False).word_hashes[0]
            if b"\n" in b[before_at + len(before) : at] or int(h) % fingerprint.USUAL == 0 or run == fingerprint.MOST:
                cuts.append(at)
                run = 0
        run += 1
    return Counter(b[x:y] for x, y in zip(cuts, [*cuts[1:], len(b)])) if b else Counter()


def brute_likeness(x, y):
    a, b = brute_paragraphs(x), brute_paragraphs(y)
    return (a & b).total() / (a | b).total() if a or b else 1.0


def test_fingerprints(spark):
    rng = random.Random(12)
    words = [f"w{k}" for k in range(300)]
    texts = {1: "One line here.\nAnother line there.\nThe last of them.", 2: "", 3: None, 4: "x", 6: "One line here.\nAnother line there.\nThe last of them.", 9: "é" * 40, 10: " \n ", 11: "a " * 300, 12: "a " * 310}
    texts |= {i: rng.choice([" ", "\n"]).join(rng.choice(words) for _ in range(rng.choice([3, 24, 25, 26, 200, 900]))) for i in range(20, 60)}
    for i in range(60, 80):  # versions that differ by little, next to each other
        texts[i] = texts[i - 1] + f" more{i}" * rng.randint(1, 40)
    d = docs_of(spark, texts.items())
    got = {r.doc_id: r for r in fingerprint.fingerprint_edits(d).collect()}
    ids = sorted(texts)
    for k, i in enumerate(ids):
        x, y = texts[i] or "", texts[ids[(k + 1) % len(ids)]] or ""
        edited = x[: len(x) - len(x) // 2] + y[: len(x) // 2]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(x)
        assert (got[i].near_edited, got[i].near_next) == pytest.approx((brute_likeness(x, edited), brute_likeness(x, y))), i
    assert got[1].fingerprint == got[6].fingerprint != got[4].fingerprint and got[2].near_next == 1
    # what is published decides: the same likeness from the two fingerprints alone
    pairs = spark.createDataFrame([(i, got[i].fingerprint, got[i].edited_fingerprint, 0.5) for i in ids], "doc_id long, a string, b string, likeness double")
    for r in fingerprint.compared(pairs, "a", "b").collect():
        assert r.likeness == pytest.approx(got[r.doc_id].near_edited)
        assert len(set(r.removed) & set(r.added)) == 0 and (r.likeness == 1) == (r.removed == [] == r.added)
    alone = fingerprint.fingerprinted(d.withColumn("fingerprint", F.lit(1))).select("doc_id", "fingerprint").collect()
    assert {r.doc_id: r.fingerprint for r in alone} == {i: r.fingerprint for i, r in got.items()}


def test_fingerprints_of_odd_tables(spark):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    assert fingerprint.fingerprint_edits(docs_of(spark, [(1, "a b c"), (1, "a b c"), (1, "a b d")])).count() == 3
    assert fingerprint.fingerprint_edits(docs_of(spark, [(1, "alone here")])).first().near_next == 1
    assert fingerprint.fingerprint_edits(empty(spark)).count() == 0
    got = {r.doc_id: r for r in fingerprint.fingerprint_edits(docs_of(spark, [(None, "no id"), (5, long), (6, long + " end"), (None, None)])).collect()}
    assert set(got) == {None, 5, 6} and got[5].near_next > 0.99
    many = [(None, f"text {k}") for k in range(300)] + [(k, f"other {k}") for k in range(7)]
    rows = fingerprint.with_next(docs_of(spark, many)).collect()
    assert len({r.bucket for r in rows if r.doc_id is None}) > 4 and sum(1 - r.tail for r in rows) == len(many)
    assert fingerprint.fingerprint_edits(docs_of(spark, many)).count() == len(many)
    far = fingerprint.compared(spark.createDataFrame([(got[5].fingerprint, got[6].fingerprint), (None, got[5].fingerprint), (None, None)], "a string, b string"), "a", "b").collect()
    assert [len(r.removed) + len(r.added) < 8 for r in far] == [True, False, True] and [r.likeness for r in far][1:] == [0, 1]


def test_sketches_recover_what_differs():
    rng = np.random.default_rng(1)
    for n, m, shared in ((0, 5, 300), (200, 200, 300), (3, 0, 300), (50, 1000, 300), (0, 4000, 0), (7, 4000, 3), (0, 0, 0)):
        common = rng.integers(0, 2**63, shared).astype(np.uint64)
        a, b = (np.concatenate([common, rng.integers(0, 2**63, k).astype(np.uint64)]) for k in (n, m))
        x, y = (fingerprint.Digests(v, np.array([0, len(v)])) for v in (a, b))
        s, t = (fingerprint.Sketches.of_text(fingerprint.sketched(v).text()) for v in (x, y))
        assert set(fingerprint.given_back(s).key.tolist()) == set(a.tolist())
        key, _, sign = fingerprint.differences(s, t, x, y)
        assert set(key[sign == 1].tolist()) == set(a[shared:].tolist()) and set(key[sign == -1].tolist()) == set(b[shared:].tolist())
        assert fingerprint.likeness(s, t, x, y)[0] == pytest.approx(shared / (shared + n + m) if shared + n + m else 1)


def brute_groups(texts, words, percent):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, x in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (x or "").translate(lower))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in sets}


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, words, percent):
    rng = random.Random(words)
    texts = [(0, None), (1, ""), (2, " \n"), (3, "One"), (4, "one"), (5, "one two"), (6, "ONE  two"), (7, "x " * 3000), (8, "x " * 2000)]
    base = [f"w{rng.randint(0, 400)}" for _ in range(150)]
    for i in range(20, 150):  # a chain of edits: neighbours are alike, the ends aren't
        base = list(base)
        for _ in range(rng.choice([0, 1, 1, 2])):
            base[rng.randrange(150)] = f"w{rng.randint(0, 400)}"
        texts.append((i, " ".join(base)))
    texts += [(i, " ".join(f"w{rng.randint(0, 400)}" for _ in range(80))) for i in range(200, 230)]
    texts += list(enumerate([*thue_morse(10), "a b " * 40, "b a " * 40 + "b", "x y y y x", "y x y x y"], 300))
    rows = docs_of(spark, texts + [(3, "One")])
    got = minhash.near_duplicates(rows, words, percent).collect()
    assert len(got) == len(texts) + 1
    expected = brute_groups(texts, words, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected
    assert all(r.kept == (r.component_id == r.doc_id) for r in got)
    assert minhash.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("null_id", [False, True])
def test_texts_that_share_an_id_are_told_apart(spark, null_id):
    import corpus_pipeline

    words = [" ".join(f"{w}{k}" for k in range(40)) for w in "abcd"]
    texts = [(5, words[0]), (5, words[1]), (3, words[1] + " more"), (7, words[2]), (7, words[2]), (8, words[3]), (8, words[3] + " more")]
    rows = docs_of(spark, texts)
    if null_id:
        rows = rows.unionByName(docs_of(spark, [(9, words[0])]).withColumn("doc_id", F.lit(None).cast("long")))
    got = sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.one_of_each(spark, rows, "").collect())
    assert [x for x in got if x[0] in (3, 5, 7)] == [(3, words[1] + " more"), (5, words[0]), (7, words[2])]
    assert len([x for x in got if x[0] == 8]) == 1
    assert [x for x in got if not x[0]] == [(0, words[0])] * null_id
    assert {(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(rows).where("doc_id < 7").collect()} == {(5, 5, True), (5, 3, False), (3, 3, True)}


def test_linked_vectors(spark):
    rng = np.random.default_rng(2)
    heads = rng.normal(size=(60, 24))
    x = np.concatenate([heads, np.repeat(heads[:4], 40, 0) + 0.15 * rng.normal(size=(160, 24)), np.repeat(heads[4:5], 300, 0) + 0.03 * rng.normal(size=(300, 24))]).astype(np.float32)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    bad = [(9001, None, 1), (9002, [0.0] * 24, 1), (9003, [float("nan")] * 24, 1), (9004, [None] + [1.0] * 23, 1), (9005, [], 1), (9006, [float("inf")] * 24, 1)]
    got = {r.vec_id: r for r in pivots.linked(spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, n long")).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    n_found = sum(got[i].n_links for i in range(len(x)))
    assert n_found >= 0.9 * link.sum() and all(got[i].n_links <= link[i].sum() for i in range(len(x)))
    assert n_found == link.sum()
    assert all(got[i].n_links == 0 and got[i].kept for i in range(9001, 9007))
    assert all(got[i].component_id == 4 and not got[i].kept for i in range(220, 520))
    assert pivots.linked(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_a_loose_group_of_vectors_is_found(spark):
    rng = np.random.default_rng(4)
    n, dim, members = 3000, 64, 1000
    x = rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    away = x[:members] - x[0] * (x[:members] @ x[0])[:, None]
    away[0] = x[1] - x[0] * (x[1] @ x[0])
    away /= np.linalg.norm(away, axis=1)[:, None]
    x[:members] = np.sqrt(0.92) * x[0] + np.sqrt(0.08) * away  # cosines with each other of about 0.92
    c = x @ x.T
    assert 0.91 < c[:members, :members].mean() < 0.93
    want = (c >= 0.9).sum(1) - 1
    got = {r.vec_id: r for r in pivots.linked(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    found = np.array([got[i].n_links for i in range(n)])
    assert (found <= want).all() and found.sum() >= 0.98 * want.sum()
    assert {got[i].component_id for i in range(members)} == {0}


def test_vectors_near_one_pivot_only(spark):
    rng = np.random.default_rng(5)
    x = np.eye(16)[0] + rng.normal(size=(300, 16)) * 0.085
    x /= np.linalg.norm(x, axis=1)[:, None]
    x = x[x @ x[0] > 0.91]  # one pivot, and most are farther than half the angle from it
    want = (x @ x.T >= 0.9).sum(1) - 1
    got = {r.vec_id: r.n_links for r in pivots.linked(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    assert [got[i] for i in range(len(x))] == want.tolist()


def brute_links(rows, least=0.9):
    """(vec_id, embedding) -> (n_links, component): rows that repeat both are one vector."""
    nodes = sorted({(i, tuple(v)) for i, v in rows}, key=lambda r: (r[0], len(r[1]), r[1]))
    root = list(range(len(nodes)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    n = [0] * len(nodes)
    for a, (_, x) in enumerate(nodes):
        for b, (_, y) in enumerate(nodes[:a]):
            if len(x) == len(y) and np.dot(x, y) >= least * np.linalg.norm(x) * np.linalg.norm(y):
                n[a] += 1
                n[b] += 1
                lo, hi = sorted((top(a), top(b)))
                root[hi] = lo
    return {node: (n[k], nodes[top(k)][0]) for k, node in enumerate(nodes)}


@pytest.mark.parametrize("parts", [1, 7])
def test_repeated_vectors_and_dimensions(spark, parts):
    rng = np.random.default_rng(6)
    heads = rng.normal(size=(4, 5))
    rows = [(k, (heads[k % 4] + 0.1 * rng.normal(size=5)).tolist()) for k in range(80)]
    rows += [rows[3]] * 3 + [(200, rows[3][1]), (5, rows[9][1]), (5, [1.0, 2.0, 3.0]), (201, [2.0, 4.0, 6.0]), (202, [1.0, 0.0]), (203, [0.9, 0.1]), (204, [4.0]), (205, [-4.0])]
    null = [(None, rows[3][1])]
    got = pivots.linked(spark.createDataFrame(rows + null, "vec_id long, embedding array<double>").repartition(parts)).collect()
    want = brute_links(rows)
    assert len(got) == len(rows) + 1
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got if r.vec_id is not None) == sorted((i, *want[i, tuple(v)]) for i, v in rows)
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, True)]


def test_ties_at_the_least_cosine_link(spark):
    rows = [(0, [1.0, 0.0]), (1, [3.0, 4.0]), (2, [-3.0, 4.0]), (3, [0.0, -2.0]), (4, [3.0, -4.0]), (5, [-1.0, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in pivots.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), least=0.6).collect()}
    want = brute_links(rows, 0.6)
    assert got == {i: want[i, tuple(v)] for i, v in rows} and got[0] == (2, 0)


def test_pivots_are_apart_and_dense_ones_come_first():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 16))
    x[300:] = x[0] + 0.02 * rng.normal(size=(100, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    p = pivots.choose(x, 0.45, 64)
    assert len(p) == 64 and p[0] @ x[0] > 0.99 and (np.triu(p @ p.T, 1) < np.cos(0.45)).all()


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://A.com", "http://a.com/", "https://x.example.com/en/1?q", "https://www.example.com/en/1", "https://a.www.example.com/en/", "http://a.net/es/x#y", "http://net/fr/", "http://x.net/de/", "ftp://notexample.com/en/", "http://a.com:80/", "http://a.com?x=/es/", "weird://"]
    urls.append("http://b.example.com/en/" + "x/" * 100_000)
    rows = spark.createDataFrame([(i, u, "x", "y", "z", 1) for i, u in enumerate(urls)] + [(5, urls[5], "x", "y", "z", 1)], "page_id long, url string, rule string, host string, verdict string, path int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(rows, URL_RULES).collect()}
    for i, u in enumerate(urls):
        rest = (u or "").partition("://")[2] if "://" in (u or "") else ""
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = host.lower()
        fit = [(len(h + p), len(h), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        expected = (host, path, max(fit)[2], max(fit)[3]) if fit else (host, path, None, "allow")
        assert got[i] == expected, u
    assert urlfilter.judge(rows.limit(0), URL_RULES).count() == 0


@pytest.mark.parametrize("n_listed", [0, 1, 500, 30_000])
def test_cascade_is_exact(spark, n_listed):
    rng = np.random.default_rng(0)
    keys = rng.integers(-(2**62), 2**62, 30_000)
    listed, universe = (spark.createDataFrame([(int(k), str(k)) for k in x], "k long, rule string") for x in (keys[:n_listed], keys))
    c = urlfilter.cascade(listed, universe.unionByName(universe))
    assert (c.has(keys) == (np.arange(30_000) < n_listed)).all()
    assert sum(len(x.words) * 64 for x in c.levels) <= n_listed * (1.45 * np.log2(30_000) + 30) + 1024 * len(c.levels)


def test_keys_with_one_hash_are_told(spark):
    listed = spark.createDataFrame([(1, "a"), (2, "b")], "k long, rule string")
    with pytest.raises(urlfilter.Collision):
        urlfilter.cascade(listed, spark.createDataFrame([(1, "a"), (2, "c")], "k long, rule string"))


def test_language(spark):
    words = {"en": "the of and to in is that with for are this".split(), "de": "der die und das nicht mit ein auf werden ist".split()}
    rng = random.Random(0)
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(30)), lang, "s", 1, 0.0, 1) for i in range(200) for lang in [("en", "de")[i % 2]]]
    rows += [(910, "½ ² Ⅷ ٣", "en", "s", 1, 0.0, 1), (911, "ª", None, "s", 1, 0.0, 1), (5, rows[5][1], "de", "s", 1, 0.0, 1), (None, "the of and", None, "s", 1, 0.0, 1)]
    rows += [(900, None, "en", "s", 1, 0.0, 1), (901, "12 34!", "en", "s", 1, 0.0, 1), (902, "the " * 40_000, None, "s", 1, 0.0, 1), (903, "", None, "s", 1, 0.0, 1)]
    d = spark.createDataFrame(rows, DOCS)
    learned = language.learn(d)
    assert set(learned) == {"en", "de"} and all(len(x) <= language.DICTIONARY for x in learned.values())
    got = {r.doc_id: r for r in language.classify(d, learned).collect()}
    assert all(got[r[0]].lang_pred == r[2] and got[r[0]].held_out == crc_held_out(r[0]) for r in rows[:200])
    assert [got[i].lang_pred for i in (900, 901, 902, 903, 910)] == ["und", "und", "en", "und", "und"] and got[900].score == 0
    assert got[911].lang_pred != "und" and got[None].lang_pred == "en" and not got[None].held_out and language.classify(d, learned).count() == len(rows)
    twins = language.classify(docs_of(spark, [(1, "the of and")] * 2), {"b": b"same words", "a": b"same words"}).collect()
    assert [(r.lang_pred, r.accepted) for r in twins] == [("b", False)] * 2  # of equal sizes the first, which is the more frequent one
    assert language.classify(d, language.learn(empty(spark))).where("lang_pred <> 'und'").count() == 0


def test_language_equals_plain_compression(spark):
    import zstandard

    rng = random.Random(3)
    words = {"en": "the of and to in is that with for are".split(), "de": "der die und das nicht mit ein auf".split(), "fr": "les des une est dans pour qui sur".split()}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.choice([2, 30, 3000]))), lang, "s", 1, 0.0, 1) for i in range(90) for lang in [("en", "de", "fr")[i % 3]]]
    d = spark.createDataFrame(rows, DOCS)
    learned = language.learn(d)
    training = {r[1].lower() for r in rows if not crc_held_out(r[0])}
    assert all(piece in x for x in [" ".join(training)] for c in learned.values() for piece in c.decode().split("\n")[:-1] if len(piece) < language.PIECE)
    plain = {}
    for lang, content in learned.items():
        c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), level=language.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
        plain[lang] = lambda b, c=c: sum(len(c.compress(b[k : k + language.PART])) for k in range(0, len(b), language.PART))
    for r in language.classify(d, learned).collect():
        sizes = {lang: f(rows[r.doc_id][1].lower().encode()) for lang, f in plain.items()}
        low = min(sizes.values())
        assert sizes[r.lang_pred] == low
        assert r.score == pytest.approx(1 / sum(np.exp(-(v - low) / (2 + 0.01 * low)) for v in sizes.values()))
        assert r.accepted == (sorted(sizes.values())[1] - low >= language.MARGIN * low)


def labelled(spark, n=600):
    rng = random.Random(1)
    clean = [f"{a}{b}" for a in ("ba", "lo", "mi", "ter", "sun", "ora") for b in ("nd", "th", "re", "ly", "so")]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(clean) for _ in range(rng.randint(5, 60))]
        toxic, junk = i % 8 == 0, i % 7 == 0
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["vileword", "slur" + rng.choice(clean)]))
        text = " ".join(w.upper() + "!!" for w in words) if junk else " ".join(words) + "."
        docs.append((i, text))
        labels.append((i, 0 if junk else 1, int(toxic)))
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    texts, labels = labelled(spark)
    odd = [(9000, None), (9001, ""), (9002, "sunnd " * 50_000), (None, "vileword bath"), (9003, "vileword bath suno"), (9003, "vileword bath suno"), texts[3], texts[3]]
    d = docs_of(spark, [*texts, *odd])
    rows = toxicity.judge(d, labels).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(texts) + len(odd)
    assert all(got[i].predicted == (i % 8 == 0) for i, _ in texts if crc_held_out(i))
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(got[i].predicted == 0 for i in (9000, 9001, 9002)) and len({r.score for r in rows if r.doc_id == texts[3][0]}) == 1
    assert toxicity.judge(empty(spark), labels).count() == 0
    assert toxicity.judge(d, labels.limit(0)).count() == len(rows)
    assert not got[None].held_out


def test_label_model_recovers_what_voters_are_worth():
    rng = np.random.default_rng(11)
    n, fires = 60_000, np.array([[0.8, 0.02], [0.6, 0.01], [0.7, 0.05], [0.5, 0.02], [0.2, 0.2], [0.6, 0.01]])
    truth = rng.random(n) < 0.1
    votes = rng.random((n, 6)) < np.where(truth[:, None], fires[:, 0], fires[:, 1])
    votes[:, 5] = votes[:, 1]  # one voter repeats another, and voter 4 knows nothing
    combination, at, counts = np.unique(votes @ (1 << np.arange(6)), return_inverse=True, return_counts=True)
    begin = ((combination[:, None] >> np.arange(4)) & 1).sum(1)
    m = toxicity.label_model(combination, counts, 6, np.where(begin >= 2, 0.95, 0.05))
    assert np.abs(m.fires - fires).max() < 0.04
    assert m.weight[[1, 5]] == pytest.approx([0.5, 0.5], abs=0.05) and (m.weight[[0, 2, 3, 4]] > 0.9).all()
    assert ((m.posterior[at] > 0.5) == truth).mean() > 0.97
    # the posterior is what Bayes' rule says, with repeated evidence halved
    one, zero = fires.T
    odds = np.log(0.1 / 0.9) + votes @ (m.weight * np.log(one / zero)) + (1 - votes) @ (m.weight * np.log((1 - one) / (1 - zero)))
    assert np.abs(1 / (1 + np.exp(-odds)) - m.posterior[at]).mean() < 0.01


def brute_terms(text):
    """Words and their beginnings of 3 to 8 bytes, and those that occur again."""
    words = [w.encode() for w in re.findall(r"[^\W\d_]+", (text or "").lower())]
    every = [("", w) for w in words] + [(n, w[:n]) for w in words for n in toxicity.STEMS if len(w) > n]
    return {t for t in every} | {(*t, "again") for t in every if every.count(t) > 1}


def test_scores_equal_the_sum_over_terms(spark):
    texts, labels = labelled(spark, 240)
    d = docs_of(spark, texts)
    model = toxicity.learn(d, labels)
    got = {r.doc_id: r.score for r in toxicity.judge(d, labels).collect()}
    t = Texts.of(pa.array([x for _, x in texts]))
    doc, code = toxicity.codes_of(*toxicity.terms(t))
    assert [int((doc == k).sum()) for k in range(40)] == [len(brute_terms(x)) for _, x in texts[:40]]
    place = {int(c): k for k, c in enumerate(model.lexicon.codes)}
    for k, (i, x) in enumerate(texts[:60]):
        z = model.bias + sum(model.weights[place[int(c)]] for c in code[doc == k] if int(c) in place)
        b = x.encode()
        shares = (sum(65 <= c <= 90 for c in b), b.count(b"!"), sum(c in b"#$%&*@^~|<>{}[]\\_=+" for c in b))
        z += sum(w for w, s, limit in zip(model.weights[len(place) :], shares, toxicity.LIMITS) if s / max(len(b), 1) > limit)
        assert got[i] == pytest.approx(1 / (1 + np.exp(-z)))


def test_toxicity_learns_from_training_rows_only(spark):
    texts, labels = labelled(spark, 300)
    d = docs_of(spark, texts)
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = ({r.doc_id: r.score for r in toxicity.judge(d, x).collect()} for x in (labels, flipped))
    assert one == pytest.approx(two)


def test_quality(spark):
    texts, labels = labelled(spark)
    odd = [(9000, None), (9001, ""), (9002, "sunnd " * 50_000), texts[3], texts[3], (None, "x")]
    d = docs_of(spark, [*texts, *odd])
    rows = quality.judge(d, labels).collect()
    got = {r.doc_id: r for r in rows}
    held = [i for i, _ in texts if crc_held_out(i)]
    assert sum(got[i].predicted == (i % 7 != 0) for i in held) >= 0.97 * len(held)
    assert len(rows) == len(texts) + len(odd) and all(0 <= r.score <= 1 and 0 < r.path_posterior < 1 for r in rows)
    kept = quality.scored(d.withColumn("source", F.lit(None).cast("string")).withColumn("own", F.lit("mine")), labels, prefix="q_").collect()
    assert len(kept) == len(rows) and {(r.own, r.score) for r in kept} == {("mine", 0.5)} and all(0 <= r.q_score <= 1 for r in kept)
    assert quality.judge(empty(spark), labels).count() == 0


def test_posteriors_equal_a_plain_computation(spark):
    rng = random.Random(9)
    rows = [("big", f"p{k % 3}", rng.gauss(3 - k % 3, 1)) for k in range(400)] + [("bad", "p", rng.gauss(-3, 1)) for _ in range(300)] + [("one", "p", -4.0)] + [(f"h{k}", "p", rng.gauss(2 * (k % 2), 1)) for k in range(60)]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, host string, path string, own double")
    paths, levels = quality.posteriors(d)
    got = {r.id: r for r in quality.read_under(d, paths, levels).collect()}
    p = [1 / (1 + np.exp(-x)) for _, _, x in rows]
    prior = sum(p) / len(p)
    assert levels["prior"] == pytest.approx(prior)

    def moments(group_of, centre_of):
        groups = {}
        for r, x in zip(rows, p):
            groups.setdefault(group_of(r), []).append(x)
        centre = {g: centre_of(g) for g in groups}
        n, above = len(p), {}
        for g, x in groups.items():
            above.setdefault(g[0] if isinstance(g, tuple) else 0, []).append(len(x))
        between = sum(len(x) * (np.mean(x) - centre[g]) ** 2 for g, x in groups.items())
        within = sum(((np.array(x) - np.mean(x)) ** 2).sum() for x in groups.values())
        spread = (between - (len(groups) - len(above)) * within / (n - len(groups))) / (n - sum(sum(k * k for k in x) / sum(x) for x in above.values()))
        return np.clip(sum(len(x) * centre[g] * (1 - centre[g]) for g, x in groups.items()) / n / spread - 1, 1, 1e4)

    of_host = {h: np.mean([x for r, x in zip(rows, p) if r[0] == h]) for h, _, _ in rows}
    assert levels["of_host"] == pytest.approx(moments(lambda r: r[0], lambda g: prior))
    assert levels["of_path"] == pytest.approx(moments(lambda r: r[:2], lambda g: of_host[g[0]]))
    for i in (0, 1, 500, 700, 710, 755):
        host, path, own = rows[i]
        others = [(r, x) for k, (r, x) in enumerate(zip(rows, p)) if k != i and r[0] == host]
        h = (sum(x for _, x in others) + levels["of_host"] * prior) / (len(others) + levels["of_host"])
        same = [x for r, x in others if r[1] == path]
        q = (sum(same) + levels["of_path"] * h) / (len(same) + levels["of_path"])
        z = own + np.log(q / (1 - q)) - np.log(prior / (1 - prior))
        assert (got[i].host_posterior, got[i].path_posterior, got[i].score) == pytest.approx((h, q, 1 / (1 + np.exp(-z))))
    of = {r.host: r.host_posterior for r in paths.collect()}
    assert of["bad"] < of["one"] < prior < of["big"]


def mixing_docs():
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randint(1, 60)) + rng.choice(["", " a@b", " copyright", " | x"]), rng.choice(["en"] * 6 + ["fr", "de", "es", None]), rng.choice(["src0"] * 10 + [f"src{k}" for k in range(20)] + [None]), 1, 0.0, 1) for i in range(6000)]
    return [*rows, (9000, None, "en", "src1", 0, 0.0, 1), (9001, "", "fr", "src2", 0, 0.0, 1), rows[7], rows[7], (9002, "w " * 200_000, "en", "src3", 1, 0.0, 1)]


@pytest.mark.parametrize("change", [{}, {"other": 0.0}, {"source": {"src0": 0.0, "src1": 0.3, "src2": 0.7}}])
def test_mixing_reaches_the_margins(spark, change):
    t = dataclasses.replace(MIX, **change)
    rows = mixing_docs()
    d = spark.createDataFrame(rows, DOCS)
    got = mixing.sampled(d, t).toPandas()
    assert len(got) == len(rows) and list(got.columns[: len(d.columns)]) == d.columns
    keys = ["c_source", "c_lang", "c_topic"]
    raked = mixing.raked(spark.createDataFrame(got[[*keys, "tokens"]]).groupBy(keys).agg(F.sum("tokens").alias("tokens")), t).toPandas()
    assert raked.weight.sum() == pytest.approx(1)
    for column, shares in (("c_lang", t.lang), ("c_source", t.source), ("c_topic", t.topic)):
        have = raked.groupby(column).weight.sum()
        whole = sum(shares.get(v, t.other) for v in have.index)
        assert all(abs(have[v] - shares.get(v, t.other) / whole) < 1e-9 for v in have.index)
    expected = (raked.tokens * raked.chance).sum()
    if not change:  # else some cells give all they have
        assert expected == pytest.approx(t.part * raked.tokens.sum(), rel=1e-6)
    out = got[(got.c_source.map(lambda v: t.source.get(v, t.other)) == 0) | (got.c_lang.map(lambda v: t.lang.get(v, t.other)) == 0)]
    assert not out.taken.any() and (len(out) > 0) == bool(change)
    small = got[got.tokens < 1000]
    assert small[small.taken].tokens.sum() == pytest.approx((small.tokens * small.chance).sum(), rel=0.05)
    again = got[got.doc_id == rows[7][0]]
    assert len(again) == 3 and again.taken.nunique() == 1


def test_mixing_of_odd_tables(spark):
    assert mixing.sampled(empty(spark), MIX).count() == 0
    one = mixing.sampled(docs_of(spark, [(1, "a b"), (2, "c"), (None, "d")]).withColumn("taken", F.lit("mine")).withColumn("source", F.lit("src0")), MIX, prefix="m_")
    assert {(r.taken, r.m_c_source, r.m_chance) for r in one.collect()} == {("mine", "src0", 0.5)}
    none = mixing.sampled(docs_of(spark, [(1, "a b")]), dataclasses.replace(MIX, source={}, other=0.0))
    assert [(r.chance, r.taken) for r in none.collect()] == [(0.0, False)]


def test_margins_that_contradict_are_told(spark):
    t = dataclasses.replace(MIX, source={"a": 0.5, "b": 0.5}, lang={"en": 0.9, "fr": 0.1}, topics={}, topic={}, sweeps=50)
    d = docs_of(spark, [(1, "x"), (2, "x")]).withColumn("source", F.expr("if(doc_id = 1, 'a', 'b')")).withColumn("lang", F.expr("if(doc_id = 1, 'en', 'fr')"))
    with pytest.warns(UserWarning, match="off by"):
        mixing.sampled(d, t)


def test_warc_round_trip(spark):
    same = "é" + "x" * 99
    odd = "\r\n\r\nWARC/1.1\r\n\r\n" * 30
    rows = [(5, "http://a/", same), (3, "http://b/", same), (9, None, same), (1, "http://c/\r\nX: y", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""), (7, "u", odd), (8, "u", "z" * 3_000_000), (3, "http://b/", same), (3, "u", "short"), (3, "u", odd + "\r\n"), (10, "u", odd + "\r\n"), (None, "u", same), (None, "v", same), (None, "u", same)]
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, payload_digest string, deal int")
    key = lambda r: (r[0] is None, *r[:1], r[1:4], r[4] or 0)
    got = sorted((tuple(r) for r in warc.round_trip(d).collect()), key=key)
    expected = []
    for i, _, x in rows:
        b = (x or "").encode()
        first = min((j for j, _, y in rows if y == x and j is not None), default=None)
        again = len(b) >= 100 and i is not None and i > first
        expected.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first if again else None))
    assert got == sorted(expected, key=key)
    assert warc.round_trip(d.limit(0)).count() == 0


def test_warc_records_refer_to_records(spark, tmp_path):
    same = "y" * 200
    rows = [(i, "u", same) for i in (4, 2, 2, 9)] + [(None, "u", same)] * 2
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"))
    records = warc.read(spark, str(tmp_path / "w")).collect()
    ids = [r.record_id for r in records]
    assert len(set(ids)) == len(ids) == len(rows)
    text = "".join(r.value for r in spark.read.option("wholetext", True).text(str(tmp_path / "w")).collect())
    assert set(re.findall("WARC-Refers-To: (.*)\r\n", text)) <= {r.record_id for r in records if r.record_type == "response"}
    assert text.count("HTTP/1.1 200 OK") == sum(r.record_type == "response" for r in records) == 4


def test_held_out_is_crc32(spark):
    from loomtext.llm.shared import held_out

    got = spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    texts, labels = labelled(spark, 400)
    d = docs_of(spark, [*texts, (5000, texts[1][1]), (5001, None)]).select("doc_id", "text", "lang", "source", "n_chars")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    d.write.parquet(str(tmp_path / "documents.parquet"))
    before = d
    for name, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, before, str(tmp_path))
        assert after.columns == d.columns, name
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in before.select("doc_id").collect()}
        before = spark.createDataFrame(after.collect(), after.schema)
        if name == "toxicity":
            assert all(i % 8 for i in ids if i < 400 and crc_held_out(i))
        if name == "near_duplicates":
            assert not {1, 5000} <= ids
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "ids", "decoded_sha256"} <= set(out.columns) and out.count() > 0


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    texts, labels = labelled(spark, 300)
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    odd = [(5000, None), (5001, ""), (5002, texts[1][1]), (1, texts[2][1] + " of another kind of text altogether with one id twice over here and now"), (None, "no id at all but some words to keep"), (None, None)]
    d = docs_of(spark, [*texts, *odd, texts[9], (5003, "sunnd " * 40_000)])
    d = d.withColumns({"own": F.lit("mine"), "tokens": F.lit(1), "taken": F.lit("t"), "chance": F.lit(0.5), "c_source": F.lit("c"), "host": F.lit("h"), "_score": F.lit(9), "__taken": F.lit(8), "lang": F.when(F.col("doc_id") % 11 > 0, "en"), "source": F.when(F.col("doc_id") % 13 > 0, F.col("source"))})
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, d, str(tmp_path))
        nothing = stage(spark, d.limit(0), str(tmp_path))
        assert nothing.count() == 0
        if name == "bpe":
            assert after.count() == d.count() and {"ids", "own", "tokens"} <= set(after.columns)
            continue
        assert after.columns == nothing.columns == d.columns, name
        kept, rows = (Counter(map(repr, x.collect())) for x in (after, d))
        assert kept and not kept - rows, name  # rows of the input, unchanged, none more often than it stands there
        if name == "near_duplicates":
            every = d.select("doc_id", "text").distinct().collect()
            groups = brute_groups([(i, r.text) for i, r in enumerate(every)], 5, 80)
            members = {}
            for i, r in enumerate(every):
                members.setdefault(groups[i][1] if r.doc_id is not None else ("null", i), []).append(r.doc_id)
            assert after.count() == len(members)
            assert Counter(r.doc_id for r in after.collect()) == Counter(min((x for x in m if x is not None), default=None) for m in members.values())


def test_passing_tables_go(spark, tmp_path, monkeypatch):
    import os

    from loomtext.llm.shared import passing, stored
    from loomtext.sources import scratch

    monkeypatch.setattr(scratch, "base_dir", lambda spark: str(tmp_path))
    with passing(spark) as made:
        stored(spark.range(3))
        kept = stored(spark.range(4))
        made.pop()
    assert kept.count() == 4 and len(os.listdir(tmp_path)) == 1


def test_long_texts_make_smaller_tiles(spark, monkeypatch):
    monkeypatch.setattr(minhash, "TILE", 4)
    monkeypatch.setattr(minhash, "HEAVY", 20)
    rng = random.Random(7)
    base = [f"w{rng.randint(0, 400)}" for _ in range(120)]
    texts = []
    for i in range(60):
        own = list(base)
        for _ in range(rng.randint(1, 12)):
            own[rng.randrange(120)] = f"v{rng.randint(0, 40)}"
        texts.append((i, " ".join(own)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs_of(spark, texts), 3, 85).collect()}
    assert got == brute_groups(texts, 3, 85)
