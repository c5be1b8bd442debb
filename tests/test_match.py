"""Many keys in many texts: common beginnings, short and long keys, hot keys, more keys than are sent to a task, odd columns."""

import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomtext.functions import scan
from loomtext.operators import match


def thue_morse(n):
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return [a, b]


def test_hashes_of_runs():
    rng = np.random.default_rng(0)
    buf = rng.integers(0, 3, 3000).astype(np.uint8)
    runs = scan.Runs(buf)
    for size in (1, 2, 7, 64):
        h = runs.at(np.arange(len(buf) - size + 1), size)
        seen = {}
        for k, x in enumerate(h.tolist()):
            assert seen.setdefault(x, buf[k : k + size].tobytes()) == buf[k : k + size].tobytes()
        assert len(seen) == len({buf[k : k + size].tobytes() for k in range(len(h))})


@pytest.mark.parametrize("piece", [64, 1 << 20])
def test_keys_are_found_as_by_searching(monkeypatch, piece):
    monkeypatch.setattr(scan, "PIECE", piece)
    rng = random.Random(4)
    keys = ["", "a", "ab", "é", *("x" * n for n in range(1, 70)), *(f"{'common beginning of very many keys ' * 2}{k}" for k in range(200)), *thue_morse(10), "tail"]
    texts = [None, "", "xxxxx", "ab" * 40 + "é", "x" * 200, f"{'common beginning of very many keys ' * 3}77 {'common beginning of very many keys ' * 2}199", thue_morse(11)[0], *("".join(rng.choice("abxé ") for _ in range(rng.randint(0, 300))) for _ in range(30)), "tail"]
    row, at, key = scan.Keys(keys).found(pa.array(texts))
    expected = {(r, m.start(), k) for r, t in enumerate(texts) for k, w in enumerate(keys) if w for m in re.finditer(f"(?={re.escape(w)})", t or "")}
    place = {(r, len((texts[r])[:c].encode())): c for r in range(len(texts)) if texts[r] for c in range(len(texts[r]))}
    got = [(r, place[r, a], k) for r, a, k in zip(row.tolist(), at.tolist(), key.tolist())]
    assert len(got) == len(set(got)) and set(got) == expected
    assert [len(x) for x in scan.Keys([]).found(pa.array(texts))] == [len(x) for x in scan.Keys([""]).found(pa.array(texts))] == [0, 0, 0]


def test_equal_heads_are_not_compared_one_by_one():
    """20,000 keys with a common beginning, in a text that repeats it: hashes of whole keys decide."""
    keys = scan.Keys([f"{'the same beginning of every key, ' * 2}{k:06}" for k in range(20_000)])
    text = f"{'the same beginning of every key, ' * 2}000007 " * 5000
    began = time.perf_counter()
    row, _, key = keys.found(pa.array([text]))
    assert len(row) == 5000 and set(key.tolist()) == {7} and time.perf_counter() - began < 10


@pytest.mark.parametrize("few", [True, False])
def test_containment_and_alternation_with_hot_keys_and_odd_columns(spark, monkeypatch, few):
    monkeypatch.setattr(match, "KEY_BYTES", 1 << 20 if few else 0)
    monkeypatch.setattr(match, "HOT", 4)
    rng = random.Random(6)
    keys = ["hot passage of words", "passage", "of", "of words", *{"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(60)}]
    texts = [(i, ("hot passage of words " if i % 3 == 0 else "") + "".join(rng.choice("abc ") for _ in range(60)), (i,)) for i in range(200)] + [(3, "of of words", (1,)), (500, None, None), (None, "passage", (2,))]
    t = spark.createDataFrame(texts, "id long, text string, `a.b` struct<`a-b`:int>")
    k = spark.createDataFrame([(x,) for x in [*keys, *keys, "", None]], "key string")
    got = [(r.id, r["a.b"] and r["a.b"]["a-b"], r.key) for r in match.containment(t, k, "id", "text", "a.b").collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, s and s[0], x) for i, text, s in texts for x in keys if text and x in text}
    for chunk in (5, 1000):
        ordered = sorted(keys, key=lambda x: (-len(x), x))
        expected = Counter((i, m) for i, text, _ in texts if text for c in range(0, len(keys), chunk) for m in re.findall("|".join(map(re.escape, ordered[c : c + chunk])), text))
        assert Counter(tuple(r) for r in match.alternation(t, k, "id", "text", chunk).collect()) == expected


def test_sieve_passes_all_keys_and_few_others(spark):
    rng = random.Random(2)
    keys = [f"{rng.random()}{'y' * rng.randint(0, 90)}" for _ in range(20_000)]
    own = match.sieve(spark.createDataFrame([(k,) for k in keys], "key string"))
    row, _, digests = own.found(pa.array(keys[:500] + [f"{rng.random()} and nothing else of any length {rng.random()}" for _ in range(2000)]))
    assert set(range(500)) <= set(row.tolist()) and (row >= 500).sum() < 100 and len(digests) == len(row)


def test_keys_beyond_a_broadcast_in_one_pass(spark, monkeypatch):
    """20 MB of keys of all lengths with 1 MB allowed: the same as with all of them sent; texts are scanned once."""
    n = 100_000
    key = F.concat(F.sha2(F.col("id").cast("string"), 256), F.repeat(F.lit("k"), (F.col("id") % 300).cast("int")))
    keys = spark.range(n).select(key.alias("key"))
    texts = spark.range(2000).select("id", F.concat(F.lit("some text "), F.sha2((F.col("id") * 7 % (2 * n)).cast("string"), 256), F.repeat(F.lit("k"), (F.col("id") * 7 % 300).cast("int")), F.lit(" and more"), F.repeat(F.lit(" filler"), 200)).alias("text"))
    scans = []
    passing = match._passing
    monkeypatch.setattr(match, "_passing", lambda *a: scans.append(1) or passing(*a))
    whole = {(r.id, r.key) for r in match.containment(texts, keys, "id", "text").collect()}
    assert not scans
    monkeypatch.setattr(match, "KEY_BYTES", 1 << 20)
    assert {(r.id, r.key) for r in match.containment(texts, keys, "id", "text").collect()} == whole and len(scans) == 1 and len(whole) >= 1000
