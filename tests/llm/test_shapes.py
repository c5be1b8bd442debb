"""Tables of odd shapes: nested, map and clashing columns, shared ids, long hosts, long lists; and the recall of the pivot index as it grows."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomtext.llm import bpe, fingerprint, language, mixing, pivots, quality, toxicity, urlfilter
from loomtext.llm.queries import MIX, vocabulary
from loomtext.llm.shared import crc_held_out

ODD = "doc_id long, text string, lang string, source string, n_chars long, SCORE double, __text string, k0 int, __k0 int, `a.b` struct<`a-b`:int,`c d`:array<struct<`e:f`:string>>>, marks map<string,int>, Ids int, own string, row string"
TEXT = "The quick brown fox jumps over the lazy dog and goes home to sleep. It was a long day for everyone there."


def odd(spark, n=12):
    rows = [(i, f"{TEXT} Number {i} is about {i * 37 % 11} other things that word{i} tells.", "en", f"src{i % 3}", 100, 0.5, "t", 1, 2, (3, [("x",)]), {"a": i}, 4, "o", "r") for i in range(n)]
    return spark.createDataFrame([*rows, rows[3], rows[3], (3, "another text", *rows[3][2:]), (None, None, None, None, None, None, None, None, None, None, None, None, None, None)], ODD)


def some_labels(spark):
    return spark.createDataFrame([(i, i % 2, (i // 2) % 2) for i in range(12)], "doc_id long, quality int, toxic int")


def as_text(df):
    return sorted(repr(r.asDict(True)) for r in df.collect())


def test_operators_pass_odd_columns_on(spark):
    d, labels = odd(spark), some_labels(spark)
    out = toxicity.scored(d, toxicity.learn(d, labels))
    assert out.columns == [*(c for c in d.columns if c != "SCORE"), "score"] and out.count() == d.count()
    out = quality.scored(d, labels)
    assert set(out.columns) == {*d.columns} - {"SCORE"} | {"score", "doc_score", "host_posterior", "path_posterior"} and out.count() == d.count()
    out = bpe.decode(bpe.encode(d, vocabulary(), proof=True), vocabulary())
    assert "Ids" not in out.columns and [r.decoded for r in out.orderBy("doc_id").limit(2).collect()] == ["", d.where("doc_id = 0").first().text]
    assert as_text(out.select("marks", "`a.b`")) == as_text(d.select("marks", "`a.b`"))
    out = mixing.sampled(d, MIX)
    assert as_text(out.select("marks", "`a.b`", "SCORE")) == as_text(d.select("marks", "`a.b`", "SCORE"))
    out = fingerprint.compared(fingerprint.fingerprinted(d).withColumn("b", F.col("fingerprint")), "fingerprint", "b")
    assert out.count() == d.count() and out.where("likeness < 1").isEmpty()


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_pass_odd_columns_on(spark, tmp_path, stage):
    d = odd(spark)
    some_labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    got = dict(corpus_pipeline.STAGES)[stage](spark, d, str(tmp_path))
    if stage == "bpe":
        assert {"ids", "decoded_sha256"} <= set(got.columns) and got.count() == d.count()
    else:
        assert got.columns == d.columns and set(as_text(got)) <= set(as_text(d))
    if stage == "near_duplicates":  # the row that stands three times goes twice; another text of its id stays, and the row of nulls
        assert as_text(got) == sorted(set(as_text(d)))
    assert dict(corpus_pipeline.STAGES)[stage](spark, d.limit(0), str(tmp_path)).count() == 0


def language_rows(shared_id, n=2000):
    rng = random.Random(1)
    words = {"en": "the of and to in is that with for this".split(), "fr": "les des une est dans pour qui sur avec mais".split()}
    text = lambda lang: " ".join(rng.choice(words[lang]) for _ in range(25))
    return [(i, text("en"), "en", "s") for i in range(n)] + [(shared_id, text("fr"), "fr", "s") for i in range(n)]


@pytest.mark.parametrize("shared_id", [1, 3, 4, 8, None])
def test_language_of_rows_that_share_an_id_is_learned(spark, shared_id):
    d = spark.createDataFrame(language_rows(shared_id), "doc_id long, text string, lang string, source string")
    learned = language.learn(d)
    assert set(learned) == {"en", "fr"} and all(len(x) > 10_000 for x in learned.values())
    rows = language.classify(d, learned)
    assert rows.where(f"doc_id <=> {'null' if shared_id is None else shared_id}").where("lang_pred <> 'fr'").count() <= 2
    assert rows.where("lang_pred <> 'en'").count() <= 2002


def test_language_of_copies_and_rare_languages_is_learned(spark, monkeypatch):
    """One text that thousands of rows share leaves the others of its language in; no language is too rare, however many there are."""
    rows = language_rows(1)[:2000] + [(9000 + i, "les des une est", "fr", "s") for i in range(4000)] + [(20_000 + i, f"dans pour qui sur avec mais {i}", "fr", "s") for i in range(50)]
    rows += [(30_000 + 40 * k + j, f"zu{k} " * 5, f"x{k:03}", "s") for k in range(300) for j in range(40) if not crc_held_out(30_000 + 40 * k + j)][: 300 * 40]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    learned = language.learn(d)
    assert len(learned) == 302 and learned["fr"].count(b"\n") > 30
    small = d.where("doc_id % 400 = 0 OR doc_id BETWEEN 30000 AND 30400")
    one = {tuple(r) for r in language.classify(small, learned).collect()}
    monkeypatch.setattr(language, "AT_ONCE", 100)
    assert {tuple(r) for r in language.classify(small, learned).collect()} == one
    monkeypatch.setattr(language, "TOGETHER", 100_000)
    less = language.learn(d)
    assert set(less) == set(learned) and sum(map(len, less.values())) <= 100_000 and min(map(len, less.values())) > 0


def test_long_hosts_take_time_in_proportion(spark):
    rules = [("block", "example.com", "/a"), ("allow", "x.example.com", "/a"), ("block", "org", "/")]
    hosts = ["a." * 50_000 + "example.com", "b." * 50_000 + "x.example.com", "c." * 50_000 + "net", "." * 3000 + "org", "org", "example.com."]
    pages = spark.createDataFrame([(i, f"http://{h}/a/b") for i, h in enumerate(hosts)], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge(pages, rules).collect()}
    assert got == {0: ("example.com/a", "block"), 1: ("x.example.com/a", "allow"), 2: (None, "allow"), 3: ("org/", "block"), 4: ("org/", "block"), 5: (None, "allow")}
    assert urlfilter.judge(pages, []).where("verdict = 'allow' AND rule IS NULL").count() == len(hosts)


def test_a_long_list_is_split(spark, monkeypatch):
    rng = random.Random(2)
    rules = list({f"h{rng.randint(0, 3000)}.org/{rng.choice(['', 'a', 'ab', 'abc'])}": None for _ in range(3000)})
    rules = [(rng.choice(["allow", "block"]), r.split("/")[0], "/" + r.split("/")[1]) for r in rules]
    pages = spark.createDataFrame([(i, f"http://{rng.choice(['', 'www.'])}h{rng.randint(0, 4000)}.org/{rng.choice(['', 'abcd', 'ax', 'b'])}") for i in range(3000)], "page_id long, url string")
    whole = sorted(map(tuple, urlfilter.judge(pages, rules).collect()))
    assert {v for *_, v in whole} == {"allow", "block"} and sum(r is None for _, _, _, r, _ in whole) > 100
    monkeypatch.setattr(urlfilter, "MOST_BYTES", 8192)
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    assert sorted(map(tuple, urlfilter.judge(pages, table).collect())) == whole


@pytest.mark.parametrize("count", [512, 2048, 4096])
def test_recall_of_the_index_stays_as_pivots_grow(spark, monkeypatch, count):
    """Isotropic vectors with planted pairs of cosine 0.90 to 0.93, most of them outside the sample that pivots come from."""
    monkeypatch.setattr(pivots, "FEWEST", count)
    monkeypatch.setattr(pivots, "SAMPLED", 4 if count < 4096 else 1)
    rng = np.random.default_rng(count)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    x = unit(rng.normal(size=(12_000, 64)))
    a, o = x[:2000], rng.normal(size=(2000, 64))
    o = unit(o - (o * a).sum(1)[:, None] * a)
    c = rng.uniform(0.9001, 0.93, 2000)[:, None]
    x = np.concatenate([x, c * a + np.sqrt(1 - c * c) * o])
    true = sum(int((x[k : k + 2000] @ x.T >= 0.9).sum()) for k in range(0, len(x), 2000)) - len(x)
    d = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 64).cast(pa.list_(pa.float64()))}))
    found = pivots.linked(d).agg(F.sum("n_links")).first()[0]
    assert 0.99 * true <= found <= true


def test_archives_are_parsed_in_time_with_their_size(monkeypatch):
    """One payload of 60 MB among small ones, in one gzip member and in one for each record, unzipped in small parts."""
    import gzip
    import hashlib
    import time

    from loomtext.llm import warc

    def record(i, payload):
        block = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
        head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}:x>\r\nWARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}\r\nContent-Length: {len(block)}\r\n\r\n"
        return head.encode() + block + warc.END

    payloads = [b"a\r\n\r\nb" * 3, b"", b"x" * 60_000_000, b"\r\n\r\n", b"last"]
    records = [record(i, p) for i, p in enumerate(payloads)]
    began = time.perf_counter()
    for data in (gzip.compress(b"".join(records), 1), b"".join(gzip.compress(r, 1) for r in records)):
        assert [(r[0], r[4]) for r in warc.parse(data)] == [(i, len(p)) for i, p in enumerate(payloads)]
    assert time.perf_counter() - began < 20
    monkeypatch.setattr(warc, "CHUNK", 7)
    small = [record(i, p) for i, p in enumerate(payloads) if len(p) < 100]
    assert [r[4] for r in warc.parse(gzip.compress(b"".join(small)))] == [len(p) for p in payloads if len(p) < 100]
    assert list(warc.parse(gzip.compress(b""))) == []
    with pytest.raises(ValueError):
        list(warc.parse(gzip.compress(b"".join(small)[:-9])))
