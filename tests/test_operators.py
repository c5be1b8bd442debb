import hashlib
import json
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.operators import context, folds, match, metrics, search
from loomtext.sources import readers, store
from loomtext.streaming import changelog


def docs(spark, groups):
    rows = [("q", g, r, c, s) for g, group in enumerate(groups) for r, (c, s) in enumerate(group, 1)]
    return spark.createDataFrame(rows, "q string, g int, rank int, content string, score double")


def in_order(df):
    return [r.content for r in df.orderBy("position").collect()]


def test_merges(spark):
    d = docs(spark, [[("A", 0.9), ("B", 0.8)], [("A", 0.7), ("C", 0.95)], [("D", 0.1)]])
    for k, expected in ((1, "AD"), (3, "ADC"), (5, "ADCB")):  # Q27
        assert "".join(in_order(context.query_first(d, "q", "g", "content", k))) == expected
    assert in_order(context.global_top(d, "q", "g", "content", 3)) == ["C", "A", "B"]
    r = docs(spark, [[("1", 0.0), ("2", 0.0)], [("3", 0.0), ("4", 0.0), ("5", 0.0)]])
    assert in_order(context.round_robin(r, "q", "g", "content")) == ["1", "3", "2", "4", "5"]


def test_packing_stops_at_the_first_overflow(spark):
    rows = spark.createDataFrame([("k", 1, "q1", "aaaa"), ("k", 2, "q2", "b" * 30), ("k", 3, "", "c")], "k string, o int, q string, c string")
    got = context.packed(rows, "k", "o", "q", "c", 40).first()
    assert got.n_blocks == 1 and got.context == "#### q1\n - aaaa\n"
    assert context.packed(rows, "k", "o", "q", "c", 3).first().context == ""


def test_fusion(spark):
    def ranked(items):
        return spark.createDataFrame([("q", x, r, float(s)) for r, (x, s) in enumerate(items, 1)], "q string, d string, rank int, score double")

    got = {r.d: r.score for r in search.rrf([ranked([("d1", 0), ("d2", 0), ("d3", 0)]), ranked([("d3", 0), ("d1", 0), ("d4", 0)])], "q", "d", 4).collect()}
    assert {k: round(v, 6) for k, v in got.items()} == {"d1": 0.032522, "d3": 0.032266, "d2": 0.016129, "d4": 0.015873}
    got = {r.d: r.score for r in search.minmax([ranked([("d1", 4), ("d2", 2), ("d3", 1)]), ranked([("d3", 0.9), ("d1", 0.5), ("d4", 0.1)])], "q", "d", 4, [2.0, 0.5]).collect()}
    assert got == {"d1": 2.25, "d2": 0.666667, "d3": 0.5, "d4": 0.0}
    same = search.minmax([ranked([("a", 1), ("b", 1)])], "q", "d", 2, [1.0]).collect()
    assert [r.score for r in same] == [1.0, 1.0]  # Q9


def test_containment_modes_q1(spark):
    texts = spark.createDataFrame([(1, "abcde"), (2, None), (3, "")], "id int, t string")
    keys = spark.createDataFrame([("abcd",), ("cde",)], "key string")
    assert {r.key for r in match.alternation(texts, keys, "id", "t").collect()} == {"abcd"}
    assert {r.key for r in match.containment(texts, keys, "id", "t").collect()} == {"abcd", "cde"}
    assert {r.key for r in match.nested_containment(texts, keys, "id", "t").collect()} == {"abcd", "cde"}


@pytest.mark.parametrize(("least", "blocks"), [(5, 1), (1, 1), (3, 4)])
def test_containment_equals_search(spark, monkeypatch, least, blocks):
    rng = random.Random(least)
    texts = [(i, "".join(rng.choice("ab가é") for _ in range(rng.randint(0, 700))), "x") for i in range(30)] + [(30, None, "y"), (31, "", "y"), (3, "ab", "z")]
    keys = list({"".join(rng.choice("ab가é") for _ in range(rng.randint(least, least + 3 * (least > 1)))) for _ in range(40)})
    if blocks > 1:
        monkeypatch.setattr(match, "KEY_BYTES", sum(len(k.encode()) for k in keys) // (blocks - 1) - 1)
    t, k = spark.createDataFrame(texts, "id int, t string, more string"), spark.createDataFrame([(k,) for k in keys] * 2, "key string")
    got = [tuple(r) for r in match.containment(t, k, "id", "t", "more").collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, m, k) for i, t, m in texts for k in keys if t and k in t}
    for chunk in (7, 1000):
        ordered = sorted(keys, key=lambda k: (-len(k), k))
        expected = Counter((i, m) for i, t, _ in texts if t for c in range(0, len(keys), chunk) for m in re.findall("|".join(ordered[c : c + chunk]), t))
        assert Counter(tuple(r) for r in match.alternation(t, k, "id", "t", chunk).collect()) == expected
    none = k.where("key = '?'")
    assert match.containment(t, none, "id", "t").count() == match.alternation(t, none, "id", "t").count() == 0


def test_bm25_equals_a_plain_computation(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 30))), rng.choice(["", None, "W1 w2", "w3"])) for i in range(80)]
    queries = [(i, " ".join(rng.choices([*words, "unknown"], k=4)).upper()) for i in range(9)] + [(20, None), (21, "?")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string, title string"), spark.createDataFrame(queries, "query_id long, query string")

    def field(k, terms):
        own = [Counter((x[k] or "").lower().split()) for x in docs]
        mean = sum(c.total() for c in own) / len(own)
        out = []
        for c in own:
            s = 0.0
            for t in terms:
                df = sum(t in o for o in own)
                s += math.log(1 + (len(own) - df + 0.5) / (df + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * c.total() / mean)) if c[t] else 0
            out.append(s)
        return out

    expected = set()
    for i, text in queries:
        terms = set((text or "").lower().replace("?", "").split())
        best = [max(a, 2 * b) for a, b in zip(field(1, terms), field(2, terms))]
        ranked = sorted((-round(s, 6), k) for k, s in enumerate(best) if s > 0)[:5]
        expected |= {(i, k, -s, r) for r, (s, k) in enumerate(ranked, 1)}
    for block in (1024, 3):
        monkeypatch.setattr(search, "QUERY_BLOCK", block)
        got = {(r.query_id, r.doc_id, round(r.score, 6), r["rank"]) for r in search.bm25(d, q, {"text": 1.0, "title": 2.0}, 5).collect()}
        assert got == expected
    assert search.bm25(d.limit(0), q, {"text": 1.0}, 5).count() == search.bm25(d, q.limit(0), {"text": 1.0}, 5).count() == 0


def test_numbered_rows_with_more_columns(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 1009).alias("o"), "id", F.repeat(F.lit("x"), 50).alias("payload"))
    got = readers.numbered_rows(rows, ["o", "id"]).collect()
    assert [(r.o, r.id) for r in sorted(got, key=lambda r: r["index"])] == sorted((r.o, r.id) for r in got)
    assert sorted(r["index"] for r in got) == list(range(5000)) and all(len(r.payload) == 50 for r in got)


@pytest.mark.parametrize("values", [[], [3], [1, 1, 2, 5], [None, 4.5, 1.0, 1.0, 7.25, 9.0], list(range(1000))])
def test_quantiles_are_exact(spark, values):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double")
    known = [v for v in values if v is not None]
    expected = sorted(set(np.quantile(known, [k / 5 for k in range(6)]).tolist())) if known else []
    assert folds.quantile_edges(df, "v") == pytest.approx(expected)


@pytest.mark.parametrize("seed", range(4))
def test_least_loaded_equals_a_plain_loop(spark, seed):
    rng = random.Random(seed)
    groups = [(g, rng.randint(0, 4), rng.choice([1, 1, 1, 2, 3]), rng.choice([0, 1, 1])) for g in range(120)]
    rows = [(g, fold, k < t * n) for g, fold, n, t in groups for k in range(n + 1)] + [(999, 2, True)] * (40 if seed == 1 else 0)
    load, sizes = Counter(f for _, f, t in rows if t), {}
    for g, _, t in rows:
        n, m = sizes.get(g, (0, 0))
        sizes[g] = (n + 1, m + t)
    to = {}
    for g in sorted((g for g in sizes if sizes[g][1]), key=lambda g: (-sizes[g][0], -sizes[g][1], g)):
        to[g] = min(range(5), key=lambda f: (load[f], f))
        load[to[g]] += sizes[g][1]
    got = folds.least_loaded(spark.createDataFrame(rows, "g int, fold int, hit boolean"), "g", "fold", F.col("hit"), 5).collect()
    assert len(got) == len(rows) and all(r.fold == to[r.g] for r in got if r.g in to)


def test_numbering_has_no_window_over_all_rows(spark):
    rows = spark.range(100).select("id", F.lit("en").alias("lang"), F.lit(3).alias("n"))
    for df in (folds.dealt(rows, "lang", "id", "s", 5), folds.balanced_targets(rows, "n", "id", "s"), folds.quota(rows.select("id"), "id", 3, 3, 5, "s")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert all("__part" in line for line in plan.splitlines() if "row_number()" in line)
    assert sorted(r["count"] for r in folds.dealt(rows, "lang", "id", "s", 5).groupBy("fold").count().collect()) == [20] * 5


def test_packing_keeps_few_rows_before_the_shuffle(spark):
    rows = spark.range(5000).select(F.pmod("id", F.lit(2)).alias("k"), "id", F.lit("q").alias("q"), F.repeat(F.lit("y"), 9000).alias("c"))
    out = context.packed(rows.withColumn("c", F.when(F.col("id") < 6, "short").otherwise(F.col("c"))), "k", "id", "q", "c", 4000)
    assert out.first().n_blocks == 3
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_propagation_q5(spark):
    rows = spark.createDataFrame([(1, "", None, None), (2, "", "a", None), (3, "x", None, "s"), (4, "x", "b", None)], "id int, n string, src string, sub string")
    got = {r.id: (r.src, r.sub) for r in match.propagate(rows, "n", ["src", "sub"], "id").collect()}
    assert got == {1: ("a", None), 2: ("a", None), 3: ("b", "s"), 4: ("b", None)}


def test_quota_and_balance(spark):
    rows = spark.createDataFrame([(i,) for i in range(7)], "id int")
    got = folds.quota(rows, "id", 3, 3, 5, "s").orderBy(*folds.shuffled("s", "id")).collect()
    assert [r.fold for r in got] == [3, 3, 3, 0, 1, 2, 4]
    q = spark.createDataFrame([(i, list("abcd"), 1 + i % 2) for i in range(10)] + [(10, ["a"], None)], "id int, ch array<string>, a int")
    out = folds.rebalanced(q, "ch", "a", "id", "s")
    counts = [r["count"] for r in out.where("a IS NOT NULL").groupBy("a").count().collect()]
    assert max(counts) - min(counts) <= 1 and out.count() == 11
    for r in out.where("a IS NOT NULL").collect():
        assert sorted(r.ch) == list("abcd") and r.ch[r.a - 1] == "ab"[r.id % 2]


def test_group_folds_keep_groups(spark):
    rows = spark.createDataFrame([(i, i // 3, f"l{i % 2}") for i in range(60)], "id int, g int, l string")
    assigned = rows.join(folds.stratified_group_folds(rows, "g", "l", 5, "s"), "g")
    assert assigned.count() == 60 and folds.leaking_groups(assigned, "g", "fold").count() == 0
    sizes = [r["count"] for r in assigned.groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 3
    moved = folds.least_loaded(assigned, "g", "fold", F.col("l") == "l1", 5)
    assert moved.count() == 60


def test_stratified_groups_stay_on_the_cluster(spark, monkeypatch):
    rows = spark.range(20_000).select((F.col("id") / 2).cast("long").alias("g"), F.when(F.col("id") % 10 < 2, None).otherwise(F.col("id") % 3).alias("l"))
    most = []
    frame, whole = type(rows), type(rows).collect
    monkeypatch.setattr(frame, "collect", lambda self: (most.append(len(r := whole(self))), r)[1])
    assigned = folds.stratified_group_folds(rows, "g", "l", 5, "s")
    monkeypatch.undo()
    assert max(most) < 20  # distinct counts of labels, not 10,000 groups
    got = {r.g: r.fold for r in assigned.collect()}
    assert len(got) == assigned.count() == 10_000 and set(got.values()) == set(range(5))
    assert got == {r.g: r.fold for r in folds.stratified_group_folds(rows.repartition(7), "g", "l", 5, "s").collect()}
    for r in rows.join(assigned, "g").groupBy("l").pivot("fold", list(range(5))).count().collect():
        n = [r[str(k)] for k in range(5)]
        assert max(n) - min(n) <= 4


def test_stratified_groups_equal_a_plain_loop(spark):
    """Kind by kind, with the spread of all labels computed anew each time."""
    rng = random.Random(9)
    rows = [(g, rng.choice(["a", "b", "c", None])) for g in range(150) for _ in range(rng.randint(1, 4))]
    labels = sorted({v for _, v in rows}, key=str)
    total = np.array([sum(v == x for _, v in rows) for x in labels], float)
    kinds = Counter()
    kind_of = {}
    for g in range(150):
        own = Counter(v for h, v in rows if h == g)
        kind_of[g] = tuple((labels.index(v), n) for v, n in sorted(own.items(), key=lambda x: labels.index(x[0])))
        kinds[kind_of[g]] += 1

    def order(kind):
        n = [c for _, c in kind]
        text = json.dumps([{"at": a, "n": c} for a, c in kind], separators=(",", ":"))
        return -round(sum(c * c for c in n) - sum(n) ** 2 / len(labels), 9), hashlib.md5(text.encode()).hexdigest()

    have, expected = np.zeros((len(labels), 5)), {}
    for kind in sorted(kinds, key=order):
        v = np.zeros(len(labels))
        for a, c in kind:
            v[a] = c
        given = [0] * 5
        for _ in range(kinds[kind]):
            tried = []
            for f in range(5):
                more = have.copy()
                more[:, f] += v
                tried.append((round(float(((more / total[:, None]).std(1) - (have / total[:, None]).std(1)).sum()), 11), have[:, f].sum(), f))
            f = min(tried)[2]
            have[:, f] += v
            given[f] += 1
        expected[kind] = given
    got = {k: [0] * 5 for k in kinds}
    for r in folds.stratified_group_folds(spark.createDataFrame(rows, "g long, l string"), "g", "l", 5, "s").collect():
        got[kind_of[r.g]][r.fold] += 1
    assert got == expected


def test_stratified_groups_of_many_labels(spark, monkeypatch):
    """500 labels, nearly as many kinds of groups as groups: settled in tasks, with a bounded collect; each label as even as its groups allow."""
    monkeypatch.setattr(folds, "KINDS", 600)
    rng = random.Random(5)
    rows = [(g, f"l{rng.randint(0, 499)}" if rng.random() < 0.99 else None) for g in range(6000) for _ in range(rng.randint(1, 6))]
    df = spark.createDataFrame(rows, "g long, l string")
    most = []
    frame, whole = type(df), type(df).collect
    monkeypatch.setattr(frame, "collect", lambda self: (most.append(len(r := whole(self))), r)[1])
    assigned = folds.stratified_group_folds(df, "g", "l", 5, "s")
    monkeypatch.setattr(frame, "collect", whole)
    assert max(most) <= 600
    got = {r.g: r.fold for r in assigned.collect()}
    assert len(got) == assigned.count() == 6000 and set(got.values()) == set(range(5))
    of_label = {}
    for g, label in rows:
        of_label.setdefault(label, [0] * 5)[got[g]] += 1
    sizes = [sum(c[k] for c in of_label.values()) for k in range(5)]
    assert max(sizes) - min(sizes) < 0.02 * len(rows)
    chance = np.sqrt(0.16 / np.array([sum(c) for c in of_label.values()]))  # of a share that groups get by chance
    spread = np.array([np.std(np.array(c) / sum(c)) for c in of_label.values()])
    assert spread.mean() < 0.75 * chance.mean()
    assert folds.stratified_group_folds(df.limit(0), "g", "l", 5, "s").count() == 0


def test_split_needs_a_fold(spark):
    with pytest.raises(ValueError):
        folds.split(spark.range(1), "fold", 1)


def test_report(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 2), (3, 4)], "t int, p int")
    assert {r["class"]: r.f1 for r in metrics.report(rows, "t", "p").collect()} == {1: 0.666667, 2: 0.8, 3: 0.0, 4: 0.0}
    assert metrics.macro_f1(rows, "t", "p").first().macro_f1 == 0.366667
    assert spark.range(1).select(metrics.correct(F.lit("x"), F.lit(1)).alias("c")).first().c is False


def test_replay_q13(spark):
    rows = [(1, "k1", "p", "v1", None, None), (2, "k2", "p", "v1", None, None), (3, "k1", None, None, True, None), (4, "k2", "p", "v2", None, None), (5, None, "p", None, None, True), (6, "k3", "p", "v3", None, None)]
    log = spark.createDataFrame(rows, "seq int, k string, parent string, v string, _deleted boolean, _deleted_by_parent boolean")
    assert {r.k: r.v for r in store.replay(log, "k", "seq", parent="parent").collect()} == {"k3": "v3"}
    assert {r.k: r.v for r in store.replay(log, "k", "seq", parent="parent", compat=True).collect()} == {"k2": "v2", "k3": "v3"}


def test_files(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"k": "a", "v": 1}\n\nnot json\n{"k": "b", "v": 2}\n')
    assert readers.jsonl_lenient(spark, str(tmp_path / "log.jsonl"), "k string, v int").where("k IS NOT NULL").count() == 2
    assert readers.jsonl_lenient(spark, str(tmp_path / "none.jsonl"), "k string, v int").count() == 0
    with pytest.raises(Exception):  # noqa: B017
        readers.jsonl(spark, str(tmp_path / "log.jsonl"), "k string, v int").collect()
    rows = spark.createDataFrame([("1", 'a "b"\nc,d', "가")], "id string, t string, k string")
    readers.write_csv(rows, str(tmp_path / "csv"), one_file=True)
    assert [tuple(r) for r in readers.csv(spark, str(tmp_path / "csv"), "id string, t string, k string").collect()] == [tuple(rows.first())]
    assert readers.csv_or_empty(spark, str(tmp_path / "nothing"), "a string").columns == ["a"]
    store.backup(rows, str(tmp_path / "backup"))
    assert store.restore(spark, str(tmp_path / "backup"), "id string, t string, k string").count() == 1
    assert readers.listed(spark, str(tmp_path / "csv"), "*.csv") and readers.listed(spark, str(tmp_path / "absent")) == []


def test_problems(spark):
    good = "{'question': 'q', 'choices': ['a', \"b's\"], 'answer': 2}"
    rows = spark.createDataFrame([(good,), ("{",), (None,)], "p string")
    got = [r.x for r in rows.select(readers.parsed_problem(F.col("p"), strict=False).alias("x")).collect()]
    assert got[0].choices == ["a", "b's"] and got[0].answer == 2 and got[1] is None and got[2] is None
    with pytest.raises(Exception):  # noqa: B017
        rows.select(readers.parsed_problem(F.col("p")).alias("x")).collect()


def test_stream_follows_the_log(spark, tmp_path):
    spark.createDataFrame([(1, "a", 1, False), (2, "b", 1, False), (3, "a", 2, False), (4, "b", None, True)], "seq int, k string, v int, _deleted boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    log = spark.readStream.schema("seq int, k string, v int, _deleted boolean").parquet(str(tmp_path / "in"))
    changelog.follow(log, "k", "seq", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert {r.k: r.v for r in changelog.state(spark, str(tmp_path / "out"), "k", "seq").collect()} == {"a": 2}


def test_tables(spark):
    store.drop(spark, "loom_t", confirm=True)
    assert store.create(spark, "loom_t", "a int") and not store.create(spark, "loom_t", "a int")
    assert store.status(spark, "loom_t") == {"table": "loom_t", "exists": True, "rows": 0}
    with pytest.raises(ValueError):
        store.drop(spark, "loom_t")
    store.drop(spark, "loom_t", confirm=True)
