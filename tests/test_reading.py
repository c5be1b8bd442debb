"""Cursors by keys, addresses of links, crawls."""

import json
import random
from urllib.parse import urldefrag, urljoin

import pytest
from pyspark.sql import functions as F

from loomtext.functions import urls
from loomtext.operators import crawl
from loomtext.sources import cursor
from loomtext.sources.cursor import Cursor, ranged


def test_cursor_pages_to_the_end_and_from_any_token(spark, tmp_path):
    rng = random.Random(2)
    rows = [(None if rng.random() < 0.1 else f"2024-01-{rng.randint(1, 9):02}", rng.choice([None, 1.5, -2.25, 3.0, 1e300]), i, f"t{i}") for i in range(230)]
    df = spark.createDataFrame(rows, "day string, price double, id long, text string").withColumn("day", F.to_date("day"))
    order = ["day", "price", "id"]
    kept = ranged(df, order, f"{tmp_path}/t")
    key = lambda r: tuple((v is not None, v or 0 if not hasattr(v, "isoformat") else v.isoformat()) for v in (r.day, r.price, r.id))
    expected = [r.id for r in sorted(df.collect(), key=key)]
    for size in (1000, 230, 50, 7):
        cursor, token, seen, tokens = Cursor(kept, order, size), None, [], []
        while True:
            page, token = cursor.page(token)
            seen += [r.id for r in page.collect()]
            tokens.append((token, len(seen)))
            if token is None:
                break
        assert seen == expected and len(tokens) == len(rows) // size + 1
    for token, n in random.Random(1).sample(tokens[:-1], 5):  # another process, with another size
        assert [r.id for p in Cursor(df, order, 90).pages(token) for r in p.collect()] == expected[n:]
    plan = Cursor(kept, order, 50).page(json.dumps(["2024-01-07", "1.5", "3"]))[0]._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(day,2024-01-07)" in plan
    assert Cursor(df.limit(0), order, 10).page()[1] is None


#: The examples of RFC 3986, 5.4, for references on http://a/b/c/d;p?q.
EXAMPLES = {
    "g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y",
    ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x", "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g",
    "../..": "http://a/", "../../": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.", "..g": "http://a/b/c/..g",
    "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h", "g;x=1/../y": "http://a/b/c/y", "g?y/./x": "http://a/b/c/g?y/./x",
}


def test_references_are_resolved(spark):
    rng = random.Random(3)
    rows = [("http://a/b/c/d;p?q", r, x) for r, x in EXAMPLES.items()] + [("http://a", "g", "http://a/g"), ("http://a?x=1", "", "http://a?x=1"), (None, "g", None), ("http://a", None, None)]
    for _ in range(400):
        base = "http://h" + "".join(f"/{rng.choice('abc')}" for _ in range(rng.randint(1, 4))) + rng.choice(["", "/", "?q=1", "/?q"])
        ref = "/" * rng.randint(0, 1) + "/".join(rng.choice(["..", ".", "x", "y.z", "w"]) for _ in range(rng.randint(1, 5))) + rng.choice(["", "/", "?k=v", "#f", "?k#f"])
        rows.append((base, ref, urldefrag(urljoin(base, ref)).url))
    df = spark.createDataFrame(rows, "base string, ref string, expected string")
    wrong = df.select("*", urls.resolved(F.col("base"), F.col("ref")).alias("got")).where("NOT (got <=> expected)").collect()
    assert not wrong


def test_links_of_pages(spark):
    html = """<a href="/x">1</a><A  class=q HREF='y z'>2</A><a href= w?a=1&amp;b=2 id=3>3</a><abbr href=no><a name=k>4</a><a data-x="1" href="  /t\n">5</a><link href="/css"><a\nhref=#top>6</a><a href="">7</a>"""
    got = spark.createDataFrame([(html,), (None,), ("",)], "h string").select(urls.links(F.col("h")).alias("x")).collect()
    assert [r.x for r in got] == [["/x", "y z", "w?a=1&b=2", "/t", "#top", ""], None, []]


@pytest.mark.parametrize("most", [None, 0, 1, 3])
def test_crawl_equals_a_walk(spark, most):
    rng = random.Random(7)
    name = lambda k: f"http://h{k % 3}/p/{k}"
    out = {k: [rng.randrange(80) for _ in range(rng.randint(0, 2))] for k in range(60)}  # pages from 60 on aren't stored
    page = lambda k: "".join(f'<a href="{name(j)}#x">' if j % 2 else f"<a href=//h{j % 3}/p/../p/{j}>" for j in out[k]) + '<a href="mailto:a@b"><a href="ftp://x/y">'
    pages = spark.createDataFrame([(name(k), page(k)) for k in out] + [(name(0), page(0)), (None, "<a href=/x>"), (name(500), None)], "url string, html string")
    depth, newest = {0: 0, 5: 0}, [0, 5]
    while newest and (most is None or depth[newest[0]] < most):
        found = {j for k in newest for j in out.get(k, [])} - depth.keys()
        depth |= {j: depth[newest[0]] + 1 for j in found}
        newest = sorted(found)
    seeds = spark.createDataFrame([(name(0) + "#a",), (name(5),), (name(0),), (None,)], "url string")
    got = crawl.reached(pages, seeds, most).collect()
    assert len(got) == len(depth) and {r.url: r.depth for r in got} == {name(k): d for k, d in depth.items()}


def test_large_pages_are_found_by_counts(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    rows = [(None if rng.random() < 0.2 else f"2024-01-{rng.randint(1, 9):02}", rng.choice([None, 1.5, -2.25, float("nan")]), i) for i in range(400)]
    df = spark.createDataFrame(rows, "day string, price double, id long").withColumn("day", F.to_date("day"))
    order = ["day", "price", "id"]
    kept = ranged(df, order, f"{tmp_path}/t")
    monkeypatch.setattr(cursor, "FEW", 60)
    monkeypatch.setattr(cursor, "SAMPLE", 30)
    expected = [r.id for r in df.orderBy(*(F.asc_nulls_first(c) for c in order)).collect()]
    for size in (400, 150):
        token, seen = None, []
        while True:
            page, token = Cursor(kept, order, size).page(token)
            ids = [r.id for r in page.collect()]
            assert "Limit" not in page._jdf.queryExecution().optimizedPlan().toString()  # no task takes a page
            seen.append(ids)
            if token is None:
                break
        assert [len(x) for x in seen] == [size] * (400 // size) + [400 % size] and sum(seen, []) == expected
