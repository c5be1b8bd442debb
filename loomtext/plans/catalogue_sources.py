"""Named queries of sources, sinks and stores, and of what the other two files leave."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.functions import arrays, lattice, text
from loomtext.operators import context, crawl, features, match, metrics, prompts
from loomtext.plans.catalogue import _CHOICES_SQL, _KEYS_SQL, _NORM_SQL, _PRED_SQL, _choices, _predicted, query, t
from loomtext.sources import cursor, readers, store, versions
from loomtext.sources.scratch import new_folder, stored
from loomtext.streaming import changelog


def ddl(df: DataFrame) -> str:
    """The columns, with names quoted where they need it, nested ones too."""
    return df._jdf.schema().toDDL()


# --- sources and sinks


@query("""SELECT doc_id, lang, source FROM documents""")
def csv_without_index(spark, d):
    """Written with an index in the first column, read without it."""
    rows, path = t(spark, d, "documents").select("doc_id", "lang", "source"), new_folder(spark)
    readers.write_csv_indexed(rows, path, ["doc_id"])
    return readers.csv_or_empty(spark, path, ddl(rows), "index")


@query("""SELECT CAST(row_number() OVER (ORDER BY lang, doc_id) - 1 AS BIGINT) AS index, doc_id, lang, source, n_chars FROM documents""")
def csv_with_index(spark, d):
    rows, path = t(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), new_folder(spark)
    readers.write_csv_indexed(rows, path, ["lang", "doc_id"])
    return readers.csv(spark, path, f"index long, {ddl(rows)}")


@query("""SELECT lang, count(*) AS n FROM documents WHERE doc_id % 2 = 0 GROUP BY lang""")
def csv_absent(spark, d):
    """Of three files, of which one is there, the absent ones give no rows."""
    folder, rows = new_folder(spark), t(spark, d, "documents").where("doc_id % 2 = 0").select("doc_id", "lang")
    readers.write_csv(rows.select(F.lit(0).alias("index"), *rows.columns), f"{folder}/b")
    parts = [readers.csv_or_empty(spark, f"{folder}/{name}", ddl(rows), "index") for name in "abc"]
    return reduce(DataFrame.unionByName, parts).groupBy("lang").agg(F.count("*").alias("n"))


@query("""SELECT conv_id, turn, role, text FROM conversations""")
def json_array_round_trip(spark, d):
    rows, path = t(spark, d, "conversations").select("conv_id", "turn", "role", "text"), new_folder(spark)
    readers.write_json_array(rows, path)
    return readers.json_array(spark, path, ddl(rows))


@query("""SELECT doc_id, text, lang FROM documents""")
def jsonl_strict_round_trip(spark, d):
    rows, path = t(spark, d, "documents").select("doc_id", "text", "lang"), new_folder(spark)
    readers.write_jsonl(rows, path)
    return readers.jsonl(spark, path, ddl(rows))


@query("""SELECT count(*) AS n, count(DISTINCT o_orderkey) AS keys FROM (SELECT o_orderkey FROM orders UNION ALL SELECT o_orderkey FROM orders)""")
def all_splits(spark, d):
    return readers.splits(spark, [f"{d}/orders.parquet", f"{d}/orders.parquet"]).agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("keys"))


@query("""WITH p AS (SELECT *, (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) // (SELECT greatest(1, (count(*) + 7) // 8) FROM orders) AS page FROM orders)
    SELECT CAST(page AS INTEGER) AS page, count(*) AS n, min(o_orderkey) AS least, max(o_orderkey) AS most, round(sum(o_totalprice), 2) AS total FROM p GROUP BY page""")
def cursor_scan(spark, d):
    """`orders` in eight pages by date and key: the first four, then the others from a token on, as another process would."""
    order = ["o_orderdate", "o_orderkey"]
    rows = cursor.ranged(t(spark, d, "orders").select(*order, "o_totalprice"), order, new_folder(spark))
    size = max(1, (rows.count() + 7) // 8)
    pages, token = [], None
    for _ in range(4):
        page, token = cursor.Cursor(rows, order, size).page(token)
        pages.append(page)
        if token is None:
            break
    pages += cursor.Cursor(rows, order, size).pages(token) if token else []
    facts = [p.agg(F.count("*").alias("n"), F.min("o_orderkey").alias("least"), F.max("o_orderkey").alias("most"), F.round(F.sum("o_totalprice"), 2).alias("total")).withColumn("page", F.lit(k)) for k, p in enumerate(pages)]
    return reduce(DataFrame.unionByName, facts).where("n > 0")


@query(r"""WITH RECURSIVE n AS (SELECT count(*) AS n FROM pages),
    u AS (SELECT page_id, regexp_extract(url, '^[^#]*') AS url, regexp_extract(url, '^https?://[^/?#]*') AS root, regexp_extract(regexp_extract(url, '^https?://[^/?#]*([^?#]*)/', 1), '^(.*)/', 1) AS above, html FROM pages),
    l AS (SELECT a.url AS at, b.url AS to FROM u a, n, u b WHERE b.page_id = (2 * a.page_id + 1) % n OR b.page_id = (3 * a.page_id + 2) % n
        UNION SELECT url, root || above || '/' || page_id || '/x?y=1' FROM u
        UNION SELECT url, regexp_extract(root || replace(unnest(regexp_extract_all(html, '<a href="(/[^"]*)"', 1)), '&amp;', '&'), '^[^#]*') FROM u),
    r(url, depth) AS (SELECT url, 0 FROM u WHERE page_id = 0 UNION SELECT l.to, depth + 1 FROM r JOIN l ON r.url = l.at WHERE depth < 6)
    SELECT url, min(depth) AS depth FROM r GROUP BY url""")
def crawl_frontier(spark, d):
    """What six steps from the first page reach, where each page also links to two others and up: by protocol-relative, absolute and relative addresses."""
    pages = t(spark, d, "pages")
    n, rows = pages.count(), pages
    for name, factor, more in (("a", 2, 1), ("b", 3, 2)):
        other = pages.select(F.col("page_id").alias(f"__{name}"), F.col("url").alias(name))
        rows = rows.withColumn(f"__{name}", (F.col("page_id") * factor + more) % n).join(other, f"__{name}")
    scheme = F.regexp_extract("url", "^[a-z]+:", 0)
    a = F.when(F.startswith("a", scheme), F.substring("a", F.length(scheme) + 1, F.length("a"))).otherwise(F.col("a"))
    b = F.replace("b", F.lit("&"), F.lit("&amp;"))
    more = ["<A class=x HREF='", a, "'>a</A> <a href=\"", F.concat(b, F.when(F.contains("b", F.lit("#")), "").otherwise("#part")), '">b</a> <a href=../', F.col("page_id").cast("string"), '/./x?y=1>c</a> <a href="mailto:x@example.com">d</a>']
    html = F.concat("html", *(F.lit(x) if isinstance(x, str) else x for x in more))
    return crawl.reached(rows.select("url", html.alias("html")), pages.where("page_id = 0"), 6)


#: What is done to the orders: version 2 changes every tenth, 3 deletes every fifteenth, 4 compacts, 5 adds late records, 6 restores 2, 7 deletes by customer.
@query("""WITH v2 AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 10 = 0 THEN 2 ELSE 1 END::BIGINT AS seq FROM orders)
    SELECT 1 AS version, o_orderkey, o_custkey, o_orderstatus, 1::BIGINT AS seq FROM orders UNION ALL SELECT 5, * FROM v2 WHERE o_orderkey % 15 <> 0 UNION ALL SELECT 7, * FROM v2 WHERE o_custkey % 4 <> 0""")
def versioned_store(spark, d):
    table = versions.Versions(spark, new_folder(spark), "o_orderkey", "seq")
    base = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.lit(1).cast("long").alias("seq"), F.lit(False).alias("_deleted"))
    changed = lambda condition, seq, **to: base.where(condition).withColumns({"seq": F.lit(seq).cast("long"), **{k: F.lit(v) for k, v in to.items()}})
    table.commit(base)
    table.commit(changed("o_orderkey % 10 = 0", 2, o_orderstatus="X"))
    table.commit(changed("o_orderkey % 15 = 0", 3, _deleted=True))
    table.compact()
    table.commit(changed("o_orderkey % 15 = 0", 1, o_orderstatus="late"))
    table.restore(2)
    table.commit(changed("o_custkey % 4 = 0", 9, _deleted=True))
    return reduce(DataFrame.unionByName, [table.read(v).withColumn("version", F.lit(v)) for v in (1, 5, 7)])


@query("""SELECT user_id, seq, event_type, value FROM (SELECT user_id, event_id AS seq, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'error'""")
def changelog_keyed_stream(spark, d):
    """As changelog_replay, from a stream with the last record of each user as state, which stops and starts again between the halves of a log in no order; the table and the copy of the log that it keeps agree."""
    folder, e = new_folder(spark), t(spark, d, "events")
    records = e.select("user_id", F.col("event_id").alias("seq"), "event_type", "value", (F.col("event_type") == "error").alias("_deleted"))
    table = versions.Versions(spark, f"{folder}/table", "user_id", "seq")
    for part in (1, 0):
        readers.write_jsonl(records.where(F.pmod(F.xxhash64("seq"), F.lit(2)) == part), f"{folder}/log", append=True)
        log = spark.readStream.schema(records.schema).option("maxFilesPerTrigger", 64).json(f"{folder}/log")
        changelog.follow_keyed(log, "user_id", "seq", table, f"{folder}/copy", f"{folder}/progress").awaitTermination()
    copy = store.replay(spark.read.schema(records.schema).json(f"{folder}/copy").drop("batch"), "user_id", "seq").select("user_id", "seq", "event_type", "value")
    return table.read().select(copy.columns).intersect(copy)


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)""")
def point_lookup(spark, d):
    orders = t(spark, d, "orders").select("o_orderkey", "o_totalprice")
    found = readers.by_id(orders, "o_orderkey", orders.agg(F.min("o_orderkey")).first()[0])
    assert readers.by_id(orders, "o_orderkey", -1) is None
    return spark.createDataFrame([found], orders.schema)


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = (SELECT max(o_custkey) FROM orders) ORDER BY o_orderkey LIMIT 1000""")
def children_of_parent(spark, d):
    orders = t(spark, d, "orders").select("o_orderkey", "o_custkey")
    return readers.children(orders, "o_custkey", orders.agg(F.max("o_custkey")).first()[0], "o_orderkey")


@query("""SELECT DISTINCT lang || '.csv' AS name FROM documents WHERE lang IS NOT NULL""")
def listed_files(spark, d):
    """A folder for each language, and one of another kind; those that hold files of the kind are listed."""
    folder, rows = new_folder(spark), t(spark, d, "documents").where("lang IS NOT NULL")
    names = [r["lang"] for r in rows.select("lang").distinct().orderBy("lang").collect()]
    for name in names:
        rows.where(F.col("lang") == name).select("doc_id").write.csv(f"{folder}/{name}.csv")
    rows.select(F.col("doc_id").cast("string")).write.text(f"{folder}/none.csv")
    found = [f"{n}.csv" for n in [*names, "none", "absent"] if readers.listed(spark, f"{folder}/{n}.csv", "part-*.csv")]
    return spark.createDataFrame([(n,) for n in found], "name string")


@query("""SELECT count(*) AS rows, max(o_totalprice) AS most FROM orders""")
def sidecar(spark, d):
    path = new_folder(spark)
    readers.write_summary(t(spark, d, "orders"), path, most=F.max("o_totalprice"))
    return spark.read.schema("rows long, most double").json(path)


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 3 = 0""")
def cleared_log(spark, d):
    """A log that is cleared holds what is written afterwards, and that only."""
    path, rows = new_folder(spark), t(spark, d, "orders").select("o_orderkey", "o_custkey")
    readers.write_jsonl(rows, path)
    readers.clear(spark, [path])
    readers.write_jsonl(rows.where("o_orderkey % 3 = 0"), path, append=True)
    return readers.jsonl_lenient(spark, path, ddl(rows))


@query("""SELECT n_nationkey, n_name, 2::BIGINT AS times FROM nation""")
def tapped_rows(spark, d):
    """What passes through a tap twice is in its log twice."""
    path, rows = new_folder(spark), t(spark, d, "nation").select("n_nationkey", "n_name")
    out = store.tap(store.tap(rows, path), path, ["n_nationkey", "n_name"])
    log = readers.jsonl_lenient(spark, path, ddl(rows)).groupBy("n_nationkey").agg(F.count("*").alias("times"))
    return out.join(log, "n_nationkey")


@query("""SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 3 = 0)""")
def delete_by_id(spark, d):
    orders = t(spark, d, "orders")
    return store.deleted(orders.select("o_orderkey", "o_orderstatus"), orders.where("o_custkey % 3 = 0"), "o_orderkey")


@query("""SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN 'new' ELSE n_name END AS n_name FROM nation""")
def write_through(spark, d):
    """Log and table hold the same last records."""
    folder, name = new_folder(spark), f"loomtext_{uuid.uuid4().hex}"
    base = t(spark, d, "nation").select("n_nationkey", "n_name", F.lit(1).cast("long").alias("seq"))
    assert store.create(spark, name, ddl(base), location=f"{folder}/table") and not store.create(spark, name, ddl(base))
    for delta in (base, base.where("n_nationkey < 5").select("n_nationkey", F.lit("new").alias("n_name"), F.lit(2).cast("long").alias("seq"))):
        store.write_through(delta, f"{folder}/log", name)
    both = [store.latest(x, "n_nationkey", "seq").select("n_nationkey", "n_name") for x in (spark.table(name), readers.jsonl(spark, f"{folder}/log", ddl(base)))]
    return both[0].intersect(both[1])


@query("""SELECT true AS made, count(*) AS rows, false AS after FROM orders""")
def table_status(spark, d):
    name, folder = f"loomtext_{uuid.uuid4().hex}", new_folder(spark)
    rows = t(spark, d, "orders").select("o_orderkey", "o_custkey")
    made = store.create(spark, name, ddl(rows), location=folder)
    rows.write.mode("append").saveAsTable(name)
    before = store.status(spark, name)
    store.drop(spark, name, confirm=True)
    return spark.createDataFrame([(made and before["exists"], before["rows"], store.status(spark, name)["exists"])], "made boolean, rows long, after boolean")


@query("""SELECT doc_id, 'v1' AS version, 0 AS n FROM documents""")
def default_fields(spark, d):
    rows = t(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "v1").alias("version"), F.lit(None).cast("array<float>").alias("vector"))
    return store.with_defaults(readers.validated(rows, ["doc_id", "version"]), "v1", ("vector",)).select("doc_id", "version", F.size("vector").alias("n"))


# --- parsing, texts, arrays


@query("""SELECT doc_id, lang AS question, ['a', 'b'] AS choices, CAST(doc_id % 5 AS INTEGER) AS answer, source AS question_plus FROM documents""")
def parse_problems_strict(spark, d):
    literal = F.concat(F.lit("{'question': '"), "lang", F.lit("', 'choices': ['a', 'b'], 'answer': "), F.col("doc_id") % 5, F.lit(", 'question_plus': \""), "source", F.lit('"}'))
    rows = t(spark, d, "documents").select("doc_id", readers.parsed_problem(literal).alias("p"))
    return rows.select("doc_id", "p.question", "p.choices", "p.answer", "p.question_plus")


@query("""SELECT doc_id, trim(text, E' \\n\\t\\r') AS said FROM documents""")
def think_tags(spark, d):
    said = F.concat(F.lit(" <think>"), "text", F.lit("</THINK>\n"))
    return t(spark, d, "documents").select("doc_id", text.without_think_tags(said).alias("said"))


@query("""SELECT doc_id, doc_id % 3 = 1 AS negative FROM documents""")
def negative_questions(spark, d):
    asked = F.when(F.col("doc_id") % 3 == 0, "옳은 것은?").when(F.col("doc_id") % 3 == 1, "글의 내용과 일치하지 않는 것은?")
    return t(spark, d, "documents").select("doc_id", text.asks_negative(asked).alias("negative"))


@query("""SELECT doc_id, CAST(CASE WHEN doc_id % 7 BETWEEN 1 AND 5 THEN doc_id % 7 - 1 END AS INTEGER) AS label, CASE WHEN doc_id % 7 BETWEEN 1 AND 5 THEN CAST(doc_id % 7 AS VARCHAR) END AS again FROM documents""")
def label_decode(spark, d):
    said = F.concat(F.when(F.col("doc_id") % 2 == 0, "x\n<think>\n\n</think>\n\n").otherwise(""), F.col("doc_id") % 7)
    rows = t(spark, d, "documents").select("doc_id", arrays.label_index(said).alias("label"))
    return rows.select("doc_id", "label", arrays.label_text(F.col("label")).alias("again"))


@query("""SELECT vec_id, round(list_avg(embedding::DOUBLE[]), 6) AS mean, round(list_max(embedding::DOUBLE[]), 6) AS most FROM embeddings""")
def array_mean_and_max(spark, d):
    x = F.col("embedding").cast("array<double>")
    return t(spark, d, "embeddings").select("vec_id", F.round(arrays.mean_of(x), 6).alias("mean"), F.round(F.array_max(x), 6).alias("most"))


@query(f"""WITH {_CHOICES_SQL} SELECT doc_id, unnest(ch) AS choice, unnest(list_transform(ch, lambda x: length(x))) AS n FROM c""")
def strict_zip(spark, d):
    rows = t(spark, d, "documents").select("doc_id", _choices().alias("ch"))
    pairs = arrays.zipped(F.col("ch"), F.transform("ch", lambda c: F.length(c).cast("long")), "choice", "n")
    return rows.select("doc_id", F.inline(pairs))


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'right' ELSE lang END AS lang, source, CASE WHEN doc_id % 2 = 0 THEN 'new' END AS more FROM documents""")
def map_merge(spark, d):
    left = F.create_map(F.lit("lang"), "lang", F.lit("source"), "source")
    right = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("lang"), F.lit("right"), F.lit("more"), F.lit("new")))
    rows = t(spark, d, "documents").select("doc_id", arrays.merged_maps(left, right).alias("m"))
    return rows.select("doc_id", *(F.try_element_at("m", F.lit(k)).alias(k) for k in ("lang", "source", "more")))


@query("""SELECT vec_id, '{"vec_id":' || vec_id || ',"inner":{"label":' || label || '}}' AS record FROM embeddings""")
def nested_json(spark, d):
    rows = t(spark, d, "embeddings").select("vec_id", F.struct("label").alias("inner"))
    return rows.select("vec_id", text.as_json("vec_id", "inner").alias("record"))


@query("""SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN lang END, CASE WHEN doc_id % 3 = 1 THEN source END, '-') AS v, doc_id % 4 = 1 AS is_history, doc_id % 4 = 1 AND n_chars > 500 AS both FROM documents""")
def conditions(spark, d):
    k = F.col("doc_id") % 3
    nested = F.when(k == 1, F.struct(F.col("source").alias("v")))
    plan = F.when(F.col("doc_id") % 4 == 1, "한국사").when(F.col("doc_id") % 4 == 2, "general")
    is_history = context.subject_is(plan, "한국사")
    both = context.all_hold(is_history, F.when(F.col("doc_id") % 4 != 3, F.col("n_chars") > 500))
    return t(spark, d, "documents").select("doc_id", context.first_known(F.when(k == 0, F.col("lang")), nested["v"], "-").alias("v"), is_history.alias("is_history"), both.alias("both"))


@query("""SELECT doc_id FROM documents WHERE len(string_split(text, ' ')) <= 200""")
def shorter_by_tokenizer(spark, d):
    return readers.shorter_than(t(spark, d, "documents").select("doc_id", "text"), "text", 200, lambda x: len(x.split(" "))).select("doc_id")


# --- metrics


@query(f"""WITH {_PRED_SQL}, c AS (SELECT quality AS class FROM p UNION SELECT pred2 FROM p), r AS (SELECT class, (SELECT count(*) FROM p WHERE quality = class) AS support,
    (SELECT count(*) FROM p WHERE pred2 = class) AS predicted, (SELECT count(*) FROM p WHERE quality = class AND pred2 = class) AS tp FROM c)
    SELECT class, support, predicted, tp, round(coalesce(tp / nullif(predicted, 0), 0.0), 6) AS precision, round(coalesce(tp / nullif(support, 0), 0.0), 6) AS recall, round(coalesce(2 * tp / nullif(support + predicted, 0), 0.0), 6) AS f1,
    round(100.0 * support / sum(support) OVER (), 6) AS share, round(coalesce(100.0 * tp / nullif(support, 0), 0.0), 6) AS accuracy FROM r""")
def class_table(spark, d):
    return metrics.class_table(_predicted(spark, d), "quality", "pred2")


@query("""SELECT lang, count(*) AS n, round(avg(n_chars), 6) AS n_chars, round(avg(CASE WHEN doc_id % 3 > 0 THEN doc_id END), 6) AS doc_id FROM documents GROUP BY lang""")
def group_means(spark, d):
    rows = t(spark, d, "documents").select("lang", "n_chars", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id")).alias("doc_id"))
    return metrics.group_means(rows, "lang", ["n_chars", "doc_id"])


@query(f"""WITH {_CHOICES_SQL} SELECT CAST(sum(CASE WHEN doc_id % 5 > 0 THEN len(ch) ELSE 0 END) AS BIGINT) AS total FROM c""")
def total_items(spark, d):
    return metrics.total_items(t(spark, d, "documents").select(F.when(F.col("doc_id") % 5 > 0, _choices()).alias("ch")), "ch")


# --- words as bits

_HASH = "('0x' || substr(md5({}), 17, 16))::UBIGINT"
_SIMHASH = (
    f"list_sum(list_transform(range(0, 64), lambda i: CASE WHEN len(ws) > 0 AND list_sum(list_transform(ws, lambda w: 2 * CAST(({_HASH.format('w')} >> i) & 1 AS INTEGER) - 1)) >= 0 THEN (1::HUGEINT << i) ELSE 0::HUGEINT END))"
)
_WORDS = "SELECT doc_id, source, list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '') AS ws FROM documents"
#: Words are counted first, as a long text says the same ones often.
_BITS = f"""w AS ({_WORDS}), c AS (SELECT doc_id, h, count(*) AS k FROM (SELECT doc_id, {_HASH.format('w')} AS h FROM (SELECT doc_id, unnest(ws) AS w FROM w)) GROUP BY ALL),
    s AS (SELECT doc_id, {', '.join(f'sum(k * (2 * CAST((h >> {i}) & 1 AS INTEGER) - 1)) AS b{i}' for i in range(64))} FROM c GROUP BY doc_id),
    u AS (SELECT doc_id, source, coalesce({' + '.join(f'CASE WHEN b{i} >= 0 THEN {1 << i}::HUGEINT ELSE 0 END' for i in range(64))}, 0) AS h FROM w LEFT JOIN s USING (doc_id))"""
SIGNED = "CAST(CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END AS BIGINT)"


@query(f"""WITH {_BITS} SELECT doc_id, {SIGNED} AS simhash FROM u""")
def simhash(spark, d):
    return t(spark, d, "documents").select("doc_id", arrays.simhash_of_texts(F.col("text")).alias("simhash"))


@query(f"""WITH {_BITS}, n AS (SELECT doc_id, h, lead(h) OVER (PARTITION BY source ORDER BY doc_id) AS g FROM u)
    SELECT doc_id, round(1 - bit_count(xor(h, g)) / 64.0, 6) AS similarity FROM n WHERE g IS NOT NULL""")
def hamming_pairs(spark, d):
    """Likeness of each document and the next one of its source. Rows are few and narrow by then, but a source is one window: ids are numbered by ranges instead."""
    rows = stored(t(spark, d, "documents").select("source", "doc_id", arrays.simhash_of_texts(F.col("text")).alias("h")))  # hashed once, as ranging reads its rows twice
    rows = readers.numbered_rows(rows, ["source", "doc_id"], "i")
    after = rows.select((F.col("i") - 1).alias("i"), "source", F.col("h").alias("g"))
    return rows.join(after, ["i", "source"]).select("doc_id", F.round(arrays.hamming_similarity(F.col("h"), F.col("g")), 6).alias("similarity"))


_ONE = _HASH.format("ch[{}]")


def _likeness(i: int) -> str:
    return f"CASE WHEN len(ch) >= {i} THEN 1 - bit_count(xor({_ONE.format(1)}, {_ONE.format(i)})) / 64.0 ELSE 0 END"


_EXTREME_SQL = "len(list_filter([{}], lambda w: contains(x, w))) > 0".format(", ".join(f"'{w}'" for w in features.EXTREME))


@query(f"""WITH {_CHOICES_SQL}, m AS (SELECT doc_id, list_transform(ch, lambda x, i: CASE WHEN i = doc_id % 3 + 1 THEN x || ' 항상' ELSE x END) AS said, ch FROM c),
    h AS (SELECT doc_id, ch, list_transform(said, lambda x: {_EXTREME_SQL}) AS hit FROM m)
    SELECT doc_id, round(greatest({', '.join(_likeness(i) for i in range(2, 6))}), 6) AS score, CAST(CASE WHEN NOT list_contains(hit, true) THEN NULL WHEN hit[1] THEN 1 ELSE 0 END AS INTEGER) AS extreme FROM h""")
def distractor_scores(spark, d):
    rows = t(spark, d, "documents").select("doc_id", _choices().alias("ch"))
    said = F.transform("ch", lambda x, i: F.when(i == F.col("doc_id") % 3, F.concat(x, F.lit(" 항상"))).otherwise(x))
    score = features.distractor_similarity(F.col("ch"), F.lit(1), features.simhash_similarity)
    return rows.select("doc_id", F.round(score, 6).alias("score"), features.extreme_flag(said, F.lit(1)).alias("extreme"))


@query(f"""WITH v AS (SELECT vec_id, list_cosine_similarity(embedding[1:32]::DOUBLE[], embedding[33:64]::DOUBLE[]) AS a, 1 - bit_count(xor({_HASH.format("'w' || vec_id % 7")}, {_HASH.format("'w' || vec_id % 5")})) / 64.0 AS b FROM embeddings)
    SELECT vec_id, round(greatest(a, b), 6) AS score FROM v""")
def hybrid_distractors(spark, d):
    word = lambda k: F.concat(F.lit("w"), (F.col("vec_id") % k).cast("string"))
    return t(spark, d, "embeddings").select("vec_id", F.round(features.hybrid_similarity(word(7), word(5), F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)), 6).alias("score"))


# --- prompts and patterns

_RANGE = "array_to_string(range(1, len(ch) + 1), ', ')"
_ASKED = f"text || chr(10) || chr(10) || lang || chr(10) || array_to_string(list_transform(ch, lambda x, i: i || ' - ' || x), chr(10)) || chr(10) || chr(10) || 'Answer with one of ' || {_RANGE} || '.'"


@query(f"""WITH {_CHOICES_SQL} SELECT doc_id, 'Think step by step, then end with `Answer: n`, n one of ' || {_RANGE} || '.' AS system, CASE WHEN length(lang) > 0 THEN chr(10) || lang ELSE '' END || chr(10) || {_ASKED} AS "user",
    'You answer multiple-choice questions with ' || len(ch) || ' choices from the passage. Reply with one of ' || {_RANGE} || ' and nothing else.' AS by_count FROM c""")
def prompt_messages(spark, d):
    rows = t(spark, d, "documents").select("doc_id", F.col("text").alias("passage"), F.col("lang").alias("question"), _choices().alias("ch"))
    of = lambda name: prompts.messages(name, F.col("passage"), F.col("question"), F.col("ch"), context=F.col("question"))
    rows = rows.select("doc_id", of("v10").alias("m"), of("v8").alias("n"))
    return rows.select("doc_id", F.col("m")[0]["content"].alias("system"), F.col("m")[1]["content"].alias("user"), F.col("n")[0]["content"].alias("by_count"))


@query(f"""WITH {_KEYS_SQL}, {_NORM_SQL}, r AS (SELECT key, (row_number() OVER (ORDER BY length(key) DESC, key) - 1) // 500 AS chunk FROM keys), p AS (SELECT string_agg(key, '|' ORDER BY length(key) DESC, key) AS pattern FROM r GROUP BY chunk)
    SELECT doc_id, unnest(regexp_extract_all(norm, pattern)) AS key FROM docs, p""")
def provenance_alternation(spark, d):
    from loomtext.plans.catalogue import _docs, _keys

    return match.alternation(_docs(spark, d), _keys(spark, d), "doc_id", "norm", 500)


@query()
def morpheme_counts(spark, d):
    """How many words of each document's runs of letters a dictionary knows: the 2,000 most frequent words of the benchmark, cheaper the more frequent they are. Held against all segmentations in the tests."""
    words = t(spark, d, "benchmark").select(F.explode(text.tokens(F.col("text"), "a-z")).alias("w")).groupBy("w").agg(F.count("*").alias("n")).where("length(w) BETWEEN 2 AND 12").orderBy(F.desc("n"), "w").limit(2000).collect()
    known = lattice.Dictionary.of([(r["w"], "W", 1.0 + 8.0 / (1 + r["n"])) for r in words], unknown=(2.0, 2.5))
    found = lattice.counted(t(spark, d, "documents"), "text", known, ["doc_id"], letters="a-z", other="0-9")
    known_word, stretch = F.col("m.tag") == "W", F.col("m.tag") == lattice.UNKNOWN
    per = found.select("doc_id", F.explode_outer("counts").alias("m")).groupBy("doc_id")
    n_where = lambda c: F.sum(F.when(c, F.col("m.n")).otherwise(0))
    return per.agg(n_where(known_word).alias("known"), n_where(stretch).alias("unknown"), F.count_distinct(F.when(known_word, F.col("m.form"))).alias("forms"))
