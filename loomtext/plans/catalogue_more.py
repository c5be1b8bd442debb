"""More named queries: parsing, answers, labels, stores, streams and smaller operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.functions import arrays, text
from loomtext.operators import context, features, folds, metrics, prompts
from loomtext.plans.catalogue import _CHOICES_SQL, _FOLD_SQL, _TOK, _choices, _folded, query, t
from loomtext.sources import readers, store
from loomtext.sources.scratch import new_folder
from loomtext.streaming import changelog


# --- parsing and values


@query("""SELECT doc_id, CASE WHEN doc_id % 10 <> 0 THEN lang END AS question, CASE WHEN doc_id % 10 <> 0 THEN 3 END AS n_choices, CAST(CASE WHEN doc_id % 10 <> 0 AND doc_id % 3 <> 0 THEN doc_id % 3 END AS INTEGER) AS answer FROM documents""")
def parse_problems(spark, d):
    answer = F.when(F.col("doc_id") % 3 == 0, "None").otherwise((F.col("doc_id") % 3).cast("string"))
    literal = F.concat(F.lit("{'question': '"), "lang", F.lit("', 'choices': ['a', \"b's\", 'c'], 'answer': "), answer, F.lit("}"))
    rows = t(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 10 == 0, "{broken").otherwise(literal).alias("problems"))
    rows = rows.select("doc_id", readers.parsed_problem(F.col("problems"), strict=False).alias("p"))
    return rows.select("doc_id", "p.question", F.when(F.col("p").isNotNull(), F.size("p.choices")).alias("n_choices"), "p.answer")


@query("""SELECT lang, count(*) AS n, count(v) AS n_known FROM (SELECT lang, CASE WHEN doc_id % 4 IN (0, 1, 2) THEN NULL ELSE source END AS v FROM documents) GROUP BY lang""")
def null_token_counts(spark, d):
    k = F.col("doc_id") % 4
    said = F.when(k == 0, " None ").when(k == 1, "").when(k == 2, "null").otherwise(F.concat(F.lit("  "), "source", F.lit("\n")))
    rows = t(spark, d, "documents").select("lang", text.null_tokens(said).alias("v"))
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.count("v").alias("n_known"))


@query("""SELECT CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' ELSE lang END AS language, count(*) AS n FROM documents GROUP BY 1""")
def value_mapping(spark, d):
    return t(spark, d, "documents").groupBy(text.mapped(F.col("lang"), {"en": "English", "fr": "French"}).alias("language")).agg(F.count("*").alias("n"))


@query("""SELECT doc_id, CAST(CASE WHEN doc_id % 2 = 0 THEN doc_id % 9 ELSE 0 END AS INTEGER) AS number FROM documents""")
def trailing_ids(spark, d):
    made = F.concat_ws("_", "doc_id", F.lit("p"), F.when(F.col("doc_id") % 2 == 0, (F.col("doc_id") % 9).cast("string")).otherwise("x"))
    return t(spark, d, "documents").select("doc_id", text.trailing_int(made).alias("number"))


@query("""SELECT doc_id, '{"doc_id":' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '' ELSE ',"n_chars":' || n_chars END || '}' AS record FROM documents""")
def json_records(spark, d):
    return t(spark, d, "documents").select("doc_id", F.to_json(F.struct("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("n_chars")).alias("n_chars"))).alias("record"))


@query("""SELECT page_id, CASE WHEN n < 1024 THEN format('{:,.1f} B', n / 1.0::DOUBLE) WHEN n < 1024 ** 2 THEN format('{:,.1f} KB', n / 1024.0::DOUBLE) ELSE format('{:,.1f} MB', n / (1024.0::DOUBLE * 1024)) END AS size
    FROM (SELECT page_id, strlen(html) * 64 AS n FROM pages)""")
def readable_sizes(spark, d):
    return t(spark, d, "pages").select("page_id", text.human_bytes(F.octet_length("html").cast("long") * 64).alias("size"))


@query("""SELECT doc_id, lang || ', ' || source AS choice, true AS tagged FROM documents""")
def combination_choices(spark, d):
    said = F.concat(F.lit("ㄱ. "), "lang", F.lit("  ㄴ) "), "source", F.lit("\nㄷ: x"))
    rows = t(spark, d, "documents").select("doc_id", said.alias("said"))
    return rows.select("doc_id", text.expanded_choice(F.lit("ㄱ, ㄴ"), text.combination_tags(F.col("said"))).alias("choice"), text.has_combination(F.col("said")).alias("tagged"))


@query(f"""WITH {_CHOICES_SQL} SELECT doc_id, CAST(coalesce(length(text), 0) + coalesce(length(lang), 0) + coalesce(list_sum(list_transform(ch, lambda x: length(x))), 0) AS BIGINT) AS n FROM c""")
def input_lengths(spark, d):
    rows = t(spark, d, "documents").select("doc_id", "text", "lang", _choices().alias("ch"))
    return rows.select("doc_id", text.input_length(F.col("text"), F.col("lang"), F.col("ch")).cast("long").alias("n"))


@query(f"""SELECT doc_id, len({_TOK.format('text')}) AS n FROM documents WHERE len({_TOK.format('text')}) <= 200""")
def token_length_filter(spark, d):
    return t(spark, d, "documents").select("doc_id", F.size(text.tokens(F.col("text"))).cast("long").alias("n")).where("n <= 200")


# --- plans, drafts, answers


@query("""SELECT doc_id, lang AS query, 5 AS top_k FROM documents WHERE doc_id % 5 <> 0 UNION ALL SELECT doc_id, '', CAST(doc_id % 9 AS INTEGER) FROM documents WHERE doc_id % 5 <> 0""")
def plan_requests(spark, d):
    plan = F.when(F.col("doc_id") % 5 == 0, "no plan").otherwise(F.concat(F.lit('[{"query":"'), "lang", F.lit('"},{"top_k":'), (F.col("doc_id") % 9).cast("string"), F.lit("}]")))
    return t(spark, d, "documents").select("doc_id", F.explode(context.requests_of(plan)).alias("r")).select("doc_id", "r.query", "r.top_k")


@query("""SELECT doc_id, CASE WHEN doc_id % 4 BETWEEN 1 AND 3 THEN CAST(doc_id % 4 AS VARCHAR) WHEN doc_id % 7 BETWEEN 1 AND 5 THEN CAST(doc_id % 7 AS VARCHAR) ELSE '0' END AS answer,
    '[DRAFT 1]' || chr(10) || 'Answer: ' || (doc_id % 7) || chr(10) || chr(10) || '[DRAFT 3]' || chr(10) || '정답: ' || (doc_id % 4) AS drafts FROM documents""")
def best_draft(spark, d):
    drafts = F.array(F.concat(F.lit("Answer: "), F.col("doc_id") % 7), F.lit(""), F.concat(F.lit("정답: "), F.col("doc_id") % 4))
    rows = t(spark, d, "documents").select("doc_id", drafts.alias("d"))
    return rows.select("doc_id", text.best_draft(F.col("d"), 5).alias("answer"), text.joined_drafts(F.col("d")).alias("drafts"))


@query("""SELECT doc_id, CAST(CASE WHEN doc_id % 15 + 5 >= 10 AND doc_id % 7 BETWEEN 1 AND 5 THEN doc_id % 7 END AS INTEGER) AS answer FROM documents""")
def constrained_answers(spark, d):
    said = F.concat(F.lit('{"reasoning":["'), F.repeat(F.lit("x"), (F.col("doc_id") % 15 + 5).cast("int")), F.lit('","yyyyyyyyyyyy"],"answer":'), (F.col("doc_id") % 7).cast("string"), F.lit("}"))
    return t(spark, d, "documents").select("doc_id", context.constrained_answer(said, 5).alias("answer"))


@query(f"""WITH {_CHOICES_SQL} SELECT doc_id, left(lang || chr(10) || array_to_string(list_transform(ch, lambda x, i: '(' || i || ') ' || x), ' ') || chr(10) || left(text, 600), 2500) AS query FROM c""")
def rerank_queries(spark, d):
    rows = t(spark, d, "documents").select("doc_id", "lang", "text", _choices().alias("ch"))
    return rows.select("doc_id", prompts.rerank_query(F.col("lang"), F.col("ch"), F.col("text")).alias("query"))


@query("""WITH g AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, round(value, 3) AS v FROM events) SELECT user_id, event_id, CASE WHEN i % 2 = 0 THEN v ELSE 0.0 END AS score FROM g""")
def score_attach(spark, d):
    from pyspark.sql.window import Window

    rows = t(spark, d, "events").select("user_id", "event_id", F.round("value", 3).alias("v"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("i"))
    answer = rows.where("i % 2 = 0").select("user_id", "i", F.col("v").alias("score"))
    beyond = rows.groupBy("user_id").agg((F.max("i") + 1).alias("i")).withColumn("score", F.lit(9.0))  # out of range: falls away
    return context.attached(rows.select("user_id", "event_id", "i"), answer.unionByName(beyond), ["user_id"], "i").select("user_id", "event_id", "score")


@query("""WITH s AS (SELECT page_id, page_id % 7 AS query_id, coalesce(nullif(CAST(page_id % 5 AS DOUBLE) / 4, 0), 0.5) AS score, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host FROM pages),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_id) AS INTEGER) AS rank FROM s) SELECT query_id, page_id, score, rank FROM r WHERE rank <= 10 AND (host = 'example.com' OR ends_with(host, '.example.com'))""")
def web_results(spark, d):
    score = context.web_score((F.col("page_id") % 5).cast("double") / 4, F.lit(0.5))
    rows = t(spark, d, "pages").select("page_id", (F.col("page_id") % 7).alias("query_id"), "url", score.alias("score"))
    return context.web_results(rows, "query_id", "page_id", "url", ["example.com"], 10).select("query_id", "page_id", "score", "rank")


# --- labels and scores


@query("""WITH i AS (SELECT doc_id, list_transform(range(0, 12), lambda i: (doc_id + i * i) % 5) AS ids FROM documents), e AS (SELECT *, CAST(coalesce(list_filter(range(1, 12), lambda i: ids[i] = 0 AND ids[i + 1] = 1)[1] + 1, 0) AS INTEGER) AS start FROM i)
    SELECT doc_id, start, list_transform(ids, lambda x, i: CASE WHEN i - 1 >= start THEN x ELSE -100 END) || [-100, -100, -100, -100] AS labels FROM e""")
def masked_labels(spark, d):
    rows = t(spark, d, "documents").select("doc_id", F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: (F.col("doc_id") + i * i) % 5).alias("ids"))
    pattern = F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))
    rows = rows.withColumn("start", arrays.subsequence_end(F.col("ids"), pattern))
    return rows.select("doc_id", "start", arrays.masked_labels(F.col("ids"), F.col("start"), F.lit(16)).alias("labels"))


@query("""WITH s AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT vec_id, CAST(list_position(v, list_max(v)) AS VARCHAR) AS pred, 65 AS n,
    list_transform(v, lambda x: round(x - ln(list_sum(list_transform(v, lambda y: exp(y)))), 5)) AS log_p FROM s""")
def logprob_decode(spark, d):
    by_token = F.create_map(*(x for i in range(1, 65) for x in (F.lit(str(i)), F.element_at("embedding", i).cast("double"))))
    rows = t(spark, d, "embeddings").select("vec_id", arrays.choice_logprobs(by_token, 65).alias("lp"))  # the last is missing: -infinity
    log_p = F.transform(arrays.log_softmax(F.slice("lp", 1, 64)), lambda v: F.round(v, 5))
    return rows.select("vec_id", arrays.argmax_label(F.col("lp")).alias("pred"), F.size("lp").alias("n"), log_p.alias("log_p"))


_COS = "list_cosine_similarity(embedding[1:16]::DOUBLE[], embedding[{}:{}]::DOUBLE[])"


@query(f"""SELECT vec_id, round(greatest({_COS.format(17, 32)}, {_COS.format(33, 48)}, {_COS.format(49, 64)}), 6) AS score FROM embeddings""")
def choice_similarity(spark, d):
    choices = F.array(*(F.slice("embedding", a, 16) for a in (1, 17, 33, 49)))
    return t(spark, d, "embeddings").select("vec_id", F.round(features.distractor_similarity(choices, F.lit(1), features.embedding_similarity), 6).alias("score"))


@query("""WITH r AS (SELECT n_chars, lang, min(n_chars) OVER () AS lo, max(n_chars) OVER () AS hi FROM documents) SELECT lang AS status, CAST(least(19, floor((n_chars - lo) * 20 / greatest(hi - lo, 1))) AS INTEGER) AS bin, count(*) AS n FROM r GROUP BY ALL""")
def length_histogram(spark, d):
    return metrics.histogram(t(spark, d, "documents").select("n_chars", "lang"), "n_chars", "lang", 20)


@query(f"""WITH {_FOLD_SQL} SELECT doc_id, CAST(k AS INTEGER) AS split, CASE WHEN fold = k THEN 'eval' ELSE 'train' END AS part FROM f, (SELECT unnest(range(5)) AS k)""")
def cv_splits(spark, d):
    return folds.cv_splits(_folded(spark, d).select("doc_id", "fold"), "fold", 5).select("doc_id", "split", "part")


# --- stores and streams


@query("""WITH k AS (SELECT user_id, event_type, event_id AS seq, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events WHERE event_type <> 'error'),
    g AS (SELECT user_id, max(event_id) AS gone FROM events WHERE event_type = 'error' GROUP BY user_id)
    SELECT user_id || ':' || event_type AS key, user_id, seq, value FROM k LEFT JOIN g USING (user_id) WHERE r = 1 AND (gone IS NULL OR seq > gone)""")
def changelog_by_parent(spark, d):
    e, bad = t(spark, d, "events"), F.col("event_type") == "error"
    log = e.select(F.when(~bad, F.concat_ws(":", "user_id", "event_type")).alias("key"), "user_id", F.col("event_id").alias("seq"), "value", F.lit(False).alias("_deleted"), bad.alias("_deleted_by_parent"))
    return store.replay(log, "key", "seq", parent="user_id").select("key", "user_id", "seq", "value")


@query("""SELECT user_id, seq, event_type, value FROM (SELECT user_id, event_id AS seq, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'error'""")
def changelog_stream(spark, d):
    """The same rows as changelog_replay, from micro-batches over a folder that the log is appended to (a file stream reads folders only)."""
    folder, e = new_folder(spark), t(spark, d, "events")
    records = e.select("user_id", F.col("event_id").alias("seq"), "event_type", "value", (F.col("event_type") == "error").alias("_deleted"))
    for part in range(2):
        readers.write_jsonl(records.where(F.pmod("seq", F.lit(2)) == part), f"{folder}/log", append=True)
    log = spark.readStream.schema(records.schema).option("maxFilesPerTrigger", 64).json(f"{folder}/log")
    changelog.follow(log, "user_id", "seq", f"{folder}/state", f"{folder}/progress").awaitTermination()
    return changelog.state(spark, f"{folder}/state", "user_id", "seq")


def _round_trip(spark, df: DataFrame, write, read) -> DataFrame:
    path = new_folder(spark)
    write(df, path)
    return read(spark, path, df._jdf.schema().toDDL())


@query("""SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def backup_restore(spark, d):
    rows = t(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    return _round_trip(spark, rows, store.backup, store.restore)


@query("""SELECT doc_id, lang, text FROM documents""")
def csv_round_trip(spark, d):
    return _round_trip(spark, t(spark, d, "documents").select("doc_id", "lang", "text"), readers.write_csv, readers.csv)
