"""Named queries over the test tables, each with the same in DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtext.functions import arrays, text
from loomtext.operators import chunking, context, features, folds, index, match, metrics, prompts, search
from loomtext.sources import readers, store
from loomtext.sources.scratch import new_folder, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


NORM = "regexp_replace(coalesce({}, ''), '[^0-9A-Za-z가-힣]', '', 'g')"
N_TEXT = NORM.format("text")
#: Characters of an anchor.
ANCHOR = 50


# --- text


@query(f"""SELECT source, count(*) AS n, round(avg(k), 6) AS mean_len, round(stddev_samp(k), 6) AS std_len, min(k) AS min_len, max(k) AS max_len
    FROM (SELECT source, length({N_TEXT}) AS k FROM documents) GROUP BY source""")
def norm_text_stats(spark, d):
    k = F.length(text.norm_text(F.col("text"))).alias("k")
    return t(spark, d, "documents").select("source", k).groupBy("source").agg(
        F.count("*").alias("n"), F.round(F.avg("k"), 6).alias("mean_len"), F.round(F.stddev_samp("k"), 6).alias("std_len"), F.min("k").cast("long").alias("min_len"), F.max("k").cast("long").alias("max_len"))


@query(f"""SELECT doc_id, left(k, 40) AS head, substr(k, greatest(0, length(k) // 2 - 20) + 1, 40) AS mid, right(k, 40) AS tail FROM (SELECT doc_id, {N_TEXT} AS k FROM documents)""")
def anchor_views(spark, d):
    head, mid, tail = text.anchors(F.col("k"), 40)
    return t(spark, d, "documents").select("doc_id", text.norm_text(F.col("text")).alias("k")).select("doc_id", head.alias("head"), mid.alias("mid"), tail.alias("tail"))


@query("""SELECT item_id, CASE WHEN p > 0 THEN trim(left(text, p), E' \\n\\t\\r') ELSE trim(text, E' \\n\\t\\r') END AS question, CASE WHEN p > 0 THEN trim(substr(text, p + 1), E' \\n\\t\\r') ELSE '' END AS passage
    FROM (SELECT item_id, replace(text, '.', '?') AS text, instr(replace(text, '.', '?'), '?') AS p FROM benchmark)""")
def question_split(spark, d):
    q, p = text.question_and_passage(F.replace("text", F.lit("."), F.lit("?")))
    return t(spark, d, "benchmark").select("item_id", q.alias("question"), p.alias("passage"))


@query("""SELECT doc_id, CASE WHEN length(text) > 80 THEN left(text, 80) || '...' ELSE text END AS short, left(replace(text, chr(10), ' '), 2500) AS for_embedding FROM documents""")
def text_previews(spark, d):
    return t(spark, d, "documents").select("doc_id", text.ellipsis(F.col("text"), 80).alias("short"), text.for_embedding(F.col("text")).alias("for_embedding"))


# --- provenance


def _keys(spark, d) -> DataFrame:
    rows = t(spark, d, "benchmark").select(text.norm_text(F.col("text")).alias("k"))
    return match.keys_of(rows.select(F.left("k", F.lit(ANCHOR)).alias("k")), "k", 20)


def _docs(spark, d, *more: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", *more, text.norm_text(F.col("text")).alias("norm"))


_KEYS_SQL = f"keys AS (SELECT DISTINCT left({N_TEXT}, {ANCHOR}) AS key FROM benchmark WHERE length(left({N_TEXT}, {ANCHOR})) >= 20)"
_NORM_SQL = f"docs AS (SELECT doc_id, source, lang, {N_TEXT} AS norm FROM documents)"


@query(f"""WITH {_KEYS_SQL}, {_NORM_SQL} SELECT source, count(DISTINCT doc_id) AS docs, count(*) AS hits, count(DISTINCT key) AS n_keys FROM docs JOIN keys ON contains(norm, key) GROUP BY source""")
def provenance_containment(spark, d):
    found = match.containment(_docs(spark, d, "source"), _keys(spark, d), "doc_id", "norm", "source")
    return found.groupBy("source").agg(F.count_distinct("doc_id").alias("docs"), F.count("*").alias("hits"), F.count_distinct("key").alias("n_keys"))


@query(f"""WITH {_KEYS_SQL}, {_NORM_SQL} SELECT DISTINCT doc_id, key FROM docs JOIN keys ON contains(norm, key)""")
def provenance_nested(spark, d):
    return match.nested_containment(_docs(spark, d), _keys(spark, d), "doc_id", "norm")


_SPLIT_SQL = "(SELECT CASE WHEN p > 0 THEN left(x, p) ELSE x END AS question, CASE WHEN p > 0 THEN substr(x, p + 1) ELSE '' END AS passage FROM (SELECT replace(text, '.', '?') AS x, instr(replace(text, '.', '?'), '?') AS p FROM benchmark))"


@query(f"""WITH k AS (SELECT {NORM.format('passage')} AS key, 0 AS kind FROM {_SPLIT_SQL} UNION SELECT {NORM.format('question')}, 1 FROM {_SPLIT_SQL}), {_NORM_SQL},
    m AS (SELECT doc_id, kind, key, row_number() OVER (PARTITION BY doc_id ORDER BY kind, length(key) DESC, key) AS r FROM docs JOIN k ON contains(norm, key) WHERE length(key) >= 20)
    SELECT doc_id, kind, key FROM m WHERE r = 1""")
def provenance_longest_match(spark, d):
    """Whole passages, then whole questions (here: what follows the first sentence, and that sentence)."""
    question, passage = text.question_and_passage(F.replace("text", F.lit("."), F.lit("?")))
    rows = t(spark, d, "benchmark").select(text.norm_text(question).alias("q"), text.norm_text(passage).alias("p"))
    keys = rows.select(F.col("p").alias("key"), F.lit(0).alias("kind")).unionByName(rows.select(F.col("q").alias("key"), F.lit(1).alias("kind"))).distinct()
    return match.longest_match(_docs(spark, d), keys.where(F.length("key") >= 20), "doc_id", "norm")


@query(f"""WITH {_KEYS_SQL}, {_NORM_SQL}, c AS (SELECT key, source, count(*) AS n, min(doc_id) AS first FROM docs JOIN keys ON contains(norm, key) GROUP BY key, source)
    SELECT key, source FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, first, source DESC) AS r FROM c) WHERE r = 1""")
def provenance_majority(spark, d):
    found = match.containment(_docs(spark, d, "source"), _keys(spark, d), "doc_id", "norm", "source")
    return match.majority(found, "key", "source", "doc_id")


@query(f"""WITH {_NORM_SQL}, lk AS (SELECT left(norm, 40) AS key, min(source) AS label FROM docs WHERE length(norm) >= 40 GROUP BY 1),
    q AS (SELECT doc_id, left(norm, 40) AS head, substr(norm, greatest(0, length(norm) // 2 - 20) + 1, 40) AS mid, right(norm, 40) AS tail FROM docs)
    SELECT doc_id, coalesce(a.label, b.label, c.label) AS label FROM q LEFT JOIN lk a ON head = a.key LEFT JOIN lk b ON mid = b.key LEFT JOIN lk c ON tail = c.key""")
def provenance_coalesced(spark, d):
    """Texts are normalised once, and only their anchors are kept."""
    head, mid, tail = text.anchors(F.col("norm"), 40)
    rows = stored(_docs(spark, d, "source").select("doc_id", "source", F.length("norm").alias("n"), head.alias("head"), mid.alias("mid"), tail.alias("tail")))
    lookup = stored(rows.where("n >= 40").groupBy(F.col("head").alias("key")).agg(F.min("source").alias("label")))
    return match.coalesced_lookup(rows.drop("source", "n"), lookup, ["head", "mid", "tail"], "label", "found").select("doc_id", F.col("found").alias("label"))


@query(f"""WITH d AS (SELECT doc_id, {N_TEXT} AS norm, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)),
    f AS (SELECT norm, arg_min(quality, doc_id) AS q, arg_min(toxic, doc_id) AS x FROM d WHERE quality IS NOT NULL GROUP BY norm)
    SELECT doc_id, coalesce(quality, q) AS quality, coalesce(toxic, x) AS toxic FROM d LEFT JOIN f USING (norm)""")
def label_propagation(spark, d):
    rows = _docs(spark, d).join(t(spark, d, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    return match.propagate(rows, "norm", ["quality", "toxic"], "doc_id").select("doc_id", "quality", "toxic")


@query("""SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1""")
def keep_first_copy(spark, d):
    rows = t(spark, d, "documents").select("doc_id", "source", F.sha2(F.col("text").cast("binary"), 256).alias("text"))
    return match.keep_first(rows, ["text"], F.col("doc_id")).select("doc_id", "source")


# --- folds


@query("""SELECT doc_id, CAST(dense_rank() OVER (ORDER BY text) - 1 AS BIGINT) AS group_id FROM documents""")
def group_id_dense(spark, d):
    return folds.dense_ids(t(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "group_id")


@query("""SELECT left(min(text), 60) AS passage, min(doc_id) AS first_id, count(*) AS sample_count, count(DISTINCT source) AS n_sources FROM documents GROUP BY text ORDER BY sample_count DESC, first_id LIMIT 10""")
def duplicate_groups_top10(spark, d):
    rows = t(spark, d, "documents").select("doc_id", "source", F.left("text", F.lit(60)).alias("passage"), F.sha2(F.col("text").cast("binary"), 256).alias("text"))
    per = rows.groupBy("text").agg(F.min("passage").alias("passage"), F.min("doc_id").alias("first_id"), F.count("*").alias("sample_count"), F.count_distinct("source").alias("n_sources"))
    return per.drop("text").orderBy(F.desc("sample_count"), "first_id").limit(10)


_BINS_SQL = "e AS (SELECT list_sort(list_distinct(quantile_cont(n_chars, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS e FROM documents)"


@query(f"""WITH {_BINS_SQL} SELECT doc_id, CAST(len(list_filter(e[2:-2], lambda x: x < n_chars)) AS INTEGER) AS para_len_bin FROM documents, e""")
def length_quantile_bins(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "n_chars")
    return docs.select("doc_id", folds.quantile_bin(F.col("n_chars"), folds.quantile_edges(docs, "n_chars")).cast("int").alias("para_len_bin"))


_FOLD_SQL = "f AS (SELECT *, CAST((row_number() OVER (PARTITION BY lang ORDER BY md5('fold:' || doc_id), doc_id) - 1) % 5 AS INTEGER) AS fold FROM documents)"


def _folded(spark, d, *more: str) -> DataFrame:
    """doc_id, lang, further columns and `fold`: in turn within each language."""
    return folds.dealt(t(spark, d, "documents").select("doc_id", "lang", *more), "lang", "doc_id", "fold", 5)


@query("""WITH q AS (SELECT doc_id, 3 + doc_id % 3 AS n_options FROM documents)
    SELECT doc_id, n_options, (row_number() OVER (PARTITION BY n_options ORDER BY md5('answers:' || doc_id), doc_id) - 1) % n_options + 1 AS target FROM q""")
def fold_round_robin(spark, d):
    rows = t(spark, d, "documents").select("doc_id", (3 + F.col("doc_id") % 3).alias("n_options"))
    return folds.balanced_targets(rows, "n_options", "doc_id", "answers")


@query("""WITH i AS (SELECT doc_id, row_number() OVER (ORDER BY md5('quota:' || doc_id), doc_id) - 1 AS i FROM documents WHERE lang = 'es'), v AS (SELECT *, ((i - 3) % 5 + 5) % 5 AS v FROM i)
    SELECT doc_id, CAST(CASE WHEN i < 3 THEN 3 WHEN v = 3 THEN 4 ELSE v END AS INTEGER) AS fold FROM v""")
def fold_quota(spark, d):
    return folds.quota(t(spark, d, "documents").where("lang = 'es'").select("doc_id"), "doc_id", 3, 3, 5, "quota")


@query(f"""WITH {_FOLD_SQL} SELECT min(doc_id) AS first_id, list_sort(list(DISTINCT fold)) AS folds, count(DISTINCT fold) AS fold_count, count(*) AS sample_count FROM f GROUP BY text HAVING count(DISTINCT fold) > 1""")
def fold_group_leakage(spark, d):
    texts = t(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text"))
    groups = folds.leaking_groups(_folded(spark, d).join(texts, "doc_id"), "text", "fold")
    return groups.join(texts.groupBy("text").agg(F.min("doc_id").alias("first_id")), "text").drop("text")


@query(f"""WITH {_FOLD_SQL} SELECT fold, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'es') AS es, count(*) FILTER (lang = 'fr') AS fr FROM f GROUP BY fold""")
def fold_pivot(spark, d):
    return _folded(spark, d).groupBy("fold").pivot("lang", ["de", "en", "es", "fr"]).count().na.fill(0)


@query(f"""WITH {_FOLD_SQL} SELECT fold, count(*) AS n, round(avg(n_chars), 4) AS mean, round(stddev_samp(n_chars), 4) AS std, min(n_chars) AS min, max(n_chars) AS max,
    count(*) FILTER (lang = 'es') AS n_es FROM f GROUP BY fold""")
def fold_length_stats(spark, d):
    c = F.col("n_chars")
    return _folded(spark, d, "n_chars").groupBy("fold").agg(F.count("*").alias("n"), F.round(F.avg(c), 4).alias("mean"), F.round(F.stddev_samp(c), 4).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"), F.count_if(F.col("lang") == "es").alias("n_es"))


@query()
def stratified_group_kfold(spark, d):
    rows = t(spark, d, "documents").select("doc_id", F.xxhash64("text").alias("group_id"), "lang").join(t(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    rows = rows.withColumn("strat_label", F.concat_ws("_", "lang", "quality"))
    return rows.join(folds.stratified_group_folds(rows, "group_id", "strat_label", 5, "kfold"), "group_id")


@query(f"""WITH RECURSIVE {_FOLD_SQL}, g AS (SELECT source, count(*) AS n, count(*) FILTER (lang = 'es') AS t FROM f GROUP BY source HAVING t > 0),
    o AS (SELECT *, row_number() OVER (ORDER BY n DESC, t DESC, source) AS i FROM g), l AS (SELECT fold, count(*) FILTER (lang = 'es') AS t FROM f GROUP BY fold),
    r(i, have, best, source) AS (SELECT 0::BIGINT, (SELECT list(coalesce(t, 0) ORDER BY k) FROM range(5) k(k) LEFT JOIN l ON l.fold = k), -1::BIGINT, ''
        UNION ALL SELECT o.i, list_transform(have, lambda x, j: CASE WHEN j = list_position(have, list_min(have)) THEN x + o.t ELSE x END), list_position(have, list_min(have)) - 1, o.source FROM r JOIN o ON o.i = r.i + 1)
    SELECT doc_id, lang, f.source, CAST(coalesce(r.best, fold) AS INTEGER) AS fold FROM f LEFT JOIN (FROM r WHERE i > 0) r ON f.source = r.source""")
def least_loaded_groups(spark, d):
    rows = _folded(spark, d, "source")
    return folds.least_loaded(rows, "source", "fold", F.col("lang") == "es", 5)


@query(f"""WITH {_FOLD_SQL} SELECT doc_id, CASE WHEN fold = 3 THEN 'eval' ELSE 'train' END AS part FROM f""")
def train_eval_split(spark, d):
    train, held = folds.split(_folded(spark, d), "fold", 3)
    return train.select("doc_id", F.lit("train").alias("part")).unionByName(held.select("doc_id", F.lit("eval").alias("part")))


# --- metrics


def _predicted(spark, d) -> DataFrame:
    """Labels, and two made-up models."""
    docs = t(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    one = F.when(F.col("doc_id") % 7 == 0, 1 - F.col("quality")).otherwise(F.col("quality"))
    two = F.when(F.col("n_chars") % 5 == 0, F.lit(2)).otherwise(F.col("quality"))
    return t(spark, d, "labels").join(docs, "doc_id").select("doc_id", "lang", "source", "n_chars", "quality", one.cast("int").alias("pred1"), two.cast("int").alias("pred2"))


_PRED_SQL = """p AS (SELECT doc_id, lang, source, n_chars, quality, CAST(CASE WHEN doc_id % 7 = 0 THEN 1 - quality ELSE quality END AS INTEGER) AS pred1,
    CAST(CASE WHEN n_chars % 5 = 0 THEN 2 ELSE quality END AS INTEGER) AS pred2 FROM labels JOIN documents USING (doc_id))"""
_REPORT_SQL = f"""{_PRED_SQL}, c AS (SELECT quality AS class FROM p UNION SELECT pred2 FROM p), r AS (SELECT class, (SELECT count(*) FROM p WHERE quality = class) AS support,
    (SELECT count(*) FROM p WHERE pred2 = class) AS predicted, (SELECT count(*) FROM p WHERE quality = class AND pred2 = class) AS tp FROM c)"""


@query(f"""WITH {_REPORT_SQL} SELECT class, support, predicted, tp, round(coalesce(tp / nullif(predicted, 0), 0.0), 6) AS precision, round(coalesce(tp / nullif(support, 0), 0.0), 6) AS recall,
    round(coalesce(2 * tp / nullif(support + predicted, 0), 0.0), 6) AS f1 FROM r""")
def classification_report(spark, d):
    return metrics.report(_predicted(spark, d), "quality", "pred2")


@query(f"""WITH {_REPORT_SQL} SELECT round(avg(coalesce(2 * tp / nullif(support + predicted, 0), 0.0)), 6) AS macro_f1, count(*) AS classes FROM r""")
def macro_f1(spark, d):
    return metrics.macro_f1(_predicted(spark, d), "quality", "pred2")


@query(f"""WITH {_PRED_SQL} SELECT quality AS true, pred2 AS pred, count(*) AS n FROM p GROUP BY ALL""")
def confusion_matrix(spark, d):
    return metrics.confusion(_predicted(spark, d), "quality", "pred2")


@query(f"""WITH {_PRED_SQL}, a AS (SELECT quality AS class, 100.0 * count(*) / sum(count(*)) OVER () AS s FROM p GROUP BY 1), b AS (SELECT pred2 AS class, 100.0 * count(*) / sum(count(*)) OVER () AS s FROM p GROUP BY 1)
    SELECT class, round(coalesce(a.s, 0), 6) AS true_share, round(coalesce(b.s, 0), 6) AS pred_share, round(coalesce(b.s, 0) - coalesce(a.s, 0), 6) AS bias FROM a FULL JOIN b USING (class)""")
def position_bias(spark, d):
    return metrics.position_bias(_predicted(spark, d), "quality", "pred2")


_OK = "coalesce(quality = pred1, false)"


@query(f"""WITH {_PRED_SQL} SELECT lo || '~' || (lo + 500) AS bin, lo, count(*) AS n, round(avg(n_chars), 6) AS mean_length, count(*) FILTER ({_OK}) AS n_correct, round(100.0 * count(*) FILTER ({_OK}) / count(*), 6) AS rate
    FROM (SELECT *, CAST(floor(n_chars / 500) * 500 AS BIGINT) AS lo FROM p) GROUP BY lo""")
def length_bin_accuracy(spark, d):
    return metrics.length_bins(_predicted(spark, d), "n_chars", metrics.correct(F.col("quality"), F.col("pred1")), 500)


@query(f"""WITH {_PRED_SQL} SELECT lang, count(*) AS n, round(100.0 * avg(CASE WHEN {_OK} THEN 1 ELSE 0 END), 6) AS accuracy FROM p GROUP BY lang""")
def category_accuracy(spark, d):
    return metrics.accuracy(_predicted(spark, d), metrics.correct(F.col("quality"), F.col("pred1")), "lang")


_SET_SQL = "CASE WHEN quality = pred1 AND quality = pred2 THEN 'both' WHEN quality = pred1 THEN 'only_1' WHEN quality = pred2 THEN 'only_2' ELSE 'neither' END"


@query(f"""WITH {_PRED_SQL} SELECT doc_id, {_SET_SQL} AS part FROM p""")
def model_compare_sets(spark, d):
    return _predicted(spark, d).select("doc_id", metrics.compare(metrics.correct(F.col("quality"), F.col("pred1")), metrics.correct(F.col("quality"), F.col("pred2"))).alias("part"))


@query(f"""WITH {_PRED_SQL} SELECT CAST(floor(n_chars / 500) * 500 AS BIGINT) AS lo, count(*) AS n, round(100.0 * avg((quality = pred1)::INT), 6) AS rate_1, round(100.0 * avg((quality = pred2)::INT), 6) AS rate_2 FROM p GROUP BY lo""")
def model_compare_bins(spark, d):
    rows = _predicted(spark, d)
    one, two = (metrics.length_bins(rows, "n_chars", metrics.correct(F.col("quality"), F.col(c)), 500).select("lo", "n", F.col("rate").alias(r)) for c, r in (("pred1", "rate_1"), ("pred2", "rate_2")))
    return one.join(two.drop("n"), "lo", "full_outer").na.fill(0.0, ["rate_1", "rate_2"])


@query("""SELECT * FROM (SELECT 'c_mktsegment' AS "column", count(DISTINCT c_mktsegment) AS n_distinct FROM customer UNION ALL SELECT 'c_nationkey', count(DISTINCT c_nationkey) FROM customer
    UNION ALL SELECT 'c_name', count(DISTINCT c_name) FROM customer UNION ALL SELECT 'c_acctbal', count(DISTINCT c_acctbal) FROM customer) WHERE n_distinct < 50""")
def low_cardinality_columns(spark, d):
    return metrics.low_cardinality(t(spark, d, "customer"), ("c_custkey",))


@query("""SELECT 'o_orderkey' AS "column", count(*) FILTER (o_orderkey IS NULL) AS n_missing FROM orders UNION ALL SELECT 'o_comment', count(*) FILTER (c IS NULL) FROM (SELECT nullif(o_orderpriority, '1-URGENT') AS c FROM orders)
    UNION ALL SELECT 'o_totalprice', count(*) FILTER (o_totalprice IS NULL) FROM orders""")
def missing_profile(spark, d):
    return metrics.missing_profile(t(spark, d, "orders").select("o_orderkey", F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("o_comment"), "o_totalprice"))


@query(f"""WITH {_PRED_SQL} SELECT doc_id, lang, quality, pred1 FROM p WHERE NOT {_OK} ORDER BY doc_id OFFSET 10 LIMIT 10""")
def error_page(spark, d):
    rows = _predicted(spark, d).where(~metrics.correct(F.col("quality"), F.col("pred1"))).select("doc_id", "lang", "quality", "pred1")
    return metrics.page(rows, [F.col("doc_id")], 2, 10)


@query("""SELECT lang, coalesce(source, '?') AS source, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share FROM documents GROUP BY ALL""")
def value_shares(spark, d):
    docs = t(spark, d, "documents")
    return docs.groupBy("lang", F.coalesce("source", F.lit("?")).alias("source")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(docs.agg(F.count("*").alias("all")))).select("lang", "source", "n", F.round(F.col("n") / F.col("all") * 100, 6).alias("share"))


# --- search


_QUERIES_SQL = "q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 20 = 0)"


def _vector_queries(spark, d) -> DataFrame:
    return t(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _knn_sql(where: str) -> str:
    return f"""WITH {_QUERIES_SQL}, s AS (SELECT query_id, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]), 6) AS score FROM embeddings, q WHERE {where}),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 5"""


@query(_knn_sql("true"))
def knn_topk(spark, d):
    return search.knn(t(spark, d, "embeddings"), _vector_queries(spark, d), 5)


@query(_knn_sql("label = 3"))
def knn_filtered(spark, d):
    return search.knn(t(spark, d, "embeddings").where("label = 3"), _vector_queries(spark, d), 5)


def _text_queries(spark, d) -> DataFrame:
    return t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


_TOK = "list_filter(string_split_regex(lower({}), '[^0-9a-z가-힣]+'), lambda x: x <> '')"
_BM25_SQL = f"""qt AS (SELECT DISTINCT item_id AS query_id, unnest({_TOK.format('text')}) AS term FROM benchmark),
    dt AS (SELECT doc_id, {_TOK.format('text')} AS ts FROM documents), st AS (SELECT count(*) AS n_docs, avg(len(ts)) AS avg_len FROM dt),
    po AS (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM dt), tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM po WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    sc AS (SELECT query_id, doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avg_len))), 6) AS score FROM tf JOIN df USING (term) JOIN qt USING (term), st GROUP BY ALL),
    bm AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM sc)"""


@query(f"""WITH {_BM25_SQL} SELECT query_id, doc_id, score, rank FROM bm WHERE rank <= 10""")
def bm25_topk(spark, d):
    return search.bm25(t(spark, d, "documents"), _text_queries(spark, d), {"text": 1.0}, 10)


def _lists(spark, d) -> list[DataFrame]:
    """Two rankings of documents within their source: by length, and by a hash."""
    docs = t(spark, d, "documents")
    a = search.top(docs.select("source", "doc_id", F.col("n_chars").cast("double").alias("score")), "source", [F.desc("score"), F.col("doc_id")], 50)
    b = search.top(docs.select("source", "doc_id", (F.col("doc_id") * 7919 % 1009).cast("double").alias("score")), "source", [F.desc("score"), F.col("doc_id")], 50)
    return [a, b]


_LISTS_SQL = """a AS (SELECT * FROM (SELECT source, doc_id, CAST(n_chars AS DOUBLE) AS score, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 50),
    b AS (SELECT * FROM (SELECT source, doc_id, CAST(doc_id * 7919 % 1009 AS DOUBLE) AS score, row_number() OVER (PARTITION BY source ORDER BY doc_id * 7919 % 1009 DESC, doc_id) AS rank FROM documents) WHERE rank <= 50)"""


def _fused_sql(wa: str, wb: str, digits: int) -> str:
    return f"""WITH {_LISTS_SQL}, p AS (SELECT source, doc_id, {wa} AS s FROM a UNION ALL SELECT source, doc_id, {wb} FROM b), f AS (SELECT source, doc_id, round(sum(s), {digits}) AS score FROM p GROUP BY ALL),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM f) SELECT source, doc_id, score, rank FROM r WHERE rank <= 10"""


@query(_fused_sql("1.0::DOUBLE / (60 + rank)", "1.0::DOUBLE / (60 + rank)", 9))
def rrf_fusion(spark, d):
    return search.rrf(_lists(spark, d), "source", "doc_id", 10)


_SCALED = "CASE WHEN max(score) OVER (PARTITION BY source) > min(score) OVER (PARTITION BY source) THEN (score - min(score) OVER (PARTITION BY source)) / (max(score) OVER (PARTITION BY source) - min(score) OVER (PARTITION BY source)) ELSE 1.0 END"


@query(_fused_sql(f"2.0 * ({_SCALED})", f"0.5 * ({_SCALED})", 6))
def minmax_fusion(spark, d):
    return search.minmax(_lists(spark, d), "source", "doc_id", 10, [2.0, 0.5])


@query(_fused_sql("0.7::DOUBLE / (60 + rank)", "0.3::DOUBLE / (60 + rank)", 9))
def weighted_ensemble(spark, d):
    return search.rrf(_lists(spark, d), "source", "doc_id", 10, weights=[0.7, 0.3])


_CHUNKS_SQL = "ch AS (SELECT doc_id || '_' || i AS chunk_id, doc_id, CAST(i AS INTEGER) AS chunk_idx, substr(text, i * 400 + 1, 400) AS chunk_text FROM (SELECT *, unnest(range(0, (greatest(length(text), 1) - 1) // 400 + 1)) AS i FROM documents WHERE length(text) > 0))"


def _chunks(spark, d) -> DataFrame:
    rows = t(spark, d, "documents").select("doc_id", F.posexplode(chunking.fixed(F.col("text"), 400)).alias("chunk_idx", "chunk_text"))
    return rows.select(F.concat_ws("_", "doc_id", "chunk_idx").alias("chunk_id"), "doc_id", "chunk_idx", "chunk_text")


@query(f"""WITH {_CHUNKS_SQL} SELECT * FROM ch""")
def chunk_fixed(spark, d):
    return _chunks(spark, d)


@query(f"""WITH {_BM25_SQL}, st1 AS (SELECT query_id, doc_id FROM bm WHERE rank <= 3), {_CHUNKS_SQL},
    ct AS (SELECT query_id, chunk_id, doc_id, len(list_intersect({_TOK.format('chunk_text')}, (SELECT list(term) FROM qt WHERE qt.query_id = st1.query_id))) AS score FROM ch JOIN st1 USING (doc_id)),
    cr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ct), c20 AS (SELECT * FROM cr WHERE rank <= 20),
    fi AS (SELECT query_id, doc_id, CAST(min(rank) AS INTEGER) AS hit_rank FROM c20 GROUP BY ALL), o AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY hit_rank, doc_id) AS INTEGER) AS rank FROM fi)
    SELECT query_id, doc_id, hit_rank, rank, length(text) AS parent_chars FROM o JOIN documents USING (doc_id) WHERE rank <= 2""")
def two_stage_retrieval(spark, d):
    queries, docs = _text_queries(spark, d), t(spark, d, "documents")
    parents = search.bm25(docs, queries, {"text": 1.0}, 3).select("query_id", "doc_id")
    asked = queries.select("query_id", F.array_distinct(text.tokens(F.col("query"))).alias("terms"))
    hits = search.chunk_hits(_chunks(spark, d), asked, parents, 20)
    out = search.parents_of(hits, docs, "query_id", "doc_id", "text", 2)
    return out.select("query_id", "doc_id", "hit_rank", "rank", F.length("text").cast("long").alias("parent_chars"))


@query(f"""WITH {_BM25_SQL}, st1 AS (SELECT query_id, doc_id FROM bm WHERE rank <= 3 AND query_id % 3 > 0), {_CHUNKS_SQL},
    ct AS (SELECT doc_id, chunk_id, list_distinct({_TOK.format('chunk_text')}) AS ts FROM ch), cu AS (SELECT doc_id, chunk_id, unnest(ts) AS term FROM ct),
    sh AS (SELECT query_id, doc_id, chunk_id, CAST(count(*) AS DOUBLE) AS score FROM cu JOIN qt USING (term) GROUP BY ALL),
    al AS (SELECT query_id, doc_id, chunk_id, coalesce(score, 0.0) AS score FROM st1 JOIN ch USING (doc_id) LEFT JOIN sh USING (query_id, doc_id, chunk_id)
        UNION ALL SELECT query_id, doc_id, chunk_id, score FROM sh WHERE query_id NOT IN (SELECT query_id FROM st1)),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM al) SELECT query_id, doc_id, chunk_id, score, rank FROM r WHERE rank <= 20""")
def chunk_search_open(spark, d):
    """Every third query has no parents, and so all chunks."""
    queries, docs = _text_queries(spark, d), t(spark, d, "documents")
    parents = search.bm25(docs, queries.where("query_id % 3 > 0"), {"text": 1.0}, 3).select("query_id", "doc_id")
    asked = queries.select("query_id", F.array_distinct(text.tokens(F.col("query"))).alias("terms"))
    return search.chunk_hits(_chunks(spark, d), asked, parents, 20)


@query(f"""WITH {_BM25_SQL}, u AS (SELECT 'benchmark' AS asker, query_id, doc_id, score, rank FROM bm WHERE rank <= 10),
    q2 AS (SELECT DISTINCT conv_id AS query_id, unnest({_TOK.format('text')}) AS term FROM conversations WHERE turn = 0),
    tf2 AS (SELECT doc_id, dl, term, count(*) AS tf FROM po WHERE term IN (SELECT term FROM q2) GROUP BY ALL), df2 AS (SELECT term, count(*) AS df FROM tf2 GROUP BY term),
    sc2 AS (SELECT query_id, doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avg_len))), 6) AS score FROM tf2 JOIN df2 USING (term) JOIN q2 USING (term), st GROUP BY ALL),
    bm2 AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM sc2)
    FROM u UNION ALL SELECT 'conversations' AS asker, query_id, doc_id, score, rank FROM bm2 WHERE rank <= 10""")
def bm25_stored_index(spark, d):
    """An index of all terms, written once, read again, and asked by two tables of queries."""
    path = new_folder(spark)
    index.build(t(spark, d, "documents"), "text", "doc_id", path=path)
    own = index.read(spark, path)
    first = t(spark, d, "conversations").where("turn = 0").select(F.col("conv_id").alias("query_id"), F.col("text").alias("query"))
    hits = []
    for asker, queries in (("benchmark", _text_queries(spark, d)), ("conversations", first)):
        asked = queries.select("query_id", F.array_distinct(text.tokens(F.col("query"))).alias("terms"))
        hits.append(search.bm25_indexed({"text": (own, 1.0)}, asked, 10).select(F.lit(asker).alias("asker"), F.col("query_id").cast("long").alias("query_id"), "doc_id", "score", "rank"))
    return hits[0].unionByName(hits[1])


# --- context


def _groups(spark, d) -> DataFrame:
    """Ranked documents: of each user, groups by event type, contents that repeat."""
    e = t(spark, d, "events")
    w = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    return e.select("user_id", "event_type", F.row_number().over(w).alias("rank"), F.concat(F.lit("c"), F.col("event_id") % 40).alias("content"), F.round("value", 3).alias("score"))


_GROUPS_SQL = "g AS (SELECT user_id, event_type, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS INTEGER) AS rank, 'c' || (event_id % 40) AS content, round(value, 3) AS score FROM events)"


@query(f"""WITH {_GROUPS_SQL}, p AS (SELECT *, CASE WHEN rank = 1 THEN 0 ELSE 1 END AS phase FROM g),
    o AS (SELECT *, CASE WHEN phase = 0 THEN event_type END AS o1, CASE WHEN phase = 1 THEN -coalesce(score, 0) END AS o2 FROM p),
    u AS (SELECT *, row_number() OVER (PARTITION BY user_id, content ORDER BY phase, o1, o2, event_type, rank) AS n FROM o),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY phase, o1, o2, event_type, rank) AS INTEGER) AS position FROM u WHERE n = 1)
    SELECT user_id, event_type, rank, content, score, position FROM r WHERE phase = 0 OR position <= 5""")
def merge_query_first(spark, d):
    return context.query_first(_groups(spark, d), "user_id", "event_type", "content", 5)


@query(f"""WITH {_GROUPS_SQL}, u AS (SELECT *, row_number() OVER (PARTITION BY user_id, content ORDER BY coalesce(score, 0) DESC, event_type, rank) AS n FROM g),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY coalesce(score, 0) DESC, event_type, rank) AS INTEGER) AS position FROM u WHERE n = 1)
    SELECT user_id, event_type, rank, content, score, position FROM r WHERE position <= 5""")
def merge_global_top(spark, d):
    return context.global_top(_groups(spark, d), "user_id", "event_type", "content", 5)


@query(f"""WITH {_GROUPS_SQL} SELECT user_id, event_type, rank, content, score, CAST(row_number() OVER (PARTITION BY user_id ORDER BY rank, event_type) AS INTEGER) AS position FROM g""")
def round_robin(spark, d):
    return context.round_robin(_groups(spark, d), "user_id", "event_type", "content")


@query("""WITH b AS (SELECT source, doc_id, '#### ' || lang || chr(10) || ' - ' || trim(text, E' \\n\\t\\r') || chr(10) AS block FROM documents),
    s AS (SELECT *, sum(length(block)) OVER (PARTITION BY source ORDER BY doc_id) AS total FROM b), k AS (SELECT source, string_agg(block, chr(10) ORDER BY doc_id) AS context, count(*) AS n_blocks FROM s WHERE total <= 4000 GROUP BY source)
    SELECT source, coalesce(context, '') AS context, CAST(coalesce(n_blocks, 0) AS BIGINT) AS n_blocks FROM (SELECT DISTINCT source FROM documents) LEFT JOIN k USING (source)""")
def context_packing(spark, d):
    return context.packed(t(spark, d, "documents").select("source", "doc_id", "lang", "text"), "source", "doc_id", "lang", "text", 4000)


@query("""SELECT doc_id, length(text) BETWEEN 50 AND 8000 AND length(text) > 0 AND len(regexp_extract_all(left(text, 200), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]')) <= 5
    AND len(regexp_extract_all(text, '[a-z]')) >= 0.5 * length(text) AS ok FROM documents""")
def quality_filter(spark, d):
    return t(spark, d, "documents").select("doc_id", text.quality_ok(F.col("text"), 50, 8000, 0.5, "a-z").alias("ok"))


@query("""WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host FROM pages) SELECT page_id, host, host IN ('example.com', 'tionsh.example.net') OR ends_with(host, '.example.com') OR ends_with(host, '.tionsh.example.net') AS allowed FROM h""")
def domain_allowlist(spark, d):
    return t(spark, d, "pages").select("page_id", text.host(F.col("url")).alias("host"), text.in_domains(F.col("url"), ["example.com", "tionsh.example.net"]).alias("allowed"))


@query("""WITH b AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '<h1(?:\\s[^>]*)?>(.*?)</h1>', 1, 'is'), '<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->|<[^>]*>', ' ', 'gis'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS title,
    trim(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->|<[^>]*>', ' ', 'gis'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS body FROM pages)
    SELECT page_id, title, trim(replace(body, title, '')) AS body FROM b WHERE title <> ''""")
def html_extract(spark, d):
    title, body = text.html_title_and_body(F.col("html"), "h1")
    return t(spark, d, "pages").select("page_id", title.alias("title"), body.alias("body")).where("title IS NOT NULL")


@query("""SELECT doc_id, CASE WHEN NOT (coalesce(length(trim(text, E' \\n\\t\\r')) < 600, true)) THEN 'none' WHEN lang = 'en' THEN 'empty' WHEN lang = 'de' THEN 'web' ELSE 'ensemble' END AS route FROM documents""")
def route_by_length(spark, d):
    subject = F.when(F.col("lang") == "en", context.SUBJECTS[0]).when(F.col("lang") == "de", context.SUBJECTS[2]).otherwise(context.SUBJECTS[1])
    return t(spark, d, "documents").select("doc_id", context.route(text.shorter_than([F.col("text")], 600), F.lit(True), context.coerced_subject(subject)).alias("route"))


# --- prompts and answers


@query("""SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) AS chat, count(*) AS n_messages FROM conversations GROUP BY conv_id""")
def chat_template(spark, d):
    ordered = F.sort_array(F.collect_list(F.struct("turn", F.struct("role", F.col("text").alias("content")).alias("m"))))
    rows = t(spark, d, "conversations").groupBy("conv_id").agg(F.transform(ordered, lambda x: x["m"]).alias("messages"))
    return rows.select("conv_id", prompts.chat_text(F.col("messages")).alias("chat"), F.size("messages").cast("long").alias("n_messages"))


def _choices() -> F.Column:
    words = F.filter(F.split("text", r"[ \n]+"), lambda w: w != "")
    return F.transform(F.slice(words, F.lit(1), (F.col("doc_id") % 3 + 3).cast("int")), lambda w: w)


_CHOICES_SQL = "c AS (SELECT doc_id, lang, text, list_filter(string_split_regex(text, '[ \\n]+'), lambda w: w <> '')[1:(doc_id % 3 + 3)] AS ch FROM documents)"


@query(f"""WITH {_CHOICES_SQL} SELECT doc_id, array_to_string(list_transform(ch, lambda x, i: i || ' - ' || x), chr(10)) AS options, array_to_string(range(1, len(ch) + 1), ', ') AS numbers, CASE WHEN length(lang) > 0 THEN '<보기>' || lang || '</보기>' ELSE '' END AS extra FROM c""")
def numbered_prompt(spark, d):
    rows = t(spark, d, "documents").select("doc_id", "lang", _choices().alias("ch"))
    return rows.select("doc_id", text.numbered(F.col("ch")).alias("options"), text.choice_range(F.col("ch")).alias("numbers"), text.block(F.col("lang"), "<보기>", "</보기>").alias("extra"))


@query("""WITH a AS (SELECT doc_id, text || ' Answer: ' || (doc_id % 7) || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'ANSWER : ' || (doc_id % 4 + 1) ELSE '' END AS txt FROM documents)
    SELECT doc_id, CASE WHEN v BETWEEN 1 AND 5 THEN CAST(v AS VARCHAR) ELSE '0' END AS answer FROM (SELECT doc_id, TRY_CAST(list_last(regexp_extract_all(txt, '(?i)(?:Answer|정답)\\s*:\\s*(\\d+)', 1)) AS BIGINT) AS v FROM a)""")
def answer_extract(spark, d):
    said = F.concat("text", F.lit(" Answer: "), F.col("doc_id") % 7, F.lit("\n"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("ANSWER : "), F.col("doc_id") % 4 + 1)).otherwise(""))
    return t(spark, d, "documents").select("doc_id", said.alias("said")).select("doc_id", text.stated_answer(F.col("said"), 5).alias("answer"))


@query("""SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) AS VARCHAR) AS pred, list_transform(range(1, len(embedding) + 1), lambda i: CASE WHEN i = list_position(embedding, list_max(embedding)) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS one_hot FROM embeddings""")
def argmax_decode(spark, d):
    rows = t(spark, d, "embeddings").select("vec_id", "embedding", arrays.argmax_label(F.col("embedding")).alias("pred"))
    return rows.select("vec_id", "pred", arrays.one_hot(F.col("pred"), F.size("embedding")).alias("one_hot"))


@query("""SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: round(exp(x) / list_sum(list_transform(embedding::DOUBLE[], lambda y: exp(y))), 6)) AS p FROM embeddings""")
def softmax_scores(spark, d):
    x = F.col("embedding").cast("array<double>")
    return t(spark, d, "embeddings").select("vec_id", F.transform(arrays.softmax(x), lambda v: F.round(v, 6)).alias("p"))


@query(f"""WITH {_CHOICES_SQL}, n AS (SELECT doc_id, ch, len(ch) AS n, doc_id % len(ch) + 1 AS a FROM c WHERE len(ch) >= 3), r AS (SELECT *, (row_number() OVER (PARTITION BY n ORDER BY md5('move:' || doc_id), doc_id) - 1) % n + 1 AS target FROM n),
    s AS (SELECT *, ch[1:a - 1] || ch[a + 1:] AS rest FROM r) SELECT doc_id, rest[1:target - 1] || [ch[a]] || rest[target:] AS ch, target AS answer FROM s""")
def choice_reorder(spark, d):
    rows = t(spark, d, "documents").select("doc_id", _choices().alias("ch")).where(F.size("ch") >= 3).withColumn("answer", (F.col("doc_id") % F.size("ch") + 1).cast("int"))
    return folds.rebalanced(rows, "ch", "answer", "doc_id", "move").select("doc_id", "ch", F.col("answer").cast("long").alias("answer"))


# --- features


_LEX_SQL = "l AS (SELECT doc_id, n_chars, len(list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '')) AS words, length(text) - length(replace(text, ',', '')) AS commas FROM documents)"


def _measures(spark, d) -> DataFrame:
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    return t(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"), words.cast("double").alias("words"), F.regexp_count("text", F.lit(",")).cast("double").alias("commas"))


@query(f"""WITH {_LEX_SQL} SELECT 'n_chars' AS a, 'n_chars' AS b, round(corr(n_chars, n_chars), 6) AS r FROM l UNION ALL SELECT 'n_chars', 'words', round(corr(n_chars, words), 6) FROM l UNION ALL SELECT 'n_chars', 'commas', round(corr(n_chars, commas), 6) FROM l
    UNION ALL SELECT 'words', 'words', round(corr(words, words), 6) FROM l UNION ALL SELECT 'words', 'commas', round(corr(words, commas), 6) FROM l UNION ALL SELECT 'commas', 'commas', round(corr(commas, commas), 6) FROM l""")
def feature_corr(spark, d):
    return metrics.correlations(_measures(spark, d), ["n_chars", "words", "commas"])


@query(f"""WITH {_LEX_SQL} SELECT doc_id, round((n_chars - avg(n_chars) OVER ()) / stddev_pop(n_chars) OVER (), 4) AS n_chars, round((words - avg(words) OVER ()) / stddev_pop(words) OVER (), 4) AS words FROM l""")
def standard_scale(spark, d):
    rows = metrics.standardised(_measures(spark, d).select("doc_id", "n_chars", "words"), ["n_chars", "words"])
    return rows.select("doc_id", F.round("n_chars", 4).alias("n_chars"), F.round("words", 4).alias("words"))


def _power_sql(name: str, matrix: str) -> str:
    """The vector of the largest eigenvalue of a symmetric matrix (aa, ab, ac, bb, bc, cc), its largest number positive, and the eigenvalue."""
    return f"""{name}_p(i, u, v, w) AS (SELECT 0, 1.0::DOUBLE, 0.7::DOUBLE, -0.4::DOUBLE UNION ALL SELECT i + 1, x / s, y / s, z / s
        FROM (SELECT *, sqrt(x * x + y * y + z * z) AS s FROM (SELECT i, aa * u + ab * v + ac * w AS x, ab * u + bb * v + bc * w AS y, ac * u + bc * v + cc * w AS z FROM {name}_p, {matrix} WHERE i < 1000)) WHERE s > 0),
    {name}_q AS (SELECT u, v, w, CASE WHEN abs(u) >= abs(v) AND abs(u) >= abs(w) THEN sign(u) WHEN abs(v) >= abs(w) THEN sign(v) ELSE sign(w) END AS s FROM {name}_p WHERE i = 1000),
    {name} AS (SELECT u * s AS u, v * s AS v, w * s AS w, aa * u * u + bb * v * v + cc * w * w + 2 * (ab * u * v + ac * u * w + bc * v * w) AS e FROM {name}_q, {matrix})"""


_SCALED_SQL = ", ".join(f"coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0), 0) AS {n}" for n, c in (("a", "n_chars"), ("b", "words"), ("c", "commas")))


@query(f"""WITH RECURSIVE {_LEX_SQL}, x AS (SELECT doc_id, {_SCALED_SQL} FROM l WHERE n_chars IS NOT NULL AND words IS NOT NULL AND commas IS NOT NULL),
    m AS (SELECT avg(a * a) AS aa, avg(a * b) AS ab, avg(a * c) AS ac, avg(b * b) AS bb, avg(b * c) AS bc, avg(c * c) AS cc FROM x), {_power_sql('one', 'm')},
    n AS (SELECT aa - e * u * u AS aa, ab - e * u * v AS ab, ac - e * u * w AS ac, bb - e * v * v AS bb, bc - e * v * w AS bc, cc - e * w * w AS cc FROM m, one), {_power_sql('two', 'n')},
    s AS (SELECT doc_id, a * one.u + b * one.v + c * one.w AS pc1, a * two.u + b * two.v + c * two.w AS pc2 FROM x, one, two)
    SELECT doc_id, round(pc1, 4) AS pc1, round(pc2, 4) AS pc2, CASE WHEN round(pc1, 4) >= 0 THEN 'right' ELSE 'left' END || '_' || CASE WHEN round(pc2, 4) >= 0 THEN 'high' ELSE 'low' END AS part FROM s""")
def principal_components(spark, d):
    scores, _ = features.principal_components(_measures(spark, d), "doc_id", ["n_chars", "words", "commas"])
    scores = scores.select("doc_id", F.round("pc1", 4).alias("pc1"), F.round("pc2", 4).alias("pc2"))
    return scores.withColumn("part", metrics.quadrant(F.col("pc1"), F.col("pc2"), 0.0, 0.0))


@query("""WITH w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '') AS ws, len(list_filter(string_split_regex(text, '[.!?]+'), lambda s: trim(s, ' ') <> '')) AS s FROM documents)
    SELECT doc_id, round(len(ws) / greatest(s, 1), 6) AS words_per_sentence, round(CASE WHEN len(ws) > 0 THEN len(list_distinct(ws)) / len(ws) ELSE 0 END, 6) AS ttr FROM w""")
def lexical_metrics(spark, d):
    m = text.lexical(F.col("text"))
    return t(spark, d, "documents").select("doc_id", F.round(m["words_per_sentence"], 6).alias("words_per_sentence"), F.round(m["ttr"], 6).alias("ttr"))


# --- store


def _log(spark, d) -> DataFrame:
    e = t(spark, d, "events")
    return e.select("user_id", F.col("event_id").alias("seq"), "event_type", "value", (F.col("event_type") == "error").alias("_deleted"))


@query("""SELECT user_id, seq, event_type, value FROM (SELECT user_id, event_id AS seq, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'error'""")
def changelog_replay(spark, d):
    return store.replay(_log(spark, d), "user_id", "seq")


@query("""SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 10 <> 0 UNION ALL SELECT o_orderkey, 'X' FROM orders WHERE o_orderkey % 10 = 0""")
def upsert(spark, d):
    base = t(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return store.upserted(base, base.where("o_orderkey % 10 = 0").withColumn("o_orderstatus", F.lit("X")), "o_orderkey")


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey % 5 <> 0""")
def delete_by_query(spark, d):
    return store.deleted_where(t(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("o_custkey") % 5 == 0)


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def multi_get(spark, d):
    ids = t(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return readers.by_ids(t(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", ids)


@query("""SELECT CAST(row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS BIGINT) AS index, o_orderkey FROM orders""")
def generated_index(spark, d):
    return readers.numbered_rows(t(spark, d, "orders").select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"]).select("index", "o_orderkey")


@query()
def chunk_recursive(spark, d):
    corpus = t(spark, d, "documents").select(F.col("doc_id").alias("index"), F.col("lang").alias("topic"), F.col("text").alias("content"))
    return chunking.hierarchy(corpus, "index", "topic", "content")[1].drop("topic_vector", "chunked_content_vector")


@query("""SELECT r_name, o_orderpriority, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def star_join_agg(spark, d):
    rows = t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
