"""One thin query for each operator of this subpackage, with production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import bpe, fingerprint, kdtree, language, minhash, mixing, negatives, pivots, quality, tokencache, toxicity, urlfilter, warc
from loomtext.llm.shared import shared_dir, table


def vocabulary() -> str:
    """The public byte-level vocabulary that op8 is held against."""
    import public_tokenizers

    return bpe.vocabulary_text(public_tokenizers.path("byte_bpe_50k.json"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_edits(table(spark, sf_dir, "documents"))


#: What op3 and the pipeline mix to: sources alike, half of the tokens English, plain texts preferred.
MIX = mixing.Targets(
    source={f"src{k}": 0.05 for k in range(20)},
    lang={"en": 0.5, "fr": 0.2, "de": 0.15, "es": 0.15},
    topic={"plain": 0.7, "markup": 0.1, "contact": 0.1, "legal": 0.1},
)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.sampled(table(spark, sf_dir, "documents"), MIX, ["doc_id"])
    return rows.select("doc_id", "c_source", "c_lang", "c_topic", "tokens", F.round("chance", 6).alias("chance"), "taken")


def op4_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.linked(table(spark, sf_dir, "embeddings"), least=0.9)


#: The rules of the contract: verdict, host, path.
URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.classify(docs, language.learn(docs))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary())


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth id asks; every seventh row's label is moved on by one first."""
    label = F.col("label").cast("long")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"))
    return negatives.mine(rows, F.col("vec_id") % 100 == 0, positives=5, negatives=5, share=(80, 100))


def op12_kdtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.clustered(table(spark, sf_dir, "embeddings"), k=40, rounds=5, dim=64, seed="2:")


def op13_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a cache that is empty at first."""
    import public_tokenizers

    return tokencache.counted(table(spark, sf_dir, "documents"), tokencache.tokenizer(public_tokenizers.path("word_bpe_49k.json")), shared_dir(spark), limit=2048)


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_fingerprint": op2_fingerprint,
    "op3_mixing": op3_mixing,
    "op4_pivots": op4_pivots,
    "op5_urls": op5_urls,
    "op6_language": op6_language,
    "op7_quality": op7_quality,
    "op8_bpe": op8_bpe,
    "op9_warc": op9_warc,
    "op10_minhash": op10_minhash,
    "op11_negatives": op11_negatives,
    "op12_kdtree": op12_kdtree,
    "op13_tokens": op13_tokens,
}

_URL_RULES_SQL = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)
_KEPT_SQL = "len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0"
_INTEGERS_SQL = "list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))"


def _clusters_sql(k: int, rounds: int, dim: int, seed: str) -> str:
    """The rounds one after another, each a distance of every vector to every centroid."""
    steps = [f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, {_INTEGERS_SQL} AS x FROM embeddings WHERE len(embedding) = {dim} AND {_KEPT_SQL}),
        c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}' || vec_id), x) - 1 AS c, x AS z FROM v QUALIFY c < {k})"""]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT r, vec_id, x, c, d FROM (SELECT r, vec_id, x, c, CAST(list_sum(list_transform(list_zip(x, z), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, c{i})
            QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        if i < rounds:
            steps.append(f"""m{i} AS MATERIALIZED (SELECT c, list(CAST(floor_mean AS BIGINT) ORDER BY j) AS z FROM (
                    SELECT c, j, (s - ((s % n) + n) % n) // n AS floor_mean FROM (SELECT c, j, CAST(sum(x[j]) AS BIGINT) AS s, count(*) AS n FROM a{i}, range(1, {dim + 1}) t(j) GROUP BY c, j)) GROUP BY c),
                c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m.z, o.z) AS z FROM c{i} o LEFT JOIN m{i} m USING (c))""")
    return "WITH " + ", ".join(steps) + f""" SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
        sha256(array_to_string(z, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (c)"""


ORACLE_SQL: dict[str, str] = {
    "op11_negatives": f"""
        WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {_INTEGERS_SQL} AS x FROM embeddings WHERE label IS NOT NULL AND {_KEPT_SQL}),
        s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS alike, CAST(list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
        p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
        SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id)
        WHERE NOT alike AND 80 * positive_score <= 100 * score AND score <= positive_score
        WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 5""",
    "op12_kdtree": _clusters_sql(40, 5, 64, "2:"),
    "op3_mixing": mixing.oracle(MIX) + " SELECT doc_id, c_source, c_lang, c_topic, tokens, round(chance, 6) AS chance, draw < chance AS taken FROM mixed",
    "op5_urls": f"""
        WITH rules(v, h, p) AS (VALUES {_URL_RULES_SQL}),
        parts AS (SELECT page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
            coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
        fits AS (SELECT page_id, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC, length(h) DESC) AS k
            FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
        SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM parts LEFT JOIN (FROM fits WHERE k = 1) USING (page_id)""",
    "op9_warc": """
        WITH r AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM r)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to FROM f""",
}
