"""Routing, merging of ranked groups, and packing of context."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtext.functions.text import in_domains, trimmed

#: Subjects that a plan may name; the first is the default.
SUBJECTS = ("general", "한국사", "정치와 법")


def first_known(top: Column, nested: Column, default) -> Column:
    """The column, or where it is null the nested field, or the default."""
    return F.coalesce(top, nested, F.lit(default))


def subject_is(plan_subject: Column, subject: str) -> Column:
    """Whether a plan names this subject; no plan: no."""
    return F.coalesce(plan_subject == subject, F.lit(False))


def all_hold(*conditions: Column) -> Column:
    """Whether all hold; an unknown one doesn't."""
    return F.coalesce(reduce(lambda a, b: a & b, conditions, F.lit(True)), F.lit(False))


def coerced_subject(c: Column) -> Column:
    return F.when(c.isin(*SUBJECTS), c).otherwise(SUBJECTS[0])


def requests_of(c: Column) -> Column:
    """A JSON array of {query, top_k} with defaults "" and 5; anything else is empty."""
    items = F.coalesce(F.from_json(c, "array<struct<query: string, top_k: int>>"), F.array().cast("array<struct<query: string, top_k: int>>"))
    return F.transform(items, lambda r: F.struct(F.coalesce(r["query"], F.lit("")).alias("query"), F.coalesce(r["top_k"], F.lit(5)).alias("top_k")))


def route(short: Column, rag: Column, subject: Column) -> Column:
    """Where a question's context comes from."""
    return F.when(~(short & rag), "none").when(subject == SUBJECTS[0], "empty").when(subject == SUBJECTS[2], "web").otherwise("ensemble")


def web_score(score: Column, relevance: Column) -> Column:
    """The score, or the relevance where it is null or 0."""
    return F.coalesce(F.nullif(score, F.lit(0.0)), relevance)


def web_results(df: DataFrame, by: str, item: str, url: str, domains: list[str], k: int) -> DataFrame:
    """The k best of each query (`rank`), and of these the ones in the domains: cut first, then filtered."""
    w = Window.partitionBy(by).orderBy(F.desc("score"), item)
    return df.withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= k) & in_domains(F.col(url), domains))


def constrained_answer(c: Column, n: int, items: int = 2, least: int = 10) -> Column:
    """The answer of a JSON object {reasoning, answer}: null unless reasoning has so many texts of so many characters and the answer is from 1 to n."""
    found = F.from_json(c, "reasoning array<string>, answer int")
    ok = (F.size(found["reasoning"]) >= items) & F.forall(found["reasoning"], lambda x: F.length(x) >= least) & found["answer"].between(1, n)
    return F.when(ok, found["answer"])


def attached(docs: DataFrame, scores: DataFrame, group: list[str], index: str) -> DataFrame:
    """Scores by place in their group: docs that got none have 0, scores out of range fall away."""
    return docs.join(scores.select(*group, index, "score"), [*group, index], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def query_first(docs: DataFrame, by: str, group: str, content: str, k: int) -> DataFrame:
    """The best document of each group, in the groups' order, then the others by score until k; equal contents count once.

    The best is the one of the smallest rank: the reranker's order is trusted. The first ones are all kept, even beyond k.
    docs: by, group, rank, content, score (null counts as 0).
    """
    score = F.coalesce("score", F.lit(0.0))
    inner = Window.partitionBy(by, group).orderBy("rank")
    rows = docs.withColumn("__phase", F.when(F.row_number().over(inner) == 1, 0).otherwise(1))
    order = [F.col("__phase"), F.when(F.col("__phase") == 0, F.col(group)), F.when(F.col("__phase") == 1, -score), F.col(group), F.col("rank")]
    rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy(by, content).orderBy(*order))).where("__n = 1")
    rows = rows.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return rows.where((F.col("__phase") == 0) | (F.col("position") <= k)).drop("__phase", "__n")


def global_top(docs: DataFrame, by: str, group: str, content: str, k: int) -> DataFrame:
    """All documents by score; equal contents count once; the k best."""
    order = [F.desc(F.coalesce("score", F.lit(0.0))), F.col(group), F.col("rank")]
    rows = docs.withColumn("__n", F.row_number().over(Window.partitionBy(by, content).orderBy(*order))).where("__n = 1").drop("__n")
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("position") <= k)


def round_robin(docs: DataFrame, by: str, group: str, content: str) -> DataFrame:
    """Firsts of all groups, then seconds, and so on; empty contents are left out."""
    rows = docs.where(F.length(content) > 0).withColumn("__n", F.row_number().over(Window.partitionBy(by, group).orderBy("rank")))
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy("__n", group))).drop("__n")


#: Ways to merge ranked groups, by name.
MERGES: dict[str, Callable[..., DataFrame]] = {"query_first": query_first, "global_top": global_top}


def merged(name: str, docs: DataFrame, by: str, group: str, content: str, k: int) -> DataFrame:
    """docs merged in the way of this name; an unknown name is an error."""
    if name not in MERGES:
        raise ValueError(f"no merge {name!r}: {', '.join(MERGES)}")
    return MERGES[name](docs, by, group, content, k)


def packed(docs: DataFrame, by: str, order: str, query: str, content: str, most: int) -> DataFrame:
    """(by, context, n_blocks): blocks in order while their lengths sum to `most` at the most; the first that doesn't fit ends it.

    A block has four characters at least, so only so many first rows of a group can fit: each task keeps these few of its own before the
    shuffle (for `most` up to 4,000, which is what Spark prunes windows for), with at most `most` + 1 characters of each.
    """
    text = trimmed(F.col(content))
    blocks = F.when(F.length(query) > 0, F.concat(F.lit("#### "), F.col(query), F.lit("\n - "), text, F.lit("\n"))).otherwise(F.concat(F.lit(" - "), text, F.lit("\n")))
    # what is cut off is longer than fits
    rows = docs.select(by, order, F.left(F.coalesce(blocks, F.lit("")), F.lit(most + 1)).alias("__block"), blocks.isNull().alias("__none"))
    w = Window.partitionBy(by).orderBy(order)
    rows = rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most // 4)
    running = F.sum(F.length("__block")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    kept = rows.withColumn("__sum", running).where((F.col("__sum") <= most) & ~F.col("__none"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "__block"))), lambda x: x["__block"]), "\n")
    found = kept.groupBy(by).agg(joined.alias("context"), F.count("*").alias("n_blocks"))
    return docs.select(by).distinct().join(found, by, "left").select(by, F.coalesce("context", F.lit("")).alias("context"), F.coalesce("n_blocks", F.lit(0)).cast("long").alias("n_blocks"))
