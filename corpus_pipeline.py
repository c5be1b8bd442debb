"""From raw documents to token ids: what is toxic or poor goes, copies go, sources are mixed, texts are encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import bpe, minhash, mixing, quality, toxicity
from loomtext.llm.queries import MIX, vocabulary
from loomtext.llm.shared import column, passing, remove, stored, table


def unused(docs: DataFrame) -> str:
    """A beginning that no column of docs has, so that what a stage adds for a while meets no column of the same name, whatever its case."""
    return "_" * (1 + max(len(c) - len(c.lstrip("_")) for c in docs.columns))


def of(docs: DataFrame) -> list[Column]:
    """The columns of docs, of whatever names."""
    return [column(c) for c in docs.columns]


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold of op1.

    A score is never null, so no row is lost by comparison: a null or empty text has the score of a text without terms and stays. Very
    long texts are scored whole; equal texts alike, so repeated rows stay or go together. An empty table gives an empty one.
    Further columns go along, whatever their names and types.
    """
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    name = f"{unused(docs)}toxic"
    return toxicity.scored(docs, model, name).where(F.col(name) < toxicity.THRESHOLD).select(of(docs))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likelier good than not.

    Null or empty texts are judged by their form, null sources and languages are a site of their own. Each of the rows that repeat counts
    in its site's posterior, without its own evidence in its prior. Very long texts are judged whole. An empty table gives an empty one.
    Further columns go along, whatever their names and types.
    """
    prefix = unused(docs)
    return quality.scored(docs, table(spark, sf_dir, "labels"), prefix=prefix).where(F.col(f"{prefix}score") >= quality.THRESHOLD).select(of(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8): that with the smallest doc_id.

    Rows without doc_id stay, and so do null and empty texts; a row that repeats another in all columns goes (also maps are
    compared, by their entries in order). Texts that share a doc_id are documents of their own. Of equally small ids the text with the smallest
    digest stays. Very long texts are compared whole. An empty table gives an empty one.
    """
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        gone = minhash.near_duplicates(docs, words=5, percent=80).where("NOT kept").select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(of(docs))
    row = f"{unused(docs)}row"
    rows = docs.withColumn(row, F.sha2(F.to_json(F.struct(*of(docs))), 256)).dropDuplicates([row])
    gone = minhash.near_duplicates(rows, words=5, percent=80, row=row).where("NOT kept").select(row)
    return rows.join(gone, row, "left_anti").select(of(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens have the target shares of sources, languages and topics.

    Null sources and languages are one value, OTHER; a null or empty text counts one token, a very long one all of its. Rows that share an id share its draw, so
    repeated rows are taken together. An empty table gives an empty one. Further columns go along, whatever their names and types.
    """
    prefix = unused(docs)
    return mixing.sampled(docs, MIX, prefix=prefix).where(F.col(f"{prefix}taken")).select(of(docs))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars and further columns, ids of each text, and the digest of what they decode to.

    A null text counts as empty and has no ids; very long texts are encoded whole, and each of the rows that repeat. Columns named ids or decoded_sha256 are replaced. An
    empty table gives an empty one.
    """
    return bpe.encode(docs, vocabulary(), proof=True)


STAGES = [
    ("toxicity", not_toxic),
    ("quality", good),
    ("near_duplicates", one_of_each),
    ("mixing", mixed),
    ("bpe", encoded),
]

#: SQL can't express the classifiers and the signatures; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage stores on its way goes when its result is stored, and that when the next one's is."""
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES:
        with passing(spark) as made:
            docs = stored(stage(spark, docs, sf_dir))
            own = made.pop()
        remove(spark, before)
        before = [own]
    return docs
