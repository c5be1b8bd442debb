"""Features of questions: distractors, extreme phrasing, principal components."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions.arrays import cosine, hamming_similarity, simhash
from loomtext.functions.text import any_of
from loomtext.operators.metrics import standardised

#: Words of extreme phrasing (of the plain words; a particle that needs a morphological analyser is left out).
EXTREME = (
    "모두", "항상", "반드시", "오직", "결코", "전혀", "단 하나", "최고의", "무조건",
    "오로지", "단지", "특정한", "절대로", "필연적", "당연히", "결국",
    "언제나", "예외 없이", "어떤 경우에도", "최고", "제일", "유일한",
    "급격히", "완전히", "일관되게",
)


def distractor_similarity(choices: Column, answer: Column, score) -> Column:
    """The largest score between the right choice and another."""
    right = F.try_element_at(choices, answer)
    others = F.filter(choices, lambda c, i: i + 1 != answer)
    return F.coalesce(F.array_max(F.transform(others, lambda c: score(right, c))), F.lit(0.0))


def simhash_similarity(a: Column, b: Column) -> Column:
    return hamming_similarity(simhash(a), simhash(b))


def embedding_similarity(a: Column, b: Column) -> Column:
    return F.coalesce(cosine(a, b), F.lit(0.0))


def hybrid_similarity(text_a: Column, text_b: Column, vector_a: Column, vector_b: Column) -> Column:
    """The larger of the likeness of words and of that of vectors; what can't be computed counts as 0."""
    return F.greatest(F.coalesce(simhash_similarity(text_a, text_b), F.lit(0.0)), embedding_similarity(vector_a, vector_b))


def extreme_flag(choices: Column, answer: Column, words: Sequence[str] = EXTREME) -> Column:
    """Null if no choice is put in extremes; else 1 if the right one is, or 0."""
    hits = F.transform(choices, lambda c: any_of(c, words))
    return F.when(~F.exists(hits, lambda h: h), None).when(F.try_element_at(hits, answer), 1).otherwise(0)


def principal_components(df: DataFrame, key: str, columns: list[str], n: int = 2) -> tuple[DataFrame, list[dict]]:
    """(key, pc1..) of the standardised columns, and of each component its share of the variance and its loadings.

    Sums of products are aggregated in one pass (a matrix of columns by columns); its eigenvectors are the driver's work.
    The largest loading of a component is positive.
    """
    rows = standardised(df.select(key, *columns).dropna(), columns)
    sums = rows.agg(*(F.sum(F.col(a) * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j), F.count("*").alias("n")).first()
    m = np.zeros((len(columns), len(columns)))
    for i in range(len(columns)):
        for j in range(i, len(columns)):
            m[i, j] = m[j, i] = (sums[f"{i}_{j}"] or 0.0) / max(sums["n"], 1)
    values, vectors = np.linalg.eigh(m)
    order = np.argsort(-values)[:n]
    vectors = vectors[:, order] * np.sign(vectors[np.abs(vectors[:, order]).argmax(0), order])
    about = [{"share": float(values[o] / max(values.sum(), 1e-12)), "loadings": dict(zip(columns, map(float, vectors[:, k]), strict=True))} for k, o in enumerate(order)]
    scores = [sum((F.col(c) * float(v) for c, v in zip(columns, vectors[:, k], strict=True)), F.lit(0.0)).alias(f"pc{k + 1}") for k in range(len(order))]
    return rows.select(key, *scores), about
