"""Array, score, vector and hash functions, as column expressions."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from loomtext.functions.text import trimmed

#: The labels of choices, in order.
CHOICE_LABELS = ("1", "2", "3", "4", "5")
#: Words whose hashes are remembered within a batch of texts, about (and those of one text), and words whose bits it counts at once.
HASHES, HASHES_AT_ONCE = 100_000, 16_384


def moved(items: Column, source: Column, target: Column) -> Column:
    """The array with the element at `source` taken out and put in at `target` (both 1-based)."""
    rest = F.concat(F.slice(items, F.lit(1), source - 1), F.slice(items, source + 1, F.greatest(F.size(items) - source, F.lit(0))))
    return F.concat(F.slice(rest, F.lit(1), target - 1), F.array(F.element_at(items, source)), F.slice(rest, target, F.greatest(F.size(items) - target, F.lit(0))))


def one_hot(answer: Column, n: Column) -> Column:
    """n zeros with a 1 at the answer; zeros only if that is no number from 1 to n."""
    at = F.coalesce(answer.try_cast("int"), F.lit(0))
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.when(i == at, 1.0).otherwise(0.0))).otherwise(F.array().cast("array<double>"))


def argmax_label(scores: Column) -> Column:
    """1-based place of the first largest score, as text."""
    return F.array_position(scores, F.array_max(scores)).cast("string")


def choice_logprobs(by_token: Column, n: int) -> Column:
    """Of the tokens 1..n, their values in a map; -infinity where missing."""
    return F.array(*(F.coalesce(F.try_element_at(by_token, F.lit(str(i))), F.lit(float("-inf"))) for i in range(1, n + 1)))


def log_softmax(x: Column) -> Column:
    """Each step binds what the next one uses for all elements, so that sums are made once and not for every element."""

    def scaled(s: Column) -> Column:
        total = F.aggregate(s["x"], F.lit(0.0), lambda sofar, v: sofar + F.exp(v - s["top"]))
        bound = F.struct(s["x"].alias("x"), (s["top"] + F.log(total)).alias("less"))
        return F.transform(F.array(bound), lambda u: F.transform(u["x"], lambda v: v - u["less"]))[0]

    return F.transform(F.array(F.struct(x.alias("x"), F.array_max(x).alias("top"))), scaled)[0]


def softmax(x: Column) -> Column:
    return F.transform(log_softmax(x), F.exp)


def subsequence_end(ids: Column, pattern: Column) -> Column:
    """Where the first occurrence of the pattern ends (0-based, after it); 0 if there is none."""
    n = F.size(pattern)
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(ids) - n + 1, F.lit(1))), lambda i: F.slice(ids, i, n) == pattern)
    return F.coalesce(F.get(starts, F.lit(0)) - 1 + n, F.lit(0))


def masked_labels(ids: Column, start: Column, length: Column) -> Column:
    """-100 before `start`, then the ids, padded with -100 to `length`."""
    own = F.transform(ids, lambda t, i: F.when(i >= start, t).otherwise(-100))
    return F.concat(own, F.array_repeat(F.lit(-100), F.greatest(length - F.size(ids), F.lit(0))))


def label_index(text: Column, think: str = "\n<think>\n\n</think>\n\n") -> Column:
    """The 0-based index of a decoded label 1..5, after an empty thinking block if there is one; null if it is no such label."""
    said = trimmed(F.element_at(F.split(text, "\\Q" + think + "\\E"), -1))
    return F.when(said.isin(*CHOICE_LABELS), said.cast("int") - 1)


def label_text(index: Column) -> Column:
    """The label of a 0-based index; null beyond."""
    return F.get(F.array(*map(F.lit, CHOICE_LABELS)), index)


def mean_of(x: Column) -> Column:
    """Mean of the elements that are not null; null without any."""
    known = F.filter(x, lambda v: v.isNotNull())
    return F.try_divide(F.aggregate(known, F.lit(0.0), lambda s, v: s + v), F.size(known))


def zipped(a: Column, b: Column, first: str, second: str) -> Column:
    """Structs of the elements at equal places; arrays of different lengths are an error."""
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.alias(first), y.alias(second)))
    return F.when(F.size(a) == F.size(b), pairs).when(a.isNull() | b.isNull(), None).otherwise(F.raise_error(F.lit("arrays of different lengths")))


def merged_maps(left: Column, right: Column) -> Column:
    """Both maps in one; of a key in both, the right one's value. A null map is empty."""
    own = F.coalesce(right, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    rest = F.map_filter(F.coalesce(left, own), lambda k, _: ~F.map_contains_key(own, k))
    return F.map_concat(rest, own)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """In double precision; null where a norm is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms)


def word_hash(word: Column) -> Column:
    """The low 64 bits of the word's MD5."""
    return F.conv(F.substring(F.md5(word), 17, 16), 16, -10).cast("bigint")


def simhash(c: Column) -> Column:
    """64 bits; a bit is set where at least half of the words (by white space, each as often as it stands) have it set. A blank text gives 0."""
    hashes = F.transform(F.filter(F.split(c, r"\s+"), lambda w: w != ""), word_hash)

    def voted(h: Column) -> Column:
        bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.aggregate(h, F.lit(0), lambda s, x: s + 2 * F.getbit(x, i).cast("int") - 1))
        # shiftleft of 1 by the bit's place; the sum of distinct powers is their OR
        return F.when(F.size(h) > 0, F.aggregate(bits, F.struct(F.lit(0).alias("i"), F.lit(0).cast("bigint").alias("v")), lambda s, n: F.struct((s["i"] + 1).alias("i"), F.when(n >= 0, s["v"].bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), s["i"]))).otherwise(s["v"]).alias("v")))["v"]).otherwise(F.lit(0).cast("bigint"))

    return F.transform(F.array(hashes), voted)[0]  # the array binds the hashes once


def hamming_similarity(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / 64.0


@F.pandas_udf(LongType())
def _simhash_of_texts(texts: pd.Series) -> pd.Series:
    place = np.uint64(1) << np.arange(63, -1, -1, dtype=np.uint64)
    known: dict[bytes, bytes] = {}

    def one(text: str | None) -> int:
        counts = Counter((text or "").encode().split())  # bytes are split at the white space that \s has
        if not counts:
            return 0
        if len(known) > HASHES:
            known.clear()
        halves = b"".join([known.get(w) or known.setdefault(w, hashlib.md5(w).digest()[8:]) for w in counts])
        times, ones = np.fromiter(counts.values(), np.int64, len(counts)), np.zeros(64, np.int64)
        for at in range(0, len(times), HASHES_AT_ONCE):
            bits = np.unpackbits(np.frombuffer(halves, np.uint8, min(HASHES_AT_ONCE, len(times) - at) * 8, at * 8)).reshape(-1, 64)
            ones += (times[at : at + HASHES_AT_ONCE].astype(float) @ bits.astype(float)).astype(np.int64)
        return int(place[2 * ones >= times.sum()].sum(dtype=np.uint64).astype(np.int64))

    return texts.map(one).astype("int64")


def simhash_of_texts(c: Column) -> Column:
    """simhash() of whole texts: each task counts a text's words and hashes distinct ones, so it costs a step a word and not one for each of the 64 bits. A column for select(), not for lambdas."""
    return _simhash_of_texts(c)
