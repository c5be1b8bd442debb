"""Language by compression: a text belongs to the language whose zstandard raw-content dictionary makes it smallest.

The dictionaries are the only thing learned: for each language, pieces of training rows, one after another. Texts are
lower-cased and compressed in parts of PART bytes, so that a dictionary helps with a long text all the way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.shared import held_out, stored
from loomtext.llm.textbatch import string_array

#: Bytes of a dictionary at most, characters of a piece (from one text), level, and bytes compressed at once.
DICTIONARY, PIECE, LEVEL, PART = 96_000, 640, 9, 8192
#: Texts that the pieces of a language are taken from, at most (a bounded sample of the training rows).
ROWS = 128
#: Bytes of all dictionaries, about: with more than some 700 languages each has less, so that what is sent to every task stays bounded and no language goes.
TOGETHER = 64 << 20
#: Languages (32 bytes each) up to this number are sent to all tasks when rows are thinned.
FEW = 100_000
#: Languages whose compressors a worker holds at once; with more, they are made anew for each batch of texts.
AT_ONCE = 256
#: A prediction whose margin to the second is a smaller part of the size is marked as not accepted.
MARGIN = 0.02
LETTER = regex.compile(r"\p{L}")


def learn(docs: DataFrame) -> dict[str, bytes]:
    """A dictionary for each language of the training rows, most frequent language first.

    Training rows have a lang, a text with a letter, and an id that isn't held out. All are counted. Pieces come from at
    most ROWS different texts of a language, those with the smallest hashes; a text that many rows share, whatever their ids, is
    one. Whole pieces fill a dictionary until its bytes are reached. No language is left out.
    """
    rows = docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    order = F.xxhash64("text", F.lit(11))
    start = F.when(F.length("text") > PIECE, F.pmod(order, F.length("text") - PIECE).cast("int") + 1).otherwise(F.lit(1))
    piece = F.lower(F.substring(F.col("text"), start, F.lit(PIECE)))
    counts = stored(rows.groupBy("lang").agg(F.count("*").alias("count"), F.approx_count_distinct(F.xxhash64("text"), 0.02).alias("texts")))
    n = counts.count()
    each = max(1, min(ROWS, TOGETHER // (PIECE * max(n, 1))))
    # of a language with many texts, about four times as many as are needed go on, whatever the corpus: none at all by chance once in e ** 64
    thinned = rows.join(F.broadcast(counts), "lang") if n <= FEW else rows.join(counts, "lang")
    thinned = thinned.where(F.pmod(F.xxhash64("text", F.lit(7)), F.lit(1 << 40)) / (1 << 40) * F.col("texts") < max(4 * each, 64))
    pieces = thinned.groupBy("lang", piece.alias("piece")).agg(F.min(order).alias("rank"), F.first("count").alias("count"))
    per = pieces.groupBy("lang").agg(F.first("count").alias("count"), F.slice(F.array_sort(F.collect_list(F.struct("rank", "piece"))), 1, each)["piece"].alias("pieces"))
    size = min(DICTIONARY, TOGETHER // max(n, 1))
    return {r["lang"]: joined(r["pieces"], size) for r in per.orderBy(F.desc("count"), "lang").toLocalIterator()}


def joined(pieces: list[str], size: int = DICTIONARY) -> bytes:
    """The pieces one after another, as many as fit; the beginning of the first one if it doesn't."""
    out = b""
    for x in pieces:
        x = x.encode() + b"\n"
        if len(out) + len(x) > size:
            break
        out += x
    return out or "".join(pieces[:1]).encode()[:size]


def compressors(dictionaries: list[bytes]) -> list[Callable[[bytes], bytes]]:
    out = []
    for content in dictionaries:
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
    return out


def classify(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, accepted.

    lang_pred is `und` (score 0, not accepted) where the text is null or has no letter, or nothing was learned. score is
    a softmax of sizes on a scale of a hundredth of the smallest. Of languages with equal sizes the more frequent one wins;
    `accepted` is false where the margin is narrow. The dictionaries (TOGETHER bytes at most) are broadcast. Rows that
    repeat are judged alike, each of them, and an empty table gives no rows; a letter is a character of category L (so neither a
    half nor a Roman numeral is). Very long texts are compressed part by part. Other columns play no part.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, contents = list(shared.value), list(shared.value.values())
        blocks = range(0, len(contents), AT_ONCE)
        held = compressors(contents) if len(blocks) == 1 else []
        for batch in batches:
            sizes, known = np.zeros((batch.num_rows, len(names))), np.zeros(batch.num_rows, bool)
            for at in blocks:
                by = held or compressors(contents[at : at + AT_ONCE])
                for i, text in enumerate(batch.column("text")):
                    x = text.as_py()
                    if x and LETTER.search(x):
                        known[i] = True
                        b = x.lower().encode()
                        parts = [b[k : k + PART] for k in range(0, len(b), PART)]
                        sizes[i, at : at + AT_ONCE] = [sum(len(c(p)) for p in parts) for c in by]
            if names:
                best = sizes.argmin(1)
                low = sizes[np.arange(len(best)), best]
                second = np.partition(sizes, 1, axis=1)[:, 1] if len(names) > 1 else np.full(len(low), np.inf)
                score = 1 / np.exp(-(sizes - low[:, None]) / (2 + 0.01 * low[:, None])).sum(1)
                accepted = known & (second - low >= MARGIN * low)
            else:
                best, score, accepted = np.zeros(batch.num_rows, int), np.zeros(batch.num_rows), known
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), string_array([names[k] if ok else "und" for k, ok in zip(best, known, strict=True)]), pa.array(np.where(known, score, 0.0)), pa.array(accepted)],
                ["doc_id", "held_out", "lang_pred", "score", "accepted"],
            )

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(work, "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")
