"""Token counts from a cache of digests: what was counted once is joined, only distinct new texts are encoded.

A stored count belongs to the digest of a content and the digest of a tokenizer (its file, its library and that library's version).
Where a tokenizer drops white space and case, the content is the text without what can't change its count, so texts that differ
in line breaks only share an entry. Digests are made by built-in functions where the text is read; the join with the cache sees 32 bytes
a document. Texts are shuffled only if they are missing in the cache, once for each content and task, are encoded one for each
content, and the counts are appended to the cache for later runs.
"""

from __future__ import annotations

import functools
import hashlib
import importlib.metadata
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.shared import stored
from loomtext.llm.textbatch import slices

#: Characters that are encoded at once.
BATCH = 1 << 19
#: Bytes of words and their counts that a worker remembers, about; then it begins anew. Longer words are not remembered.
MEMO, LONG = 64 << 20, 256
#: Bytes after which a very long text is cut at the next white space.
PART = 1 << 20
#: Missing contents up to this number are sent to all tasks (32 bytes each), so that only their texts are shuffled; more are joined.
FEW = 500_000
#: A content is hot if it is more than this part of all rows: so there are HOT - 1 of them at most, whatever the corpus.
HOT = 1024
SPACE = re.compile(rb"[ \t-\r]")


@dataclass(frozen=True)
class Tokenizer:
    #: tokenizers (a .json file) or sentencepiece (a .model file).
    library: str
    content: bytes

    @functools.cached_property
    def digest(self) -> str:
        version = f"{self.library} {importlib.metadata.version(self.library)}\n"
        return hashlib.sha256(version.encode() + self.content).hexdigest()

    @functools.cached_property
    def spec(self) -> dict:
        return json.loads(self.content) if self.library == "tokenizers" else {}

    @property
    def added(self) -> list[str]:
        return [x["content"] for x in self.spec.get("added_tokens") or []]

    @functools.cached_property
    def folds(self) -> bool:
        """Whether it is known to drop white space and case: it makes white space one blank, lower-cases, and keeps only what a pattern without white space matches."""
        steps = (self.spec.get("normalizer") or {}).get("normalizers") or []
        known = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
        first = ((self.spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        if steps != known or first.get("type") != "Split" or first.get("behavior") != "Removed" or not first.get("invert"):
            return False
        return not regex.search(first["pattern"]["Regex"], " \t\n\v\f\r") and not any(SPACE.search(x.encode()) for x in self.added) and not any(x.get("lstrip") or x.get("rstrip") for x in self.spec["added_tokens"])


def tokenizer(path: str) -> Tokenizer:
    """Of a file: .json for the tokenizers library, .model for sentencepiece. It is some megabytes at most, whatever the corpus, and goes to every task."""
    library = {".json": "tokenizers", ".model": "sentencepiece"}.get(os.path.splitext(path)[1])
    if library is None:
        raise ValueError(f"{path} is neither .json nor .model")
    with open(path, "rb") as f:
        return Tokenizer(library, f.read())


def content(text: Column, of: Tokenizer) -> Column:
    """What decides the count: the text (null: empty); of a tokenizer that folds, with runs of ASCII white space as one blank, none at the ends, and an ASCII text without an added token's string in any case in lower case."""
    text = F.coalesce(text, F.lit(""))
    if not of.folds:
        return text
    spaced = F.btrim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "))
    lower = F.lower(spaced)
    plain = F.octet_length(spaced) == F.char_length(spaced)
    for token in of.added:
        plain &= ~F.contains(lower, F.lit(token.lower()))
    return F.when(plain, lower).otherwise(spaced)


_loaded: dict[str, object] = {}


def _counter(of: Tokenizer):
    """Counts of a list of texts; one tokenizer a worker process."""
    if of.digest not in _loaded:
        _loaded.clear()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if of.library == "tokenizers":
            import tokenizers

            t = tokenizers.Tokenizer.from_str(of.content.decode())
            t.no_truncation()
            t.no_padding()
            _loaded[of.digest] = lambda texts: [len(x) for x in t.encode_batch_fast(texts, add_special_tokens=False)]
        else:
            import sentencepiece

            s = sentencepiece.SentencePieceProcessor(model_proto=of.content)
            _loaded[of.digest] = lambda texts: [len(x) for x in s.encode(texts, num_threads=1)]
    return _loaded[of.digest]


def in_batches(texts: list[str], of: Tokenizer) -> list[int]:
    count, out, at, size = _counter(of), [], 0, 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= BATCH:
            out += count(texts[at : k + 1])
            at, size = k + 1, 0
    return out + count(texts[at:])


def parts(text: bytes) -> Iterator[bytes]:
    """The text cut at the first white space after every PART bytes."""
    at = 0
    while len(text) - at > PART and (space := SPACE.search(text, at + PART)):
        yield text[at : space.start()]
        at = space.start()
    yield text[at:]


class Words:
    """Counts of whole texts by a tokenizer that drops white space: no token or added token's string reaches over ASCII white space, so a text has as many tokens as its words, and each distinct word is encoded once a worker (in a bounded memo)."""

    def __init__(self, of: Tokenizer):
        self.of, self.memo, self.held = of, {}, 0

    def lengths(self, texts: list[bytes]) -> list[int]:
        """Of very long texts part by part, so that not all of their words are held."""
        if all(len(x) <= PART for x in texts):
            return self.counted(texts)
        return [sum(self.counted([p])[0] for p in parts(x)) for x in texts]

    def counted(self, texts: list[bytes]) -> list[int]:
        words = [x.split() for x in texts]
        new = list(set().union(*words) - self.memo.keys())
        own = dict(zip(new, in_batches([w.decode("utf-8", "replace") for w in new], self.of), strict=True))
        self.memo |= own
        out = [sum(map(self.memo.__getitem__, x)) for x in words]
        for w in [w for w in new if len(w) > LONG]:
            del self.memo[w]
        self.held += sum(len(w) + 150 for w in new if len(w) <= LONG)  # 150: what an object and an entry take besides
        if self.held > MEMO:
            self.memo, self.held = {}, 0
        return out


def encoded(texts: DataFrame, of: Tokenizer) -> DataFrame:
    """(digest, n_tokens) from (digest, text)."""
    shared = texts.sparkSession.sparkContext.broadcast(of)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        words = Words(of) if of.folds else None
        for part, _ in slices(batches):
            texts = part.column("text")
            n = words.lengths([x or b"" for x in texts.cast(pa.binary()).to_pylist()]) if words else in_batches([x or "" for x in texts.to_pylist()], of)
            yield pa.RecordBatch.from_arrays([part.column("digest"), pa.array(n, pa.int64())], ["digest", "n_tokens"])

    return texts.select("digest", "text").mapInArrow(work, "digest binary, n_tokens long")


def cached(spark: SparkSession, cache: str, of: Tokenizer) -> DataFrame:
    """(digest, n_tokens): what the cache holds for this tokenizer, one row a content (two runs at once may both have counted it). A folder that isn't there is an empty cache."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "digest binary, n_tokens long")
    rows = spark.read.schema("digest binary, n_tokens long, tokenizer string").parquet(cache).where(F.col("tokenizer") == of.digest)
    return rows.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def counted(docs: DataFrame, of: Tokenizer, cache: str, limit: int = 2048) -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit). Counts that `cache` (a folder that the cluster shares) lacks are appended to it.

    Counts are what the library gives for the whole text without begin, end or special tokens added, without truncation or
    padding; a special token's string within a text is that token where the library's default says so. A null text counts as
    empty. Rows may repeat and ids may be null or shared: each row gets its count. Other columns play no part. An empty table
    gives no rows and leaves the cache as it is. A run that is stopped appends all of its counts or none.
    """
    spark = docs.sparkSession
    digest = F.unhex(F.sha2(content(F.col("text"), of).cast("binary"), 256)).alias("digest")
    keyed = stored(docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), digest))
    groups = stored(keyed.groupBy("digest").count())
    missing = stored(groups.select("digest").join(cached(spark, cache, of), "digest", "left_anti"))
    if n := missing.count():
        texts = docs.select(digest, "text")
        if n <= FEW:
            texts = texts.join(F.broadcast(missing), "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text"))
        else:
            texts = texts.groupBy("digest").agg(F.first("text").alias("text")).join(missing, "digest", "left_semi")
        encoded(texts, of).withColumn("tokenizer", F.lit(of.digest)).write.mode("append").partitionBy("tokenizer").parquet(cache)
    counts = cached(spark, cache, of)
    # a content that very many rows share would bring them all to one task of the join; there are few such contents, so they are broadcast
    often = groups.where(F.col("count") * HOT > (groups.agg(F.sum("count")).first()[0] or 0)).select("digest")
    hot = F.broadcast(counts.join(F.broadcast(often), "digest", "left_semi"))
    usual = keyed.join(F.broadcast(often), "digest", "left_anti").join(counts, "digest")
    out = keyed.join(hot, "digest").unionByName(usual)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
