"""Hierarchical splitting of a corpus into parents and children."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions.batches import carried

#: Characters of chunks that a task holds, about.
PIECE = 1 << 20
#: Sizes, overlaps and separators of the two levels.
PARENT = (2500, 200, ("\n\n", "\n", ". "), "start")
CHILD = (350, 50, ("\n\n", "\n", ". ", "? ", "! ", " ", ""), "end")


def pieces(text: str, separator: str, keep: str) -> list[str]:
    """The text cut at a separator, which goes to the piece that follows it, or (keep="end") to the one before."""
    if not separator:
        return list(text)
    parts = text.split(separator)
    glued = [p + separator for p in parts[:-1]] + parts[-1:] if keep == "end" else parts[:1] + [separator + p for p in parts[1:]]
    return [p for p in glued if p]


def gathered(parts: Sequence[str], size: int, overlap: int) -> Iterator[str]:
    """Neighbouring pieces up to `size` together; each chunk begins with as much of the last one as fits in `overlap`."""
    window: list[str] = []
    length = 0
    for part in parts:
        if window and length + len(part) > size:
            yield "".join(window).strip()
            while window and (length > overlap or length + len(part) > size):
                length -= len(window.pop(0))
        window.append(part)
        length += len(part)
    yield "".join(window).strip()


def split_text(text: str, size: int, overlap: int, separators: Sequence[str], keep: str) -> list[str]:
    """Chunks of at most `size` characters, if the separators allow: too long pieces are split by the separators that come later."""
    at = next((i for i, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    finer = separators[at + 1 :]
    out: list[str] = []
    small: list[str] = []
    for part in pieces(text, separators[at], keep):
        if len(part) < size:
            small.append(part)
            continue
        out += gathered(small, size, overlap)
        small = []
        out += split_text(part, size, overlap, finer, keep) if finer else [part.strip()]
    out += gathered(small, size, overlap)
    return [c for c in out if c]


def split_rows(corpus: DataFrame, keep: list[str], content: str, levels: Sequence[tuple]) -> DataFrame:
    """The columns `keep`, places p0, p1, ... of a chunk at each level, and `chunk`. A task takes text by text and gives rows away PIECE characters at a time, so it holds a batch of texts and no batch of chunks."""

    def chunks(text: str, left: Sequence[tuple]) -> Iterator[tuple]:
        for k, chunk in enumerate(split_text(text, *left[0])):
            if len(left) == 1:
                yield k, chunk
            else:
                yield from ((k, *more) for more in chunks(chunk, left[1:]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        for batch in batches:
            texts, kept = batch.column("text"), batch.select([c for c in batch.schema.names if c != "text"])
            rows, found, held = [], [], 0
            for i, text in enumerate(texts):
                for own in chunks(text.as_py() or "", levels):
                    rows.append(i)
                    found.append(own)
                    held += len(own[-1])
                    if held >= PIECE:
                        yield kept.take(pa.array(rows, pa.int64())), arrays_of(found)
                        rows, found, held = [], [], 0
            if rows:
                yield kept.take(pa.array(rows, pa.int64())), arrays_of(found)

    def arrays_of(found: list[tuple]) -> list[pa.Array]:
        *places, chunk = zip(*found, strict=True)
        return [*(pa.array(p, pa.int32()) for p in places), pa.array(chunk, pa.string())]

    added = "".join(f"p{i} int, " for i in range(len(levels))) + "chunk string"
    return carried(corpus, keep, {"text": F.col(content)}, added, work)


def hierarchy(corpus: DataFrame, index: str, topic: str, content: str) -> tuple[DataFrame, DataFrame]:
    """Parents (parent_id, topic, content) and children (id, parent_id, topic, chunked_content, null vectors)."""
    parent = F.concat_ws("_", "index", "p0").alias("parent_id")
    rows = corpus.select(F.col(index).alias("index"), F.col(topic).alias("topic"), F.col(content).alias("content"))
    parents = split_rows(rows, ["index", "topic"], "content", [PARENT]).select(parent, "topic", F.col("chunk").alias("content"))
    vector = F.lit(None).cast("array<float>")
    children = split_rows(rows, ["index", "topic"], "content", [PARENT, CHILD]).select(parent, "topic", "p1", F.col("chunk").alias("chunked_content"))
    return parents, children.select(F.concat_ws("_", "parent_id", "p1").alias("id"), "parent_id", "topic", "chunked_content", vector.alias("topic_vector"), vector.alias("chunked_content_vector"))


def fixed(c: Column, size: int) -> Column:
    """Runs of `size` characters."""
    return F.when(F.length(c) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.length(c), F.lit(1)) - 1) / size).cast("int")), lambda i: F.substring(c, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))
