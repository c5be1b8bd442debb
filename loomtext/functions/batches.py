"""What tasks do with Arrow batches: parts of equal keys as they come, the k best of each group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def spans(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Parts of the batches whose rows have equal keys, which are numbers, and these keys. A run that goes on in the next batch comes in several parts, so that no more than a batch is held."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(n, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(new).tolist(), n]
        for x, y in zip(starts, starts[1:], strict=False):
            yield tuple(c[x].item() for c in columns), batch.slice(x, y - x)


def best(row: np.ndarray, score: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """The places of the k largest scores of each row number; ties go to the smaller `own`."""
    order = np.lexsort((own, -score, row))
    r = row[order]
    begins = np.flatnonzero(np.append(True, r[1:] != r[:-1])) if len(r) else np.zeros(0, int)
    rank = np.arange(len(r)) - np.repeat(begins, np.diff(np.append(begins, len(r))))
    return order[rank < k]


def at_least_kth(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the scores of a matrix that are among the k largest of their row, with all that tie with the last of these; -inf never is."""
    if score.shape[1] > k:
        return np.nonzero((score >= np.partition(score, score.shape[1] - k, axis=1)[:, [score.shape[1] - k]]) & (score > -np.inf))
    return np.nonzero(score > -np.inf)


def column(name: str) -> Column:
    """The column of this name, whatever signs are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def carried(rows: DataFrame, keep: list[str], inputs: dict[str, Column], added: str, work: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, list[pa.Array]]]]) -> DataFrame:
    """The columns `keep` of rows, of any names and types, with those (`added`, as DDL) that work() makes of batches with the inputs: it yields rows of the batches with an array for each added column.

    Within the task kept columns have names of their own, so they meet neither the inputs nor what is added.
    """
    more = StructType.fromDDL(added).fields
    own = [f"__k{i}" for i in range(len(keep))]
    plain = rows.select(*(column(c).alias(k) for c, k in zip(keep, own, strict=True)), *(e.alias(c) for c, e in inputs.items()))
    kind = StructType([*(StructField(k, plain.schema[k].dataType) for k in own), *(StructField(f"__a{i}", f.dataType) for i, f in enumerate(more))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, arrays in work(batches):
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in own), *arrays], kind.names)

    return plain.mapInArrow(run, kind).select(*(F.col(k).alias(c) for k, c in zip(own, keep, strict=True)), *(F.col(f"__a{i}").alias(f.name) for i, f in enumerate(more)))
