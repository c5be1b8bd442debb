"""A cursor over a table by keys: pages that can be asked for one after another, or from any token on, by any process."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that one task puts in order, at most (more only where keys repeat), and keys that a sample of the rest has, about.
FEW, SAMPLE = 20_000, 4096


@dataclass
class Cursor:
    """Pages of `size` rows in order of these columns (nulls first), which together are different for every row.

    A page is a filter on the columns, so nothing is held open, and a table that ranged() has
    written is read from the page on. A token is the last row's key as text.
    """

    rows: DataFrame
    order: list[str]
    size: int = 1000

    def _after(self, token: str) -> Column:
        """Rows whose key is larger."""
        kinds = [self.rows.schema[c].dataType for c in self.order]
        values = [None if v is None else F.lit(v).cast(k) for v, k in zip(json.loads(token), kinds, strict=True)]
        either, equal = F.lit(False), F.lit(True)
        for c, v in zip(self.order, values, strict=True):
            own = F.col(c)
            larger = own.isNotNull() if v is None else F.coalesce(own > v, F.lit(False))
            either, equal = either | (equal & larger), equal & own.eqNullSafe(F.lit(None) if v is None else v)
        return either if values[0] is None else (F.col(self.order[0]) >= values[0]) & either  # the first part reaches the scan

    def _upto(self, token: str) -> Column:
        """Rows whose key is not larger."""
        first, v = F.col(self.order[0]), json.loads(token)[0]
        near = first.isNull() if v is None else first.isNull() | (first <= F.lit(v).cast(self.rows.schema[self.order[0]].dataType))
        return near & ~self._after(token)

    def _keys(self, rows: DataFrame) -> tuple[DataFrame, Column, list[Column]]:
        """Only the keys, a key as text, and the order."""
        return rows.select(*self.order), F.struct(*(F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(self.order))).alias("key"), [F.asc_nulls_first(c) for c in self.order]

    def _end(self, left: DataFrame, n: int, size: int) -> str:
        """The key of row number `size` (from 1) of the n rows that are left, by counts: a sample gives two keys that enclose it, the rows up to them are counted, and so on until few are between."""
        for salt in range(20):
            if n <= FEW:
                break
            keys, key, order = self._keys(left)
            some = keys.where(F.pmod(F.xxhash64(F.lit(salt), *self.order), F.lit(max(1, n // SAMPLE))) == 0).orderBy(*order).select(key).collect()
            if not some:
                continue
            at, margin = len(some) * size // n, 4 * int(len(some) ** 0.5) // 2 + 1
            low, high = (json.dumps(list(some[k]["key"])) if 0 <= k < len(some) else None for k in (at - margin, at + margin))
            below, upto = (F.lit(k) if t is None else F.count_if(self._upto(t)) for t, k in ((low, 0), (high, n)))
            counts = left.agg(F.count("*").alias("n"), below.cast("long").alias("low"), upto.cast("long").alias("high")).first()
            if counts["low"] >= size:
                left, n = left.where(self._upto(low)), counts["low"]
            elif counts["high"] < size:
                left, n, size = left.where(self._after(high)), n - counts["high"], size - counts["high"]
            else:
                left = left if low is None else left.where(self._after(low))
                left = left if high is None else left.where(self._upto(high))
                n, size = counts["high"] - counts["low"], size - counts["low"]
        keys, key, order = self._keys(left)
        return json.dumps(list(keys.orderBy(*order).limit(size).agg(F.max_by(key, F.struct(*self.order)).alias("key")).first()["key"]))

    def page(self, token: str | None = None) -> tuple[DataFrame, str | None]:
        """The rows after the token (None: the first ones), in order, and the token of the next page; None where this one is the last.

        Of a page of more than FEW rows the last key is found by counting, and the page is all rows up to it, so that no task takes a whole page.
        """
        left, order = self.rows if token is None else self.rows.where(self._after(token)), [F.asc_nulls_first(c) for c in self.order]
        if self.size > FEW:
            n = left.count()
            end = self._end(left, n, self.size) if n >= self.size else None
            return (left if n <= self.size else left.where(self._upto(end))).orderBy(*order), end
        page = left.orderBy(*order).limit(self.size)
        key, by = self._keys(page)[1], F.struct(*self.order)
        end = page.agg(F.max_by(key, by).alias("key"), F.count("*").alias("n")).first()  # one row
        return page, json.dumps(list(end["key"])) if end["n"] == self.size else None

    def pages(self, token: str | None = None) -> Iterator[DataFrame]:
        while True:
            page, token = self.page(token)
            yield page
            if token is None:
                return


def ranged(rows: DataFrame, order: list[str], path: str) -> DataFrame:
    """The rows written by ranges of these columns and in order within, so that a page reads the files and row groups that it is in."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)

