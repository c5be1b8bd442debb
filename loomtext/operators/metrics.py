"""Metrics of predictions and comparisons of models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def correct(answer: Column, predicted: Column) -> Column:
    """Whether both are the same integer; false where one is none."""
    return F.coalesce(answer.cast("string").try_cast("int") == predicted.cast("string").try_cast("int"), F.lit(False))


def accuracy(df: DataFrame, ok: Column, *by: str) -> DataFrame:
    """n and accuracy in percent; 0 for no rows."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(F.round(F.avg(ok.cast("double")) * 100, 6), F.lit(0.0)).alias("accuracy"))


def confusion(df: DataFrame, true: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(true).alias("true"), F.col(predicted).alias("pred")).agg(F.count("*").alias("n"))


def report(df: DataFrame, true: str, predicted: str) -> DataFrame:
    """Per class (any that is true or predicted somewhere): support, predicted, tp, precision, recall, f1; 0 on a zero denominator."""
    cells = confusion(df, true, predicted)
    hit = F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0)
    per = cells.select(F.explode(F.array(F.struct(F.col("true").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), hit.cast("long").alias("tp")),
                                         F.struct(F.col("pred").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("tp")))).alias("x")).select("x.*")
    per = per.groupBy("class").agg(*(F.sum(c).alias(c) for c in ("support", "predicted", "tp")))
    p, r = F.coalesce(F.try_divide("tp", "predicted"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), F.col("support") + F.col("predicted")), F.lit(0.0))
    return per.select("*", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def macro_f1(df: DataFrame, true: str, predicted: str) -> DataFrame:
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), F.col("support") + F.col("predicted")), F.lit(0.0))
    return report(df, true, predicted).agg(F.round(F.avg(f1), 6).alias("macro_f1"), F.count("*").alias("classes"))


def shares(df: DataFrame, column: str, out: str) -> DataFrame:
    counts = df.groupBy(F.col(column).alias("class")).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("all")))).select("class", (F.col("n") / F.col("all") * 100).alias(out))


def position_bias(df: DataFrame, true: str, predicted: str) -> DataFrame:
    """Predicted share less true share of each class, in points."""
    both = shares(df, true, "true_share").join(shares(df, predicted, "pred_share"), "class", "full_outer").na.fill(0.0, ["true_share", "pred_share"])
    return both.select("class", F.round("true_share", 6).alias("true_share"), F.round("pred_share", 6).alias("pred_share"), F.round(F.col("pred_share") - F.col("true_share"), 6).alias("bias"))


def length_bins(df: DataFrame, length: str, ok: Column, width: int = 100) -> DataFrame:
    """Bins [lo, lo + width): n, mean length, correct, rate in percent; empty ones don't occur."""
    lo = (F.floor(F.col(length) / width) * width).cast("long")
    per = df.groupBy(lo.alias("lo")).agg(F.count("*").alias("n"), F.round(F.avg(length), 6).alias("mean_length"), F.count_if(ok).alias("n_correct"))
    return per.select(F.concat_ws("~", "lo", F.col("lo") + width).alias("bin"), "lo", "n", "mean_length", "n_correct", F.round(F.col("n_correct") / F.col("n") * 100, 6).alias("rate"))


def histogram(df: DataFrame, column: str, status: str, bins: int = 20) -> DataFrame:
    """(status, bin, n): equal bins from the smallest to the largest value, which is in the last one; empty ones don't occur."""
    ends = df.agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"))
    at = F.floor((F.col(column) - F.col("__lo")) * bins / F.greatest(F.col("__hi") - F.col("__lo"), F.lit(1)))
    rows = df.crossJoin(F.broadcast(ends)).select(F.col(status).alias("status"), F.least(F.lit(bins - 1), at).cast("int").alias("bin"))
    return rows.groupBy("status", "bin").agg(F.count("*").alias("n"))


def compare(first: Column, second: Column) -> Column:
    """Which of two models is right."""
    return F.when(first & second, "both").when(first, "only_1").when(second, "only_2").otherwise("neither")


def low_cardinality(df: DataFrame, ignore: tuple[str, ...] = (), fewer: int = 50) -> DataFrame:
    """Columns with fewer distinct values than this, in one pass."""
    columns = [c for c in df.columns if c not in ignore]
    one = df.agg(*(F.count_distinct(c).alias(c) for c in columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("n_distinct")) for c in columns))).alias("x")).select("x.*").where(F.col("n_distinct") < fewer)


def missing_profile(df: DataFrame) -> DataFrame:
    """Nulls of each column."""
    one = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("n_missing")) for c in df.columns))).alias("x")).select("x.*")


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson's r of each pair, over the rows where both are known."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = df.agg(*(F.corr(F.when(F.col(b).isNotNull(), F.col(a).cast("double")), F.when(F.col(a).isNotNull(), F.col(b).cast("double"))).alias(f"{a}|{b}") for a, b in pairs))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.col(f"{a}|{b}"), 6).alias("r")) for a, b in pairs))).alias("x")).select("x.*")


def standardised(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less their mean over their population deviation; constants give 0."""
    one = df.agg(*(F.avg(c).alias(f"__m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"__s_{c}") for c in columns))
    rows = df.crossJoin(F.broadcast(one))
    return rows.withColumns({c: F.when(F.col(f"__s_{c}") > 0, (F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}")).otherwise(0.0) for c in columns}).select(df.columns)


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """The number-th page (from 1)."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def class_table(df: DataFrame, true: str, predicted: str) -> DataFrame:
    """report() with each class's share of all rows and its accuracy (right among those of the class), in percent."""
    rows = report(df, true, predicted)
    return rows.crossJoin(F.broadcast(rows.agg(F.sum("support").alias("all")))).select(
        *rows.columns, F.round(100 * F.coalesce(F.try_divide("support", "all"), F.lit(0.0)), 6).alias("share"), F.round(100 * F.coalesce(F.try_divide("tp", "support"), F.lit(0.0)), 6).alias("accuracy"))


def group_means(df: DataFrame, by: str, columns: list[str], digits: int = 6) -> DataFrame:
    """Mean of each column over the rows of each group where it is known, and n, its rows."""
    return df.groupBy(by).agg(F.count("*").alias("n"), *(F.round(F.avg(c), digits).alias(c) for c in columns))


def total_items(df: DataFrame, groups: str) -> DataFrame:
    """One row, `total`: elements of an array column over all rows; null arrays have none."""
    return df.agg(F.coalesce(F.sum(F.coalesce(F.when(F.col(groups).isNotNull(), F.size(groups)), F.lit(0))), F.lit(0)).cast("long").alias("total"))


def quadrant(x: Column, y: Column, at_x: float = -3.5, at_y: float = 2.0) -> Column:
    return F.concat(F.when(x >= at_x, "right").otherwise("left"), F.lit("_"), F.when(y >= at_y, "high").otherwise("low"))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
