"""Sources and sinks, each with a declared schema."""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from loomtext.sources.scratch import stored

QUESTIONS = "id string, paragraph string, problems string, subject string"
PROBLEM = "question string, choices array<string>, answer int, question_plus string"
CORPUS = "index long, topic string, content string"
PARENT_DOC = "doc_id string, subject string, topic string, parent_text string, topic_vector array<float>, parent_vector array<float>, version string, created_at timestamp"
CHUNK_DOC = "chunk_id string, doc_id string, subject string, topic string, chunk_idx int, chunk_text string, chunk_vector array<float>, start_char int, end_char int, version string, created_at timestamp"


def only_if_absent(e: AnalysisException) -> None:
    """Raises anything but the error that a path doesn't exist."""
    if e.getCondition() != "PATH_NOT_FOUND":
        raise e


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """RFC quoting; cells may span lines."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def csv_or_empty(spark: SparkSession, path: str, schema: str, index: str = "_c0") -> DataFrame:
    """A CSV whose first column is an index, which is dropped; an empty table if there is no such file."""
    plain = StructType.fromDDL(schema)
    try:
        return csv(spark, path, f"`{index}` string, {schema}").drop(index)
    except AnalysisException as e:
        only_if_absent(e)
        return spark.createDataFrame([], plain)


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Strict: a malformed line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def jsonl_lenient(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Blank and malformed lines are skipped; a missing file is an empty table."""
    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException as e:
        only_if_absent(e)
        return spark.createDataFrame([], StructType.fromDDL(schema))


def jsonl_in_order(spark: SparkSession, path: str, schema: str | StructType, line: str = "line") -> DataFrame:
    """JSON lines with a column that orders them as they were written: by the time and name of the file, then by place in it."""
    rows = spark.read.schema(schema).json(path)
    at = F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    return rows.select(*rows.columns, at.alias(line))


def splits(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """All splits of a data set."""
    return spark.read.parquet(*paths)


def rows_of(df: DataFrame) -> Iterator[Row]:
    """A cursor: one partition at a time is on the driver."""
    return df.toLocalIterator()


def by_id(df: DataFrame, key: str, value) -> Row | None:
    return df.where(F.col(key) == F.lit(value)).limit(1).first()


def by_ids(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows with these ids; missing ones are left out."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def children(df: DataFrame, parent: str, value, order: str = "chunk_idx", most: int = 1000) -> DataFrame:
    return df.where(F.col(parent) == F.lit(value)).orderBy(order).limit(most)


def listed(spark: SparkSession, folder: str, pattern: str = "*.csv") -> list[str]:
    """Sorted names of the files that fit; none if there is no such folder."""
    try:
        rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path").collect()
    except AnalysisException as e:
        only_if_absent(e)
        return []
    return sorted(r["path"].rsplit("/", 1)[-1] for r in rows)


def parsed_problem(c: Column, strict: bool = True) -> Column:
    """The struct in a Python literal. Strict: anything else, or no question or choices, is an error; else it gives null."""

    @F.pandas_udf(PROBLEM)
    def parse(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            try:
                d = ast.literal_eval(t)
                row = (str(d["question"]), [str(x) for x in d["choices"]], None if d.get("answer") in (None, "") else int(d["answer"]), d.get("question_plus"))
            except (ValueError, SyntaxError, TypeError, KeyError, AttributeError, MemoryError):
                if strict:
                    raise ValueError(f"not a problem: {str(t)[:80]!r}") from None
                row = (None, None, None, None)
            out.append(row)
        return pd.DataFrame(out, columns=["question", "choices", "answer", "question_plus"], dtype=object)

    found = parse(c)
    return found if strict else F.when(found["question"].isNotNull(), found)


def numbered_rows(df: DataFrame, order: Sequence[str], out: str = "index") -> DataFrame:
    """A 0-based index in this order: ranges of rows are counted, and numbered within. The rows are stored once with their range, as Spark samples the bounds anew whenever it ranges rows."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    rows = ranged.withColumn("__at", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    ends = ranged.groupBy("__part").agg(F.count("*").alias("__n"))  # a row a range
    before = ends.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return rows.join(F.broadcast(before), "__part").withColumn(out, (F.col("__at") + F.col("__before") - 1).cast("long")).drop("__part", "__at", "__before")


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """White space at the ends of cells stays."""
    writer = (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_csv_indexed(df: DataFrame, path: str, order: Sequence[str], index: str = "index") -> None:
    """As write_csv, with a 0-based index in this order as the first column."""
    write_csv(numbered_rows(df, order, index).select(index, *df.columns), path)


def write_json_array(df: DataFrame, path: str) -> None:
    """Each file is one JSON array of records (json_array() reads it); null fields are left out."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the last record so far: a comma follows it if another does
        for part in parts:
            records = part["record"].tolist()
            if records:
                before = ["["] if held is None else [f"{held},"]
                yield pd.DataFrame({"value": before + [f"{r}," for r in records[:-1]]})
                held = records[-1]
        yield pd.DataFrame({"value": ["[]"] if held is None else [held, "]"]})

    df.select(F.to_json(F.struct(*df.columns)).alias("record")).mapInPandas(work, "value string").write.mode("overwrite").text(path)


def clear(spark: SparkSession, paths: Sequence[str]) -> None:
    """Empties logs: what is read from them afterwards has no rows."""
    for path in paths:
        spark.createDataFrame([], "value string").write.mode("overwrite").text(path)


def shorter_than(df: DataFrame, text: str, most: int, count: Callable[[str], int]) -> DataFrame:
    """The rows whose text has at most so many tokens, as `count` (of one text; it goes to the tasks) tells them; in Arrow batches."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part[part[text].map(lambda x: count(x or "") <= most).astype(bool)]

    return df.mapInPandas(work, df.schema)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """Null fields are left out; characters beyond ASCII stay."""
    if append and df.isEmpty():
        return
    df.write.mode("append" if append else "overwrite").json(path)


def write_summary(df: DataFrame, path: str, **facts: Column) -> None:
    """One row: the number of rows, and these aggregates."""
    df.agg(F.count("*").alias("rows"), *(c.alias(n) for n, c in facts.items())).coalesce(1).write.mode("overwrite").json(path)


def validated(df: DataFrame, required: Sequence[str]) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
