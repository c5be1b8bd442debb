"""WARC archives with revisit records: payloads that were seen before are not stored again.

Only headers (id, digest, size) are shuffled by payload digest. Records whose payload is that of an earlier one become
revisits of it. Archives are written by Spark's own text writer, whose line separator is the one that ends a record: a row
is a header, an empty line and a block. They go to the shared folder, and are read back file by file by their content
lengths. A file is one gzip stream (Spark's writer has no member a record), so it is read from its beginning.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtext.llm.shared import shared_dir, stored

#: Payloads with fewer bytes are always stored.
LEAST = 100
#: Payload bytes of an archive, about, where there is enough for all tasks; else as many archives as shuffles have parts, but of
#: LITTLE bytes at least. A file is read back as one row, so it must fit into a task several times.
ARCHIVE, LITTLE = 256 << 20, 8 << 20
#: Bytes of a file that are unzipped at once.
CHUNK = 1 << 18
END = b"\r\n\r\n"
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def resolved(headers: DataFrame, least: int = LEAST) -> DataFrame:
    """Of each revisit record: page_id and the response it refers to. headers: page_id, payload_digest, payload_bytes.

    Of records with equal payloads of at least `least` bytes, the one with the smallest page_id is the response. Rows that
    repeat this page_id are responses too. Records without page_id are never revisits.
    """
    large = headers.where(F.col("payload_bytes") >= least)
    firsts = large.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return large.join(firsts, "payload_digest").where("page_id > refers_to").select("page_id", "payload_digest", "refers_to").distinct()


def write(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes one record per row of pages (page_id, url, html) below `path`: gzip files of whole records.

    A response's block is an HTTP head and the payload. Record ids are urn:page:, the page_id (or, where it is null, ~ and a
    hash of the row), the beginning of the payload's digest and, for rows that repeat both, their number.
    """
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    # rows without page_id are dealt by what is in them
    rows = rows.withColumn("deal", F.coalesce(F.col("page_id").cast("long"), F.xxhash64("url", "html")))
    digest, size = F.sha2(F.encode("html", "utf-8"), 256).alias("payload_digest"), F.octet_length("html").cast("long").alias("payload_bytes")
    headers = stored(rows.select("page_id", digest, size))
    total = headers.agg(F.sum("payload_bytes")).first()[0] or 0
    # both sides are dealt alike, by page_id to as many parts as there are archives, so that payloads are shuffled once
    tasks = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    archives = max(1, -(-total // ARCHIVE), min(tasks, -(-total // LITTLE)))
    rows = rows.repartition(archives, "deal").withColumn("payload_digest", digest)
    again = resolved(headers).withColumn("deal", F.col("page_id").cast("long")).repartition(archives, "deal")
    again = again.groupBy("deal").agg(F.map_from_entries(F.collect_set(F.struct("payload_digest", "refers_to"))).alias("firsts"))
    rows = rows.join(again, "deal", "left").withColumn("refers_to", F.when(F.col("page_id").isNotNull(), F.try_element_at("firsts", "payload_digest")))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("deal", "page_id", "payload_digest").orderBy("url")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    record = lambda i, nth: F.concat(F.lit("<urn:page:"), i, F.lit(":"), F.substring("payload_digest", 1, 16), nth, F.lit(">"))
    own = F.when(F.col("page_id").isNull(), F.concat(F.lit("~"), F.hex("deal"))).otherwise(F.col("page_id").cast("string"))
    revisit = F.col("refers_to").isNotNull()
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit("\r\n\r\n"))
    rows = rows.withColumn("block", F.when(revisit, F.lit("")).otherwise(F.concat(head, "html")))
    text = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", record(own, F.when(F.col("nth") > 1, F.concat(F.lit(":"), F.col("nth").cast("string"))).otherwise(""))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "%0A")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
        F.when(revisit, F.concat(line("WARC-Refers-To", record(F.col("refers_to").cast("string"), F.lit(""))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length("block").cast("string")),
        F.lit("\r\n"),
        F.col("block"),
    )
    rows.select(text.alias("value")).write.option("lineSep", END.decode()).option("compression", "gzip").text(path)


def page_of(record: str | None) -> int | None:
    """The page_id in a record id."""
    own = record.split(":")[2] if record else "~"
    return None if own.startswith("~") else int(own)


def unzipped(data: bytes) -> Iterator[bytes]:
    """A gzip file part by part, of one member or of one for each record."""
    plain = zlib.decompressobj(31)
    for k in range(0, len(data), CHUNK):
        part = data[k : k + CHUNK]
        while part:
            yield plain.decompress(part)
            part = plain.unused_data
            if plain.eof:
                plain = zlib.decompressobj(31)
    yield plain.flush()


def parse(data: bytes) -> Iterator[tuple]:
    """(page_id, type, digest, refers_to, payload bytes, record id) of each record of a gzip file. A response's digest is made anew from its payload.

    What is held is about a record and CHUNK bytes; a large record is looked at when it is all there, so time grows with the file, not with its square.
    """
    buffer, seen, head, size = bytearray(), 0, None, 0
    for part in unzipped(data):
        buffer += part
        at = 0
        while True:
            if head is None:
                end = buffer.find(END, at + seen)
                if end < 0:
                    seen = max(0, len(buffer) - at - len(END) + 1)  # no head ends before
                    break
                head = dict(x.split(": ", 1) for x in buffer[at:end].decode().split("\r\n")[1:])
                seen, size = end - at, int(head["Content-Length"])
            if len(buffer) - at < seen + 8 + size:
                break
            block = bytes(buffer[at + seen + 4 : at + seen + 4 + size])
            payload = block.partition(END)[2]  # after the HTTP head
            digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
            if head["WARC-Type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError(f"the payload of {head['WARC-Record-ID']} is damaged")
            yield page_of(head["WARC-Record-ID"]), head["WARC-Type"], digest, page_of(head.get("WARC-Refers-To")), len(payload), head["WARC-Record-ID"]
            at += seen + 8 + size
            seen, head = 0, None
        del buffer[:at]
    if buffer:
        raise ValueError("an archive ends within a record")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per record: page_id, record_type, payload_digest, refers_to, stored_bytes, record_id. A file is a row, of about ARCHIVE bytes before compression."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                rows = list(parse(data.as_py())) if len(data.as_py()) else []
                columns = list(zip(*rows, strict=True)) or [[]] * 6
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "record_type", "payload_digest", "refers_to", "stored_bytes", "record_id"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(work, "page_id long, record_type string, payload_digest string, refers_to long, stored_bytes long, record_id string")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the archives and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A null html is an empty payload; each row gives a record. A revisit's size is that of the response it refers to, found
    by its digest; the responses' sizes are aggregated by digest first, so a payload with very many revisits is one row there.
    Rows that repeat a page_id are records of their own. Columns of pages other than page_id, url and html play no part, whatever their names.
    An empty table gives no rows. A payload may be as large as a string of Spark's.
    """
    path = shared_dir(pages.sparkSession)
    write(pages, path)
    records = stored(read(pages.sparkSession, path))
    revisits = records.where("record_type = 'revisit'")
    sizes = records.where("record_type = 'response'").join(revisits.select("payload_digest").distinct(), "payload_digest", "left_semi").groupBy("payload_digest").agg(F.max("stored_bytes").alias("payload_bytes"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return revisits.join(sizes, "payload_digest").select(columns).unionByName(records.where("record_type = 'response'").withColumnRenamed("stored_bytes", "payload_bytes").select(columns))
