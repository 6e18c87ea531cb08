"""WARC archives with revisit records.

Headers alone are shuffled by payload digest: the smallest id of a digest holds the payload (response), others revisit
it. Records are formatted and written by Spark's text writer, a record a row and a gzip file a task, so a task that runs
again leaves one file. The reader takes a file's lines in order and follows Content-Length, a record at a time, so
payloads may hold anything; revisit records then get the length of their original by a join on its record id.

Null payloads are empty. A null url is left out of the header, a control character or space in it is percent-coded. A
null id can't be named in an archive: such rows are an error. Rows of one id must have one payload (repeated rows are one
record each, with the same record id; of several payloads the archive would be ambiguous, and each is written). Very
long payloads are whole, but one record must fit in memory. An empty table gives an archive without records. Other
columns aren't archived.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cistern.sources.scratch import scratch_path, stage

# Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
ID = "urn:page:"
FIELDS = "record_id string, record_type string, page_id long, url string, payload_digest string, payload string, content_length long, refers_to long, refers_to_url string"


def sha1_base32(payload: Column) -> Column:
    """Base32 of the SHA-1 of a text in UTF-8: ten hex digits are eight of base 32."""
    digits = [F.lpad(F.conv(F.substring(F.sha1(payload), 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def resolve(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Originals (payload_digest, refers_to, refers_to_url) of digests that several records of at least min_bytes share."""
    of_size = headers.where(F.col("payload_bytes") >= min_bytes)
    first = of_size.groupBy("payload_digest").agg(F.min(F.struct("page_id", "url")).alias("o"), F.count("*").alias("n"))
    return first.where("n > 1").select("payload_digest", F.col("o.page_id").alias("refers_to"), F.col("o.url").alias("refers_to_url"))


def _record(line: dict[str, Column]) -> Column:
    """A record as a row of text; the writer adds the last line feed. Fields that are null are left out."""
    fields = [F.concat(F.lit(f"{k}: "), v, F.lit("\r\n")) for k, v in line.items()]
    return F.concat(F.lit(f"{VERSION}\r\n"), *(F.coalesce(f, F.lit("")) for f in fields), F.lit("\r\n"))


def write_archives(pages: DataFrame, path: str, payload: str = "html", page_id: str = "page_id", url: str = "url", min_bytes: int = 0) -> None:
    """A record for each row, payloads that several rows share once."""
    safe = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(url), "\r", "%0D"), "\n", "%0A"), " ", "%20")
    rows = pages.select(
        F.coalesce(F.col(page_id), F.raise_error(F.lit("a page without an id")).cast("long")).cast("long").alias("page_id"),
        safe.alias("url"),
        F.coalesce(F.col(payload), F.lit("")).alias("payload"),
    )
    rows = rows.withColumn("payload_digest", sha1_base32(F.col("payload"))).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    originals = stage(resolve(rows.drop("payload"), min_bytes), "originals")
    rows = rows.join(originals, "payload_digest", "left")
    # Repeated rows of an original's id are responses as well.
    revisits = F.coalesce((F.col("refers_to") != F.col("page_id")) & (F.col("payload_bytes") >= min_bytes), F.lit(False))
    kind = F.when(revisits, "revisit").otherwise("response")
    body = F.when(revisits, "").otherwise(F.col("payload"))
    head = _record(
        {
            "WARC-Type": kind,
            "WARC-Record-ID": F.concat(F.lit(f"<{ID}"), F.col("page_id").cast("string"), F.lit(">")),
            "WARC-Date": F.lit(DATE),
            "WARC-Target-URI": F.col("url"),
            "WARC-Payload-Digest": F.concat(F.lit("sha1:"), F.col("payload_digest")),
            "WARC-Refers-To": F.when(revisits, F.concat(F.lit(f"<{ID}"), F.col("refers_to").cast("string"), F.lit(">"))),
            "WARC-Refers-To-Target-URI": F.when(revisits, F.col("refers_to_url")),
            "WARC-Profile": F.when(revisits, PROFILE),
            "Content-Type": F.lit("text/html; charset=utf-8"),
            "Content-Length": F.octet_length(body).cast("string"),
        }
    )
    text = rows.select(F.concat(head, body, F.lit("\r\n\r")).alias("value"))
    text.write.option("lineSep", "\n").option("compression", "gzip").text(path)


def _parsed(lines: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, body) of the records in a run of lines that were ended by a line feed each."""
    for line in lines:
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not the begin of a record: {line[:60]!r}")
        head: dict[str, str] = {}
        for line in lines:
            if line in (b"\r", b""):
                break
            k, _, v = line.rstrip(b"\r").decode().partition(": ")
            head[k.lower()] = v
        left, parts = int(head.get("content-length", 0)), []
        while left > 0:
            part = next(lines, None)
            if part is None:
                raise ValueError("a record ends early")
            part += b"\n"
            parts.append(part[:left])
            if len(part) > left and part[left:] not in (b"\r\n", b"\n"):
                raise ValueError("a record is longer than its header says")
            left -= len(part)
        yield head, b"".join(parts)


def _number(name: str | None) -> int | None:
    return int(name.strip("<>").removeprefix(ID)) if name else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(f.split(" ")[0], pa.int64() if f.endswith("long") else pa.string()) for f in FIELDS.split(", ")])
    lines = (x.as_py().encode() for b in batches for x in b.column(0))
    rows, size = [], 0
    for head, body in _parsed(lines):
        name = head["warc-record-id"].strip("<>")
        rows.append(
            (name, head["warc-type"], _number(name), head.get("warc-target-uri"), head["warc-payload-digest"].removeprefix("sha1:"), body.decode(), len(body), _number(head.get("warc-refers-to")), head.get("warc-refers-to-target-uri"))
        )
        size += len(body)
        if size > 1 << 22 or len(rows) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of archives, with FIELDS. Gzip files aren't split, so each is read by one task in order."""
    return spark.read.option("lineSep", "\n").schema("value string").text(path).mapInArrow(_read, FIELDS)


def with_originals(records: DataFrame) -> DataFrame:
    """Records with payload_bytes: of a revisit that of the record it refers to; null where that is missing."""
    own = records.where("record_type = 'response'").groupBy(F.col("record_id").alias("original")).agg(F.max("content_length").alias("own_bytes"))
    revisited = records.where("refers_to is not null").select(F.concat(F.lit(ID), F.col("refers_to").cast("string")).alias("original")).distinct()
    sizes = own.join(revisited, "original", "left_semi")
    key = F.concat(F.lit(ID), F.col("refers_to").cast("string"))
    joined = records.withColumn("original", key).join(sizes, "original", "left").drop("original")
    return joined.withColumn("payload_bytes", F.when(F.col("record_type") == "revisit", F.col("own_bytes")).otherwise(F.col("content_length"))).drop("own_bytes")


def deduplicate(spark: SparkSession, source: str, target: str, min_bytes: int = 0) -> None:
    """Archives written anew: revisits of the source get their payload back, then shared payloads are kept once."""
    records = read_archives(spark, source)
    bodies = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("payload").alias("own"))
    pages = records.join(bodies.dropDuplicates(["refers_to"]), "refers_to", "left").select(
        "page_id", "url", F.when(F.col("record_type") == "revisit", F.col("own")).otherwise(F.col("payload")).alias("html")
    )
    write_archives(pages, target, min_bytes=min_bytes)


def archived(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url) as read back from archives of the pages.

    The digest of a response is that of the body that was read; a revisit's is that of its header.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, min_bytes=min_bytes)
    records = read_archives(spark, path)
    read = F.when(F.col("record_type") == "response", sha1_base32(F.col("payload"))).otherwise(F.col("payload_digest"))
    heads = stage(records.withColumn("payload_digest", read).drop("payload"), "headers")
    return with_originals(heads).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
