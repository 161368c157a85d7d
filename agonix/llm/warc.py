"""A content-addressed WARC archive.

Payload bytes are stored once, under their SHA-256, verified when written (all payloads of one digest must have the
same bytes) and again when read. Exact record headers are kept apart, one row per record. Original records come back
through a join of headers and payloads on the digest; what the query returns is parsed from the bytes of these records.

A payload of at least ``min_bytes`` is archived as a response by the record with the largest id that holds it, and as
a revisit, which refers to that response, by all others; smaller payloads are always responses. A payload of many
records is joined in shares of about ``_SHARE`` records each.

Defined cases: a null html counts as empty, a null url as an empty target; rows that share an id, equal ones too, are
records of their own, and of those with the largest id the one with the largest url, then row number, is the response;
a null id is the smallest; line ends in a url are percent-encoded in the header and decoded on reading; an empty table
makes an empty archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, small_batches, stored

_CRLF = "\r\n"
_SHARE = 1024  # records of one payload that meet in one join key
#: Fixed value: the profile of revisits by equal payload digest.
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEADER = _CRLF.join(["WARC/1.1", "WARC-Type: %s", "WARC-Record-ID: <%s>", "WARC-Date: %s", "WARC-Target-URI: %s", "WARC-Payload-Digest: sha1:%s", "%sContent-Type: text/html", "Content-Length: %s", "", ""])
_ESCAPED = re.compile("%0D|%0A|%25")


def _b32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def base32_of(sha1_hex: str):
    """The bare upper-case base32 of a column of hexadecimal digests."""
    return F.pandas_udf(lambda s: s.map(_b32, na_action="ignore"), "string")(sha1_hex)


def _escaped(url: str):
    """A url column on one line; a percent sign is escaped only where it would read as an escape of this kind."""
    out = F.regexp_replace(url, "%(?=0[AD]|25)", "%25")
    return F.replace(F.replace(out, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _unescaped(uri: str) -> str:
    return _ESCAPED.sub(lambda m: chr(int(m[0][1:], 16)), uri)


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0, date: str | None = None) -> None:
    """Write ``path``/headers and ``path``/payloads for pages (page_id, url, html); date: of the records, now by default."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url"), F.lit("")).alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha256", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))

    # The rows without payloads are stored, so a row keeps its number.
    heads = rows.select("page_id", "url", "sha256", base32_of(F.sha1("payload")).alias("payload_digest"), "payload_bytes")
    heads = stored(heads.withColumn("row", F.monotonically_increasing_id()), "heads")
    first = heads.groupBy("sha256").agg(F.max(F.struct("page_id", "url", "row")).alias("resp"), F.ceil(F.count(F.lit(1)) / _SHARE).alias("shares"))
    # A table, so that both sides of its join are plain shuffles, which are split where one digest is hot.
    first = stored(first.select("sha256", F.col("resp.page_id").alias("resp_page"), F.col("resp.row").alias("resp_row"), "shares"), "first")

    # Once per digest. min = max over the bytes proves that every payload of the digest is the stored one; both are
    # combined before the shuffle, so a payload that a third of the pages share moves once per task.
    payloads = rows.groupBy("sha256").agg(F.min("payload").alias("payload"), F.max("payload").alias("same"))
    payloads = payloads.select("sha256", "payload", F.when(F.col("payload") == F.col("same"), F.lit(True)).otherwise(F.raise_error(F.lit("two payloads share a SHA-256"))).alias("verified"))
    payloads.where("verified").select("sha256", "payload").write.parquet(f"{path}/payloads")
    first.where("shares > 1").select("sha256", "shares").write.parquet(f"{path}/shares")

    heads = heads.join(first.hint("merge"), "sha256")
    heads = heads.withColumn("record_type", F.when((F.col("payload_bytes") >= min_bytes) & (F.col("row") != F.col("resp_row")), "revisit").otherwise("response"))
    revisit = F.col("record_type") == "revisit"
    name = lambda page, row: F.concat(F.lit("urn:x-page:"), F.coalesce(F.col(page).cast("string"), F.lit("")), F.lit(":"), F.col(row).cast("string"))
    refers = F.when(revisit, F.concat(F.lit("WARC-Refers-To: <"), name("resp_page", "resp_row"), F.lit(f">{_CRLF}WARC-Profile: {_PROFILE}{_CRLF}"))).otherwise("")
    header = F.format_string(_HEADER, "record_type", name("page_id", "row"), F.lit(date), _escaped("url"), "payload_digest", refers, F.when(revisit, F.lit(0).cast("long")).otherwise(F.col("payload_bytes")))
    heads.select("sha256", F.pmod("row", "shares").alias("share"), header.alias("header")).write.parquet(f"{path}/headers")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records again: sha256, header, payload (of revisits too), verified against the digest."""
    heads = spark.read.parquet(f"{path}/headers")
    payloads = spark.read.parquet(f"{path}/payloads")
    payloads = payloads.withColumn("payload", F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload does not match its digest")).cast("binary")))
    # A payload of many records is there once per share.
    shares = spark.read.parquet(f"{path}/shares").select("sha256", F.explode(F.sequence(F.lit(1).cast("long"), F.col("shares") - 1)).alias("share"))
    more = payloads.join(shares, "sha256").select("sha256", "share", "payload")
    payloads = payloads.select("sha256", F.lit(0).cast("long").alias("share"), "payload").unionByName(more)
    return heads.join(payloads, ["sha256", "share"]).drop("share")


def records(archive: DataFrame) -> DataFrame:
    """``record``: the exact WARC record bytes, header, block and end; ``same``: the payload a revisit's empty block stands for."""
    revisit = F.col("header").contains(f"{_CRLF}WARC-Profile: {_PROFILE}{_CRLF}")
    block = F.when(revisit, F.lit("").cast("binary")).otherwise(F.col("payload"))
    return archive.select(F.concat(F.encode("header", "UTF-8"), block, F.lit(_CRLF * 2).cast("binary")).alias("record"), F.when(revisit, F.col("payload")).alias("same"))


def _page_of(name: str) -> int | None:
    """The page_id in a record's name, <urn:x-page:page_id:row>."""
    page = name.strip("<>").split(":")[2]
    return int(page) if page else None


def read_record(record: bytes, same: bytes | None = None) -> tuple:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url of one record's bytes; its length, end and
    payload digest must be as its header says. ``same``: the payload that a revisit refers to."""
    head, rest = record.split(b"\r\n\r\n", 1)
    fields = dict(x.split(": ", 1) for x in head.decode().split(_CRLF)[1:])
    size, name = int(fields["Content-Length"]), fields["WARC-Record-ID"]
    block, end = rest[:size], rest[size:]
    if len(block) != size or end != b"\r\n\r\n":
        raise ValueError(f"record {name}: not as long as its header says")
    payload = same if fields["WARC-Type"] == "revisit" else block
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if fields["WARC-Payload-Digest"] != f"sha1:{digest}":
        raise ValueError(f"record {name}: header and payload disagree")
    refers = _page_of(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None
    return _page_of(name), len(payload), digest, fields["WARC-Type"], refers, _unescaped(fields["WARC-Target-URI"])


def parsed(archive: DataFrame) -> DataFrame:
    """What the bytes of the records say: page_id, payload_bytes, payload_digest, record_type, refers_to, url."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [read_record(r.as_py(), s.as_py()) for r, s in zip(batch.column("record"), batch.column("same"), strict=True)]
            cols = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return records(archive).mapInArrow(run, schema)


def archive_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Archive the pages in the shared folder and read them back."""
    small_batches(pages.sparkSession)
    path = scratch(pages.sparkSession, "warc")
    write_archive(pages, path, min_bytes)
    return parsed(read_archive(pages.sparkSession, path))
