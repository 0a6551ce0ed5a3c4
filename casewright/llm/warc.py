"""Web archives: transactions written as WARC records, read back and assembled.

``write`` turns every page into one transaction, a request, a response (or a revisit of an equal payload)
and a metadata record that name each other in ``WARC-Concurrent-To``, and lets Spark's text writer lay
them down, as many archives as there are write tasks. ``records`` reads archives, its own or others', by
Spark's text reader, which cuts the stream at the version line, so plain archives are split over tasks and
nothing larger than a record is held. ``captures`` joins the records of a transaction through their
identifiers into one nested row per capture and lets revisits find what they refer to.

A payload may hold version lines or whole records: where a record is shorter than its Content-Length says,
the pieces of that archive are put together again in order (``_rejoined``).

Rows: a null payload is an empty one. Rows without a page_id are captures of their own, behind all others
when the earliest of equal payloads is asked for; of repeated rows one is the response. An empty table gives
an archive without records. Columns other than page_id, url and html are not written.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.scratch import Scratch

VERSION, CRLF = "WARC/1.1", "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SOFTWARE = "casewright"
#: A fixed date keeps archives of one table equal byte by byte; callers give their own.
DATE = "2024-01-01T00:00:00Z"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    """The SHA-1 of ``data`` in the base 32 of RFC 4648, upper case; 160 bits need no padding."""
    digest = F.sha1(data)
    # ten hexadecimal digits are eight letters of five bits
    forty = F.array(*(F.conv(F.substring(digest, 10 * k + 1, 10), 16, 10).cast("long") for k in range(4)))
    letters = F.array_join(F.transform(forty, lambda x: F.concat(*(F.substring(F.lit(BASE32), F.shiftright(x, 35 - 5 * k).bitwiseAND(31).cast("int") + 1, F.lit(1)) for k in range(8)))), "")
    return F.when(data.isNotNull(), letters)


def first_of_equal(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``pages`` (row_id, page_id, payload) with ``first``, the row_id of the smallest page_id of an equal payload.

    Null where the payload is the first of its kind, the only one, or shorter than ``least_bytes``. Only keys
    move to find the groups; a payload that a third of all pages share is one partial aggregate per task and
    a side of one row in the join, whose other side Spark may split.
    """
    key = F.sha2("payload", 256)
    slim = pages.where(F.octet_length("payload") >= least_bytes).select(key.alias("same"), F.struct(F.col("page_id").isNull().alias("unnamed"), "page_id", "row_id").alias("at"))
    groups = slim.groupBy("same").agg(F.min("at").alias("at"), F.count("*").alias("n")).where("n > 1").select("same", F.col("at.row_id").alias("first"))
    joined = pages.withColumn("same", F.when(F.octet_length("payload") >= least_bytes, key)).join(groups, "same", "left").drop("same")
    return joined.withColumn("first", F.when(F.col("first") != F.col("row_id"), F.col("first")))


def _record(kind: str, fields: list[tuple[str, Column]], block: Column) -> Column:
    """One record without the two empty lines behind it; fields of null value are left out."""
    lines = [F.concat(F.lit(f"{name}: "), value) for name, value in [("WARC-Type", F.lit(kind)), *fields, ("Content-Length", F.octet_length(block).cast("string"))]]
    head = F.concat(F.concat_ws(CRLF, F.lit(VERSION), *lines), F.lit(CRLF * 2))
    return F.concat(head.cast("binary"), block)


def write(pages: DataFrame, path: str, least_bytes: int = 0, date: str = DATE, compression: str = "gzip") -> None:
    """Write ``pages`` (page_id, url, html as text or binary) as archives below ``path``.

    Equal payloads of ``least_bytes`` or more are written once; the others revisit the one of smallest page_id.
    Identifiers follow from the place of a row in its table, so a task that runs again writes the same ones.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"), F.monotonically_increasing_id().alias("row_id"))
    rows = first_of_equal(rows, least_bytes)

    def name(kind: str, row: str = "row_id") -> Column:
        digest = F.md5(F.concat(F.lit(f"{kind}:"), F.col(row).cast("string")))
        return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(digest, "^(.{8})(.{4}).(.{3}).(.{3})(.{12})$", "$1-$2-5$3-8$4-$5"), F.lit(">"))

    digest = F.concat(F.lit("sha1:"), base32_sha1(F.col("payload")))
    # a line break would end the field, so such a url is not fit for one; metadata holds the page's own
    target = F.when(~F.col("url").rlike(r"[\r\n]"), F.col("url"))
    common = [("WARC-Target-URI", target), ("WARC-Date", F.lit(date))]
    host, rest = F.regexp_extract("url", "^[^:]*://([^/?#]*)", 1), F.regexp_extract("url", "^[^:]*://[^/?#]*([^#]*)", 1)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit(CRLF * 2)).cast("binary")
    asked = F.coalesce(F.concat(F.lit("GET "), F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(CRLF * 2)), F.lit("GET / HTTP/1.1" + CRLF * 2)).cast("binary")
    told = F.concat_ws(CRLF, F.concat(F.lit("page-id: "), F.col("page_id").cast("string")), F.concat(F.lit("url-base64: "), F.base64(F.col("url").cast("binary"))), F.lit(f"software: {SOFTWARE}"), F.lit("")).cast("binary")
    again = F.col("first").isNotNull()
    content = [("WARC-Record-ID", name("response")), *common, ("WARC-Payload-Digest", digest), ("Content-Type", F.lit("application/http; msgtype=response"))]
    response = _record("response", content, F.concat(http, "payload"))
    revisit = _record("revisit", [*content, ("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", name("response", "first"))], http)
    request = _record("request", [("WARC-Record-ID", name("request")), *common, ("WARC-Concurrent-To", name("response")), ("Content-Type", F.lit("application/http; msgtype=request"))], asked)
    metadata = _record("metadata", [("WARC-Record-ID", name("metadata")), *common, ("WARC-Concurrent-To", name("response")), ("Content-Type", F.lit("application/warc-fields"))], told)
    lines = rows.select(F.explode(F.array(request, F.when(again, revisit).otherwise(response), metadata)).alias("record")).select(F.col("record").cast("string").alias("value"))
    lines.write.option("lineSep", CRLF * 2).option("compression", compression).text(path)


def _split_head(piece: Column) -> tuple[Column, Column]:
    """The head of a piece behind its version line, and its bytes from the block on."""
    text = piece.cast("string")
    ends = F.instr(text, CRLF * 2)
    head = F.when(ends > 0, F.substring(text, F.lit(1), ends - 1)).otherwise(text)
    return head, F.when(ends > 0, F.substring(piece, F.octet_length(head) + 5, F.octet_length(piece))).otherwise(F.lit(b""))


def _fields(head: Column) -> Column:
    return F.transform(F.split(head, CRLF), lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("name"), F.trim(F.regexp_replace(x, "^[^:]*:?", "")).alias("value")))


def _all(fields: Column, name: str) -> Column:
    return F.transform(F.filter(fields, lambda x: x["name"] == name), lambda x: x["value"])


def _rejoined(pieces: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces in the order of their archives, put together until each record has its length."""
    archive, held, wanted, out = None, [], None, []

    def length(piece: bytes) -> int | None:
        head, mark, _ = piece.partition(b"\r\n\r\n")
        for line in head.split(b"\r\n") if mark else ():
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"content-length" and value.strip().isdigit():
                return len(head) + 4 + int(value)
        return None

    for batch in pieces:
        for at, piece in zip(batch["archive"], batch["piece"], strict=True):
            piece = bytes(piece)
            if at != archive:
                archive, held, wanted = at, None, None  # what stands before the first version line is no record
                continue
            if held is None:
                held = [piece]
            else:
                held.append(piece)
            if wanted is None:
                whole = f"{VERSION}{CRLF}".encode().join(held)
                wanted, size = length(whole), len(whole)
                held = [whole]
            else:
                size += len(f"{VERSION}{CRLF}") + len(piece)
            if wanted is not None and size >= wanted:
                out.append((archive, f"{VERSION}{CRLF}".encode().join(held)[: wanted + 4]))
                held, wanted = None, None
        if out:
            yield pd.DataFrame(out, columns=["archive", "piece"])
            out = []


def records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives below ``path``, plain or compressed, with their fields and blocks.

    Archives whose records all have their length, which is nearly every one, are parsed by built-in functions.
    The pieces of the others go, in order, through a stream that holds one record at a time.
    """
    read = spark.read.option("lineSep", f"{VERSION}{CRLF}").text(path).select(F.col("_metadata.file_path").alias("archive"), F.col("_metadata.file_block_start").alias("block_start"), F.col("value").cast("binary").alias("piece"), F.monotonically_increasing_id().alias("n"))
    head, block = _split_head(F.col("piece"))
    length = F.get(_all(_fields(head), "content-length"), F.lit(0)).try_cast("long")
    short = (F.octet_length("piece") > 0) & ~F.coalesce(F.octet_length(block) == length + 4, F.lit(False))
    # a first piece is empty: it ends where the first version line begins
    whole = read.where(F.octet_length("piece") > 0).select("archive", "piece")
    broken = Scratch(spark, "broken").keep(read.where(short).select("archive").distinct(), "archives")
    if not broken.isEmpty():
        again = read.join(broken, "archive", "left_semi").repartition("archive").sortWithinPartitions("archive", "block_start", "n")
        again = again.select("archive", "piece").mapInPandas(_rejoined, "archive string, piece binary")
        whole = whole.join(broken, "archive", "left_anti").unionByName(again)
    fields = _fields(head)
    parsed = whole.select("archive", fields.alias("fields"), block.alias("block"))

    def one(name: str) -> Column:
        return F.get(_all(F.col("fields"), name), F.lit(0))

    return parsed.select(
        "archive", one("warc-record-id").alias("record_id"), one("warc-type").alias("kind"), _all(F.col("fields"), "warc-concurrent-to").alias("concurrent"), one("warc-refers-to").alias("refers_to"),
        one("warc-target-uri").alias("url"), one("warc-date").alias("date"), one("warc-payload-digest").alias("payload_digest"), F.substring("block", F.lit(1), one("content-length").cast("int")).alias("block"),
    )


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: its record, its payload, the requests and metadata that are concurrent to it.

    Columns: record_id, kind (response or revisit), url, date, payload_digest (without ``sha1:``), payload (of a
    revisit null), refers_to (the identifier a revisit names), requests and metadata (arrays of texts, in order;
    empty if none). A request or metadata record that names several captures belongs to each of them; one that
    names none, or a record that is not there, is left out, as are other kinds of records.
    """
    text = F.col("block").cast("string")
    ends = F.instr(text, CRLF * 2)
    cut = F.octet_length(F.substring(text, F.lit(1), ends - 1)) + 5
    main = records.where("kind IN ('response', 'revisit')").select(
        "record_id", "kind", "url", "date", F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"),
        F.when(F.col("kind") == "response", F.when(ends > 0, F.substring(F.col("block"), cut, F.octet_length("block"))).otherwise(F.lit(b""))).alias("payload"), F.when(F.col("kind") == "revisit", F.col("refers_to")).alias("refers_to"),
    )
    beside = records.where("kind IN ('request', 'metadata')").select(F.explode(F.array_distinct("concurrent")).alias("record_id"), "kind", text.alias("said"))
    beside = beside.groupBy("record_id").agg(*(F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.col("said")))).alias(name) for k, name in (("request", "requests"), ("metadata", "metadata"))))
    none = F.array().cast("array<string>")
    return main.join(beside, "record_id", "left").withColumns({"requests": F.coalesce("requests", none), "metadata": F.coalesce("metadata", none)})


def said(metadata: Column, name: str) -> Column:
    """The first value of a field in metadata records of a capture; null if there is none."""
    lines = F.flatten(F.transform(metadata, lambda x: F.split(x, CRLF)))
    return F.get(F.transform(F.filter(lines, lambda x: x.startswith(f"{name}: ")), lambda x: F.substring(x, len(name) + 3, 1 << 30)), F.lit(0))


def round_trip(pages: DataFrame, least_bytes: int = 0, compression: str = "gzip") -> DataFrame:
    """``pages`` written as archives in the shared scratch folder and read back, one row per page.

    Columns: page_id, url, record_type, payload_bytes and payload_digest (both computed from the payload that was
    read, a revisit's from the response it names), refers_to (that response's page_id), requests.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    path = scratch.path("archives")
    write(pages, path, least_bytes, compression=compression)
    page, url = said(F.col("metadata"), "page-id").cast("long"), F.unbase64(said(F.col("metadata"), "url-base64")).cast("string")
    found = captures(records(spark, path)).select("record_id", page.alias("page_id"), url.alias("url"), F.col("kind").alias("record_type"), F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"), "refers_to", "requests")
    found = scratch.keep(found, "captures")
    first = found.where("record_type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("named"), F.col("payload_bytes").alias("bytes"), F.col("payload_digest").alias("digest"))
    asked = found.where("record_type = 'revisit'").select("refers_to").distinct()
    resolved = found.join(first.join(asked, "refers_to", "left_semi"), "refers_to", "left")
    return resolved.select("page_id", "url", "record_type", F.coalesce("payload_bytes", "bytes").alias("payload_bytes"), F.coalesce("payload_digest", "digest").alias("payload_digest"), F.col("named").alias("refers_to"), "requests")
