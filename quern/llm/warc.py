r"""WARC archives: written and read by Spark's text files, and records joined into captures.

A record ends with two line breaks, which is a line separator to the text writer, so tasks write
archives under Spark's commit protocol in any store that Spark reaches.  The reader splits at line
breaks before `WARC/1.`, so plain archives of any size are read in parallel and compressed ones as
streams; no archive is held whole.  Records whose content holds such a line itself are put together
again by their lengths.
"""

from __future__ import annotations

import uuid
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import discard, shared_dir, stored, table

#: Names and forms of the file format.
END, MARK = "\r\n\r\n", "\nWARC/1."
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: A record's own types, and those that others are concurrent to.
SIDES, MAINS = ("request", "metadata"), ("response", "revisit", "resource", "conversion")


def base32(hexed: Column) -> Column:
    """The base32 form of 20 bytes given as 40 hex digits: eight letters for each ten digits."""
    letters = []
    for k in range(4):
        number = F.conv(F.substring(hexed, 10 * k + 1, 10), 16, 10).cast("long")
        letters += [F.substring(F.lit(BASE32), F.shiftright(number, 35 - 5 * j).bitwiseAND(31).cast("int") + 1, F.lit(1)) for j in range(8)]
    return F.concat(*letters)


def _urn(run: str, number: Column, kind: str) -> Column:
    h = F.md5(F.concat_ws(" ", F.lit(run), number.cast("string"), F.lit(kind)))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _record(fields: list[tuple[str, Column]], block: Column) -> Column:
    """A record's text: null fields are left out, and its length comes last."""
    lines = [F.concat(F.lit(f"{name}: "), value) for name, value in fields]
    return F.concat(F.concat_ws("\r\n", F.lit("WARC/1.1"), *lines, F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))), F.lit(END), block)


def write(pages: DataFrame, folder: str, payload: str = "html", key: str = "page_id", url: str = "url", date: str = "2020-01-01T00:00:00Z", compression: str = "gzip") -> None:
    """Archives of pages in a new folder: for each row a request, a response or revisit, and a metadata record.

    The first row of each payload, by `key` (null last), is a response; the others revisit it and
    carry no payload.  Request and metadata name the response or revisit they are concurrent to.
    Metadata holds all columns but the payload as JSON, so every column comes back.  A null payload
    is an empty one; a null url gives a record without target (line breaks and spaces in one are
    percent-coded, the metadata keep it as it was); rows equal in all columns are captures of their
    own; an empty table gives no record.

    Rows are numbered as they are stored once; payloads meet in a shuffle of digests only, and the
    rows of repeated payloads, if many, come back by number, so copies gather nowhere.
    """
    run = uuid.uuid4().hex
    text = F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit(""))
    others = [F.col(f"`{c}`") for c in pages.columns if c != payload]
    rows = stored(pages.select(
        F.monotonically_increasing_id().alias("number"), F.col(f"`{key}`").alias("place"), F.col(f"`{url}`").cast("string").alias("address"), text.alias("payload"),
        base32(F.sha1(text)).alias("digest"), F.to_json(F.struct(*others), {"ignoreNullFields": "false"}).alias("kept"),
    ), "captures", "zstd")
    narrow = rows.select("number", "digest", F.struct(F.col("place").isNull().alias("none"), "place", "number").alias("rank"))
    heads = narrow.groupBy("digest").agg(F.min("rank").alias("head"), F.count("*").alias("n")).where("n > 1")
    again = stored(narrow.join(heads, "digest").where("number <> head.number").select("number", F.col("head.number").alias("head")), "revisits")
    known = rows.join(again, "number", "left")

    first = F.col("head").isNull()
    own = F.coalesce(F.when(first, _urn(run, F.col("number"), "response")), _urn(run, F.col("number"), "revisit"))
    coded = F.col("address")
    for c in (" ", "\r", "\n", "\t"):
        coded = F.replace(coded, F.lit(c), F.lit(f"%{ord(c):02X}"))
    host = F.regexp_extract(coded, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(coded, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    reply = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit(END))
    ask = F.concat(F.lit("GET "), F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END))
    common = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.when(coded != "", coded))]
    beside = [("WARC-Concurrent-To", own)]
    each = known.select(F.explode(F.array(
        _record([("WARC-Type", F.lit("request")), ("WARC-Record-ID", _urn(run, F.col("number"), "request")), *common, *beside, ("Content-Type", F.lit("application/http; msgtype=request"))], F.coalesce(ask, F.lit(f"GET / HTTP/1.1{END}"))),
        _record(
            [("WARC-Type", F.when(first, "response").otherwise("revisit")), ("WARC-Record-ID", own), *common, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
             ("WARC-Profile", F.when(~first, PROFILE)), ("WARC-Refers-To", F.when(~first, _urn(run, F.col("head"), "response"))), ("Content-Type", F.lit("application/http; msgtype=response"))],
            F.when(first, F.concat(reply, "payload")).otherwise(reply)),
        _record([("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", _urn(run, F.col("number"), "metadata")), *common, *beside, ("Content-Type", F.lit("application/json"))], F.col("kept")),
    )).alias("value"))
    each.write.option("lineSep", END).option("compression", compression).text(folder)
    discard(rows)
    discard(again)


def _field(head: Column, name: str) -> Column:
    return F.regexp_extract(head, rf"(?im)^{name}:[ \t]*([^\r\n]*?)[ \t]*\r?$", 1)


def _sized(lines: DataFrame) -> DataFrame:
    """lines (value) with their header, its length with the empty line, the declared length of the block, and their own."""
    head = F.substring_index("value", END, 1)
    found = lines.withColumn("head", head).withColumn("size", F.octet_length("value"))
    whole = F.octet_length("head") < F.col("size")
    length = _field(F.col("head"), "Content-Length")
    return found.withColumn("lead", F.octet_length("head") + len(END)).withColumn("length", F.when(whole & (length != ""), length.cast("long")))


def _starts(pieces: pd.DataFrame) -> pd.DataFrame:
    """For one archive's pieces in order: the piece in which each one's record begins."""
    out, have, need, start = [], 0, -1, None
    for at in pieces.sort_values("at").itertuples():
        if have >= need:
            start, have, need = at.at, at.size, -1 if pd.isna(at.length) else int(at.lead + at.length)
        else:
            have += len(MARK) + at.size
        out.append((at.archive, at.at, start))
    return pd.DataFrame(out, columns=["archive", "at", "start"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives at path, plain or compressed as a whole or record by record.

    record_id, type, target, date, concurrent_to (array), refers_to, digest, headers (array of
    name and value), block (binary), http (status line and headers of HTTP responses) and payload
    (binary, what follows them, or the whole block), with its payload_bytes and payload_digest as
    computed from the bytes read.

    Lengths decide where records end.  An archive with a record that holds a line starting with
    the mark is found by its lengths, its pieces are dealt to their records from lengths and order
    alone, and only such pieces are joined.  What has no length is a record of type null with all
    its bytes as block.  An empty folder of archives gives an empty table.
    """
    lines = spark.read.option("lineSep", MARK).text(path).select(
        "value", F.col("_metadata.file_path").alias("archive"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("at"),
    ).where("value <> ''")
    pieces = _sized(lines)
    over = F.col("size") - F.col("lead") - F.col("length")
    odd = pieces.where(F.col("length").isNull() | (over < 0) | (over > len(END))).select("archive").distinct()
    odd = stored(odd, "archives")
    if odd.isEmpty():
        found = pieces
    else:
        flat = pieces.select("archive", F.struct("at.block", "at.line").alias("at"), "size", "lead", "length").join(odd, "archive").select(
            "archive", F.format_string("%020d %020d", "at.block", "at.line").alias("at"), "size", "lead", "length")
        places = stored(flat.groupBy("archive").applyInPandas(_starts, "archive string, at string, start string"), "places")
        keyed = lines.withColumn("at", F.format_string("%020d %020d", "at.block", "at.line"))
        mended = keyed.join(places, ["archive", "at"]).groupBy("archive", "start").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]), MARK).alias("value"))
        found = _sized(keyed.join(odd, "archive", "left_anti").select("value").union(mended.select("value")))
    head, raw = F.col("head"), F.col("value").cast("binary")
    known = F.col("length").isNotNull()
    records = found.select(
        F.when(known, F.lower(_field(head, "WARC-Type"))).alias("type"), _field(head, "WARC-Record-ID").alias("record_id"), _field(head, "WARC-Target-URI").alias("target"), _field(head, "WARC-Date").alias("date"),
        F.regexp_extract_all(head, F.lit(r"(?im)^WARC-Concurrent-To:[ \t]*([^\r\n]*?)[ \t]*\r?$"), F.lit(1)).alias("concurrent_to"), _field(head, "WARC-Refers-To").alias("refers_to"),
        _field(head, "WARC-Payload-Digest").alias("digest"), _field(head, "Content-Type").alias("kind"),
        F.transform(
            F.regexp_extract_all(head, F.lit(r"(?m)^([^:\r\n]+:[^\r\n]*)\r?$"), F.lit(1)),
            lambda x: F.struct(F.regexp_extract(x, r"^([^:]+):", 1).alias("name"), F.trim(F.regexp_extract(x, r"^[^:]+:(.*)$", 1)).alias("value"))).alias("headers"),
        F.when(known, F.substring(raw, F.col("lead") + 1, F.col("length").cast("int"))).otherwise(raw).alias("block"),
    )
    spoken = F.lower("kind").startswith("application/http") | ((F.col("kind") == "") & F.col("block").cast("string").startswith("HTTP/"))
    answer = spoken & F.col("type").isin("response", "revisit")
    http = F.when(answer, F.substring_index(F.col("block").cast("string"), END, 1))
    payload = F.when(answer, F.substring(F.col("block"), F.octet_length(http) + len(END) + 1, F.length("block"))).when(F.col("type").isin(*MAINS), F.col("block"))
    blank = [c for c in ("target", "date", "refers_to", "digest")]
    records = records.withColumns({c: F.when(F.col(c) != "", F.col(c)) for c in blank})
    return records.withColumn("http", http).withColumn("payload", payload).withColumn("payload_bytes", F.length("payload").cast("long")).withColumn("payload_digest", base32(F.sha1("payload"))).drop("kind")


def captures(records: DataFrame) -> DataFrame:
    """One nested row for each capture: the response (or revisit, resource, conversion) with its request and metadata records.

    Records belong together where one names the other in WARC-Concurrent-To.  A request or metadata
    record that leads to no capture gives a row of its own without the response's columns, so no
    record is lost; records of other types (warcinfo, malformed ones) are not captures.  A capture
    has few records, and they meet in one row; response bodies move once, by their own identifier.
    Records need record_id, type and concurrent_to; of the other columns that `read` makes, those
    that are there come along.  They are read several times: store them before, as far as needed.
    """
    main, side = records.where(F.col("type").isin(*MAINS)), records.where(F.col("type").isin(*SIDES))
    forth = side.select(F.explode("concurrent_to").alias("capture"), F.col("record_id").alias("own"))
    back = main.select(F.col("record_id").alias("capture"), F.explode("concurrent_to").alias("own"))
    linked = forth.union(back).distinct()
    loose = side.select("record_id").join(linked, F.col("record_id") == F.col("own"), "left_anti")
    links = linked.union(loose.select("record_id", "record_id"))
    part = F.struct(*[c for c in ("record_id", "type", "date", "target", "headers", "block") if c in records.columns])
    held = side.select(F.col("record_id").alias("own"), part.alias("part")).join(links, "own").groupBy("capture").agg(F.array_sort(F.collect_list(F.struct(F.col("part.record_id").alias("id"), "part"))).alias("parts"))
    of = lambda kind: F.transform(F.filter("parts", lambda x: x["part"]["type"] == kind), lambda x: x["part"])
    return main.withColumnRenamed("record_id", "capture").join(held, "capture", "full").select(
        "capture", *[c for c in ("type", "target", "date", "refers_to", "digest", "headers", "http", "payload", "payload_bytes", "payload_digest") if c in records.columns],
        F.coalesce(of("request"), F.array()).alias("requests"), F.coalesce(of("metadata"), F.array()).alias("metadata"),
    )


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/quern/{spark.sparkContext.applicationId}/warc-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    kept = F.from_json(F.element_at("metadata", 1)["block"].cast("string"), "page_id bigint")
    records = stored(read(spark, folder).select(
        "record_id", "type", "concurrent_to", "refers_to", "payload_bytes", "payload_digest", F.when(F.col("type") == "metadata", F.col("block")).alias("block")), "records")
    found = stored(captures(records).select("capture", kept["page_id"].alias("page_id"), F.col("type").alias("record_type"), "refers_to", "payload_bytes", "payload_digest"), "read-back")
    heads = found.where("record_type = 'response'").select(F.col("capture").alias("refers_to"), F.col("page_id").alias("head_id"), F.col("payload_bytes").alias("head_bytes"), F.col("payload_digest").alias("head_digest"))
    again = found.where("record_type = 'revisit'").join(heads, "refers_to", "left")
    return found.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")).union(
        again.select("page_id", "head_bytes", "head_digest", "record_type", "head_id"))


OP11_SQL = rf"""
WITH hashed AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload) AS head FROM hashed)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('{BASE32}', (((('0x' || substr(h, (5 * i // 4 + 1)::INT, 2))::INT >> (3 - 5 * i % 4)::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> head THEN head END AS refers_to
FROM firsts
"""
