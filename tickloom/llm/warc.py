"""Not-modified revisits of web archives, resolved to the response they stand for.

A revisit says that a page has not changed since an earlier capture. It is resolved by an as-of join: the latest earlier full
response (status 200) of the same canonical URL, in the order of (at, record_id). The validators of both are compared: entity
tags (weakly, without W/), then modification dates, then payload digests; those that both sides have must agree. The
record's headers are those of the response, with the permitted ones of the revisit put in their place.

The join cuts the rows into ordered pieces of about equal size, so a URL with very many captures spreads over many pieces;
what the response before a piece was is carried between pieces.

Outcomes: resolved; unchecked (found, but no validator in common); changed (a validator differs; no source, the revisit's own
headers); no_response (none before, or no URL). Null headers count as none. Repeated rows give repeated results; extra
columns are ignored.

Files: dates are ISO 8601 as the standard has them, or whole numbers; both become microseconds, finer digits are cut off. A record id
that ends in a number below 2^63 is that number, any other (such as a UUID) its 64-bit digest. A field that is absent is null.
Files may be compressed with gzip, as a whole or record by record; a record lies in one member. A record without a usable
Content-Length, or cut short, and a member that can't be unpacked are rows of type `damaged`, so that they can be counted; they
resolve nothing, and reading goes on at the next record or member. Empty tables and files give no rows; bodies of any length stay
whole, one file or member at a time in a task's memory.
"""
from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from hashlib import blake2b

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .store import written

#: Headers of a not-modified answer that replace those of the stored response.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Parameters that don't change what a URL shows.
TRACKING = "^(utm_[a-z]+|ref|sid)(=|$)"
FILE = 1 << 20
STEP = 1 << 16
SCHEMA = "record_id long, type string, url string, at long, status int, headers map<string,string>, digest string, body binary"


def canonical(url: Column) -> Column:
    """Host in lower case without www. and standard port, path without end slashes, parameters sorted and without tracking; no scheme or fragment."""
    bare = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), "^www[.]", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    ask = F.filter(F.split(F.regexp_extract(bare, "[?](.*)$", 1), "&"), lambda x: (x != "") & ~x.rlike(TRACKING))
    return F.concat(host, path, F.lit("?"), F.array_join(F.array_sort(ask), "&"))


def _agree(a: Column, b: Column) -> Column:
    """True, false, or null where one side has none."""
    return F.when(a.isNotNull() & b.isNotNull(), a == b)


def resolved(records: DataFrame) -> DataFrame:
    """record_id, at, source_id, outcome, headers of each revisit among records (columns as in SCHEMA, body not needed)."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    full = (F.col("type") == "response") & (F.col("status") == 200)
    rows = records.select("record_id", "at", canonical(F.col("url")).alias("key"), "digest", F.coalesce("headers", none).alias("headers"),
                          F.when(full, "full").when(F.col("type") == "revisit", "revisit").alias("kind")).where("kind IS NOT NULL")
    rows = written(rows.repartitionByRange("key", "at", "record_id").withColumn("piece", F.spark_partition_id()), "captures")
    answer = F.when(F.col("kind") == "full", F.struct(F.col("record_id").alias("source_id"), F.col("headers").alias("had"), F.col("digest").alias("had_digest")))
    inside = F.last(answer, ignorenulls=True).over(Window.partitionBy("piece", "key").orderBy("at", "record_id").rowsBetween(Window.unboundedPreceding, -1))
    # Only the first key of a piece can go on from the piece before: one row for each piece, so this side has a bound.
    first = F.broadcast(rows.groupBy("piece").agg(F.min("key").alias("key")).select("key").distinct())
    ends = rows.join(first, "key", "left_semi").groupBy("piece", "key").agg(F.max_by(answer, F.when(F.col("kind") == "full", F.struct("at", "record_id"))).alias("end"))
    carried = ends.select("piece", "key", F.last("end", ignorenulls=True).over(Window.partitionBy("key").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    j = rows.withColumn("inside", inside).where("kind = 'revisit'").join(F.broadcast(carried), ["piece", "key"], "left")
    j = j.withColumn("from", F.when(F.col("key").isNotNull(), F.coalesce("inside", "carried")))
    tag = lambda h: F.regexp_replace(F.element_at(h, "etag"), "^W/", "")
    had = F.col("from.had")
    checks = F.array_compact(F.array(_agree(tag(F.col("headers")), tag(had)), _agree(F.element_at("headers", "last-modified"), F.element_at(had, "last-modified")),
                                     _agree(F.col("digest"), F.col("from.had_digest"))))
    outcome = (F.when(F.col("from").isNull(), "no_response").when(F.size(checks) == 0, "unchecked")
               .when(F.forall(checks, lambda x: x), "resolved").otherwise("changed"))
    new = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED))
    kept = F.map_filter(had, lambda k, v: ~F.array_contains(F.map_keys(new), k))
    found = F.col("outcome").isin("resolved", "unchecked")
    return j.withColumn("outcome", outcome).select(
        "record_id", "at", F.when(found, F.col("from.source_id")).alias("source_id"), "outcome", F.when(found, F.map_concat(kept, new)).otherwise(F.col("headers")).alias("headers"))


def with_bodies(results: DataFrame, records: DataFrame) -> DataFrame:
    """results with the body of the source; null where there is none."""
    bodies = records.where("type = 'response' AND status = 200").select(F.col("record_id").alias("source_id"), "body").dropDuplicates(["source_id"])
    return results.join(bodies, "source_id", "left")


_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
_DATE = re.compile(r"(\d{4})-(\d\d)(?:-(\d\d)(?:T(\d\d):(\d\d)(?::(\d\d)(?:[.](\d+))?)?(Z|[+-]\d\d:\d\d)?)?)?", re.ASCII)
_DIGITS = re.compile(r"\d+", re.ASCII)


def _number(x: str) -> int | None:
    """A whole number that a long holds."""
    return n if _DIGITS.fullmatch(x) and len(x.lstrip("0")) < 20 and (n := int(x.lstrip("0") or "0")) < 1 << 63 else None


def micros_of(date: str) -> int | None:
    """Microseconds of a WARC-Date: a whole number as it is, ISO 8601 since 1970; null if it is neither."""
    m = _DATE.fullmatch(date)
    if not m:
        return _number(date)
    year, month, day, hour, minute, second, part, zone = m.groups()
    try:
        t = datetime(int(year), int(month), int(day or 1), int(hour or 0), int(minute or 0), min(int(second or 0), 59), int((part or "0")[:6].ljust(6, "0")), timezone.utc)
    except ValueError:
        return None
    away = 0 if zone in (None, "Z") else (int(zone[1:3]) * 60 + int(zone[4:])) * (-1 if zone[0] == "-" else 1)
    return (t - _EPOCH) // timedelta(microseconds=1) + (second == "60") * 1_000_000 - away * 60_000_000


def _date_of(at: int) -> str:
    """ISO 8601 of microseconds; a number outside of the calendar's years stays a number."""
    return (_EPOCH + timedelta(microseconds=at)).isoformat(timespec="microseconds").replace("+00:00", "Z") if 0 <= at < 253_402_300_800_000_000 else str(at)


def id_of(name: str) -> int | None:
    """The number a record id ends in, or the digest of the id; null for none."""
    bare = name.strip("<>")
    number = _number(bare.rpartition(":")[2])
    if number is None and bare:
        return int.from_bytes(blake2b(bare.encode(), digest_size=8).digest(), "big", signed=True)
    return number


def warc_bytes(record_id: int, type_: str, url: str | None, at: int | None, status: int | None, headers: dict | None, digest: str | None, body: bytes | None) -> bytes:
    """One record of a WARC file."""
    http = f"HTTP/1.1 {'-' if status is None else status} -\r\n".encode() + b"".join(f"{k}: {v}\r\n".encode() for k, v in (headers or {}).items()) + b"\r\n" + (body or b"")
    head = {"WARC-Type": type_, "WARC-Record-ID": f"<urn:record:{record_id}>", "WARC-Target-URI": url, "WARC-Date": None if at is None else _date_of(at),
            "Content-Type": "application/http", "Content-Length": str(len(http)), "WARC-Payload-Digest": digest or None}
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head.items() if v is not None) + b"\r\n" + http + b"\r\n\r\n"


def _fields(block: bytes) -> dict[str, str]:
    pairs = (line.split(b":", 1) for line in block.split(b"\r\n")[1:] if b":" in line)
    return {k.strip().lower().decode(errors="replace"): v.strip().decode(errors="replace") for k, v in pairs}


def parse_warc(data: bytes) -> Iterator[tuple]:
    """Records of plain WARC bytes, as rows of SCHEMA: responses, revisits and damaged ones; what is nothing of these is left out."""
    at = data.find(b"WARC/")
    while at >= 0:
        stop = data.find(b"\r\n\r\n", at)
        if stop < 0:
            return
        head = _fields(data[at:stop])
        size = _number(head.get("content-length", ""))
        name = (id_of(head.get("warc-record-id", "")), head.get("warc-type"), head.get("warc-target-uri"), micros_of(head.get("warc-date", "")))
        if size is None or stop + 4 + size > len(data):
            yield name[0], "damaged", *name[2:], None, {}, head.get("warc-payload-digest"), b""
            at = data.find(b"\r\nWARC/", stop + 2)  # its length says nothing, so the next record is looked for in its body
            at += 2 if at >= 0 else 0
            continue
        if name[1] in ("response", "revisit"):
            top, _, body = data[stop + 4:stop + 4 + size].partition(b"\r\n\r\n")
            status = top.split(b" ")[1:2]
            yield *name, int(status[0]) if status and status[0].isdigit() and len(status[0]) == 3 else None, _fields(top), head.get("warc-payload-digest"), body
        at = data.find(b"WARC/", stop + 4 + size)


_MEMBER = b"\x1f\x8b\x08"


def members(data: bytes) -> Iterator[bytes | None]:
    """The gzip members of a file, unpacked, or the file itself if it isn't compressed; None for a member that is damaged or cut short."""
    if not data.startswith(_MEMBER):
        yield data
        return
    at, view = 0, memoryview(data)
    while at >= 0:
        unpack, out, end = zlib.decompressobj(zlib.MAX_WBITS | 16), [], at
        try:
            while not unpack.eof and end < len(data):  # in steps, as the rest of the file is copied for every member otherwise
                out.append(unpack.decompress(view[end:end + STEP]))
                end += STEP
        except zlib.error:
            pass
        yield b"".join(out) if unpack.eof else None
        at = data.find(_MEMBER, min(end, len(data)) - len(unpack.unused_data) if unpack.eof else at + 1)


def parse_file(data: bytes) -> Iterator[tuple]:
    """Records of a WARC file, plain or compressed."""
    for part in members(data):
        if part is None:
            yield None, "damaged", None, None, None, {}, None, b""
        else:
            yield from parse_warc(part)


def records_of(files: DataFrame) -> DataFrame:
    """Records of rows with `content` (bytes of WARC files, plain or gzip, as the binaryFile source gives them)."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches):
        for b in batches:
            for content in b["content"]:
                yield pd.DataFrame(list(parse_file(bytes(content or b""))), columns=names).astype({"record_id": "Int64", "at": "Int64", "status": "Int64"})
    return files.select("content").mapInPandas(run, SCHEMA)


def files_of(records: DataFrame) -> DataFrame:
    """`content`: WARC files, each with the records (columns as in SCHEMA) of a part of the rows, up to about FILE bytes of bodies."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches):
        parts, size = [], 0
        for b in batches:
            for r in b.itertuples(index=False, name=None):
                record_id, type_, url, at, status, headers, digest, body = r
                parts.append(warc_bytes(record_id, type_, url, None if pd.isna(at) else int(at), None if pd.isna(status) else int(status), dict(headers) if headers is not None else None, digest, body))
                size += len(parts[-1])
                if size >= FILE:
                    yield pd.DataFrame({"content": [b"".join(parts)]})
                    parts, size = [], 0
        if parts:
            yield pd.DataFrame({"content": [b"".join(parts)]})
    return records.select(*names).mapInPandas(run, "content binary")


def captures(pages: DataFrame) -> DataFrame:
    """A crawl made of pages: the pages of a host are versions of eight addresses, fetched one after the other under several spellings.

    Some fetches fail or lead elsewhere. Each address is asked for again some time after each fetch, mostly with other fetches in between; some
    of these answers carry another entity tag, none, or the digest of the page fetched then."""
    p, h = F.col("page_id"), F.coalesce("html", F.lit(""))
    text = lambda c: c.cast("string")
    url = F.concat(F.regexp_extract("url", "^[^/]*//[^/?#]*", 0), F.lit("/s"), text(p % 8))
    base = pages.select("page_id", url.alias("url"), h.cast("binary").alias("body"), F.octet_length(h).alias("n"), F.md5(h).alias("sum"))
    version = text(F.floor(p / 64))
    tag, day = F.concat(F.lit('"v'), version, F.lit('"')), F.concat(F.lit("day "), version)
    later = 2 * (p + 1 + p % 97) + 1
    status = F.when(p % 6 == 5, 404).when(p % 6 == 4, 301).otherwise(200)
    first = base.select((2 * p).alias("record_id"), F.lit("response").alias("type"), F.when(p % 3 == 0, F.concat("url", F.lit("/?ref=x"))).otherwise(F.col("url")).alias("url"),
                        (2 * p).alias("at"), status.alias("status"), F.create_map(
        F.lit("cache-control"), F.lit("max-age=60"), F.lit("content-length"), text(F.col("n")), F.lit("content-type"), F.lit("text/html"), F.lit("date"), text(2 * p),
        F.lit("etag"), tag, F.lit("last-modified"), day).alias("headers"), F.col("sum").alias("digest"), "body")
    sent = F.create_map(F.lit("cache-control"), F.lit("max-age=120"), F.lit("content-length"), F.lit("0"), F.lit("date"), text(later), F.lit("server"), F.lit("edge"),
                        F.lit("etag"), F.when(p % 11 == 0, '"other"').when(p % 13 != 0, F.concat(F.lit("W/"), tag)), F.lit("last-modified"), F.when(p % 13 == 0, day))
    again = base.select((2 * p + 1).alias("record_id"), F.lit("revisit").alias("type"), F.concat(F.regexp_replace("url", "^https?://", "HTTP://"), F.lit("#again")).alias("url"), later.alias("at"),
                        F.lit(304).alias("status"), F.map_filter(sent, lambda k, v: v.isNotNull()).alias("headers"), F.when(p % 17 == 0, F.col("sum")).alias("digest"), F.lit(b"").alias("body"))
    return first.unionByName(again)


def op8(spark, sf_dir: str) -> DataFrame:
    """Revisits of the crawl made of all pages, written as WARC records and read again: record_id, source_id, outcome, headers (sorted, one string)."""
    r = resolved(records_of(files_of(captures(spark.read.parquet(f"{sf_dir}/pages.parquet")))))
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))
    return r.select("record_id", "source_id", "outcome", F.array_join(lines, "; ").alias("headers"))


def _sql_key(url: str) -> str:
    bare = f"regexp_replace(regexp_replace({url}, '#.*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://', '')"
    return (f"regexp_replace(regexp_replace(lower(regexp_extract({bare}, '^[^/?]*')), '^www[.]', ''), ':(80|443)$', '') || regexp_replace(regexp_extract({bare}, '^[^/?]*([^?]*)', 1), '/+$', '') || '?' || "
            f"array_to_string(list_sort(list_filter(string_split(regexp_extract({bare}, '[?](.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '{TRACKING}'))), '&')")


OP8_SQL = f"""
WITH b AS (SELECT page_id AS p, regexp_extract(url, '^[^/]*//[^/?#]*') || '/s' || (page_id % 8) AS url, md5(coalesce(html, '')) AS s, strlen(coalesce(html, '')) AS n, '"v' || (page_id // 64) || '"' AS tag, 'day ' || (page_id // 64) AS day FROM pages),
f AS (SELECT 2 * p AS source_id, 2 * p AS at, {_sql_key("url")} AS key, tag, day, s, n FROM b WHERE p % 6 < 4),
r AS (SELECT 2 * p + 1 AS record_id, 2 * (p + 1 + p % 97) + 1 AS at, {_sql_key("url")} AS key,
        CASE WHEN p % 11 = 0 THEN '"other"' WHEN p % 13 <> 0 THEN tag END AS tag, CASE WHEN p % 13 = 0 THEN day END AS day,
        CASE WHEN p % 17 = 0 THEN s END AS s, p % 11 = 0 AS other FROM b),
j AS (SELECT r.record_id, r.at AS r_at, r.tag, r.day, r.other, f.source_id, f.at AS f_at, f.tag AS f_tag, f.day AS f_day, f.n,
        CASE WHEN f.source_id IS NULL THEN 'no_response' WHEN r.tag <> f.tag OR r.day <> f.day OR r.s <> f.s THEN 'changed'
             WHEN r.tag IS NULL AND r.day IS NULL AND r.s IS NULL THEN 'unchecked' ELSE 'resolved' END AS outcome
      FROM r ASOF LEFT JOIN f ON r.key = f.key AND r.at > f.at),
h AS (SELECT *, outcome IN ('resolved', 'unchecked') AS found, CASE WHEN other THEN tag ELSE 'W/' || tag END AS sent FROM j)
SELECT record_id, CASE WHEN found THEN source_id END AS source_id, outcome,
  CASE WHEN found THEN concat_ws('; ', 'cache-control: max-age=120', 'content-length: ' || n, 'content-type: text/html', 'date: ' || r_at, 'etag: ' || coalesce(sent, f_tag), 'last-modified: ' || coalesce(day, f_day))
       ELSE concat_ws('; ', 'cache-control: max-age=120', 'content-length: 0', 'date: ' || r_at, 'etag: ' || sent, 'last-modified: ' || day, 'server: edge') END AS headers
FROM h
"""
