import gzip
import random

from pyspark.sql import functions as F

from tickloom.llm.warc import PERMITTED, SCHEMA, canonical, captures, files_of, micros_of, parse_file, parse_warc, records_of, resolved, warc_bytes, with_bodies


def brute(rows):
    out = {}
    full = sorted((r for r in rows if r[1] == "response" and r[4] == 200 and r[2]), key=lambda r: (r[3], r[0]))
    weak = lambda h: (h or {}).get("etag", "").removeprefix("W/") or None
    for r in rows:
        if r[1] != "revisit":
            continue
        before = [f for f in full if f[2].lower() == (r[2] or "").lower() and (f[3], f[0]) < (r[3], r[0])]
        h = r[5] or {}
        if not before:
            out[r[0]] = (None, "no_response", h)
            continue
        f = before[-1]
        pairs = [(weak(h), weak(f[5])), (h.get("last-modified"), (f[5] or {}).get("last-modified")), (r[6], f[6])]
        checks = [a == b for a, b in pairs if a is not None and b is not None]
        if all(checks):
            out[r[0]] = (f[0], "resolved" if checks else "unchecked", (f[5] or {}) | {k: v for k, v in h.items() if k in PERMITTED})
        else:
            out[r[0]] = (None, "changed", h)
    return out


def test_against_brute_force_with_a_hot_url(spark):
    r = random.Random(1)
    rows = []
    for i in range(1500):
        kind = r.choice(["response", "revisit", "revisit", "request"])
        h = {k: r.choice("ab") for k in ("etag", "last-modified", "vary", "server") if r.random() < 0.6}
        if "etag" in h and r.random() < 0.3:
            h["etag"] = "W/" + h["etag"]
        url = r.choice(["h/hot", "H/hot", "h/hot", f"x/{r.randrange(40)}", None])
        rows.append((i, kind, url, r.randrange(400), r.choice([200, 200, 404]), r.choice([h, h, None]), r.choice(["d1", "d2", None]), b"%d" % i))
    df = spark.createDataFrame(rows, SCHEMA)
    same = [(x[0], x[1], x[2] and x[2].replace("H/", "h/"), *x[3:]) for x in rows]
    got = {x.record_id: (x.source_id, x.outcome, x.headers) for x in resolved(df).collect()}
    assert got == brute(same)
    for x in with_bodies(resolved(df), df).where("source_id IS NOT NULL").limit(50).collect():
        assert bytes(x.body) == b"%d" % x.source_id


def test_canonical_urls(spark):
    rows = [("http://WWW.A.com:80/x/?b=2&utm_source=q&a=1#f", "a.com/x?a=1&b=2"), ("https://a.com/x?ref=1", "a.com/x?"), ("a.com", "a.com?"), (None, None), ("", "?"),
            ("http://m.a.com/P/q.html//", "m.a.com/P/q.html?")]
    for url, want in rows:
        assert spark.range(1).select(canonical(F.lit(url).cast("string"))).first()[0] == want


def test_files_round_trip(spark):
    rows = [(1, "response", "http://a/b", 5, 200, {"etag": '"x"'}, "md5:1", b"<p>\r\n\r\nWARC/1.1 inside</p>"), (2, "revisit", "http://a/b", 9, 304, {"date": "d"}, None, b"")]
    data = b"".join(warc_bytes(*r) for r in rows[:1]) + b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n" + warc_bytes(*rows[1])
    assert list(parse_warc(data)) == rows and list(parse_warc(b"")) == [] and list(parse_warc(b"WARC/1.1 cut")) == []
    got = records_of(spark.createDataFrame([(data,), (None,)], "content binary")).collect()
    assert sorted((x.record_id, x.outcome) for x in resolved(spark.createDataFrame(got, SCHEMA)).collect()) == [(2, "unchecked")]


def test_no_rows(spark):
    assert resolved(spark.createDataFrame([], SCHEMA)).count() == 0


def record(kind, name, date, status, tag):
    http = f"HTTP/1.1 {status} x\r\nETag: {tag}\r\n\r\n".encode()
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Date: {date}\r\nWARC-Target-URI: http://a/b\r\nContent-Length: {len(http)}\r\n\r\n"
    return head.encode() + http + b"\r\n\r\n"


def test_standard_dates_and_ids(spark):
    data = b"".join([record("response", "92283950-ef2f-4d72-b224-f54c6ec90bb1", "2024-01-03T00:00:00Z", 200, "new"), record("response", "92283950-ef2f-4d72-b224-f54c6ec90bb2", "2024-01-01T00:00:00Z", 200, "old"),
                     record("revisit", "92283950-ef2f-4d72-b224-f54c6ec90bb3", "2024-01-02T00:00:00.5Z", 304, "old"), record("revisit", "92283950-ef2f-4d72-b224-f54c6ec90bb4", "2024-01-04T00:00:00+01:00", 304, "new")])
    ids = [r[0] for r in parse_warc(data)]
    assert len(set(ids)) == 4 and None not in ids
    got = {r.record_id: (r.source_id, r.outcome) for r in resolved(records_of(spark.createDataFrame([(data,)], "content binary"))).collect()}
    assert got == {ids[2]: (ids[1], "resolved"), ids[3]: (ids[0], "resolved")}


def test_dates():
    day = 1_704_067_200_000_000
    want = {"2024-01-01T00:00:00Z": day, "2024-01-01T00:00:00.123456789Z": day + 123_456, "2024-01-01T01:00:00+01:00": day, "2024-01": day, "2024-01-01": day, "2024-01-01T00:01Z": day + 60_000_000,
            "2016-12-31T23:59:60Z": 1_483_228_800_000_000, "17": 17, "2024-13-01": None, "": None, "x": None, "9" * 30: None}
    assert {x: micros_of(x) for x in want} == want


def test_rows_through_files(spark):
    rows = [(1, "response", None, 5, 200, {"etag": "x"}, "d", b"b\xff\r\n\r\n"), (2, "revisit", "u", None, None, {}, None, b""), (3, "revisit", "u", 1 << 60, 304, {}, None, b"")]
    got = records_of(files_of(spark.createDataFrame(rows, SCHEMA))).collect()
    assert sorted((*x[:7], bytes(x[7])) for x in got) == rows


def test_damaged_records_are_counted_and_the_rest_is_read(spark):
    good = [(i, "response", "http://a/b", 10 * i, 200, {"etag": f"t{i}"}, None, b"body %d" % i) for i in range(4)]
    bad = [b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: many\r\n\r\nHTTP/1.1 200 x\r\n\r\nlost\r\n\r\n", b"WARC/1.1\r\nWARC-Type: response\r\n\r\nno length\r\n\r\n",
           b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: -5\r\n\r\n\r\n\r\n", b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: " + b"9" * 5000 + b"\r\n\r\nx\r\n\r\n"]
    odd = b"WARC/1.1\r\nWARC-Type: revisit\r\nWARC-Record-ID: <urn:record:9>\r\nWARC-Target-URI: http://a/b\r\nWARC-Date: 99\r\n\xff\xfe: x\r\nContent-Length: 36\r\n\r\nHTTP/1.1 30433333333 x\r\n\xffName: y\r\n\r\n\r\n\r\n"
    data = b"".join(x for pair in zip((warc_bytes(*g) for g in good), bad) for x in pair) + odd
    cut = warc_bytes(7, "response", "http://a/b", 70, 200, {}, None, b"long body" * 20)[:-60]
    rows = list(parse_warc(data))
    assert [r for r in rows if r[1] == "response"] == good and sum(r[1] == "damaged" for r in rows) == 4
    assert rows[-1][:5] == (9, "revisit", "http://a/b", 99, None) and [r[:2] for r in parse_warc(cut)] == [(7, "damaged")]
    got = records_of(spark.createDataFrame([(data,), (cut,)], "content binary"))
    assert got.where("type = 'damaged'").count() == 5
    assert [(r.record_id, r.source_id) for r in resolved(got).collect()] == [(9, 3)]


def test_compressed_files(spark):
    rows = [(i, "response", "http://a/b", i, 200, {}, None, b"x\x1f\x8b\x08y" * i) for i in range(5)]
    parts = [gzip.compress(warc_bytes(*r)) for r in rows]
    assert list(parse_file(b"".join(parts))) == rows == list(parse_file(gzip.compress(b"".join(warc_bytes(*r) for r in rows))))
    broken = bytearray(parts[1])
    broken[len(broken) // 2] ^= 0xFF
    got = list(parse_file(parts[0] + bytes(broken) + parts[2] + parts[3][:-9]))
    assert [r[0] for r in got if r[1] == "response"] == [0, 2] and sum(r[1] == "damaged" for r in got) >= 2
    assert list(parse_file(gzip.compress(b""))) == [] == list(parse_file(b""))
    kinds = {r["type"]: r["count"] for r in records_of(spark.createDataFrame([(b"".join(parts),), (bytes(broken),)], "content binary")).groupBy("type").count().collect()}
    assert kinds["response"] == 5 and kinds["damaged"] >= 1


def test_long_bodies_and_clashing_columns(spark):
    long_ = "ä" * 3_000_000
    rows = [(1, "response", "u", 1, 200, {"etag": "x"}, None, long_.encode()), (2, "revisit", "u", 2, 304, {"etag": "x"}, None, None)]
    extra = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit("z") for n in ("key", "kind", "piece", "inside", "from", "carried", "source_id", "outcome", "content", "id")})
    back = records_of(files_of(extra))
    for d in (extra, back):
        assert [(r.record_id, r.source_id, r.outcome) for r in resolved(d).collect()] == [(2, 1, "resolved")]
    assert with_bodies(resolved(back), back).select(F.length("body")).first()[0] == 6_000_000


def test_made_crawl_chooses_among_several_responses(spark):
    pages = spark.createDataFrame([(i, f"https://h{i % 2}.org/x{i}?a={i}", "t" * (i % 9)) for i in range(400)] + [(400, None, None)], "page_id long, url string, html string")
    got = captures(pages).withColumn("key", canonical(F.col("url")))
    per = got.where("type = 'response' AND key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("status").alias("statuses"))
    assert per.agg(F.min("n")).first()[0] >= 40 and per.agg(F.max("statuses")).first()[0] >= 2
    outcomes = {r["outcome"]: r["count"] for r in resolved(got).groupBy("outcome").count().collect()}
    assert outcomes["resolved"] > 50 and outcomes["changed"] > 50 and outcomes["no_response"] >= 1
    assert resolved(got).where("source_id IS NOT NULL AND source_id <> record_id - 1").count() > 50
