import base64
import gzip
import hashlib
import io
import zlib

from colloquy.llm import warc
from colloquy.session import new_folder


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def pages(spark):
    rows = [(i, f"http://h{i % 3}.org/{i}", f"<p>page {i % 7}</p>" * (i % 5 * 2000 + 1)) for i in range(60)]
    rows += [(100, None, None), (101, "u\r\nX: 1", ""), (None, "n", "<p>only null</p>"), (None, "n", "<p>page 0</p>"), (5, rows[5][1], rows[5][2])]
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'c' as first", "1 as sha1", "2 as n").repartition(4)


def written(spark, df, **options):
    warc.register(spark)
    path = new_folder(spark, "warc-test")
    warc.with_revisits(df, "page_id", "url", "html").write.format("warc").options(**options).mode("append").save(path)
    return path


def test_round_trip(spark):
    df = pages(spark)
    path = written(spark, df, max_file_bytes="2000")
    got = spark.read.format("warc").option("verify", "true").option("partition_bytes", "5000").load(path).collect()
    rows = df.collect()
    assert len(got) == len(rows)
    first = {}
    for r in rows:
        if r["page_id"] is not None:
            first[digest(r["html"])] = min(first.get(digest(r["html"]), 1 << 60), r["page_id"])
    by_id = {}
    for r in got:
        by_id.setdefault(r["record_id"][11:-1], []).append(r)
    for r in rows:
        d, key = digest(r["html"]), str(r["page_id"]).lower().replace("none", "null")
        mine = [g for g in by_id[key] if g["payload_digest"] == f"sha1:{d}"]
        again = d in first and first[d] != r["page_id"]
        for g in mine:
            assert g["warc_type"] == ("revisit" if again else "response")
            assert g["payload_length"] == len((r["html"] or "").encode())
            assert g["payload"] == (None if again else (r["html"] or "").encode())
            assert g["refers_to"] == (f"<urn:x-row:{first[d]}>" if again else None)
    assert [g["target_uri"] for g in by_id["101"]] == ["u%0D%0AX:%201"] and by_id["100"][0]["target_uri"] is None


def test_filters_reach_the_source(spark):
    path = written(spark, pages(spark))
    read = spark.read.format("warc").load(path)
    some = read.filter("warc_type = 'response' and target_uri like 'http://h1.org/%' and record_id in ('<urn:x-row:1>', '<urn:x-row:4>', '<urn:x-row:2>')")
    assert sorted(r["record_id"] for r in some.collect()) == ["<urn:x-row:1>", "<urn:x-row:4>"]
    # the reader alone, as planned: no filter is left to Spark, and unwanted payloads stay packed
    reader = warc.WarcReader({"path": path}, warc.T.StructType.fromDDL(warc.SCHEMA))
    filters = [warc.EqualTo(("warc_type",), "revisit"), warc.IsNotNull(("refers_to",))]
    assert list(reader.pushFilters(filters)) == []
    decoded = []
    full = warc.Record.block
    warc.Record.block = lambda self, enough=None: decoded.append(enough) or full(self, enough)
    try:
        out = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    finally:
        warc.Record.block = full
    assert out and {r["warc_type"] for r in out} == {"revisit"} and None not in decoded


def test_foreign_archives(spark):
    body = b"HTTP/1.1 200 OK\r\n\r\n" + b"x" * 5000
    one = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:a>\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:i>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    many = zlib.compressobj(9, zlib.DEFLATED, 31)
    for data in (info + one + info + one, gzip.compress(info) + gzip.compress(one) + gzip.compress(info), many.compress(one) + many.flush()):
        for decode in (True, False):
            seen = []
            for r in warc.records(io.BytesIO(data), len(data)):
                seen.append(r.headers["warc-record-id"])
                if decode and r.headers["warc-type"] == "response":
                    assert r.block() == body
            assert seen.count("<urn:a>") == max(1, data.count(b"urn:a"))


def test_lost_attempts_leave_nothing(spark):
    path = written(spark, pages(spark))
    system, root = warc.opened(path)
    with system.open_output_stream(f"{root}/stray.warc.gz", compression=None) as f:
        f.write(b"half a record")
    assert spark.read.format("warc").load(path).count() == 65


def test_empty(spark):
    path = written(spark, pages(spark).limit(0))
    assert spark.read.format("warc").load(path).count() == 0
