import gzip
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from quillspark.llm import queries, warc

BIG = "<p>é</p>" * 300
PAGES = [(1, "http://a.b/c d", BIG), (2, "http://a.b/e", BIG), (7, "x", BIG), (7, "x", BIG), (7, "y", BIG), (3, None, "small"), (4, "http://q", "small"), (5, "http://n", None), (None, "http://z", BIG), (8, "http://r", "a\r\n\r\nb" * 400)]


def run(spark, pages, path):
    pages.write.parquet(f"{path}/pages.parquet")
    return queries.op1_warc_transactions(spark, path).collect()


def test_round_trip(spark, tmp_path):
    rows = run(spark, spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id long, url string, html string, payload string, digest int"), str(tmp_path))
    want = []
    for page_id, _, html in PAGES:
        payload = (html or "").encode()
        last = max((p for p, _, h in PAGES if (h or "").encode() == payload and p is not None), default=None) if len(payload) >= 1000 else None
        again = last is not None and page_id != last
        want.append((page_id, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if again else "response", last if again else None, 1))
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)


def test_files_are_whole_gzip_members(spark, tmp_path):
    warc.write_captures(spark.createDataFrame(PAGES, "page_id long, url string, html string"), str(tmp_path / "w"))
    n = 0
    for f in (tmp_path / "w").glob("part-*"):
        data = f.read_bytes()
        while data:
            d = zlib.decompressobj(31)
            record = d.decompress(data)
            assert d.eof and record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
            data, n = d.unused_data, n + 1
    assert n == 3 * len(PAGES)


def records(*some):
    out = b""
    for kind, rid, to, block in some:
        fields = [("WARC-Type", kind), ("WARC-Record-ID", rid), *(("WARC-Concurrent-To", t) for t in to)]
        out += b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"Content-Length: %d\r\n\r\n%s\r\n\r\n" % (len(block), block)
    return out


def test_links_over_several_steps_and_orphans(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(records(("warcinfo", "<i>", [], b"x"), ("response", "<r1>", [], b"HTTP/1.1 200 OK\r\n\r\nbody"), ("request", "<q1>", ["<r1>"], b"q"), ("metadata", "<m1>", ["<q1>"], b"page-id: 1\r\n")))
    (tmp_path / "b.txt").write_bytes(records(("request", "<q2>", ["<lost>"], b"q"), ("metadata", "<m2>", ["<lost>"], b""), ("response", "<r3>", ["<q3>"], b""), ("request", "<q3>", [], b"")))
    rows = {r.capture_id: r for r in warc.assemble(spark, str(tmp_path)).collect()}
    shape = lambda r: (r.record.warc_type if r.record else None, [x.record_id for x in r.requests], [x.record_id for x in r.metadata])
    assert {k: shape(r) for k, r in rows.items()} == {"<r1>": ("response", ["<q1>"], ["<m1>"]), "<lost>": (None, ["<q2>"], ["<m2>"]), "<r3>": ("response", ["<q3>"], [])}
    assert bytes(rows["<r1>"].record.block).endswith(b"body")


def test_empty_table(spark, tmp_path):
    assert run(spark, spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path)) == []


def test_headers_beyond_64_kib_and_records_without_ids(spark, tmp_path):
    head = b"HTTP/1.1 200 OK\r\n" + b"".join(b"X-%d: %s\r\n" % (i, b"y" * 1000) for i in range(90)) + b"\r\n"
    about = b"".join(b"a-%d: %s\r\n" % (i, b"z" * 1000) for i in range(90)) + b"page-id: 77\r\n"
    data = records(("response", "<r1>", [], head + b"body\r\n\r\nx"), ("metadata", "<m>", ["<r1>"], about), ("request", "", ["<r1>"], b"GET"))
    (tmp_path / "a.warc").write_bytes(data.replace(b"WARC-Record-ID: \r\n", b""))
    (row,) = warc.assemble(spark, str(tmp_path)).select(warc.http_body(F.col("record")).alias("body"), warc.field(F.col("metadata")[0]["block"], "page-id").alias("page"), "requests").collect()
    assert bytes(row.body) == b"body\r\n\r\nx" and row.page == "77" and bytes(row.requests[0].block) == b"GET"


def test_files_are_rolled_by_bytes(spark, tmp_path):
    pages = spark.range(40).selectExpr("id AS page_id", "'u' AS url", "repeat(sha2(cast(id AS string), 512), 20) AS html").coalesce(1)
    warc.write_captures(pages, str(tmp_path / "w"), row_bytes=4000, rows_per_file=2)
    assert len(list((tmp_path / "w").glob("part-*"))) > 3
    assert warc.assemble(spark, str(tmp_path / "w")).count() == 40


def test_ordinary_archives_are_read(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        warc.assemble(spark, str(tmp_path))
    (tmp_path / "a.warc").write_bytes(records(("response", "<r1>", [], b"one")))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(records(("response", "<r2>", [], b"two"))))
    assert sorted(bytes(r.record.block) for r in warc.assemble(spark, str(tmp_path)).collect()) == [b"one", b"two"]
