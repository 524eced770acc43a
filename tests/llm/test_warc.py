import gzip
import hashlib
import io

import pytest
from cases import duck, found

from quadrille.llm import queries as Q
from quadrille.llm.warc import WarcError, archive_pages, read_records, record_bytes, register

BIG, BIG2 = "<p>" + "ab" * 900, "<p>é" * 400
PAGES = [(1, "http://a", BIG), (2, "http://b\r\nX: y", BIG), (9, None, BIG), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (8, "u", BIG2), (None, "u", BIG2), (8, "u", BIG2), (None, None, None)]


def brute(pages):
    out = []
    top = {}
    for i, _, h in pages:
        b = (h or "").encode()
        if len(b) >= 1000:
            top[b] = max(top.get(b, -1), -1 if i is None else i)
    for i, _, h in pages:
        b = (h or "").encode()
        again = len(b) >= 1000 and top[b] != (-1 if i is None else i)
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", top[b] if again else None))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


def test_pages_as_sql_says(spark, sf):
    assert found(Q.queries()["op1_warc"](spark, sf)) == duck(Q.oracle_sql()["op1_warc"], sf, "pages")


def test_awkward_pages(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 n", "'x' sha", "'y' payload", "2 top")
    assert got(archive_pages(pages)) == brute(PAGES)
    assert archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_source_round_trip(spark, tmp_path):
    register(spark)
    rows = [("urn:x:1", "response", "http://a", "2024-01-01T00:00:00Z", None, b"\r\n\r\nWARC/1.1\r\n\0" * 9), ("urn:x:2", "response", "http://b", "2024-01-01T00:00:00Z", None, b"")]
    spark.createDataFrame(rows, "record_id string, record_type string, uri string, date string, refers_to string, payload binary").write.format("warc").mode("append").save(str(tmp_path / "w"))
    back = spark.read.format("warc").load(str(tmp_path / "w")).collect()
    assert {(r.record_id, bytes(r.payload)) for r in back} == {(r[0], r[5]) for r in rows}
    files = [p.name for p in (tmp_path / "w").iterdir()]
    assert all(f.endswith(".warc.gz") for f in files if not f.startswith("."))


def test_one_member_a_record():
    one = record_bytes("urn:a", "response", "http://a", "2024-01-01T00:00:00Z", b"x" * 200_000, None)
    two = record_bytes("urn:b", "revisit", "http://a", "2024-01-01T00:00:00Z", b"x" * 200_000, "urn:a")
    a, b = read_records(io.BytesIO(one + two))
    assert (a["payload"], a["length"], b["payload"], b["refers_to"], b["length"]) == (b"x" * 200_000, 200_000, None, "urn:a", 200_000)
    assert a["digest"] == b["digest"] == hashlib.sha1(b"x" * 200_000).hexdigest()
    assert gzip.decompress(one).startswith(b"WARC/1.1\r\n")


def test_damage_is_told():
    good = record_bytes("urn:a", "response", "http://a", "d", b"hello there", None)
    with pytest.raises(WarcError, match="breaks off"):
        list(read_records(io.BytesIO(good[:-5])))
    with pytest.raises(WarcError, match="digest"):
        list(read_records(io.BytesIO(gzip.compress(gzip.decompress(good).replace(b"hello", b"jello")))))
    with pytest.raises(WarcError, match="as long as"):
        list(read_records(io.BytesIO(gzip.compress(gzip.decompress(good).replace(b"hello", b"hell")))))
    with pytest.raises(WarcError, match="WARC record"):
        list(read_records(io.BytesIO(gzip.compress(b"text\r\n\r\n"))))
