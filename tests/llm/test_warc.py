"""WARC archives: written, read back, carried to files, damaged on the way."""

import base64
import glob
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from gleanwork.llm import common, warc
from gleanwork.operators import joins

PAGES = "page_id long, url string, html string"
b32 = lambda data: base64.b32encode(hashlib.sha1(data).digest()).decode()


def some_pages(n=60):
    rows = [(i, f"http://h{i % 7}.example/{i}", f"<p>page {i % 40}</p>" * (1 + i % 9)) for i in range(n)]
    rows += [(500 + i, f"http://same.example/{i}", "<p>one payload of many</p>" * 30) for i in range(30)]
    rows += [(900, None, None), (901, "http://e.example/", ""), (902, None, None), (None, "http://n.example/", "<p>page 3</p>"), (None, None, "alone")]
    rows += [(910, "http://r.example/", "twice " * 50), (910, "http://r.example/", "twice " * 50), (910, "http://q.example/", "twice " * 50), (911, "http://r.example/", "twice " * 50)]
    rows += [(920, "http://x.example/a b\r\nWARC-Type: fake\n", "Grüße 日本 \r\n\r\nWARC/1.1\r\n\r\n" * 20), (921, "http://l.example/", "é" * 300_000)]
    return rows


def plain(rows):
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")
    groups, out = {}, []
    for r in rows:
        groups.setdefault((r[2] or "").encode(), []).append(r)
    for data, members in groups.items():
        for n, r in enumerate(sorted(members, key=key)):
            out.append((r[0], len(data), b32(data), "revisit" if n else "response", sorted(members, key=key)[0][0] if n else None))
    return sorted(out, key=repr)


def told(df):
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("chunk_bytes", "frequent"), [(7, 1000), (1000, 5), (1 << 20, 1)])
def test_round_trip(spark, monkeypatch, chunk_bytes, frequent):
    monkeypatch.setattr(joins, "FREQUENT", frequent)
    rows = [r for r in some_pages() if chunk_bytes > 7 or r[0] != 921]
    pages = spark.createDataFrame(rows, PAGES).selectExpr("*", "'x' AS digest", "1 AS n", "2 AS data", "3 AS first", "4 AS record_id").repartition(5)
    assert told(warc.round_trip(pages, chunk_bytes)) == plain(rows)


def test_chunks_are_bounded_and_carry_digests(spark):
    pages = spark.createDataFrame([(1, "u", "abcdefghij" * 100), (2, "v", "abcdefghij" * 100)], PAGES)
    chunks = warc.record_chunks(pages, chunk_bytes=64).orderBy("record_id", "chunk_number").collect()
    payload = [r for r in chunks if r["chunk_number"] > 0]
    assert len(payload) == 16 and all(len(r["data"]) <= 64 + 4 for r in payload)  # the revisit brings none
    assert b"".join(r["data"] for r in payload) == b"abcdefghij" * 100 + b"\r\n\r\n"
    for k, r in enumerate(payload):
        assert r["digest_so_far"] == b32((b"abcdefghij" * 100)[: 64 * (k + 1)])
    assert {r["digest_so_far"] for r in chunks if r["chunk_number"] == 0} == {b32(b"")}


def test_damage_is_a_row_with_an_error(spark):
    pages = spark.createDataFrame([(i, f"u{i}", f"text {i} " * 40) for i in range(6)], PAGES)
    chunks = common.materialize(warc.record_chunks(pages, chunk_bytes=50))
    page = F.split_part("record_id", F.lit(":"), F.lit(3)).cast("int")
    flipped = F.when((page == 1) & (F.col("chunk_number") == 3), F.concat(F.lit(b"X"), F.expr("substring(data, 2, 999)"))).otherwise(F.col("data"))
    cut = F.when((page == 4) & (F.col("chunk_number") == 0), F.expr("substring(data, 1, 20)")).otherwise(F.col("data"))
    more = F.when((page == 5) & (F.col("chunk_number") == 6), F.concat("data", F.lit(b"Y"))).otherwise(F.col("data"))
    last = chunks.groupBy(page.alias("p")).agg(F.max("chunk_number")).where("p = 3").first()[1]
    bad = chunks.withColumn("data", flipped).withColumn("data", cut).withColumn("data", more)
    bad = bad.where(~((page == 2) & (F.col("chunk_number") == 2)) & ~((page == 3) & (F.col("chunk_number") == last)))
    got = {r["target_uri"] or r["record_id"].split(":")[2]: r["error"] for r in warc.read_records(bad).collect()}
    assert got["u0"] is None and got["u1"] == "chunk 3 differs from its digest" and got["u2"] == "chunk 2 is missing" and got["u3"] == "record ends early"
    assert got["4"] and got["u5"]
    with pytest.raises(Exception, match="differs from its digest"):
        kind = F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))).otherwise("x")
        warc.read_records(chunks.withColumn("data", flipped)).select(kind).collect()


def records_of(data):
    """A plain sequential reader: (fields, block) of each record."""
    at, out = 0, []
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        fields = dict(line.split(": ", 1) for line in lines[1:])
        length = int(fields["Content-Length"])
        out.append((fields, data[end + 4 : end + 4 + length]))
        assert data[end + 4 + length : end + 8 + length] == b"\r\n\r\n"
        at = end + 8 + length
    return out


@pytest.mark.parametrize("packed", [True, False])
def test_files(spark, tmp_path, packed):
    rows = some_pages()
    chunks = warc.record_chunks(spark.createDataFrame(rows, PAGES).repartition(3), chunk_bytes=500)
    files = warc.export_files(chunks, f"file://{tmp_path}/out", files=3).collect()
    assert sum(r["records"] for r in files) == len(rows)
    by_type = {"response": 0, "revisit": 0, "warcinfo": 0}
    for path in glob.glob(f"{tmp_path}/out/*"):
        with open(path, "rb") as f:
            data = gzip.decompress(f.read())
        if not packed:
            with open(f"{tmp_path}/{path.rsplit('/', 1)[1][:-3]}", "wb") as f:
                f.write(data)
        for fields, block in records_of(data):
            by_type[fields["WARC-Type"]] += 1
            if fields["WARC-Type"] == "response":
                assert fields["WARC-Payload-Digest"] == "sha1:" + b32(block.split(b"\r\n\r\n", 1)[1])
    want = plain(rows)
    assert by_type == {"response": sum(r[3] == "response" for r in want), "revisit": sum(r[3] == "revisit" for r in want), "warcinfo": len(files)}
    read = warc.read_records(warc.file_chunks(spark, f"file://{tmp_path}/{'out' if packed else ''}", chunk_bytes=300))
    assert read.where("error IS NOT NULL").count() == 0
    got = read.where("record_type <> 'warcinfo'").withColumn("page_id", warc.page_of(F.col("record_id"))).withColumn("refers_to", warc.page_of(F.col("refers_to")))
    assert told(got) == want
    assert got.where("target_uri LIKE '%fake%'").first()["target_uri"] == "http://x.example/a%20b%0D%0AWARC-Type:%20fake%0A"


def test_empty_and_foreign_input(spark, tmp_path):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0
    with open(f"{tmp_path}/a.warc", "wb") as f:
        f.write(b"WARC/1.0\r\nwarc-type: metadata\r\nWARC-Record-ID: <urn:a>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nnot a record")
    with open(f"{tmp_path}/b.warc", "wb") as f:
        f.write(b"")
    rows = {r["record_id"]: r for r in warc.read_records(warc.file_chunks(spark, f"file://{tmp_path}")).collect()}
    assert rows["urn:a"]["payload_bytes"] == 3 and rows["urn:a"]["payload_digest"] == b32(b"abc") and rows["urn:a"]["error"] is None
    assert len(rows) == 2 and all(r["error"] for k, r in rows.items() if k != "urn:a")
