import base64
import gzip
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from netloom.llm import warc

PAGES = "page_id long, url string, html string, record_type string"


def brute(rows, least=0):
    """rows of (page_id, url, html); what the archive says of each."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or ""))
    first, out = {}, []
    for i, url, html in rows:
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        if len(data) < least or data not in first:
            first.setdefault(data, i)
            out.append((i, len(data), digest, "response", None))
        else:
            out.append((i, len(data), digest, "revisit", first[data]))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], PAGES).repartition(3)


def table():
    rnd = random.Random(2)
    texts = ["", None, "<p>a</p>", "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n", "é𝒳\r\n\r\n" * 50, "x" * 300_000]
    rows = [(k, rnd.choice([None, "http://a/", "http://b/ü\r\nX: y"]), rnd.choice(texts)) for k in rnd.sample(range(10**6), 60)]
    rows += [(5, "u", "same"), (5, "u", "same"), (5, None, "same"), (None, None, "same"), (2**62, None, "only"), (7, "u", "twice"), (7, "u", "twice")]
    return rows


@pytest.mark.parametrize("least", [0, 5])
def test_pages_round_trip(spark, least):
    rows = table()
    out = warc.archive_report(frame(spark, rows), least)
    assert out.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute(rows, least)
    assert warc.archive_report(frame(spark, rows).where(F.lit(False))).collect() == []


def test_archive_is_readable_and_whole(spark, tmp_path):
    rows = table()
    warc.write_pages(frame(spark, rows), str(tmp_path / "a"))
    files = warc.archive_files(str(tmp_path / "a"))
    text = b"".join(gzip.decompress(open(f, "rb").read()) for f, _ in files)  # plain gzip readers see ordinary records
    assert text.count(b"WARC/1.1\r\nWARC-Type: ") == len(rows)
    read = spark.read.format("warc").load(str(tmp_path / "a"))
    got = read.collect()
    ids = [r["record_id"] for r in got]
    assert len(set(ids)) == len(rows) and {r["refers_to"] for r in got if r["refers_to"]} <= set(ids)
    whole = {r["record_id"]: r["payload"] for r in got if r["record_type"] == "response"}
    back = sorted(((r["headers"]["X-Page-ID"], whole[r["refers_to"] or r["record_id"]]) for r in got), key=str)
    assert back == sorted((("" if i is None else str(i), (h or "").encode()) for i, _, h in rows), key=str)


@pytest.mark.parametrize("compress", ["true", "false"])
def test_filters_reach_the_reader(spark, tmp_path, compress):
    warc.register(spark)
    rows = [("response" if k % 3 else "revisit", f"http://h/{k}", bytes([k % 256]) * (k * 500)) for k in range(60)]
    df = spark.createDataFrame(rows, "record_type string, target_uri string, payload binary").repartition(2)
    df.write.format("warc").mode("append").option("compress", compress).option("file_bytes", "2500").save(str(tmp_path / "w"))
    assert len(warc.archive_files(str(tmp_path / "w"))) > 2
    read = spark.read.format("warc").option("partition_bytes", "3000").load(str(tmp_path / "w"))
    assert read.rdd.getNumPartitions() > 2 and read.count() == 60
    for cond in (F.col("record_type") == "revisit", F.col("target_uri").startswith("http://h/1"), F.col("content_length") >= 20000, F.col("record_type").isin("a", "response"),
                 F.col("refers_to").isNull() & (F.col("target_uri") != "http://h/5")):
        got = sorted((r["target_uri"], bytes(r["payload"])) for r in read.where(cond).collect())
        want = sorted((r["target_uri"], bytes(r["payload"])) for r in spark.createDataFrame(read.collect(), read.schema).where(cond).collect())
        assert got == want and want
    plan = read.where(F.col("record_type") == "revisit")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (record_type" not in plan and "Filter isnotnull(record_type" not in plan
    heads = spark.read.format("warc").schema("target_uri string, content_length long").load(str(tmp_path / "w"))
    assert sorted(map(tuple, heads.collect())) == sorted((u, len(p)) for _, u, p in rows)


def test_skipped_payloads_are_not_read(tmp_path):
    """A plain file whose skipped blocks are damaged, and gzip members whose bodies are, still give the other records."""
    writer = warc.WarcWriter(str(tmp_path), False, 6, 1 << 30)
    big = os.urandom(400_000)
    for compress in (False, True):
        writer.compress = compress
        parts = [writer.record({"record_type": t, "payload": big}) for t in ("request", "response", "request")]
        if compress:
            parts[0] = parts[0][:-200_000] + b"\0" * 200_000
        path = tmp_path / f"x{compress}.warc"
        path.write_bytes(b"".join(parts))
        reader = warc.WarcReader(str(path), warc.StructType.fromDDL("record_type string, payload binary"), 1)
        reader.filters = [warc.EqualTo(("record_type",), "response")]
        rows = [r for b in reader.read(reader.partitions()[0]) for r in b.to_pylist()]
        assert [r["record_type"] for r in rows] == ["response"] and rows[0]["payload"] == big


def test_foreign_archives(spark, tmp_path):
    """Whole-file gzip, several records a member, folded headers, no HTTP block, no manifest."""
    warc.register(spark)
    one = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nX-Long: a\r\n b\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    two = b"WARC/1.0\r\nwarc-type: resource\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "a.warc.gz").write_bytes(gzip.compress(one + two) + gzip.compress(one))
    (tmp_path / "d" / "e" / "b.warc").write_bytes(two + one)
    (tmp_path / "d" / "note.txt").write_bytes(b"no archive")
    (tmp_path / "d" / "empty.warc").write_bytes(b"")
    got = spark.read.format("warc").load(f"file://{tmp_path}/d")
    assert sorted((r["record_type"], bytes(r["payload"]), r["headers"].get("X-Long")) for r in got.collect()) == [("resource", b"", None)] * 2 + [("warcinfo", b"abc", "a b")] * 3
    assert got.where("record_type = 'resource'").count() == 2
    (tmp_path / "cut.warc").write_bytes(one[:-8])
    with pytest.raises(Exception, match="cut off"):
        spark.read.format("warc").load(str(tmp_path / "cut.warc")).collect()


def test_base32(spark):
    for data in (b"", b"abc", bytes(range(256))):
        got = spark.createDataFrame([(data,)], "d binary").select(warc.digest_column(F.col("d"))).first()[0]
        assert got == base64.b32encode(hashlib.sha1(data).digest()).decode() == warc.base32_sha1(data)
