import base64
import gzip
import hashlib
import json
import os
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from propgraph.llm.warc import archive_pages, read_warc, register, warc_query


def expected(pages, least=0):
    groups = defaultdict(list)
    for i, html in pages:
        groups[(html or "").encode()].append(i)
    out = {}
    for data, ids in groups.items():
        for i in ids:
            again = len(data) >= least and i != min(ids)
            out[i] = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", min(ids) if again else None)
    return out


def read(spark, path, **options):
    return spark.read.format("warc").options(**options).load(path)


def test_query_against_brute_force(spark, medium):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{medium}/pages.parquet").collect()]
    rows = warc_query(spark, medium).collect()
    assert len(rows) == len(pages)
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows} == expected(pages)


@pytest.mark.parametrize("zipped", [True, False])
@pytest.mark.parametrize("least", [0, 4])
def test_copies_nulls_and_odd_values(spark, tmp_path, zipped, least):
    data = [(5, "u5", "same"), (2, "u2\r\nX: y", "same"), (9, None, "same"), (1, "ü", None), (7, "u7", ""), (3, "u3", "é\r\n\r\nWARC/1.0\r\n"), (4, "u4", "x" * 3_000_000), (6, "u6", "abc"), (8, "u8", "abc")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("payload", F.lit("clash")).withColumn("sha1", F.lit(0)).repartition(3)
    path = str(tmp_path / "a")
    archive_pages(pages, path, least, zipped)
    rows = read(spark, path, verify="true").collect()
    want = expected([(i, h) for i, _, h in data], least)
    got = {int(r.headers["X-Page-Id"]): (r.payload_length, r.payload_digest[5:], r.record_type, int(r.headers["X-Refers-To-Page-Id"]) if r.refers_to else None) for r in rows}
    assert got == want
    by_id = {r.record_id: r for r in rows}
    assert all(by_id[r.refers_to].record_type == "response" for r in rows if r.refers_to)
    assert {int(r.headers["X-Page-Id"]): bytes(r.payload).decode() for r in rows if r.record_type == "response"} == {i: h or "" for i, _, h in data if want[i][2] == "response"}
    assert {r.target_uri for r in rows} == {"u5", "u2%0D%0AX: y", None, "ü", "u7", "u3", "u4", "u6", "u8"}


def test_predicates_and_columns_are_pushed(spark, tmp_path, medium):
    path = str(tmp_path / "a")
    pages = spark.read.parquet(f"{medium}/pages.parquet")
    archive_pages(pages.unionByName(pages.limit(20).withColumn("page_id", F.col("page_id") + 100000)), path, gzip=False)
    assert read(spark, path, pushdown="true").filter("record_type = 'revisit'").count() == 20

    def slim():
        return spark.read.format("warc").option("pushdown", "true").schema("record_type string, target_uri string").load(path)

    assert slim().filter("target_uri is not null and record_type in ('response')").count() == pages.count()
    # a file whose payloads are damaged can still be read for its headers, so payloads are not decoded
    for name in os.listdir(path):
        if name.endswith(".warc"):
            blob = open(f"{path}/{name}", "rb").read()
            open(f"{path}/{name}", "wb").write(blob.replace(b"<html", b"<HTML"))
    for name in os.listdir(path):
        if name.endswith(".crc"):
            os.remove(f"{path}/{name}")
    assert slim().count() == pages.count() + 20
    assert read(spark, path, verify="true", pushdown="true").filter("record_type = 'revisit'").count() == 20  # responses are not decoded
    assert read_warc(spark, path, ["revisit"], verify=True).count() == 20
    page = str(read_warc(spark, path, ["revisit"]).head().headers["X-Page-Id"])
    assert [r.record_type for r in read_warc(spark, path, headers={"x-page-id": page}, verify=True).collect()] == ["revisit"]
    one = slim().filter("target_uri is not null").head().target_uri
    assert read(spark, path).filter(F.col("target_uri") == one).count() == spark.read.parquet(f"{medium}/pages.parquet").filter(F.col("url") == one).count() + read(spark, path).filter(F.col("record_type") == "revisit").filter(F.col("target_uri") == one).count()
    with pytest.raises(Exception, match="does not have the digest"):
        read(spark, path, verify="true").collect()


def test_one_relation_in_several_queries(spark, tmp_path):
    path = str(tmp_path / "a")
    archive_pages(spark.createDataFrame([(k, f"u{k}", f"page {k % 3}") for k in range(9)], "page_id long, url string, html string"), path)
    for df in (read(spark, path), read_warc(spark, path)):
        response, revisit = df.filter("record_type = 'response'"), df.filter("record_type = 'revisit'")
        assert (response.count(), revisit.count(), df.count()) == (3, 6, 9)
        assert response.unionByName(revisit).count() == 9 and response.crossJoin(revisit.select("record_id")).count() == 18
    assert read_warc(spark, path, ["response"], columns=["target_uri"]).columns == ["target_uri"]
    assert read_warc(spark, path, [], columns=["record_type"]).count() == 0


def test_only_committed_files_are_read_and_foreign_archives(spark, tmp_path):
    path = tmp_path / "a"
    pages = spark.createDataFrame([(1, "u", "a")], "page_id long, url string, html string")
    archive_pages(pages, str(path))
    (path / "part-lost.warc.gz").write_bytes(b"junk")
    assert read(spark, str(path)).count() == 1
    archive_pages(pages, str(path))
    assert read(spark, str(path)).count() == 2
    assert [len(json.loads(p.read_text())) for p in path.glob("_manifest-*.json")] == [1, 1] and not list(path.glob("_draft-*"))
    pages.select(F.lit("resource").alias("record_type"), F.lit(b"x").alias("payload"), F.create_map(F.lit("A:\nB"), F.lit("c\nd")).alias("headers")).write.format("warc").mode("overwrite").save(str(path))
    assert [(r.record_type, r.headers["A%3A%0AB"]) for r in read(spark, str(path)).collect()] == [("resource", "c%0Ad")]
    other = tmp_path / "b"
    other.mkdir()
    one = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    (other / "x.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(one.replace(b"warcinfo", b"resource")))
    register(spark)
    assert sorted(r.record_type for r in read(spark, str(other)).collect()) == ["resource", "warcinfo"]
    assert bytes(read(spark, str(other)).filter("record_type = 'resource'").head().payload) == b"hello"


def test_empty_table(spark, tmp_path):
    archive_pages(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "a"))
    assert read(spark, str(tmp_path / "a")).count() == 0
