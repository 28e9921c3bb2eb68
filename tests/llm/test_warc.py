import pytest

from cleanloom.llm import warc
from cleanloom.llm._common import Scratch


@pytest.fixture
def pages(spark):
    long_, other = "<p>" + "x" * 1000, "é" * 600
    rows = [(k, f"http://a/{k}", long_, 1) for k in range(40)] + [(50, None, None, 1), (51, "u\r\nX: y", "", 1), (52, "u", "short", 1), (53, "v", "short", 1)]
    rows += [(60, "u", other, 1), (61, "u", other, 1), (62, "u", other * 200, 1)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest int")


def test_against_sql(spark, pages, against, tmp_path):
    path = f"file://{tmp_path}/a"
    warc.write_archive(spark, pages, path)
    got = warc.read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    against(got, warc.ORACLE, pages=pages)
    assert spark.read.parquet(f"{path}/payloads").count() == 5


def test_exact_round_trip(spark, pages, tmp_path):
    path = f"file://{tmp_path}/a"
    warc.write_archive(spark, pages, path)
    want = {r["page_id"]: (r["html"] or "").encode() for r in pages.collect()}
    for r in warc.read_archive(spark, path).collect():
        assert bytes(r["payload"]) == want[r["page_id"]]
        fields, http, payload = warc.parse_record(bytes(r["record"]))
        assert http.startswith(b"HTTP/1.1 200") and fields["warc-type"] == r["record_type"]
        assert payload == (b"" if r["record_type"] == "revisit" else want[r["page_id"]])
        assert "x" not in fields


def test_repeats_nulls_and_empty(spark, tmp_path):
    big = "y" * 2000
    rows = [(None, "u", big), (4, "u", big), (4, "u", big), (2, "u", big)]
    path = f"file://{tmp_path}/a"
    warc.write_archive(spark, spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = warc.read_archive(spark, path).collect()
    assert sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in got) == sorted(
        [("None", "revisit", 4), ("4", "response", None), ("4", "revisit", 4), ("2", "revisit", 4)]
    )
    empty = f"file://{tmp_path}/b"
    warc.write_archive(spark, spark.createDataFrame([], "page_id long, url string, html string"), empty)
    assert warc.read_archive(spark, empty).count() == 0


def test_damage_is_found(spark, pages, tmp_path):
    path = f"file://{tmp_path}/a"
    warc.write_archive(spark, pages, path)
    stored = spark.read.parquet(f"{path}/payloads").collect()
    swapped = [(stored[0]["digest"], stored[1]["packed"]), *((r["digest"], r["packed"]) for r in stored[1:])]
    spark.createDataFrame(swapped, "digest binary, packed binary").write.mode("overwrite").parquet(f"{tmp_path}/c/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{tmp_path}/c/headers")
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read_archive(spark, f"file://{tmp_path}/c").collect()


def test_scratch_is_shared_setting(spark):
    assert Scratch(spark, "x").root.startswith(spark.conf.get("spark.checkpoint.dir"))
