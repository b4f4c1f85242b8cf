import json

import pytest
from pyspark.sql import functions as F

from quillmill.sources import files, snapshot
from quillmill.streaming import resume


def test_pages_in_order(spark, tmp_path):
    (tmp_path / "page-2.json").write_text(json.dumps({"records": [{"id": "c"}]}))
    (tmp_path / "page-1.json").write_text(json.dumps([{"id": "a", "n": 1}, {"id": "b"}]))
    (tmp_path / "notes.txt").write_text("not a page")
    rows = snapshot.read_pages(spark, str(tmp_path), "id string, n int").orderBy("ingest_seq").collect()
    assert [(r["id"], r["n"]) for r in rows] == [("a", 1), ("b", None), ("c", None)]


def test_broken_page_fails(spark, tmp_path):
    (tmp_path / "page-1.json").write_text("{")
    with pytest.raises(Exception, match="JSONDecodeError|Expecting"):
        snapshot.read_pages(spark, str(tmp_path), "id string", attempts="2").collect()


def test_pdf_import(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF one doi:10.1234/x")
    (tmp_path / "b.pdf").write_bytes(b"broken")

    def pages(content):
        if content == b"broken":
            raise ValueError("damaged")
        return [content.decode(), "\nReferences\nold"]

    got = {r["path"][-5:]: r for r in files.pdf_papers(files.read_binary(spark, str(tmp_path)), pages).collect()}
    assert got["a.pdf"]["doi"] == "10.1234/x" and "old" not in got["a.pdf"]["full_text"]
    assert got["b.pdf"]["status"] == "failed" and got["b.pdf"]["last_error"] == "damaged"
    (tmp_path / "t.txt").write_text("whole\ntext ")
    assert [r["full_text"] for r in files.read_texts(spark, str(tmp_path)).collect()] == ["whole\ntext "]


def test_ingest_resumes(spark, tmp_path):
    source, target, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string")
    rows.coalesce(1).write.parquet(f"{source}")
    resume.ingest(spark, source, rows.schema, target, check, key="k")
    spark.createDataFrame([(2, "again"), (3, "c")], rows.schema).coalesce(1).write.mode("append").parquet(source)
    resume.ingest(spark, source, rows.schema, target, check, key="k")
    resume.ingest(spark, source, rows.schema, target, check, key="k")
    got = spark.read.option("recursiveFileLookup", "true").parquet(target)
    assert sorted((r["k"], r["v"]) for r in got.collect()) == [(1, "a"), (2, "b"), (3, "c")]


def test_windowed_counts(spark):
    rows = spark.createDataFrame([("2024-01-01 10:00:00", "x"), ("2024-01-01 23:00:00", "x"), ("2024-01-02 00:00:00", "y")], "t string, event_type string").withColumn("ts", F.to_timestamp("t"))
    assert sorted(r["n"] for r in resume.windowed_counts(rows).collect()) == [1, 2]


def test_doi_candidates_by_key(spark):
    """Preferred keys first, the journal's own DOI never, then the text's."""
    info = {"/Note": "10.1234/note", "/JournalDOI": "10.1234/journal", "/doi": "see doi:10.1234/own", "/Subject": "10.1234/subject and 10.1234/own"}
    rows = spark.createDataFrame([("a", info, "10.1234/text 10.1234/text 10.1234/note"), ("b", None, None), ("c", {}, "10.1234/x")], "path string, info map<string,string>, full_text string")
    got = {r["path"]: r["candidates"] for r in files.doi_candidates(rows).collect()}
    assert got["a"] == ["10.1234/own", "10.1234/subject", "10.1234/note", "10.1234/text"] and got["b"] == [] and got["c"] == ["10.1234/x"]
