import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillmill.llm.common import release, written

from .test_minhash import brute as near_brute
from .test_packing import P, Tokenizer
from .test_substring import brute as spans_brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), name)
        out[name] = docs
    return out


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_stages_and_columns(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "language_id", "near_dedup", "substring_dedup", "packing"]
    for n in names[:-1]:
        assert stages[n].columns == stages[""].columns
    counts = [stages[n].count() for n in ["", *names[:-1]]]
    assert counts == sorted(counts, reverse=True) and counts[0] > counts[-1] > 0.6 * counts[0]


def test_near_dedup_is_brute_force(stages):
    rows = pairs(stages["language_id"])
    keep = {i for i, _, c in near_brute(rows, 5, 80) if i == c}
    assert {i for i, _ in pairs(stages["near_dedup"])} == keep


def test_substring_dedup_is_brute_force(stages):
    rows = pairs(stages["near_dedup"])
    kept = {i: (n, t) for i, n, t in spans_brute(rows, 20)}
    for i, text in pairs(stages["substring_dedup"]):
        assert text.split() == kept[i][1].split()
        assert len(text.split()) < kept[i][0] or text == dict(rows)[i]
    assert stages["substring_dedup"].where(F.length("text") != F.col("n_chars")).count() == 0


def test_packing_holds_all_tokens(stages):
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    expected = {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in pairs(stages["substring_dedup"])}
    got = {r["doc_id"]: r["n"] for r in stages["packing"].groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert got == expected


def test_clean_documents_stay(stages, spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    clean = stages[""].join(labels.where("toxic = 0"), "doc_id", "left_semi")
    lost = clean.join(stages["toxicity"], "doc_id", "left_anti").count()
    assert lost <= 0.03 * clean.count()
    assert stages["toxicity"].join(stages["language_id"], "doc_id", "left_anti").count() <= 0.05 * stages["toxicity"].count()


def test_odd_rows(spark, tmp_path):
    rng = random.Random(1)
    words = [f"w{c}" for c in "abcdefghijklmnopqrstuvwxyz"]
    rows = [(i, " ".join(rng.choices(words, k=30)), "en", "s", 1) for i in range(20)]
    rows += [(50, None, "en", "s", 0), (51, "", None, None, None), (None, "no id at all here", "en", "s", 1), (52, "1 2 3", "en", "s", 1), (1, rows[1][1], "en", "s", 1)]
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = sorted({r["doc_id"] for r in out}, key=str)
    assert 52 not in ids and 50 not in ids and None in ids and sum(r["doc_id"] == 1 and r["piece"] == 0 for r in out) == 1
    empty = tmp_path / "empty"
    spark.createDataFrame([], schema).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
    release(spark)
