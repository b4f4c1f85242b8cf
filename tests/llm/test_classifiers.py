import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillmill.llm import langid, queries, toxicity
from quillmill.llm.common import id_crc

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").withColumn("held_out", id_crc() % 5 == 0)


def test_crc_matches_zlib(docs):
    for r in docs.select("doc_id", "held_out").limit(50).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_language_accuracy(spark, docs):
    model = langid.fit_languages(docs.where(~F.col("held_out")))
    assert set(model.dictionaries) == {"de", "en", "es", "fr"} and all(len(d) <= 112_640 for d in model.dictionaries.values())
    out = langid.identify(docs.where("held_out"), model, keep=["lang"]).where("lang_pred <> 'und'").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in out]) >= 0.95
    assert np.mean([r["rejected"] for r in out]) < 0.05 and all(0 <= r["score"] <= 1 for r in out)


def test_language_edge_cases(spark, docs):
    model = langid.fit_languages(docs.where(~F.col("held_out")))
    rows = spark.createDataFrame([(1, None, 0.0), (2, "", 0.0), (3, "12 -- 3", 0.0), (4, "der die und das " * 40_000, 0.0), (4, "der die und das " * 40_000, 0.0), (None, "the of and", 0.0)], "doc_id long, text string, score double")
    out = langid.identify(rows, model, keep=["score", "text"]).collect()
    got = {r["doc_id"]: r for r in out}
    assert len(out) == 6 and [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and got[1]["rejected"] and got[1]["score"] == 0
    assert got[4]["lang_pred"] == "de"
    assert langid.identify(rows.limit(0), model).count() == 0
    empty = langid.fit_languages(docs.limit(0))
    assert {r["lang_pred"] for r in langid.identify(rows, empty).collect()} == {"und"}
    again = langid.fit_languages(docs.where(~F.col("held_out")).repartition(7))
    assert again.dictionaries == model.dictionaries


def plain_languages(rows, size=112_640, most=400, chars=3_520):
    """The dictionaries of ``(text, lang)`` rows."""
    found = {}
    for text, lang in rows:
        for a in range(0, len(text or ""), chars):
            piece = text[a : a + chars]
            if lang is not None and any(c.isalpha() for c in piece):
                found.setdefault(lang, {})[xxhash.xxh3_64_intdigest(piece.encode())] = piece
    return {lang: b"\n".join([t for _, p in sorted(some.items())[:most] if (t := langid.letters(p).encode())])[:size] for lang, some in found.items()}


def test_language_query_against_plain_python(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, _, _ in rows}
    model = langid.LanguageModel(plain_languages([(t, lang) for i, t, lang in rows if not held[i]]))
    expected = sorted((i, held[i], *model.predict(t, 0.001)) for i, t, _ in rows)
    got = sorted(tuple(r) for r in queries.op9_language_id(spark, SF).select("doc_id", "held_out", "lang_pred", "score", "rejected").collect())
    assert got == expected


def test_no_language_is_lost(spark):
    """Repeated ids, null ids, long texts, one text many times, no letters at all."""
    rng = random.Random(6)
    words = {a: ["".join(rng.choices(a, k=6)) for _ in range(80)] for a in ("abcdef", "ghijkl", "mnopqr")}
    text = lambda alphabet, n: " ".join(rng.choices(words[alphabet], k=n))
    rows = [(7, text("abcdef", 30), "repeated id") for _ in range(3000)]
    rows += [(None, text("ghijkl", 30), "null id") for _ in range(500)] + [(10_000 + i, text("ghijkl", 30), "null id") for i in range(50)]
    rows += [(20_000 + i, text("mnopqr", 9000), "long") for i in range(3)]
    rows += [(30_000 + i, "stu vwx yzu", "one text") for i in range(3000)]
    rows += [(40_000, "123 --", "no letter"), (40_001, None, "no letter"), (40_002, "abc", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit_languages(docs)
    assert model.dictionaries == plain_languages([r[1:] for r in rows])
    assert set(model.dictionaries) == {"repeated id", "null id", "long", "one text"} and all(map(len, model.dictionaries.values()))
    for lang, alphabet in (("repeated id", "abcdef"), ("null id", "ghijkl"), ("long", "mnopqr"), ("one text", "stuvwxyz")):
        assert model.predict("stu vwx yzu" if lang == "one text" else text(alphabet, 40), 0.001)[0] == lang


def test_narrow_margins_are_rejected():
    model = langid.LanguageModel({"a": b"same words here", "b": b"same words here"})
    assert model.predict("same words", 0.001)[0] == "a" and model.predict("same words", 0.001)[2]


def test_toxicity_accuracy(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit_toxicity(docs.where(~F.col("held_out")), labels)
    out = toxicity.score_toxicity(docs, model, keep=["held_out"]).join(labels, "doc_id").toPandas()
    assert ((out.score >= 0) & (out.score <= 1)).all()
    held = out[out.held_out]
    assert ((held.score >= 0.5) == (held.label == 1)).mean() >= 0.93
    assert (out[out.label == 0].score < 0.5).mean() >= 0.97


def test_toxicity_edge_cases(spark, docs):
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 0), (3, 1)], "doc_id long, label int")
    rows = spark.createDataFrame([(1, "a", 1), (2, "fine words", 1), (3, "idiot", 1), (4, None, 1), (5, "", 1), (6, "IDIOT! " * 50_000, 1)], "doc_id long, text string, score int")
    model = toxicity.fit_toxicity(rows, labels)
    out = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(rows, model, keep=["score"]).collect()}
    assert len(out) == 6 and out[4] == out[5] and all(0 <= s <= 1 for s in out.values())
    none = toxicity.fit_toxicity(rows, labels.limit(0))
    assert {r["score"] for r in toxicity.score_toxicity(rows, none).collect()} == {0.0}
    assert toxicity.score_toxicity(rows.limit(0), model).count() == 0


def test_features_see_through_obfuscation():
    listed = {"idiot": 3.0}
    at = dict(zip(toxicity.FEATURES, toxicity.features("YOU are an 1d10t and an i.d.i.o.t, IDIOOOOT!", listed)))
    assert at["listed"] == 3 and at["revealed"] > 0 and at["near_you"] > 0 and at["exclaimed"] > 0 and at["shouted"] > 0
    assert toxicity.features("", listed) == [0.0] * len(toxicity.FEATURES)


def test_trees_fit_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    trees = toxicity.grow(x, y, depth=3)
    assert ((trees.margin(x) > 0) == (y > 0)).mean() > 0.97


def test_isotonic_is_the_least_squares_fit():
    rng = random.Random(2)
    s = np.array([rng.randrange(12) for _ in range(200)], float)
    y = np.array([float(rng.random() < v / 12) for v in s])
    xs, ys = toxicity.isotonic(s, y)
    fit = np.interp(s, xs, ys)
    assert (np.diff(ys) >= 0).all() and abs(fit.mean() - y.mean()) < 1e-9
    # every nondecreasing step function is at least as far away
    for _ in range(200):
        other = np.sort(np.array([rng.random() for _ in range(12)]))[s.astype(int)]
        assert ((fit - y) ** 2).sum() <= ((other - y) ** 2).sum() + 1e-9


def test_small_blocks_of_the_calibration_are_held_back():
    s, y = np.array([1.0, 2, 3, 4, 5, 6, 6, 6, 6, 6, 6, 6, 6, 6]), np.array([0, 0, 0, 0, 1, 0, 1, 1, 1, 1, 1, 1, 1, 1], float)
    xs, ys = toxicity.isotonic(s, y, 0.1)
    assert (np.diff(ys) >= 0).all() and np.interp(4, xs, ys) < 0.1 and 0.6 < np.interp(6, xs, ys) < 0.8
    for n, held in ((1, True), (2, True), (8, False)):
        assert (np.interp(5, *toxicity.isotonic(np.array([4.0] * 9 + [5.0] * n), np.array([0.0] * 9 + [1.0] * n), 0.1)) < 0.5) == held


def plain_toxicity(rows, labels, sample=12_000):
    """The model of ``(id, text)`` rows and ``(id, label)`` pairs."""
    def h(i, text):
        seed = xxhash.xxh64(i.to_bytes(8, "little", signed=True), seed=42).intdigest()
        value = xxhash.xxh64(text.encode(), seed=seed).intdigest()
        return value - 2**64 if value >= 2**63 else value

    pairs = {(i, v) for i, v in labels if i is not None and v in (0, 1)}
    known = sorted({(h(i, t or ""), i, v, t or "") for i, t in rows if i is not None for v in (0, 1) if (i, v) in pairs})[:sample]
    y, fold = np.array([r[2] for r in known], float), np.arange(len(known)) % 4
    seen, n = {}, [0, 0]
    for (_, _, v, text), f in zip(known, fold):
        if f < 2:
            n[v] += 1
            for w in {toxicity.plain(w) for w in text.split()}:
                seen.setdefault(w, [0, 0])[v] += 1
    words = toxicity.pick_words([(w, c[1], c[0]) for w, c in seen.items()], n[1], n[0])
    x = np.array([toxicity.features(r[3], words) for r in known])
    return toxicity.fit_model(x, y, fold, words)


def test_toxicity_query_against_plain_python(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic").collect()]
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, _ in rows}
    model = plain_toxicity([r for r in rows if not held[r[0]]], labels)
    expected = {i: (held[i], s) for (i, _), s in zip(rows, model.score(np.array([toxicity.features(t or "", model.listed) for _, t in rows])))}
    got = queries.op10_toxicity(spark, SF).collect()
    assert len(got) == len(rows) and model.trees is not None
    for r in got:
        assert r["held_out"] == expected[r["doc_id"]][0] and abs(r["score"] - expected[r["doc_id"]][1]) < 1e-12 and r["predicted"] == (r["score"] >= 0.5)


def test_toxicity_sample_bounds_rows(spark, monkeypatch):
    """One id on many rows, texts beyond 40,000 characters, equal rows and ids with two labels."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(200)]
    text = lambda bad, n: " ".join([*rng.choices(words, k=n), *(["vile", "you"] if bad else [])])
    rows = [(1, text(False, 20)) for _ in range(3000)] + [(i, text(i % 2 == 0, 20 if i % 5 else 12_000)) for i in range(2, 102)] + [(200, "same")] * 500 + [(None, "vile"), (201, None), (202, "vile you")]
    labels = [(1, 0), (200, 0), (200, 1), (201, 0), (202, 1), (202, None), (None, 1)] + [(i, int(i % 2 == 0)) for i in range(2, 102)]
    tables, whole = {}, toxicity.written
    monkeypatch.setattr(toxicity, "written", lambda df, name: tables.setdefault(name, whole(df, name)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, label int")
    model = toxicity.fit_toxicity(docs, marks, sample=300)
    assert tables["sampled"].count() == 300
    plain = plain_toxicity(rows, labels, sample=300)
    assert model.listed == plain.listed and np.array_equal(model.knots, plain.knots)
    tables.clear()
    model = toxicity.fit_toxicity(docs, marks)
    assert tables["sampled"].count() == len({(i, t) for i, t in rows if i}) + 1
    assert "vile" in model.listed
    scores = model.score(np.array([toxicity.features(t, model.listed) for t in ("vile you " + "w1 " * 20_000, "w1 w2")]))
    assert scores[0] > scores[1]
