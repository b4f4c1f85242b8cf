import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillmill.llm.packing import Encoder, endless, pack_documents, plan_packing
from quillmill.llm.queries import byte_bpe


def bins_of(plan, counts, capacity):
    """Place every (length, rank) by the plan and check that bins are gapless."""
    found = {}
    for length, n in counts.items():
        for rank in range(n):
            rows = [p for p in plan if p[0] == length and p[1] <= rank < p[2]]
            assert len(rows) == 1
            _, first, _, start, each, offset = rows[0]
            k = rank - first
            found.setdefault(start + k // each, []).append((offset + k % each * length, length))
    for pieces in found.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return found


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), max_size=25))
def test_plan_places_all_without_gaps(counts):
    found = bins_of(plan_packing(counts, 60).tolist(), counts, 60)
    assert sum(map(len, found.values())) == sum(counts.values())
    assert all(sum(3 * n > 60 for _, n in pieces) <= 2 for pieces in found.values())


def test_plan_is_near_the_lower_bound():
    rng = random.Random(3)
    counts = {}
    for _ in range(5000):
        n = min(2048, int(rng.lognormvariate(5.5, 1.2)) + 1)
        counts[n] = counts.get(n, 0) + 1
    plan = plan_packing(counts, 2048)
    bins = max(p[3] + -(-(p[2] - p[1]) // p[4]) for p in plan.tolist())
    assert bins <= 1.01 * sum(n * c for n, c in counts.items()) / 2048 + 1


def test_lengths_are_checked():
    with pytest.raises(ValueError):
        plan_packing({2049: 1}, 2048)
    assert plan_packing({}, 2048).shape == (0, 6)


def test_documents(spark):
    rows = [(1, "Hello world"), (2, None), (3, ""), (4, "word " * 5000), (4, "word " * 5000), (None, "no id"), (5, "a <|endoftext|> b")]
    rows += [(100 + i, "same text") for i in range(50)]
    docs = spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, text string, piece string, length long")
    out = pack_documents(docs, capacity=64, **byte_bpe()).toPandas().sort_values(["sequence_id", "offset"])
    assert (out.offset == out.groupby("sequence_id").length.cumsum() - out.length).all()
    assert out.groupby("sequence_id").length.sum().max() <= 64
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    expected = []
    for i, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        end = (len(ids) - 1) % 64 + 1
        start = piece = 0
        while start < len(ids):
            expected.append((i, piece, start, end - start, zlib.crc32(np.array(ids[start:end], "<u4").tobytes())))
            start, end, piece = end, end + 64, piece + 1
    got = [(None if i != i else int(i), *map(int, r)) for i, *r in out[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pack_documents(docs, **byte_bpe()).count() == 0


def test_ranks_survive_hot_lengths(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("hot").alias("text"))
    out = pack_documents(docs, capacity=16, **byte_bpe()).toPandas()
    assert out.groupby("sequence_id").size().max() == 16 // out.length[0] and len(out) == 3000
    assert not out.duplicated(["sequence_id", "offset"]).any()


@pytest.mark.parametrize("text", [" " * 1_000_000 + "a", "a" * 1_000_001, "\n" * 300_000 + " " * 700_000, "1" * 1_000_000, "-" * 1_000_000 + "<|endoftext|>"])
def test_endless_runs(spark, text):
    docs = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    out = pack_documents(docs, **byte_bpe()).where("doc_id = 1").orderBy("piece").collect()
    ids = np.array([*Tokenizer.from_file(P.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids, 0], "<u4")
    assert sum(r["length"] for r in out) == len(ids)
    assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in out)


ENCODER = Encoder(**byte_bpe())
LIBRARY = Tokenizer.from_file(P.path("byte_bpe_50k.json"))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(), st.sampled_from([" ", "\n\n", "the", " the", "'s", "12", "<|endoftext|>", "é", "\u2028", "日本", "²", "_", "--"])), max_size=12).map("".join))
def test_any_text_has_the_ids_of_the_library(text):
    assert ENCODER.ids(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_documents_have_the_ids_of_the_library(spark):
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect():
        assert ENCODER.ids(r["text"] or "").tolist() == LIBRARY.encode(r["text"] or "", add_special_tokens=False).ids


def test_endless_runs_are_found():
    assert endless("a " + "b" * 1000) and endless("a" + " " * 1000 + "b") and endless("x" + "\n\t" * 500) and endless(" " * 1000)
    assert not endless("a " * 5000) and not endless("a  " * 5000) and not endless(("b" * 999 + " " * 999) * 3) and not endless("")
