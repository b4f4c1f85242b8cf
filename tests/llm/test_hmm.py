import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from quillmill.llm import hmm


def tiny(seed, symbols=4, states=3):
    rng = np.random.default_rng(seed)
    row = lambda n: rng.dirichlet(np.ones(n))
    return hmm.Hmm(row(states), row(states), np.stack([row(states) for _ in range(states)]), np.stack([row(symbols) for _ in range(states)], 1))


def paths(model, seq, start):
    for path in itertools.product(range(len(start)), repeat=len(seq)):
        p = start[path[0]] * model.emit[seq[0], path[0]]
        for a, b, s in zip(path, path[1:], seq[1:]):
            p *= model.move[a, b] * model.emit[s, b]
        yield path, p


SEQUENCES = [[1, 2, 0], [0], [3, 3, 1, 2, 0], [2, 0]]


def packed_sequences():
    tokens = np.array([s for q in SEQUENCES for s in q])
    n = np.array([len(q) for q in SEQUENCES])
    return tokens, np.cumsum(n) - n, n


def test_forward_is_the_sum_over_paths():
    model = tiny(1)
    got = hmm.log_likelihood(model, *packed_sequences())
    expected = [math.log10(sum(p for _, p in paths(model, q, model.start))) for q in SEQUENCES]
    assert np.allclose(got, expected)


def test_expected_counts_are_exact():
    model = tiny(2)
    begins = np.array([True, True, False, True])
    got, total = hmm.expected(model, *packed_sequences(), begins)
    emit, move, start, later = np.zeros_like(model.emit), np.zeros_like(model.move), np.zeros(3), np.zeros(3)
    whole = 0.0
    for q, b in zip(SEQUENCES, begins):
        first = model.start if b else model.share
        z = sum(p for _, p in paths(model, q, first))
        whole += math.log10(z)
        for path, p in paths(model, q, first):
            (start if b else later)[path[0]] += p / z
            for s, k in zip(q, path):
                emit[s, k] += p / z
            for a, c in zip(path, path[1:]):
                move[a, c] += p / z
    assert np.allclose(got, np.vstack([emit, move, start, later])) and np.isclose(total, whole)


def corpus(n=150):
    rng = random.Random(1)
    vocab = {"x": [f"x{k}" for k in range(40)], "y": [f"y{k}" for k in range(40)]}
    rows = []
    for i in range(n):
        words = rng.choices(vocab["xy"[i % 2]], k=rng.randint(0, 30)) + [f"rare{i}"] * (i % 5 == 0)
        rows.append((i, rng.choice([" ", "\n"]).join(words).title()))
    return [*rows, (900, None), (901, ""), (0, rows[0][1]), (None, "x1 x2"), (902, "x1 " * 5000)]


def test_documents(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int").repartition(3)
    out = hmm.score_documents(docs, frequent=30, classes=8, states=3, rounds=4, longest=16).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    words = lambda t: (t or "").encode().lower().split()
    counts, ends = Counter(), 0
    for i, t in rows:
        if not held(i):
            counts.update(words(t))
            ends += 1
    total, kinds = sum(counts.values()) + ends, len(counts) + 1
    expected = []
    for i, t in rows:
        c = [counts[w] for w in words(t)] + [ends]
        base = sum(math.log10((x + 0.1) / (total + 0.1 * (kinds + 1))) for x in c)
        expected.append((i, held(i), len(c), sum(x > 0 for x in c), total, round(base, 6)))
    got = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    assert all(r["score"] < 0 for r in out)


def test_words_of_a_state_sum_to_one(spark):
    docs = spark.createDataFrame([(i, t) for i, t in corpus() if i is not None], "doc_id long, text string")
    from pyspark.sql import functions as F

    packed = hmm.pack_texts(docs.withColumn("held", F.lit(False)), "held").cache()
    words = hmm.word_table(packed).cache()
    model = hmm.train(packed, words, frequent=10, classes=4, states=2, rounds=2)
    known = [bytes(r["word"]) for r in words.where("word is not null").select("word", "c").collect()]
    counts = {bytes(r["word"]): r["c"] for r in words.where("word is not null").collect()}
    symbols = model.symbols.of(known)
    mass = np.zeros(model.symbols.total)
    mass[: 1 + len(model.symbols.frequent)] = 1
    for w, s in zip(known, symbols):
        if s > len(model.symbols.frequent):
            mass[s] += (counts[w] + 0.1) / (model.class_tokens[s] + 0.1 * (model.class_words[s] + 1))
    mass[1 + len(model.symbols.frequent) :] += 0.1 / (model.class_tokens + 0.1 * (model.class_words + 1))[1 + len(model.symbols.frequent) :]
    assert np.allclose(mass, 1) and np.allclose(model.hmm.emit.sum(0), 1) and np.allclose(model.hmm.move.sum(1), 1)


def test_training_helps():
    rng = np.random.default_rng(3)
    model = hmm.Hmm.begin(np.full(6, 1 / 6), 2, 0)
    tokens = np.concatenate([np.append(rng.choice([1, 2] if k % 2 else [3, 4, 5], 12), 0) for k in range(40)])
    first, n = np.arange(40) * 13, np.full(40, 13)
    seen = []
    for _ in range(8):
        sums, total = hmm.expected(model, tokens, first, n, np.ones(40, bool))
        seen.append(total)
        emit, move = sums[:6] + 1e-6, sums[6:8] + 1e-6
        model = hmm.Hmm((sums[-2] + 1e-6) / (sums[-2] + 1e-6).sum(), model.share, move / move.sum(1, keepdims=True), emit / emit.sum(0))
    assert all(b >= a - 1e-3 for a, b in zip(seen, seen[1:])) and seen[-1] > seen[0]


def test_nothing_to_learn_from(spark):
    assert hmm.score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = hmm.score_documents(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert r["train_tokens"] == 0 and r["n_known"] == 0 and r["n_tokens"] == 3 and math.isfinite(r["score"])


def test_words_are_those_of_bytes():
    blanks = [chr(c) for c in range(33)] + ["\x7f", "\x85", "\xa0", "\u2003", "\u3000", "\u200b"]
    texts = [None, "", " ", "\t\n", " A b\x0bC\x0c", "ÄÖ İI ſK\u212a", "e\u0301 E\u0301", "\U0001f600A \U0001f600a", "x", *(f"A{b}B{b}{b}C{b}" for b in blanks), *(f"{b}A" for b in blanks)]
    for some in (pa.array(texts), pa.array(texts, pa.large_string()), pa.array(["no", *texts, "no"]).slice(1, len(texts)), pa.array([None], pa.string()), pa.array([], pa.string())):
        words, n = hmm.cut_words(some)
        lists = [(t or "").encode().lower().split() for t in some.to_pylist()]
        assert n.tolist() == [len(ws) for ws in lists]
        assert [w.encode() for w in words.to_pylist()] == [w for ws in lists for w in ws]


def test_packed_texts_come_back(spark):
    from pyspark.sql import functions as F

    rows = [(i, t) for i, t in corpus() if i is not None] + [(903, "\u3000 Ä\x0bä"), (904, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = []
    packed = hmm.pack_texts(docs.withColumn("held", F.col("doc_id") % 3 == 0), "held", chunk_chars=3000).collect()
    for r in packed:
        chunk = hmm.Chunk.of(r.asDict())
        assert len(set(chunk.words)) == len(chunk.words)
        ends = np.cumsum(chunk.lengths)
        got += [(i, h, [chunk.words[k] for k in chunk.tokens[e - n : e]]) for i, h, e, n in zip(chunk.doc_ids, chunk.held, ends, chunk.lengths)]
    assert len(got) == len(rows)
    assert sorted(got) == sorted((i, i % 3 == 0, (t or "").encode().lower().split()) for i, t in rows)


def test_training_numbers_the_texts_once(spark, monkeypatch):
    """Rounds read written symbols instead of opening every chunk and numbering its words again."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, t) for i, t in corpus() if i is not None], "doc_id long, text string")
    packed = hmm.pack_texts(docs.withColumn("held", F.col("doc_id") % 7 == 0), "held").cache()
    words = hmm.word_table(packed).cache()
    passes, plain = [], type(packed).mapInArrow
    monkeypatch.setattr(type(packed), "mapInArrow", lambda self, *a, **k: (passes.append(1) if self is packed else None, plain(self, *a, **k))[1])
    model = hmm.train(packed, words, frequent=10, classes=4, states=2, rounds=4)
    assert len(passes) == 1
    symbols = {}
    for r in hmm.training_symbols(packed, model.symbols).collect():
        flat, at = hmm._open_numbers(r["symbols"]).tolist(), 0
        for n in r["lengths"]:
            symbols[len(symbols)], at = flat[at : at + n], at + n
        assert at == len(flat)
    of = lambda t: [*model.symbols.of((t or "").encode().lower().split()).tolist(), hmm.END]
    assert sorted(symbols.values()) == sorted(of(t) for i, t in corpus() if i is not None and i % 7)


def test_word_counts_take_one_sort(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, "c d")], "doc_id long, text string").repartition(3)
    packed = hmm.pack_texts(docs.withColumn("held", F.col("doc_id") == 3), "held").cache()
    table = hmm.word_table(packed)
    rows = table.collect()
    assert sorted((bytes(r["word"]), r["c"]) for r in rows if r["word"] is not None) == [(b"a", 2), (b"b", 2), (b"c", 1), (b"d", 0)]
    plan = table._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Window") == 1 + plan.count("WindowGroupLimit")
