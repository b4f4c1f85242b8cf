import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmill.llm import substring
from quillmill.llm.substring import remove_repeats


def brute(rows, size):
    """(n_words, kept words) per row, by looking at every window in order."""
    seen, drop = {}, {}
    for i, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        words = (text or "").encode().split()
        for s in range(len(words) - size + 1):
            window = tuple(words[s : s + size])
            first = seen.setdefault(window, (i, s))
            if first != (i, s):
                drop.setdefault(i, set()).update(range(s, s + size))
    out = []
    for i, text in rows:
        words = (text or "").encode().split()
        gone = drop.get(i, set()) if i is not None else set()
        out.append((i, len(words), b" ".join(w for k, w in enumerate(words) if k not in gone).decode()))
    return sorted(out, key=str)


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(300)]
    passage = rng.choices(vocab, k=40)
    rows = []
    for i in range(n):
        words = rng.choices(vocab, k=rng.choice([0, 3, 19, 20, 60]))
        if rng.random() < 0.5:
            a, b = sorted(rng.sample(range(41), 2))
            words += passage[a:b] + rng.choices(vocab, k=5)
        if rng.random() < 0.2:
            words += words
        if rng.random() < 0.1:
            words += ["again"] * 50
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(words)))
    rows += [(1000 + k, rows[k][1]) for k in range(10)] + [(2000, None), (2001, ""), (None, rows[0][1])]
    return rows


def run(spark, rows, size):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_words string").repartition(5)
    out = remove_repeats(docs, size=size)
    assert out.columns.count("n_words") == 1
    return sorted(((r["doc_id"], r["n_words"], r["kept_text"]) for r in out.collect()), key=str), out


def test_against_brute_force(spark):
    for seed, size in ((1, 20), (2, 8)):
        rows = corpus(seed)
        got, out = run(spark, rows, size)
        assert got == brute(rows, size)
        for r in out.collect():
            assert r["n_removed"] == sum(s["end"] - s["first"] for s in r["removed_spans"])


def test_spread_minimisers_change_nothing(spark, monkeypatch):
    """Frequent minimisers go to buckets window by window; several buckets and slices are in use."""
    rows = corpus(3)
    monkeypatch.setattr(substring, "BUCKET_BYTES", 4000)
    for bits in (0, 0b10101010, 255):
        monkeypatch.setattr(substring, "_frequent", lambda *a, bits=bits: np.full((2, substring.CELLS // 8), bits, np.uint8))
        assert run(spark, rows, 20)[0] == brute(rows, 20)


def test_minimiser_that_is_rare_in_each_slice_is_found(spark):
    """One passage in each of very many small tasks, once a task."""
    rng = random.Random(9)
    passage = " ".join(f"p{k}" for k in range(20))
    rows = [(i, passage + "\n" + " ".join(f"v{rng.randrange(10**6)}" for _ in range(60))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(100)
    bits = substring._frequent(docs, 20, 150)
    low = substring.Words.of([passage.encode()], 20).minimisers()
    assert substring._is_frequent(bits, low).all()
    assert sum(np.unpackbits(b).sum() for b in bits) < 40
    own = substring.Words.of([rows[0][1].encode()], 20).minimisers()
    assert substring._is_frequent(bits, own).mean() < 0.5


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "ab", "aaaaaaaa", "aaaaaaaab", "x" * 16, "x" * 17, "é", "\u2003", "y" * 513, "y" * 514, " ", "  ", "\t", "\n", "\x0b\x0c", "\r", "\x1c", "\x85"]), max_size=30).map("".join), max_size=6))
def test_words_are_those_of_a_split(texts):
    raw = [t.encode() for t in texts]
    row = substring.Words.of(raw, 2)
    words = [w for t in raw for w in t.split()]
    assert [row.bytes_of(k) for k in range(len(row.starts))] == words and row.first.tolist() == np.cumsum([0, *(len(t.split()) for t in raw)])[:-1].tolist()
    assert [[a == b for b in words] for a in words] == [[a == b for b in row.ids.tolist()] for a in row.ids.tolist()]
    assert row.hash.tolist() == [int(substring.Words.of([w], 2).hash[0]) for w in words]


def test_words_that_share_a_hash(spark, monkeypatch):
    """Numbers come from a dictionary then, and windows with one hash are told apart by them."""
    monkeypatch.setattr(substring.Words, "_hashes", lambda self: np.full(len(self.starts), 7, np.uint64))
    a, b, c = b"aaaaaaaaa", b"bbbbbbbbb", b"c" * 600
    row = substring.Words.of([b" ".join((a, b, a, c)), b" ".join((c, a))], 2)
    assert row.ids.tolist() == [0, 1, 0, 2, 2, 0]
    repeat, first = row.repeats(row.text, row.at - row.first[row.text], row.window_hash())
    assert repeat.tolist() == [False] * 4 and first.all()
    row = substring.Words.of([b" ".join((a, b, a, b))], 2)
    assert row.repeats(row.text, row.at, row.window_hash())[0].tolist() == [False, False, True]


def test_odd_rows(spark):
    """A very long text, one endless word, blanks only, many rows without an id."""
    long = " ".join(f"w{k % 5000}" for k in range(60_000))
    rows = [(1, long), (2, "x" * 1_000_000), (3, "x" * 1_000_000), (4, " " * 500_000), (5, long)] + [(None, long[:2000])] * 20
    assert run(spark, rows, 20)[0] == brute(rows, 20)


def test_rows_that_share_an_id(spark):
    text = " ".join(f"a{k}" for k in range(30))
    got, _ = run(spark, [(1, text), (1, text), (2, text)], 20)
    assert got == [(1, 30, text), (1, 30, text), (2, 30, "")]


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
