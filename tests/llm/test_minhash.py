import random
import re
from functools import partial

import numpy as np
import pytest

from quillmill.llm import graph, minhash
from quillmill.llm.common import spread_join
from quillmill.llm.minhash import Banding, near_duplicates, shingles


def sets_of(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset([tuple(words)] if len(words) < width else [tuple(words[k : k + width]) for k in range(len(words) - width + 1)])


def brute(rows, width, threshold):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    sets = [(i, sets_of(t, width)) for i, t in rows if i is not None]
    for n, (a, x) in enumerate(sets):
        find(a)
        for b, y in sets[:n]:
            if x and y and 100 * len(x & y) >= threshold * len(x | y):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return sorted(((i, len(sets_of(t, width)), None if i is None else find(i)) for i, t in rows), key=str)


def corpus(seed, groups=12):
    rng = random.Random(seed)
    vocab = [f"v{k}" for k in range(400)]
    rows, n = [], 0
    for _ in range(groups):
        base = rng.choices(vocab, k=rng.choice([1, 2, 5, 40, 150]))
        for _ in range(rng.randint(1, 12)):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 12))):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            rows.append((n, " ".join(words) if rng.random() < 0.8 else "\n".join(words).upper()))
            n += 1
    rng.shuffle(rows)
    return rows + [(5000, None), (5001, ""), (5002, " \n"), (5003, "one"), (5004, "ONE"), (None, rows[0][1])]


def run(spark, rows, width, threshold):
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, component_id int")
    out = near_duplicates(docs, width=width, threshold=threshold).collect()
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in out)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out), key=str)


@pytest.mark.parametrize(("seed", "width", "threshold"), [(1, 3, 85), (2, 5, 80)])
def test_against_all_pairs(spark, seed, width, threshold):
    rows = corpus(seed)
    assert run(spark, rows, width, threshold) == brute(rows, width, threshold)


def test_strays_are_compared_in_blocks(spark, monkeypatch):
    """A chain in which hubs miss links: neighbours are similar, the ends aren't."""
    whole, blocks = minhash.rest_links, []
    monkeypatch.setattr(minhash, "rest_links", lambda m, b, w: blocks.append(1) or whole(m, b, w, block=3))
    words = [f"c{k}" for k in range(400)]
    rows = [(i, " ".join(words[2 * i : 2 * i + 60])) for i in range(60)]
    random.Random(4).shuffle(rows)
    got = run(spark, rows, 3, 85)
    assert got == brute(rows, 3, 85) and blocks


def test_rows_that_share_an_id_add_their_links(spark):
    a, b = (" ".join(f"{p}{k}" for k in range(30)) for p in "ab")
    assert {r[0]: r[2] for r in run(spark, [(1, a), (2, a), (2, b), (3, b)], 3, 85)} == {1: 1, 2: 1, 3: 1}


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bands_and_bounds():
    b = Banding(85)
    assert (1 - 0.85**b.rows) ** b.bands <= b.miss
    steps = b.steps()
    assert steps[-1][0] == b.hashes
    rng = np.random.default_rng(0)
    for similarity, share in ((0.95, 1.0), (0.5, 0.0)):
        left = np.zeros((4000, b.hashes), np.uint16)
        right = (rng.random(left.shape) > similarity).astype(np.uint16)
        assert abs(len(minhash._survive(left, right, steps)) / 4000 - share) < 0.01


def test_shingles_are_distinct():
    values, counts = shingles(["a b c a b c", "", "A b", "a b"], 3)
    assert counts.tolist() == [3, 0, 1, 1] and values[3] == values[4]


def test_components_of_a_chain_take_few_rounds(spark, monkeypatch):
    """Pointers double their reach, whichever way a chain is numbered."""
    tables, plain = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: tables.append(name) or plain(df, name))
    n = 4096
    mixed = random.Random(3).sample(range(n), n)
    for order in (list(range(n)), mixed):
        tables.clear()
        edges = spark.createDataFrame(list(zip(order, order[1:])), "a long, b long")
        got = graph.components(edges).collect()
        assert len(got) == n and {r["component"] for r in got} == {0}
        assert tables.count("edges") <= 9 and (order is mixed or tables.count("step") <= 15)


def test_chain_of_versions(spark, monkeypatch):
    """Each version is near only those beside it, in order of id."""
    tables, plain = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: tables.append(name) or plain(df, name))
    words = [f"c{k}" for k in range(400)]
    rows = [(i, " ".join(words[3 * i : 3 * i + 60])) for i in range(64)]
    assert run(spark, rows, 3, 85) == brute(rows, 3, 85)
    assert tables.count("step") <= 3 * 8


def test_spread_join_is_a_join(spark):
    rng = random.Random(1)
    left = spark.createDataFrame([(rng.choice([1, 1, 1, 1, 2, 3, None, 9]), i) for i in range(400)], "k int, v int")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d"), (None, "n")], "k int, w string")
    for how in ("left", "inner", "left_semi"):
        got = spread_join(left, right, ["k"], how, least=20, share=4)
        want = left.join(right, ["k"], how)
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert spread_join(left.limit(0), right, ["k"]).count() == 0


def test_very_long_and_repeated_texts(spark):
    """Texts of many words, one word without a blank, rows written more than once."""
    long = " ".join(f"w{k}" for k in range(60_000))
    rows = [(1, long), (2, long + " end"), (2, long + " end"), (3, "x" * 1_000_000), (4, "x" * 1_000_000), (5, " " * 1_000_000 + "a"), (6, "a"), (7, "a b")]
    assert {r[0]: r[2] for r in run(spark, rows, 3, 85)} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5, 7: 7}


def rows_made(spark, pattern, run):
    """Rows that the plan nodes with this description have put out while ``run`` ran."""
    context, store = spark.sparkContext._jsc.sc(), spark._jsparkSession.sharedState().statusStore()
    context.listenerBus().waitUntilEmpty()
    listed = store.executionsList()
    last = max((listed.apply(k).executionId() for k in range(listed.size())), default=-1)
    run()
    context.listenerBus().waitUntilEmpty()
    total, listed = 0, store.executionsList()
    for number in (listed.apply(k).executionId() for k in range(listed.size())):
        if number > last:
            nodes, values = store.planGraph(number).allNodes(), store.executionMetrics(number)
            for node in (nodes.apply(k) for k in range(nodes.size())):
                if re.search(pattern, re.sub(r"#\d+L?", "", node.desc())):
                    metrics = (node.metrics().apply(k) for k in range(node.metrics().size()))
                    total += sum(int(values.apply(m.accumulatorId()).replace(",", "")) for m in metrics if m.name() == "number of output rows" and values.contains(m.accumulatorId()))
    return total


def test_members_of_mixed_buckets_are_found_once(spark, monkeypatch):
    """A group near the threshold: each member of a bucket goes through the semi join once, in frequent buckets too."""
    base, made, labelled, whole = [f"b{k}" for k in range(40)], [], minhash._labelled, near_duplicates
    rows = [(i, " ".join([*base[: i % 36 + 2], f"x{i}", *base[i % 36 + 3 :]])) for i in range(60)]
    monkeypatch.setattr(minhash, "_labelled", lambda m, labels: made.append(labelled(m, labels)) or made[-1])
    monkeypatch.setattr(minhash, "spread_join", partial(spread_join, least=20))
    got = []
    # no rounds: what they make comes on top, over a quarter of the bands each
    monkeypatch.setitem(globals(), "near_duplicates", partial(whole, rounds=0))
    n = rows_made(spark, r"\[band, bucket\], \[band, bucket\], LeftSemi", lambda: got.extend(run(spark, rows, 3, 85)))
    assert got == brute(rows, 3, 85)
    (members,) = made
    mixed = members.join(members.where("component <> hub").select("band", "bucket").distinct(), ["band", "bucket"], "left_semi").count()
    frequent = members.groupBy("band", "bucket").count().where("count > 20").count()
    assert frequent and mixed > members.count() / 2
    assert mixed <= n <= mixed + frequent  # the list of frequent buckets is joined as well
