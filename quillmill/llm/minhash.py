"""Near-duplicate documents by MinHash, with sequential Bayesian verification.

1. Documents with equal shingle sets form a class, which its smallest id stands
   for. All later steps see one row per class.
2. Signatures are cut into bands. The number of bands follows from the rows per
   band and the chance to miss a pair at the threshold.
3. *Hubs*: in every bucket the smallest id is compared with the other members.
   Signatures are compared batch by batch; a pair is given up as soon as the
   posterior chance that its similarity reaches the threshold falls below
   ``miss``. Survivors are confirmed on their full shingle sets.
4. *Rounds*, where large buckets still hold several components: in random
   blocks of a bucket every component but the largest names the pair with
   another component that agrees best. The few named pairs are confirmed like
   others, and groups that no hub could hold together grow together.
5. Pairs within a bucket whose components still differ are the only ones that
   can matter now, so exactly those are compared, in blocks of bounded size,
   by the same test and confirmation.

Step 5 leaves out no pair that could join two components, so the result is
what comparing all banded pairs would give, without listing the pairs of large
groups. Equal texts are never paired at all.

Texts that are null or hold no word have an empty set and are linked with
nothing. Rows that share an id are one document written more than once, whose
links add up. A row without an id is linked with nothing, has no component
and is kept. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_of, give_back, mix64, ragged, slices, spread_join, written
from .graph import components

_ODD = mix64(np.arange(1, 4097, dtype=np.uint64)) | np.uint64(1)


def shingles(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of each text in one row, and how many each has.

    A text with fewer than ``width`` words, but some, has its whole sequence as
    its only shingle. Words are lower-cased (A to Z) and cut at ASCII blanks.
    """
    import xxhash

    lists = [t.encode().lower().split() for t in texts]
    words = [w for ws in lists for w in ws]
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, number), np.uint64, len(number))
    hashes = own[np.fromiter(map(number.__getitem__, words), np.int64, len(words))]
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    first = np.cumsum(counts) - counts
    room = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    at, doc = ragged(first, room), np.repeat(np.arange(len(counts)), room)
    span = np.minimum(counts, width)[doc]
    total = span.astype(np.uint64) * _ODD[4000]
    for j in range(width):
        inside = j < span
        total[inside] += hashes[at[inside] + j] * _ODD[3000 + j]
    total = mix64(total)
    order = np.lexsort((total, doc))
    total, doc = total[order], doc[order]
    new = np.ones(len(total), bool)
    new[1:] = (total[1:] != total[:-1]) | (doc[1:] != doc[:-1])
    return total[new], np.bincount(doc[new], minlength=len(texts))


@dataclass(frozen=True)
class Banding:
    """``threshold`` in hundredths; ``bands`` of ``rows`` hashes miss a pair at it with chance ``miss``."""

    threshold: int
    rows: int = 5
    miss: float = 1e-6

    @property
    def bands(self) -> int:
        return math.ceil(math.log(self.miss) / math.log(1 - (self.threshold / 100) ** self.rows))

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    def steps(self, batch: int = 20) -> list[tuple[int, int]]:
        """(hashes seen, least matches to go on): fewer leave a posterior below ``miss``.

        With a flat prior the posterior of the similarity after m matches in n
        is Beta(m + 1, n - m + 1), and its weight above t is the chance of at
        most m successes in n + 1 trials at t.
        """
        out, t = [], self.threshold / 100
        for n in [*range(batch, self.hashes, batch), self.hashes]:
            total, least = 0.0, 0
            for m in range(n + 1):
                total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
                if total >= self.miss:
                    least = m
                    break
            out.append((n, least))
        return out


def signatures(docs: DataFrame, width: int, banding: Banding, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_shingles, set_key, bands array<long>, signature binary`` (16 bits a hash) per row."""
    n, rows = banding.hashes, banding.rows
    schema = "doc_id long, n_shingles long, set_key binary, bands array<long>, signature binary"

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        a, b = (_ODD[k : k + n].astype(np.uint32) | np.uint32(1) for k in (0, 1500))
        for batch in batches:
            ids = column_of(batch, "doc_id")
            for at, texts in slices(column_of(batch, "text")):
                values, counts = shingles(texts, width)
                ends = np.cumsum(counts)
                some = np.flatnonzero(counts)
                starts = (ends - counts)[some]
                low = np.zeros((len(some), n), np.uint32)
                if len(some):
                    x = (values >> np.uint64(32)).astype(np.uint32)
                    for i in range(n):
                        low[:, i] = np.minimum.reduceat(x * a[i] + b[i], starts)
                bands = np.zeros((len(some), banding.bands), np.uint64)
                for j in range(rows):
                    bands += low[:, j::rows].astype(np.uint64) * _ODD[2900 + j]
                bands = mix64(bands + np.arange(banding.bands, dtype=np.uint64) * _ODD[2999]).view(np.int64)
                short = low.astype("<u2")
                key, sig, band = [None] * len(texts), [None] * len(texts), [None] * len(texts)
                for k, d in enumerate(some.tolist()):
                    key[d] = xxhash.xxh3_128_digest(values[ends[d] - counts[d] : ends[d]].tobytes())
                    sig[d], band[d] = short[k].tobytes(), bands[k]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(texts)), pa.array(counts, pa.int64()), pa.array(key, pa.binary()), pa.array(band, pa.list_(pa.int64())), pa.array(sig, pa.binary())],
                    names=["doc_id", "n_shingles", "set_key", "bands", "signature"],
                )
        give_back()

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(sign, schema)


def _survive(left: np.ndarray, right: np.ndarray, steps: list[tuple[int, int]]) -> np.ndarray:
    """Which rows of two equally long signature matrices stay above every step's bound."""
    alive = np.arange(len(left))
    matches, seen = np.zeros(len(left), np.int64), 0
    for n, least in steps:
        matches = matches + (left[alive, seen:n] == right[alive, seen:n]).sum(1)
        ok = matches >= least
        alive, matches, seen = alive[ok], matches[ok], n
        if not len(alive):
            break
    return alive


def prune(pairs: DataFrame, signed: DataFrame, banding: Banding) -> DataFrame:
    """Pairs ``(a, b)`` that survive the sequential comparison of their signatures."""
    steps, width = banding.steps(), banding.hashes
    left = signed.select(F.col("doc_id").alias("a"), F.col("signature").alias("x"), F.col("n_shingles").alias("m"))
    right = signed.select(F.col("doc_id").alias("b"), F.col("signature").alias("y"), F.col("n_shingles").alias("n"))
    near = 100 * F.least("m", "n") >= banding.threshold * F.greatest("m", "n")  # else the sizes alone rule it out

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(column_of(batch, c).to_pylist()), "<u2").reshape(-1, width) for c in "xy")
                yield batch.select(["a", "b"]).take(pa.array(_survive(x, y, steps)))

    return pairs.join(left, "a").join(right, "b").where(near).select("a", "b", "x", "y").mapInArrow(test, "a long, b long")


def confirm(pairs: DataFrame, texts: DataFrame, width: int, threshold: int, together: int = 64) -> DataFrame:
    """Pairs whose full shingle sets reach the threshold: 100 * common >= threshold * all.

    The partners of one document are confirmed in groups of about ``together``,
    each of which gets that document's text once.
    """
    groups = pairs.groupBy("a").agg(F.ceil(F.count("*") / together).alias("parts"))
    dealt = pairs.join(groups, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")))
    # the first member of a group's rows is the document itself
    wanted = dealt.select("a", "part", F.col("b").alias("id")).unionByName(dealt.select("a", "part", F.col("a").alias("id")).distinct())
    rows = wanted.join(texts.select(F.col("doc_id").alias("id"), "text"), "id")

    def compare(group: pa.Table) -> pa.Table:
        a = group.column("a")[0].as_py()
        ids = group.column("id").to_pylist()
        values, counts = shingles([t or "" for t in group.column("text").to_pylist()], width)
        sets = np.split(values, np.cumsum(counts)[:-1])
        own = [s for i, s in zip(ids, sets) if i == a]
        found = set()
        for i, s in zip(ids, sets):
            if i != a:
                for mine in own:
                    common = len(np.intersect1d(mine, s, assume_unique=True))
                    if common and 100 * common >= threshold * (len(mine) + len(s) - common):
                        found.add(i)
        return pa.table({"a": pa.array([a] * len(found), pa.int64()), "b": pa.array(sorted(found), pa.int64())})

    return rows.groupBy("a", "part").applyInArrow(compare, "a long, b long")


def rest_links(members: DataFrame, banding: Banding, width: int, block: int = 2048) -> DataFrame:
    """Confirmed links across components within buckets, from ``(band, bucket, doc_id, component, hub, size, n_shingles, bands, signature, text)``.

    A member outside its hub's component is sent to every block of its bucket
    and compared there with the members of the block. Survivors are confirmed
    on the spot, so a group of documents that nearly reach the threshold is
    never listed pair by pair. A pair is looked at in the first band that it
    shares, and not again once another pair has joined its components.
    """
    steps, threshold = banding.steps(), banding.threshold
    stray = F.col("component") != F.col("hub")
    blocks = F.ceil(F.col("size") / block)
    home = members.withColumn("block", F.pmod(F.xxhash64("doc_id"), blocks)).withColumn("stray", F.lit(False))
    away = members.where(stray).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).withColumn("stray", F.lit(True))
    columns = ["band", "bucket", "block", "doc_id", "component", "n_shingles", "bands", "signature", "text", "stray"]

    def compare(group: pa.Table) -> pa.Table:
        band = group.column("band")[0].as_py()
        away = group.column("stray").to_numpy(zero_copy_only=False)
        ids, comp, size = (group.column(c).to_numpy() for c in ("doc_id", "component", "n_shingles"))
        sig = np.frombuffer(b"".join(group.column("signature").to_pylist()), "<u2").reshape(len(ids), -1)
        bands = np.array(group.column("bands").to_pylist(), np.int64)
        texts = group.column("text")
        sets: dict[str, frozenset] = {}

        def of(k: int) -> frozenset:
            text = texts[int(k)].as_py() or ""
            if text not in sets:
                sets[text] = frozenset(shingles([text], width)[0].tolist())
            return sets[text]

        here, joined, out = np.flatnonzero(~away), {}, []
        moved = np.isin(ids[here], ids[away])  # two strays meet where the larger id is at home

        def root(c: int) -> int:
            while joined.get(c, c) != c:
                c = joined[c]
            return c

        for k in np.flatnonzero(away):
            fits = 100 * np.minimum(size[here], size[k]) >= threshold * np.maximum(size[here], size[k])
            other = here[fits & (comp[here] != comp[k]) & ((ids[here] > ids[k]) | ~moved)]
            other = other[_survive(sig[other], np.broadcast_to(sig[k], (len(other), sig.shape[1])), steps)]
            if band and len(other):
                other = other[~(bands[other, :band] == bands[k, :band]).any(1)]
            for j in other.tolist():
                x, y = root(comp[k]), root(comp[j])
                if x != y:
                    mine, theirs = of(k), of(j)
                    common = len(mine & theirs)
                    if common and 100 * common >= threshold * (len(mine) + len(theirs) - common):
                        out.append((int(min(ids[k], ids[j])), int(max(ids[k], ids[j]))))
                        joined[max(x, y)] = min(x, y)
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return home.select(*columns).unionByName(away.select(*columns)).groupBy("band", "bucket", "block").applyInArrow(compare, "a long, b long")


def best_pairs(members: DataFrame, banding: Banding, number: int, block: int = 256) -> DataFrame:
    """For each component in a block of a bucket, but the largest, its pair ``(a, b)`` that agrees best with another component."""
    least = banding.steps()[-1][1]
    blocks = members.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(number)), F.ceil(F.col("size") / block)))

    def name(group: pa.Table) -> pa.Table:
        ids, comp = group.column("doc_id").to_numpy(), group.column("component").to_numpy()
        kinds, of, n = np.unique(comp, return_inverse=True, return_counts=True)
        out = []
        if len(kinds) > 1:
            sig = np.frombuffer(b"".join(group.column("signature").to_pylist()), "<u2").reshape(len(ids), -1)
            best: dict[int, tuple[int, int, int]] = {}
            size, threshold = group.column("n_shingles").to_numpy(), banding.threshold
            for k in np.flatnonzero(of != n.argmax()):
                fits = 100 * np.minimum(size, size[k]) >= threshold * np.maximum(size, size[k])
                agree = np.where(fits & (of != of[k]), (sig == sig[k]).sum(1), -1)
                j = int(agree.argmax())
                if agree[j] >= least and agree[j] > best.get(of[k], (0, 0, 0))[0]:
                    best[of[k]] = (int(agree[j]), int(min(ids[k], ids[j])), int(max(ids[k], ids[j])))
            out = sorted({p[1:] for p in best.values()})
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return blocks.select("band", "bucket", "block", "doc_id", "component", "n_shingles", "signature").groupBy("band", "bucket", "block").applyInArrow(name, "a long, b long").distinct()


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members with their ``component`` and their hub's."""
    at = members.join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    hubs = labels.select(F.col("id").alias("hub"), F.col("component").alias("__hub"))
    return written(spread_join(written(at, "members"), hubs, ["hub"]).withColumn("hub", F.coalesce("__hub", "hub")).drop("__hub"), "labelled")


def _mixed(at: DataFrame) -> DataFrame:
    """Labelled members of the buckets that hold more than the hub's component."""
    mixed = written(at.where("component <> hub").select("band", "bucket").distinct(), "mixed")  # else a join with it takes all strays
    return spread_join(at, mixed, ["band", "bucket"], "left_semi")


def _shared_ids(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of ids that stand for several texts."""
    rows = signed.where(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "set_key")
    shared = rows.groupBy("doc_id").agg(F.min("set_key").alias("x"), F.max("set_key").alias("y")).where("x <> y").select("doc_id")
    shared = written(shared, "shared")  # most often empty
    reps = rows.join(shared, "doc_id").join(classes, "set_key").select("doc_id", "rep").distinct()
    first = reps.groupBy("doc_id").agg(F.min("rep").alias("a"))
    return reps.join(first, "doc_id").where("rep <> a").select("a", F.col("rep").alias("b"))


def near_duplicates(docs: DataFrame, *, width: int = 5, threshold: int = 80, miss: float = 1e-6, rounds: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``."""
    banding = Banding(threshold, miss=miss)
    signed = written(signatures(docs, width, banding, id_column, text_column), "signatures")
    classes = signed.where(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull()).groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    classes = written(classes, "classes")
    reps = written(signed.join(classes.select("set_key", F.col("rep").alias("doc_id")), ["set_key", "doc_id"], "left_semi").dropDuplicates(["set_key", "doc_id"]), "classes")
    banded = reps.select("doc_id", F.posexplode("bands").alias("band", "bucket"))
    buckets = written(banded.groupBy("band", "bucket").agg(F.count("*").alias("size"), F.min("doc_id").alias("hub")).where("size > 1"), "buckets")
    # of buckets that more than one class shares; most rows are in none, so a plain join, whose skewed partitions Spark splits, drops them at once
    members = written(banded.join(buckets, ["band", "bucket"]), "members")
    named = members.select("doc_id").distinct()
    few = written(reps.select("doc_id", "n_shingles", "bands", "signature").join(named, "doc_id", "left_semi"), "candidates")
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    texts = written(texts.join(named, "doc_id", "left_semi"), "texts")
    pairs = members.where("doc_id <> hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct()
    links = written(confirm(written(prune(pairs, few, banding), "pairs"), texts, width, threshold), "links")
    links = links.unionByName(_shared_ids(signed, classes.drop("n")))
    labels = components(links)
    for number in range(rounds):  # each looks at a quarter of the bands, and labels only those
        at = _labelled(members.where(F.col("band") % 4 == number % 4), labels)
        # comparisons that are left, at most; where they are few against the members there is nothing to save
        left = at.where("component <> hub").agg(F.sum("size").alias("n")).first()["n"] or 0
        if left <= 20 * at.count():
            break
        named = written(best_pairs(_mixed(at).join(few, "doc_id"), banding, number), "named")
        found = written(confirm(named, texts, width, threshold), "links")
        if found.isEmpty():
            break
        links = links.unionByName(found)
        labels = components(links)
    rest = written(_mixed(_labelled(members, labels)), "rest")  # rest_links reads it twice
    rest = rest.join(few, "doc_id").join(texts, "doc_id")
    more = written(rest_links(rest, banding, width), "links")
    labels = components(links.unionByName(more))
    named = classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component"))
    out = spread_join(signed.select("doc_id", "n_shingles", "set_key"), named, ["set_key"], counts=classes)
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))
