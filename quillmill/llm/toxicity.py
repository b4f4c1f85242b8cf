"""Toxicity scores from gradient-boosted trees over a few dense features.

The features of a text are densities of a word list (learnt from labelled
texts, plus the matches that appear only after undoing obfuscation), closeness
of listed words to the second person, shares of capitals and punctuation, rates
of stretched and letter-swapped words, and counts over the whole text.

Trees are grown on quantile bins with Newton steps for the logistic loss. A
fold of the sample that the trees never see calibrates their margins by
isotonic regression (pool adjacent violators). Both need labels and are fitted
on a bounded sample of rows with their whole texts. Words are counted and
features computed where the texts are; the driver only sees the features of the
sample. Scoring is one pass over all rows without a shuffle.

Null and empty texts have all features 0 and get the score of those. Rows with
a null label take no part; a document labelled both ways counts once with each
label, an id with several texts once with each, equal rows once. Without labels
of both kinds every score is the share of label 1.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import column_of, give_back, slices, written

FEATURES = ("listed", "listed_share", "listed_distinct", "strength", "near_you", "revealed", "capitals", "shouted", "punctuation", "exclaimed", "stretched", "swapped", "log_words")
SECOND_PERSON = frozenset("you your yours yourself yourselves u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti contigo usted ustedes vosotros".split())
_WORD = re.compile(r"[^\s]+")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_UNDO = str.maketrans("013457@$!|+", "oieastasiit")
_INNER = re.compile(r"(?<=\w)[\W_]+(?=\w)")
_RUN = re.compile(r"(\w)\1{2,}")


def plain(word: str) -> str:
    """Lower case without marks at either end."""
    return _EDGE.sub("", word).lower()


def revealed(word: str) -> str:
    """The word without inner marks, digits for letters or stretched letters."""
    bare = word.strip(".,;:!?\"'()[]{}*_-")  # marks that stand for letters stay
    return _RUN.sub(r"\1", _INNER.sub("", bare.translate(_UNDO)).lower())


def features(text: str, listed: dict[str, float]) -> list[float]:
    """One value for each of :data:`FEATURES`, over the whole text."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    counts = Counter(words)
    hits = swaps = hidden = stretched = shouted = 0
    strength, kinds, places = 0.0, set(), set()
    for word, c in counts.items():
        low = plain(word)
        if low in listed:
            hits += c
            strength += c * listed[low]
            kinds.add(low)
            places.add(word)
        elif not word.isalpha() or _RUN.search(word):
            open_word = revealed(word)
            if open_word != low and open_word in listed:
                hidden += c
                strength += c * listed[open_word]
                kinds.add(open_word)
                places.add(word)
            inner = low.translate(_UNDO)
            if inner != low and not low.isdigit():
                swaps += c
            if _RUN.search(low):
                stretched += c
        if len(word) > 2 and word.isupper():
            shouted += c
    near = 0
    if places:
        you = [i for i, w in enumerate(words) if plain(w) in SECOND_PERSON]
        if you:
            for i, w in enumerate(words):
                if w in places:
                    k = bisect_right(you, i)
                    near += any(abs(j - i) <= 4 for j in you[max(0, k - 1) : k + 1])
    chars = len(text)
    upper = sum(map(str.isupper, text)) if not text.islower() else 0
    marks = chars - sum(map(len, re.findall(r"[\w\s]+", text)))
    found = hits + hidden
    return [float(found), found / n, float(len(kinds)), strength / n**0.5, near / n, hidden / n, upper / chars, shouted / n, marks / chars, text.count("!") / n, stretched / n, swaps / n, float(np.log1p(n))]


@dataclass
class Trees:
    """Boosted trees as flat arrays; ``split`` below 0 marks a leaf."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node]
        return out


def grow(x: np.ndarray, y: np.ndarray, *, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, ridge: float = 1.0, least: float = 2.0) -> Trees:
    """Boost complete trees of fixed depth; a node that gains nothing passes all rows to the left."""
    p = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
    base = float(np.log(p / (1 - p)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins)[1:-1], method="lower")) for c in x.T]
    code = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], 1)  # x <= cut k  <=>  code <= k
    n, d = x.shape
    inner, total = 2**depth - 1, 2 ** (depth + 1) - 1
    margin = np.full(n, base)
    out_f, out_t, out_v = [], [], []
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-margin))
        g, h = y - q, q * (1 - q)
        f, t, v = np.zeros(total, np.int64), np.full(total, np.inf), np.zeros(total)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            for j in range(d):
                k = len(cuts[j])
                if not k:
                    continue
                at = (node - first) * (k + 1) + code[:, j]
                gs = np.bincount(at, g, width * (k + 1)).reshape(width, k + 1)
                hs = np.bincount(at, h, width * (k + 1)).reshape(width, k + 1)
                gl, hl = gs.cumsum(1), hs.cumsum(1)
                ga, ha = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
                gain[(hl < least) | (ha - hl < least)] = 0
                gain = gain[:, :-1]
                top = gain.argmax(1)
                value = gain[np.arange(width), top]
                better = value > best
                best[better] = value[better]
                where = first + np.flatnonzero(better)
                f[where], t[where] = j, cuts[j][top[better]]
            node = 2 * node + 1 + (x[np.arange(n), f[node]] > t[node])
        leaf = node - inner
        gs, hs = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        v[inner:] = rate * gs / (hs + ridge)
        margin += v[node]
        out_f.append(f)
        out_t.append(t)
        out_v.append(v)
    return Trees(base, np.array(out_f), np.array(out_t), np.array(out_v), depth)


def _pooled(blocks: list[list[float]]) -> list[list[float]]:
    """Adjacent blocks (mean, weight, first and last score) pooled until their means rise."""
    out: list[list[float]] = []
    for block in blocks:
        out.append(list(block))
        while len(out) > 1 and out[-2][0] >= out[-1][0]:
            m2, w2, _, last = out.pop()
            m1, w1, first, _ = out.pop()
            out.append([(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, first, last])
    return out


def isotonic(scores: np.ndarray, y: np.ndarray, prior: float | None = None, weight: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the nondecreasing least-squares fit (pool adjacent violators), for interpolation.

    With ``prior``, each block counts ``weight`` more observations of that
    value, so that one or two rows can't claim what they don't show, and blocks
    are pooled again.
    """
    order = np.argsort(scores, kind="stable")
    values, index = np.unique(scores[order], return_index=True)
    weights = np.diff([*index, len(scores)]).astype(float)
    means = np.add.reduceat(y[order].astype(float), index) / weights
    blocks = _pooled([[m, w, s, s] for m, w, s in zip(means, weights, values)])
    if prior is not None:
        blocks = _pooled([[(m * w + weight * prior) / (w + weight), w + weight, a, z] for m, w, a, z in blocks])
    xs = [e for b in blocks for e in ([b[2], b[3]] if b[2] < b[3] else [b[2]])]
    ys = [e for b in blocks for e in ([b[0]] * (2 if b[2] < b[3] else 1))]
    return np.array(xs), np.array(ys)


@dataclass
class ToxicityModel:
    listed: dict[str, float]
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray]
    share: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.share)
        margin = self.trees.margin(x)
        fit = np.interp(margin, *self.knots)
        # within a flat stretch of the calibration the margin still ranks; it moves no score by more than a millionth
        return np.clip(fit + 1e-6 * (1 / (1 + np.exp(-margin)) - fit), 0, 1)


def pick_words(counts: list[tuple[str, int, int]], n1: int, n0: int, *, size: int = 400, least: int = 4, ratio: float = 2.5) -> dict[str, float]:
    """Words whose share of the ``n1`` texts with label 1 stands out, with their smoothed log odds, from ``(word, of label 1, of label 0)``."""
    found = {}
    for word, c1, c0 in counts:
        odds = float(np.log((c1 + 0.5) / (max(1, n1) + 1)) - np.log((c0 + 0.5) / (max(1, n0) + 1)))
        if word and c1 >= least and odds >= ratio:
            found[word] = (odds, c1)
    # rank by evidence, not odds alone: rare words have wild odds
    best = sorted(found.items(), key=lambda p: (-p[1][0] * p[1][1], p[0]))[:size]
    return {word: odds for word, (odds, _) in best}


def word_counts(rows: DataFrame) -> DataFrame:
    """``word, c1, c0``: how many texts of either label hold a word, from ``(text, label)``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = column_of(batch, "label").to_pylist()
            for first, texts in slices(column_of(batch, "text")):
                seen = (Counter(), Counter())
                for at, text in enumerate(texts, first):
                    seen[labels[at]].update({plain(w) for w in text.split()})
                words = list({**seen[0], **seen[1]})
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([seen[k][w] for w in words], pa.int64()) for k in (1, 0))], names=["word", "c1", "c0"])
        give_back()

    return rows.select("text", "label").mapInArrow(count, "word string, c1 long, c0 long").groupBy("word").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0"))


def fit_model(x: np.ndarray, y: np.ndarray, fold: np.ndarray, words: dict[str, float]) -> ToxicityModel:
    """Trees from the folds 0 to 2 and their calibration from fold 3."""
    grown, held = fold != 3, fold == 3
    if len({*y[grown]}) < 2:
        return ToxicityModel(words, None, (np.zeros(1), np.zeros(1)), float(y.mean()))
    trees = grow(x[grown], y[grown])
    share = float(y.mean())
    knots = isotonic(trees.margin(x[held]), y[held], share) if len({*y[held]}) == 2 else isotonic(trees.margin(x), y, share)
    return ToxicityModel(words, trees, knots, share)


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, sample: int = 12_000, text_column: str = "text", id_column: str = "doc_id") -> ToxicityModel:
    """Fit on at most ``sample`` different labelled rows, those with the smallest hashes of id and text.

    Every fourth row in that order calibrates; words come from the first two
    of four. ``sample`` bounds the rows whatever their ids and lengths are.
    """
    spark = docs.sparkSession
    known = labels.where(F.col("label").isin(0, 1) & F.col(id_column).isNotNull()).select(F.col(id_column).alias("id"), F.col("label").cast("int").alias("label")).distinct()
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("id"), text.alias("text"), F.xxhash64(F.col(id_column), text).alias("h"))
    usable = written(rows.select("id", "h").distinct().join(known, "id").select("h", "id", "label"), "labelled")
    n = usable.count()
    if n > 2 * sample:  # sort only the part of the hash range that holds the sample
        usable = usable.where(F.col("h") < int(-(2**63) + 1.5 * sample / n * 2**64))
    chosen = usable.orderBy("h", "id", "label").limit(sample).collect()
    if len({r["label"] for r in chosen}) < 2:
        return ToxicityModel({}, None, (np.zeros(1), np.zeros(1)), float(chosen[0]["label"]) if chosen else 0.0)
    few = spark.createDataFrame([(*r, k) for k, r in enumerate(chosen)], StructType([*usable.schema.fields, StructField("place", LongType())]))  # at most ``sample`` rows
    picked = written(rows.join(F.broadcast(few), ["id", "h"]).groupBy("place", "label").agg(F.min("text").alias("text")), "sampled")
    first = picked.where("place % 4 < 2")
    sizes = {r["label"]: r["count"] for r in first.groupBy("label").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    # what can be picked at all; the sums are exact, so the same words come out whatever the partitions were
    odds = F.log((F.col("c1") + 0.5) / (max(1, n1) + 1)) - F.log((F.col("c0") + 0.5) / (max(1, n0) + 1))
    likely = word_counts(first).where((F.col("c1") >= 4) & (odds >= 2.5 - 1e-9) & (F.col("word") != ""))
    words = pick_words([tuple(r) for r in likely.orderBy(F.desc(odds * F.col("c1")), "word").limit(800).collect()], n1, n0)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t, words) for _, texts in slices(column_of(batch, "text")) for t in texts]
            yield pa.RecordBatch.from_arrays([column_of(batch, "place"), column_of(batch, "label"), pa.array(x, pa.list_(pa.float64()))], names=["place", "label", "x"])

    found = sorted(map(tuple, picked.mapInArrow(measure, "place long, label int, x array<double>").collect()))
    place, y, x = (np.array(c, float) for c in zip(*found))
    return fit_model(x, y, place.astype(np.int64) % 4, words)


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, text_column: str = "text", id_column: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """The id, the columns in ``keep`` (but those named like a result) and ``score`` (0 to 1) for every row."""
    kept = [id_column, *(c for c in keep or [] if c not in (id_column, *["score"]))]
    text = text_column if text_column in kept else "__text"
    rows = docs.select(*kept, *([] if text in kept else [F.col(text_column).alias(text)]))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred words and small trees

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            x = [features(t, own.listed) for _, texts in slices(column_of(batch, text)) for t in texts]
            score = own.score(np.array(x).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([*(column_of(batch, c) for c in kept), pa.array(score, pa.float64())], names=[*kept, "score"])
        give_back()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(kept)])
    return rows.mapInArrow(judge, f"{fields}, score double")
