"""A hidden Markov language model over words, trained by Baum-Welch.

Every text is its words and one end. The states emit *symbols*: the end, a
bounded number of the most frequent training words, and classes of all other
words (by their last bytes). A word of a class then has its smoothed share of
the class, so that the probabilities of all known words and of one unknown word
sum to 1 in each state.

Texts are cut into words once, by Arrow. A slice of documents becomes one packed row: its
vocabulary and the documents as numbers in it. Counts come from one shuffle of
the slices' vocabularies by word, which also returns each word's count to the
slices that hold it, so no vocabulary of the whole corpus is ever broadcast or
collected. What the driver holds is bounded: the frequent words, the classes
and the parameters.

Baum-Welch runs over all training documents, whose symbols are written once for
all rounds. Its expected counts are added up
within a task, then across partitions by a shuffle with as many rows as symbols
and states. For training only, a text counts as consecutive sequences of at
most ``longest`` tokens, of which the later ones start from the states' overall
shares. Scores use whole texts, by the scaled forward recursion.

Null texts hold only the end. Repeated rows are scored (and learnt) as often as
they occur. Extra columns are ignored. With no training text every token is
unknown and the model knows only the end and unknown words.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column_of, give_back, id_crc, most_frequent, ragged, runs, written

PACKED = "chunk long, vocab binary, doc_ids array<long>, held array<boolean>, lengths array<long>, tokens binary"
END = 0  # the end's symbol; frequent words and then classes follow


def _press(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(data)


def _open(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def _press_numbers(numbers: np.ndarray) -> bytes:
    """Numbers below 2 ** 32 by planes of equal bytes, so that those of high bytes compress away."""
    return _press(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _open_numbers(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_open(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def cut_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts one after another, A-Z lower-cased, and how many each text has."""
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    parts = lists.flatten()  # with empty ones where a text is empty or has blanks at its ends
    word = np.asarray(pc.binary_length(parts)) > 0
    before = np.concatenate([[0], np.cumsum(word)])
    return parts.filter(pa.array(word)), np.diff(before[np.concatenate([[0], np.cumsum(pc.list_value_length(lists))])])


def pack_texts(docs: DataFrame, held: str, *, chunk_chars: int = 16_000_000, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Documents as numbers in the vocabulary of their chunk; one row per chunk."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        ids, flags, lengths, found, held_chars = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            coded = pa.concat_arrays(found).dictionary_encode()
            flat = coded.indices.to_numpy()
            # the commonest words get the smallest numbers, so that high bytes compress away
            order = np.argsort(-np.bincount(flat, minlength=len(coded.dictionary)), kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order))
            words = pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), coded.dictionary.take(pa.array(order)))
            vocab = pc.binary_join(words, "\n")[0].as_buffer().to_pybytes()
            (chunk,) = struct.unpack("<q", os.urandom(8))
            row = [chunk, _press(vocab), ids[:], flags[:], lengths[:], _press_numbers(rank[flat])]
            types = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=[f.split()[0] for f in PACKED.split(", ")])

        for batch in batches:
            all_ids, all_held, texts = column_of(batch, "doc_id").to_pylist(), column_of(batch, "held").to_pylist(), column_of(batch, "text")
            for first, end in runs(texts):
                some = texts.slice(first, end - first)
                words, n = cut_words(some)
                found.append(words)
                lengths += n.tolist()
                ids += all_ids[first:end]
                flags += all_held[first:end]
                held_chars += pc.sum(pc.utf8_length(some)).as_py() or 0
                if held_chars >= chunk_chars:
                    yield flush()
                    ids, flags, lengths, found, held_chars = [], [], [], [], 0
                    give_back()
        if ids:
            yield flush()
        found.clear()
        give_back()

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(held).alias("held"), F.col(text_column).alias("text")).mapInArrow(pack, PACKED)


@dataclass
class Chunk:
    words: list[bytes]
    doc_ids: np.ndarray
    held: np.ndarray
    lengths: np.ndarray
    tokens: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Chunk:
        vocab = _open(row["vocab"])
        return cls(vocab.split(b"\n") if vocab else [], np.array(row["doc_ids"], object), np.array(row["held"], bool), np.array(row["lengths"], np.int64), _open_numbers(row["tokens"]))


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield Chunk.of(batch.slice(k, 1).to_pylist()[0])


@dataclass
class Symbols:
    """Numbers of the frequent words, and of the classes that all other words fall into."""

    frequent: dict[bytes, int]
    classes: int

    @property
    def total(self) -> int:
        return 1 + len(self.frequent) + self.classes

    def of(self, words: list[bytes]) -> np.ndarray:
        first, get, crc, n = 1 + len(self.frequent), self.frequent.get, zlib.crc32, self.classes
        return np.fromiter((get(w) or first + crc(w[-3:]) % n for w in words), np.int64, len(words))


@dataclass
class Hmm:
    start: np.ndarray  # of the first token, by state
    share: np.ndarray  # of later training sequences
    move: np.ndarray
    emit: np.ndarray  # symbols x states

    @classmethod
    def begin(cls, shares: np.ndarray, states: int, seed: int) -> Hmm:
        """States that differ by a random factor in every symbol, and rather stay than move."""
        rng = np.random.default_rng(seed)
        emit = shares[:, None] * rng.gamma(2.0, 0.5, (len(shares), states))
        move = np.full((states, states), 0.3 / states) + 0.7 * np.eye(states)
        return cls(np.full(states, 1 / states), np.full(states, 1 / states), move, emit / emit.sum(0))


def _time_major(tokens: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of sequences in order of falling length: all first ones, all second ones ..., and how many at each step."""
    order = np.argsort(-lengths, kind="stable")
    at, n = first[order], lengths[order]
    steps = int(n[0])
    active = np.searchsorted(-n, -np.arange(steps), side="left")  # sequences longer than t
    t = np.repeat(np.arange(steps), active)
    k = np.arange(len(t)) - np.repeat(np.cumsum(active) - active, active)
    return tokens[at[k] + t], active, order


def expected(model: Hmm, tokens: np.ndarray, first: np.ndarray, lengths: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, float]:
    """Baum-Welch counts of some sequences: rows for each symbol, each state moved from, starts and later starts."""
    flat, active, order = _time_major(tokens, first, lengths)
    states, symbols = len(model.start), len(model.emit)
    # one row a state, so that every operation runs along the sequences
    move, back = np.ascontiguousarray(model.move.T), np.ascontiguousarray(model.move)
    seen = np.take(np.ascontiguousarray(model.emit.T), flat, axis=1)
    at = np.concatenate([[0], np.cumsum(active)]).tolist()
    steps = active.tolist()
    alpha, scale = np.empty_like(seen), np.empty(len(flat))
    for t, n in enumerate(steps):
        here = slice(at[t], at[t + 1])
        a, c = alpha[:, here], scale[here]
        if t:
            np.matmul(move, alpha[:, at[t - 1] : at[t - 1] + n], out=a)
        else:
            a[:] = np.where(begins[order], model.start[:, None], model.share[:, None])
        a *= seen[:, here]
        a.sum(0, out=c)
        a /= c
    seen /= scale
    beta = np.ones((states, steps[0]))  # of the step at hand; a sequence that ends there still has its ones
    moves = np.zeros((states, states))
    for t in range(len(steps) - 1, -1, -1):
        n, here = steps[t], slice(at[t], at[t + 1])
        alpha[:, here] *= beta[:, :n]  # now the states' probabilities: the scales make them sum to 1
        if t:
            ahead = seen[:, here]
            ahead *= beta[:, :n]
            moves += alpha[:, at[t - 1] : at[t - 1] + n] @ ahead.T
            np.matmul(back, ahead, out=beta[:, :n])
    out = np.zeros((symbols + states + 2, states))
    for s in range(states):
        out[:symbols, s] = np.bincount(flat, alpha[s], symbols)
    out[symbols:-2] = moves * model.move
    g, b = alpha[:, : steps[0]], begins[order]
    out[-2], out[-1] = g[:, b].sum(1), g[:, ~b].sum(1)
    return out, float(np.log10(scale).sum())


def log_likelihood(model: Hmm, tokens: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """log10 of each whole sequence's probability, by the scaled forward recursion."""
    flat, active, order = _time_major(tokens, first, lengths)
    move, emit = np.ascontiguousarray(model.move.T), np.ascontiguousarray(model.emit.T)
    scale, a, at = np.empty(len(flat)), None, 0
    out = np.zeros(len(lengths))
    for n in active.tolist():
        c = scale[at : at + n]
        a = np.repeat(model.start[:, None], n, 1) if a is None else move @ a[:, :n]
        a *= np.take(emit, flat[at : at + n], axis=1)
        a.sum(0, out=c)
        a /= c
        at += n
    np.log10(scale, out=scale)
    at = 0
    for n in active.tolist():
        out[:n] += scale[at : at + n]
        at += n
    result = np.empty_like(out)
    result[order] = out
    return result


def _with_ends(chunk: Chunk, symbols: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of the documents ``which`` with an end after each, where each starts, and its length."""
    first = np.cumsum(chunk.lengths) - chunk.lengths
    n = chunk.lengths[which]
    out = np.full(int(n.sum()) + len(n), END)
    to = np.cumsum(n + 1) - (n + 1)
    out[ragged(to, n)] = symbols[chunk.tokens[ragged(first[which], n)]]
    return out, to, n + 1


def _groups(lengths: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Indices in order of length, in groups of about ``most`` tokens."""
    order = np.argsort(lengths, kind="stable")
    part = np.cumsum(lengths[order]) // most
    yield from np.split(order, np.flatnonzero(np.diff(part)) + 1) if len(order) else ()


@dataclass
class LanguageModel:
    symbols: Symbols
    hmm: Hmm
    class_tokens: np.ndarray  # training tokens and distinct words of each class
    class_words: np.ndarray
    tokens: int
    distinct: int
    ends: int


def word_table(packed: DataFrame) -> DataFrame:
    """``chunk, position, c, word``: each chunk's words with their training counts; ``word`` only in one row a word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                chunk = Chunk.of(row)
                train = np.repeat(~chunk.held, chunk.lengths)
                n = np.bincount(chunk.tokens[train], minlength=len(chunk.words))
                for a in range(0, len(n), 50_000):
                    some = slice(a, a + 50_000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(chunk.words[some], pa.binary()), pa.array([row["chunk"]] * len(n[some]), pa.int64()), pa.array(np.arange(len(n), dtype=np.int32)[some]), pa.array(n[some].astype(np.int64))],
                        names=["word", "chunk", "position", "n"],
                    )
                row = chunk = train = n = None
        give_back()

    rows = packed.select(*packed.columns).mapInArrow(count, "word binary, chunk long, position int, n long")
    of_word = Window.partitionBy("word").orderBy("chunk")  # one order for both, so that rows are sorted once
    first, all_rows = F.row_number().over(of_word) == 1, of_word.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.select("chunk", "position", F.sum("n").over(all_rows).alias("c"), F.when(first, F.col("word")).alias("word"))


def training_symbols(packed: DataFrame, symbols: Symbols) -> DataFrame:
    """``symbols, lengths``: one row per chunk with the symbols of its training documents, ends included."""
    sent = packed.sparkSession.sparkContext.broadcast(symbols)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            flat, _, n = _with_ends(chunk, sent.value.of(chunk.words), np.flatnonzero(~chunk.held))
            yield pa.RecordBatch.from_arrays([pa.array([_press_numbers(flat)], pa.binary()), pa.array([n.tolist()], pa.list_(pa.int64()))], names=["symbols", "lengths"])
            chunk = flat = None
        give_back()

    return packed.mapInArrow(number, "symbols binary, lengths array<long>")


def train(packed: DataFrame, words: DataFrame, *, frequent: int = 3000, classes: int = 512, states: int = 8, rounds: int = 5, longest: int = 1024, seed: int = 7) -> LanguageModel:
    """Fit the model to the documents of ``packed`` that aren't held out."""
    spark = packed.sparkSession
    known = words.where("word is not null and c > 0")
    ends = packed.select(F.sum(F.size(F.filter("held", lambda h: ~h)))).first()[0] or 0
    top = most_frequent(known.select("word", "c"), frequent, "word", "c").collect()
    symbols = Symbols({bytes(r["word"]): i for i, r in enumerate(top, 1)}, classes)

    def by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, symbols.total), np.int64)
        for batch in batches:
            s = symbols.of(column_of(batch, "word").to_pylist())
            sums[0] += np.bincount(s, column_of(batch, "c").to_numpy(), symbols.total).astype(np.int64)
            sums[1] += np.bincount(s, minlength=symbols.total)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(symbols.total)), pa.array(sums[0]), pa.array(sums[1])], names=["symbol", "tokens", "words"])

    sums = known.select("word", "c").mapInArrow(by_class, "symbol long, tokens long, words long").groupBy("symbol").agg(F.sum("tokens").alias("t"), F.sum("words").alias("w")).collect()
    tokens, distinct = np.zeros(symbols.total, np.int64), np.zeros(symbols.total, np.int64)
    for r in sums:
        tokens[r["symbol"]], distinct[r["symbol"]] = r["t"], r["w"]
    total, kinds = int(tokens.sum()) + ends, int(distinct.sum()) + (ends > 0)
    counts = tokens.astype(float)
    counts[END] = ends
    shares = (counts + 0.1) / (counts + 0.1).sum()
    hmm = Hmm.begin(shares, states, seed)
    rounds = rounds if ends else 0
    sequences = written(training_symbols(packed, symbols), "sequences") if rounds else None
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(hmm)

        def count(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((len(shares) + states + 2, states))
            for batch in batches:
                for j in range(batch.num_rows):
                    row = batch.slice(j, 1).to_pylist()[0]
                    flat, n = _open_numbers(row["symbols"]), np.array(row["lengths"], np.int64)
                    first, pieces = np.cumsum(n) - n, -(-n // longest)
                    k = ragged(np.zeros(len(n), np.int64), pieces)
                    at, size = np.repeat(first, pieces) + k * longest, np.minimum(np.repeat(n, pieces) - k * longest, longest)
                    for some in _groups(size, 400_000):
                        sums += expected(sent.value, flat, at[some], size[some], k[some] == 0)[0]
                    row = flat = None
            give_back()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), *(pa.array(c) for c in sums.T)], names=["row", *(f"s{i}" for i in range(states))])

        schema = "row long, " + ", ".join(f"s{i} double" for i in range(states))
        found = sequences.mapInArrow(count, schema).groupBy("row").agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(states))).collect()
        sums = np.zeros((symbols.total + states + 2, states))
        for r in found:
            sums[r["row"]] = r[1:]
        emit = sums[: symbols.total] + shares[:, None]  # a token's worth of the overall shares for each state
        move, start, share = sums[symbols.total : -2] + 0.1, sums[-2] + 0.1, sums[: symbols.total].sum(0) + 0.1
        hmm = Hmm(start / start.sum(), share / share.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
        sent.unpersist()
    return LanguageModel(symbols, hmm, tokens, distinct, total, kinds, int(ends))


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(packed: DataFrame, words: DataFrame, model: LanguageModel) -> DataFrame:
    """Score every document's whole text; each chunk meets the counts of its own words only."""
    sent = packed.sparkSession.sparkContext.broadcast(model)

    def judge(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        give_back()  # what the chunk before took
        m, parts = sent.value, []
        c_all = None
        for chunk in chunks(left.to_batches()):
            c_all = np.zeros(len(chunk.words), np.int64)
            c_all[right.column("position").to_numpy()] = right.column("c").to_numpy()
            symbols = m.symbols.of(chunk.words)
            first_class = 1 + len(m.symbols.frequent)
            inside = np.where(symbols < first_class, 0.0, np.log10((c_all + 0.1) / (m.class_tokens[symbols] + 0.1 * (m.class_words[symbols] + 1))))
            norm = m.tokens + 0.1 * (m.distinct + 1)
            base = np.log10((c_all + 0.1) / norm)
            doc = np.repeat(np.arange(len(chunk.lengths)), chunk.lengths)
            sums = lambda v: np.bincount(doc, v[chunk.tokens], len(chunk.lengths))  # noqa: B023, E731
            n_known = sums((c_all > 0).astype(float)) + (m.ends > 0)
            total = sums(inside)
            flat, first, n = _with_ends(chunk, symbols, np.arange(len(chunk.lengths)))
            for some in _groups(n, 1_000_000):
                total[some] += log_likelihood(m.hmm, flat, first[some], n[some])
            parts.append(
                pa.table(
                    {
                        "doc_id": pa.array(chunk.doc_ids.tolist(), pa.int64()), "held_out": pa.array(chunk.held), "n_tokens": pa.array(chunk.lengths + 1), "n_known": pa.array(n_known.astype(np.int64)),
                        "train_tokens": pa.array(np.full(len(n), m.tokens, np.int64)), "base_score": pa.array(sums(base) + np.log10((m.ends + 0.1) / norm)), "score": pa.array(total),
                    }
                )
            )
        return pa.concat_tables(parts) if parts else pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]).empty_table()

    return packed.groupBy("chunk").cogroup(words.select("chunk", "position", "c").groupBy("chunk")).applyInArrow(judge, SCORES)


def score_documents(docs: DataFrame, *, hold_out: int = 10, id_column: str = "doc_id", text_column: str = "text", **training) -> DataFrame:
    """Train on documents whose crc32(id) mod ``hold_out`` isn't 0, and score all."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    packed = written(pack_texts(rows.withColumn("held", id_crc() % hold_out == 0), "held"), "packed")
    words = written(word_table(packed), "words")
    return score(packed, words, train(packed, words, **training))
