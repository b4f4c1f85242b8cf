"""Byte-level BPE over a lexicon compiled into a minimal acyclic transducer.

The most frequent words of the corpus (a bounded number) are compiled, in
sorted order, into a minimal acyclic automaton: equal suffixes share states.
Every transition carries the number of words that sort before it, so the sum
along a path is the word's rank, and the rank addresses the word's token ids.
The arrays are one file that Spark hands to every executor; Python workers
memory-map it, so that they share its pages.

A worker walks all distinct words of a slice through the automaton at once,
byte by byte. Words outside the lexicon are merged exactly, by rank, with a
heap if they are long (``n log n`` also for words of megabytes). The lexicon therefore only
decides the speed, never the ids.

A null text has no ids and decodes to the empty text; equal rows give equal
results, once each. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import tempfile
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_of, joined, most_frequent, ragged, shared_path, slices, written

#: Letters, digits and blanks on which ``re`` and the tokenizer's pattern agree; other texts take the tokenizer's own splitter.
SAFE = re.compile("[\x00-\x1b\x20-\x7e\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-˿Ѐ-ԯ‐-‧‰-⁞€ぁ-ゖァ-ヺ一-龥가-힣]*")
_WORDS = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Merger:
    """The exact encoder: vocabulary, merge ranks and word splitting of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or before["type"] != "ByteLevel" or before["add_prefix_space"] or spec["normalizer"]:
            raise ValueError(f"{path} isn't a plain byte-level BPE")
        byte = {c: b for b, c in enumerate(byte_letters())}
        text = {i: bytes(byte[c] for c in t) for t, i in model["vocab"].items() if all(c in byte for c in t)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        text |= {i: t.encode() for t, i in self.special.items()}
        self.bytes_of = [text.get(i, b"") for i in range(max(text) + 1)]
        vocab = model["vocab"]
        self.single = [vocab[c] for c in byte_letters()]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self._size = max(vocab.values()) + 1
        self._none = len(self.merges) * self._size
        # the same as one number each way, rank before id, for words that a scan merges faster than a heap
        self._quick = {a * self._size + b: rank * self._size + made for (a, b), (rank, made) in self.merges.items()}
        self._mark = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._known: dict[bytes, tuple[int, ...]] = {}

    def words(self, text: str) -> list[str]:
        """Pre-tokens in order; a special token's string is an element by itself."""
        if self._mark and any(s in text for s in self.special):
            return [w for part in self._mark.split(text) if part for w in ([part] if part in self.special else self._plain(part))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if SAFE.fullmatch(text):
            return _WORDS.findall(text)
        from tokenizers.pre_tokenizers import ByteLevel

        return [text[a:b] for _, (a, b) in ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str(text)]

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Ids of one word: adjacent pairs merge in the order of their ranks, leftmost first."""
        ids = [self.single[b] for b in word]
        return self._merge_scan(ids) if len(ids) <= 48 else self._merge_heap(ids)

    def _merge_scan(self, ids: list[int]) -> tuple[int, ...]:
        size, none, find = self._size, self._none, self._quick.get
        found = [find(a * size + b, none) for a, b in zip(ids, ids[1:])]
        while found and (low := min(found)) < none:
            i = found.index(low)
            ids[i : i + 2] = (made := low % size,)
            del found[i]
            if i:
                found[i - 1] = find(ids[i - 1] * size + made, none)
            if i < len(found):
                found[i] = find(made * size + ids[i + 1], none)
        return tuple(ids)

    def _merge_heap(self, ids: list[int]) -> tuple[int, ...]:
        n, find = len(ids), self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := find((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, left, right, made = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # one of them has been merged meanwhile
            ids[i], ids[j] = made, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := find((made, ids[k])):
                    heapq.heappush(heap, (m[0], i, made, ids[k], m[1]))
            if (h := before[i]) >= 0 and (m := find((ids[h], made))):
                heapq.heappush(heap, (m[0], h, ids[h], made, m[1]))
        return tuple(x for x in ids if x >= 0)

    def ids(self, word: bytes) -> tuple[int, ...]:
        """:meth:`merge`, remembering a bounded number of short words."""
        if (found := self._known.get(word)) is None:
            found = self.merge(word)
            if len(word) <= 64:
                if len(self._known) >= 200_000:
                    self._known.clear()
                self._known[word] = found
        return found


def compile_lexicon(words: list[bytes], ids: list[tuple[int, ...]]) -> dict[str, np.ndarray]:
    """The minimal acyclic transducer of distinct ``words``, with ``ids[i]`` for ``words[i]``.

    Words are added in sorted order; when a word leaves the path of the one
    before, the states that can't change any more are looked up among the
    finished ones (Daciuk and others, 2000).
    """
    order = sorted(range(len(words)), key=words.__getitem__)
    register: dict[tuple, int] = {}
    reach: list[int] = []  # words accepted from each finished state
    edges: list[tuple] = []

    def finish(node: list) -> int:
        final, arcs = node
        key = (final, tuple(arcs))
        state = register.get(key)
        if state is None:
            state = register[key] = len(reach)
            reach.append(final + sum(reach[t] for _, t in arcs))
            edges.append(key)
        return state

    path: list[list] = [[0, []]]
    last = b""
    for i in order:
        word = words[i]
        same = len(os.path.commonprefix((word, last)))
        while len(path) > same + 1:
            done = finish(path.pop())
            path[-1][1].append((last[len(path) - 1], done))
        path.extend([0, []] for _ in word[same:])
        path[-1][0] = 1
        last = word
    while len(path) > 1:
        done = finish(path.pop())
        path[-1][1].append((last[len(path) - 1], done))
    root = finish(path[0])
    keys, targets, outputs = [], [], []
    for state, (final, arcs) in enumerate(edges):
        rank = final
        for byte, target in arcs:
            keys.append(state * 256 + byte)
            targets.append(target)
            outputs.append(rank)
            rank += reach[target]
    at = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(ids[i]) for i in order], out=at[1:])
    return {
        "keys": np.array(keys, np.int64), "targets": np.array(targets, np.int64), "outputs": np.array(outputs, np.int64),
        "final": np.array([k[0] for k in edges], np.int64), "root": np.array([root], np.int64),
        "at": at, "ids": np.array([x for i in order for x in ids[i]], np.int64),
    }


class Lexicon:
    """A compiled transducer whose arrays are views of one memory-mapped file."""

    NAMES = ("keys", "targets", "outputs", "final", "root", "at", "ids")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)

    @classmethod
    def write(cls, arrays: dict[str, np.ndarray], path: str) -> None:
        head = np.array([len(arrays[n]) for n in cls.NAMES], np.int64)
        with open(path, "wb") as f:
            f.write(head.tobytes())
            for n in cls.NAMES:
                f.write(arrays[n].astype("<i8").tobytes())

    @classmethod
    def map(cls, path: str) -> Lexicon:
        whole = np.memmap(path, "<i8", "r")
        cut = np.cumsum(whole[: len(cls.NAMES)])
        body = whole[len(cls.NAMES) :]
        return cls({n: body[b - whole[k] : b] for k, (n, b) in enumerate(zip(cls.NAMES, cut))})

    def ranks(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The rank of each word ``data[offsets[i]:offsets[i + 1]]``, or -1: all walk in step."""
        n = len(offsets) - 1
        out = np.full(n, -1, np.int64)
        if not n or not len(self.at) > 1:
            return out
        sizes = np.diff(offsets)
        alive = np.arange(n)
        state, rank = np.full(n, self.root[0], np.int64), np.zeros(n, np.int64)
        step = 0
        while len(alive):
            ends = sizes[alive] == step
            if ends.any():
                done = ends & (self.final[state] == 1)
                out[alive[done]] = rank[done]
                alive, state, rank = alive[~ends], state[~ends], rank[~ends]
            if not len(alive) or not len(self.keys):
                break
            key = state * 256 + data[offsets[alive] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            alive, at = alive[hit], at[hit]
            state, rank = self.targets[at], rank[hit] + self.outputs[at]
            step += 1
        return out


_MERGERS: dict[str, Merger] = {}
_LEXICONS: dict[str, Lexicon] = {}


def merger(path: str) -> Merger:
    if path not in _MERGERS:
        _MERGERS[path] = Merger(path)
    return _MERGERS[path]


def lexicon(name: str) -> Lexicon:
    if name not in _LEXICONS:
        _LEXICONS.clear()
        _LEXICONS[name] = Lexicon.map(SparkFiles.get(name))
    return _LEXICONS[name]


def word_counts(docs: DataFrame, tokenizer_path: str, text_column: str = "text") -> DataFrame:
    """``(word binary, n)`` over all pre-tokens of all texts, combined in each slice before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = merger(tokenizer_path).words
        for batch in batches:
            for _, texts in slices(column_of(batch, "text")):
                seen: Counter[str] = Counter()
                for text in texts:
                    seen.update(split(text))
                yield pa.RecordBatch.from_arrays([pa.array([w.encode() for w in seen], pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    return docs.select(F.col(text_column).alias("text")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, tokenizer_path: str, *, size: int = 262_144, longest: int = 64, text_column: str = "text") -> str:
    """Compile the ``size`` most frequent words of ``docs``; returns the file's name for :func:`lexicon`.

    ``size`` words of at most ``longest`` bytes bound what the driver holds.
    """
    spark, exact = docs.sparkSession, merger(tokenizer_path)
    counts = written(word_counts(docs, tokenizer_path, text_column).where((F.length("word") <= longest) & (F.col("n") > 1)), "words")
    top = most_frequent(counts, size, "word")
    words = [w for r in top.collect() if (w := bytes(r["word"])).decode() not in exact.special]
    with tempfile.TemporaryDirectory() as folder:  # the driver's own; Spark's file server copies it
        name = os.path.basename(shared_path(spark, "lexicon"))
        Lexicon.write(compile_lexicon(words, [exact.merge(w) for w in words]), f"{folder}/{name}")
        _publish(spark, f"{folder}/{name}")
    return name


def _publish(spark, path: str) -> None:
    """Put the file into the shared folder and let Spark hand it to every executor."""
    target = f"{shared_path(spark, 'files')}/{os.path.basename(path)}"
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(target)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).copyFromLocalFile(jvm.org.apache.hadoop.fs.Path("file://" + os.path.abspath(path)), there)
    spark.sparkContext.addFile(target)


class Codec:
    """Encodes and decodes slices of texts with a lexicon and an exact merger."""

    def __init__(self, exact: Merger, words: Lexicon):
        self.exact, self.words = exact, words
        self.pieces = pa.array(exact.bytes_of, pa.binary())

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text's ids start (one more than texts)."""
        split = self.exact.words
        parts = [split(t) for t in texts]
        flat = [w for p in parts for w in p]
        number: dict[str, int] = defaultdict()
        number.default_factory = number.__len__  # a new word gets the next number
        codes = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
        special = self.exact.special
        raw = [w.encode() for w in number]
        rank = self.words.ranks(*joined(raw))
        for w in special:
            if w in number:
                rank[number[w]] = -1
        unseen = np.flatnonzero(rank < 0)
        keys = list(number) if len(unseen) and any(w in number for w in special) else None
        own = [(special[keys[i]],) if keys and keys[i] in special else self.exact.ids(raw[i]) for i in unseen]
        sizes, starts = np.empty(len(raw), np.int64), np.empty(len(raw), np.int64)
        hit = rank >= 0
        starts[hit] = self.words.at[rank[hit]]
        sizes[hit] = self.words.at[rank[hit] + 1] - starts[hit]
        extra = np.fromiter(map(len, own), np.int64, len(own))
        sizes[unseen], starts[unseen] = extra, np.cumsum(extra) - extra
        merged = np.fromiter((x for o in own for x in o), np.int64, int(extra.sum()))
        index, mapped = ragged(starts[codes], sizes[codes]), np.repeat(hit[codes], sizes[codes])
        ids = np.empty(len(index), np.int64)
        ids[mapped], ids[~mapped] = self.words.ids[index[mapped]], merged[index[~mapped]]
        ends = np.concatenate([[0], np.cumsum(sizes[codes])])
        words_at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        return ids, ends[words_at]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; byte sequences that aren't UTF-8 become replacement characters."""
        taken = self.pieces.take(pa.array(ids))  # its values lie one after another
        end = int(np.frombuffer(taken.buffers()[1], np.int32, len(ids) + 1)[-1]) if len(ids) else 0
        return taken.buffers()[2][:end].to_pybytes().decode("utf-8", "replace") if end else ""


CODED = "doc_id long, token_ids array<int>, decoded string"


def encode_decode(docs: DataFrame, tokenizer_path: str, *, lexicon_size: int = 262_144, id_column: str = "doc_id", text_column: str = "text", then: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, schema: str = CODED) -> DataFrame:
    """Per document its ids (``token_ids``) and the text decoded from them (``decoded``).

    ``then`` turns each batch of these rows into rows of ``schema`` on the
    worker, for callers that want less than the ids and texts themselves.
    """
    name = build_lexicon(docs, tokenizer_path, size=lexicon_size, text_column=text_column)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(merger(tokenizer_path), lexicon(name))
        for batch in batches:
            doc_ids = column_of(batch, "doc_id")
            for first, texts in slices(column_of(batch, "text"), 2_000_000):
                ids, at = codec.encode(texts)
                decoded = [codec.decode(ids[a:b]) for a, b in zip(at, at[1:])]
                coded = pa.RecordBatch.from_arrays([doc_ids.slice(first, len(texts)), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())), pa.array(decoded, pa.string())], names=["doc_id", "token_ids", "decoded"])
                yield then(coded) if then else coded

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(code, schema)


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digest(coded: pa.RecordBatch) -> pa.RecordBatch:
    """Number of ids and sha256 of ids and decoded text, from a batch of :func:`encode_decode`."""
    lists = column_of(coded, "token_ids")
    values, at = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
    return pa.RecordBatch.from_arrays(
        [
            column_of(coded, "doc_id"),
            pa.array(np.diff(at).astype(np.int64)),
            pa.array([hashlib.sha256(values[a:b].tobytes()).hexdigest() for a, b in zip(at, at[1:])], pa.string()),
            pa.array([hashlib.sha256(t.as_buffer()).hexdigest() for t in column_of(coded, "decoded")], pa.string()),
        ],
        names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    )
