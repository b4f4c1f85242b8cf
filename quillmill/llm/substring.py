"""Removal of word passages that occur earlier in the corpus.

A window is ``size`` consecutive words of a document. Windows whose words also
start at an earlier place (smaller id, or earlier in the same document) are
repeats; every word that a repeat covers is removed.

Windows meet by *super-k-mers*: each window has a minimiser, the smallest hash
among its word triples, and consecutive windows with the same minimiser travel
together as one string of words to the minimiser's bucket. A task packs what a
slice of documents sends to a bucket into one compressed row. In a bucket the
windows are sorted by hash, and neighbours with equal hashes are compared word
by word, so the result is exact.

Skew: windows that repeat within a slice are settled there, and only their
first place travels. Minimisers that are frequent in the whole corpus spread
their windows over all buckets by the window's own hash. They are found by a
sketch: every task counts all its minimisers in two arrays of fixed size, at
cells that two hashes name, and the arrays are added up over all tasks, so a
minimiser that is rare in every slice and common over all is found too. What is
broadcast is a bit for each cell, whatever the size of the corpus. A minimiser
that shares its cells with a frequent one spreads as well, which changes no
result. The number of buckets follows the size of the texts, so a bucket has a
bounded share.

Null texts have no words. Rows that share an id count as one document written
more than once: equal windows at the same place leave each other alone. Rows
without an id stay as they are. Extra columns are kept, but for those named like
a result, which the result replaces.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_of, give_back, mix64, ragged, slices

TRIPLE = 3
#: Packed text that a bucket holds on average, in bytes, and how many times the text the packed windows are.
BUCKET_BYTES = 8_000_000
SPREAD = 3
#: Bytes of texts whose repeats are settled together before any window travels.
SLICE = 4_000_000
#: Cells of each of a sketch's two arrays, and how many of them travel together.
CELLS, TOGETHER = 1 << 20, 2048
_ODD = mix64(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Words up to this many bytes are hashed in step, eight bytes at a time; longer ones one by one.
_STEPWISE = 512
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end in bytes whose last one is blank."""
    edge = np.flatnonzero(np.diff(_BLANK[data].view(np.int8), prepend=np.int8(1)))
    return edge[::2], edge[1::2]


class Words:
    """Words of several texts in one row, as places in a buffer, with exact numbers and window hashes.

    ``data`` holds eight bytes beyond the last word's end. ``counts`` says how
    many words each text has. A word's hash depends on its bytes only. Words of
    up to seven bytes have hashes that none other has. Hashes serve as the words'
    numbers if no two different longer words here share one, which is checked
    on the bytes; else words get numbers by a dictionary.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray, size: int):
        self.size, self.data, self.starts, self.ends = size, data, starts, ends
        self.eight = np.ndarray(max(0, len(data) - 7), "<u8", data, strides=(1,))  # every eight bytes in a row
        self.hash = self._hashes()
        self.ids = self.hash if self._distinct() else self._numbers()
        self.first = np.cumsum(counts) - counts  # of each text
        room = np.maximum(counts - size + 1, 0)
        self.at = ragged(self.first, room)  # where windows start, in this row
        self.text = np.repeat(np.arange(len(counts)), room)

    @classmethod
    def of(cls, texts: list[bytes], size: int) -> Words:
        data = np.frombuffer(b" ".join([*texts, b"       "]), np.uint8)
        starts, ends = word_spans(data)
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        return cls(data, starts, ends, np.diff(np.searchsorted(starts, begins)), size)

    def bytes_of(self, k: int) -> bytes:
        return self.data[self.starts[k] : self.ends[k]].tobytes()

    def _chunk(self, words: np.ndarray, k: int) -> np.ndarray:
        """Bytes ``8 k`` and on of the words, as numbers; what lies beyond a word is 0."""
        return self.eight[self.starts[words] + 8 * k] & _LOW_BYTES[np.minimum(self.ends[words] - self.starts[words] - 8 * k, 8)]

    def _hashes(self) -> np.ndarray:
        import xxhash

        n = self.ends - self.starts
        out = np.zeros(len(n), np.uint64)
        # bytes and length in one number, scrambled by a bijection; no longer word's number starts with 0 to 7
        short = np.flatnonzero(n < 8)
        out[short] = mix64(self._chunk(short, 0) | n[short].astype(np.uint64) << np.uint64(56))
        long = words = np.flatnonzero((n >= 8) & (n <= _STEPWISE))
        out[words], k = n[words].astype(np.uint64) * _ODD[240], 0
        while len(words):
            out[words] = mix64(out[words] + self._chunk(words, k) * _ODD[241])
            k += 1
            words = words[n[words] > 8 * k]
        out[long] = mix64(out[long] | np.uint64(255 << 56))
        for w in np.flatnonzero(n > _STEPWISE).tolist():
            out[w] = mix64(np.array([xxhash.xxh3_64_intdigest(self.bytes_of(w)) | 255 << 56], np.uint64))[0]
        return out

    def _distinct(self) -> bool:
        """Whether equal hashes are equal words, by comparing neighbours in order of hash; short words need no look."""
        order = np.flatnonzero(self.ends - self.starts >= 8)
        order = order[np.argsort(self.hash[order])]
        same = np.flatnonzero(self.hash[order[1:]] == self.hash[order[:-1]])
        left, right = order[same], order[same + 1]
        n = self.ends[left] - self.starts[left]
        if (n != self.ends[right] - self.starts[right]).any():
            return False
        if any(self.bytes_of(a) != self.bytes_of(b) for a, b in zip(left[n > _STEPWISE].tolist(), right[n > _STEPWISE].tolist())):
            return False
        left, right, k = left[n <= _STEPWISE], right[n <= _STEPWISE], 0
        while len(left):
            if (self._chunk(left, k) != self._chunk(right, k)).any():
                return False
            k += 1
            more = self.ends[left] - self.starts[left] > 8 * k
            left, right = left[more], right[more]
        return True

    def _numbers(self) -> np.ndarray:
        number: dict[bytes, int] = {}
        return np.array([number.setdefault(self.bytes_of(k), len(number)) for k in range(len(self.starts))], np.uint64)

    def window_hash(self) -> np.ndarray:
        out = np.zeros(len(self.at), np.uint64)
        for j in range(self.size):
            out += self.hash[self.at + j] * _ODD[j]
        return mix64(out)

    def minimisers(self) -> np.ndarray:
        """The smallest triple hash in each window."""
        n = len(self.hash) - TRIPLE + 1
        if not len(self.at):
            return np.zeros(0, np.uint64)
        low = mix64(sum(self.hash[j : n + j] * _ODD[200 + j] for j in range(TRIPLE)))
        width, span = 1, self.size - TRIPLE + 1
        while 2 * width <= span:  # low[i] covers width triples from i
            low = np.minimum(low[: len(low) - width], low[width:])
            width *= 2
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
        return low[self.at]

    def repeats(self, keys: np.ndarray, place: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(repeat, first) masks over windows; texts must come in order of (key, place).

        ``keys`` and ``place`` say for each window which document it is of and
        where it starts there. A window at the same place as the first of its
        kind is neither a repeat nor a first.
        """
        order = np.argsort(hashes, kind="stable")
        at = self.at[order]
        same = np.zeros(len(order), bool)
        same[1:] = hashes[order][1:] == hashes[order][:-1]
        pairs = np.flatnonzero(same)
        equal = np.ones(len(pairs), bool)
        for j in range(self.size):
            equal &= self.ids[at[pairs] + j] == self.ids[at[pairs - 1] + j]
        if not equal.all():  # different windows with one hash: tell them apart by their words
            exact = np.array([hash(self.ids[a : a + self.size].tobytes()) for a in self.at[order]])
            return self.repeats(keys, place, mix64(hashes) + mix64(exact[np.argsort(order)].astype(np.uint64)))
        leader = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        k, p = keys[order], place[order]
        repeat, first = np.zeros(len(order), bool), np.zeros(len(order), bool)
        repeat[order] = same & ((k != k[leader]) | (p != p[leader]))
        first[order] = ~same
        return repeat, first


def _spans(keys: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge windows at ``starts`` of documents ``keys`` (both in order) to (key, first word, end)."""
    if not len(keys):
        return keys, starts, starts
    cut = np.flatnonzero((np.diff(keys) != 0) | (np.diff(starts) > size)) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(keys)]]) - 1
    return keys[first], starts[first], starts[last] + size


def _read(doc_ids: pa.Array, texts: list[str], first: int) -> tuple[np.ndarray, list[bytes]]:
    """Ids and texts of the rows that have an id, in order of id."""
    rows = sorted((i, first + k) for k, i in enumerate(doc_ids.slice(first, len(texts)).to_pylist()) if i is not None)
    return np.array([i for i, _ in rows], np.int64), [texts[k - first].encode() for _, k in rows]


def _cells(minimisers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the two arrays of a sketch count a minimiser."""
    return (minimisers % np.uint64(CELLS)).astype(np.int64), (mix64(minimisers + np.uint64(1)) % np.uint64(CELLS)).astype(np.int64)


def _frequent(docs: DataFrame, size: int, limit: float) -> np.ndarray:
    """A bit for each cell of the two arrays: whether more than ``limit`` runs of windows have a minimiser there."""
    import zstandard

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, CELLS), np.int64)
        for batch in batches:
            for first, texts in slices(column_of(batch, "text"), SLICE):
                row = Words.of(_read(column_of(batch, "doc_id"), texts, first)[1], size)
                low = row.minimisers()
                new = np.ones(len(low), bool)
                new[1:] = (low[1:] != low[:-1]) | (row.text[1:] != row.text[:-1])
                for array, at in zip(sums, _cells(low[new])):
                    array += np.bincount(at, minlength=CELLS)
        press = zstandard.ZstdCompressor(level=1)
        parts = [(k, part) for k, part in enumerate(sums.reshape(-1, TOGETHER)) if part.any()]
        packed = [press.compress(part.astype(np.min_scalar_type(int(part.max()))).tobytes()) for _, part in parts]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array(packed, pa.binary())], names=["part", "packed"])
        give_back()

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(TOGETHER, np.int64)
        for data in group.column("packed"):
            data = zstandard.ZstdDecompressor().decompress(data.as_py())
            total += np.frombuffer(data, f"<u{len(data) // TOGETHER}")
        return pa.table({"part": group.column("part").slice(0, 1), "bits": pa.array([np.packbits(total > limit).tobytes()], pa.binary())})

    out = np.zeros((2 * CELLS // TOGETHER, TOGETHER // 8), np.uint8)
    for r in docs.mapInArrow(count, "part int, packed binary").groupBy("part").applyInArrow(add, "part int, bits binary").collect():  # as many rows as the arrays have parts
        out[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(2, -1)


def _is_frequent(bits: np.ndarray, minimisers: np.ndarray) -> np.ndarray:
    """Whether both cells of each minimiser are over the limit."""
    out = np.ones(len(minimisers), bool)
    for array, at in zip(bits, _cells(minimisers)):
        out &= (array[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return out


def _pack(row: Words, doc: np.ndarray, place: np.ndarray, travels: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """One compressed row per bucket with the runs of travelling windows that go there, as they stand in the texts."""
    import zstandard

    index = np.flatnonzero(travels)
    if not len(index):
        return
    b = bucket[index]
    cut = np.flatnonzero((np.diff(index) != 1) | (np.diff(b) != 0) | (np.diff(row.text[index]) != 0)) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(index)]]) - 1
    order = np.argsort(b[first], kind="stable")
    first, last = index[first[order]], index[last[order]]
    n_words = row.at[last] - row.at[first] + row.size
    # a blank follows every word
    begin, end = row.starts[row.at[first]].tolist(), (row.ends[row.at[last] + row.size - 1] + 1).tolist()
    goes, data = bucket[first], row.data.tobytes()
    edges = np.concatenate([[0], np.flatnonzero(np.diff(goes)) + 1, [len(goes)]]).tolist()
    press = zstandard.ZstdCompressor(level=3)
    for a, z in zip(edges, edges[1:]):
        head = struct.pack("<q", z - a) + doc[first[a:z]].astype("<i8").tobytes() + place[first[a:z]].astype("<i8").tobytes() + n_words[a:z].astype("<i8").tobytes()
        yield int(goes[a]), press.compress(head + b"".join([data[x:y] for x, y in zip(begin[a:z], end[a:z])]))


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(data)
    (n,) = struct.unpack_from("<q", data)
    doc, place, words = np.frombuffer(data, "<i8", 3 * n, 8).reshape(3, n)
    return doc, place, words, data[8 + 24 * n :]


def repeated_spans(docs: DataFrame, *, size: int = 20, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id`` and ``spans`` (first word and end, both from 0) of the words that repeats cover."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    total = rows.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets = max(1, -(-total * SPREAD // BUCKET_BYTES))
    # runs of windows come about once in 60 bytes; a minimiser with an eighth of a bucket's runs is spread.
    # Beyond some hundred thousand buckets a cell's ordinary share is more than that, and the limit follows it.
    runs = total / 60
    sent = spark.sparkContext.broadcast(_frequent(rows, size, max(64, runs / buckets / 8, 4 * runs / CELLS)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = sent.value
        for batch in batches:
            for begin, texts in slices(column_of(batch, "text"), SLICE):
                ids, own = _read(column_of(batch, "doc_id"), texts, begin)
                row = Words.of(own, size)
                hashes, low = row.window_hash(), row.minimisers()
                doc, place = ids[row.text], row.at - row.first[row.text]
                repeat, first = row.repeats(doc, place, hashes)
                low = np.where(_is_frequent(hot, low), mix64(hashes), low)
                out = list(_pack(row, doc, place, first, (low % np.uint64(buckets)).astype(np.int64)))
                key, start, end = _spans(doc[repeat], place[repeat], size)
                settled = np.stack([key, start, end]).astype("<i8")
                for part in range(0, settled.shape[1], 50_000):
                    piece = settled[:, part : part + 50_000]
                    out.append((int(piece[0, 0] % buckets), b"=" + piece.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array([p for _, p in out], pa.binary())], names=["bucket", "packed"])
        give_back()

    def settle(group: pa.Table) -> pa.Table:
        found, parts = [], []
        for data in group.column("packed"):
            data = data.as_py()
            if data[:1] == b"=":  # spans that a slice has found by itself
                found.append(np.frombuffer(data, "<i8", -1, 1).reshape(3, -1))
            else:
                parts.append(_unpack(data))
        if parts:
            doc, place, n = (np.concatenate([p[k] for p in parts]) for k in range(3))
            data = np.frombuffer(b"".join([*(p[3] for p in parts), b"        "]), np.uint8)
            del parts
            starts, ends = word_spans(data)
            order = np.lexsort((place, doc))
            words = ragged((np.cumsum(n) - n)[order], n[order])
            doc, place, n = doc[order], place[order], n[order]
            row = Words(data, starts[words], ends[words], n, size)
            key, start = doc[row.text], place[row.text] + row.at - row.first[row.text]
            # a document's runs can overlap here only in rows that share an id
            repeat, _ = row.repeats(key, start, row.window_hash())
            found.append(np.stack(_spans(key[repeat], start[repeat], size)))
            del row, key, start, repeat, words, data
            give_back()
        out = np.concatenate(found, 1) if found else np.zeros((3, 0), np.int64)
        return pa.table({"doc_id": pa.array(out[0], pa.int64()), "first": pa.array(out[1], pa.int64()), "end": pa.array(out[2], pa.int64())})

    spans = rows.mapInArrow(send, "bucket int, packed binary").groupBy("bucket").applyInArrow(settle, "doc_id long, first long, end long")
    return spans.groupBy("doc_id").agg(F.collect_list(F.struct("first", "end")).alias("spans"))


def remove_repeats(docs: DataFrame, *, size: int = 20, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Add ``n_words``, ``n_removed``, ``removed_spans`` and ``kept_text`` to every row.

    ``kept_text`` joins the words that stay by single spaces; the text column
    itself is left as it was.
    """
    docs = docs.drop("n_words", "n_removed", "removed_spans", "kept_text")
    spans = repeated_spans(docs, size=size, id_column=id_column, text_column=text_column).select(F.col("doc_id").alias("__id"), F.col("spans").alias("__spans"))
    own = F.col(id_column).cast("long")
    both = docs.where(own.isNotNull()).withColumn("__own", own).join(spans, F.col("__own") == F.col("__id"), "left").drop("__own", "__id")
    both = both.unionByName(docs.where(own.isNull()), allowMissingColumns=True)  # these meet nothing, so they stay where they are
    names = docs.columns
    text = names.index(text_column)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(len(names))
            begin, end = (spans.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            offsets, none = spans.offsets.to_numpy(), spans.is_null().to_numpy(zero_copy_only=False)
            total, gone, merged, kept = [], [], [], []
            for first, texts in slices(batch.column(text)):
                for k, value in enumerate(texts, first):
                    words = value.encode().split()
                    drop: list[list[int]] = []
                    if not none[k]:
                        for a, z in sorted(zip(begin[offsets[k] : offsets[k + 1]].tolist(), end[offsets[k] : offsets[k + 1]].tolist())):
                            if drop and a <= drop[-1][1]:
                                drop[-1][1] = max(drop[-1][1], z)
                            else:
                                drop.append([a, z])
                    for a, z in reversed(drop):
                        del words[a:z]
                    n = sum(z - a for a, z in drop)
                    total.append(len(words) + n)
                    gone.append(n)
                    merged.append([{"first": a, "end": z} for a, z in drop])
                    kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(merged, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.string())],
                names=[*names, "n_words", "n_removed", "removed_spans", "kept_text"],
            )

    return both.mapInArrow(cut, f"{fields}, n_words long, n_removed long, removed_spans array<struct<first: long, end: long>>, kept_text string")
