"""Best-fit packing of token sequences into bins of a fixed capacity.

The packing is planned over the histogram of piece lengths, which has at most
``capacity`` entries however many documents there are:

* *large* lengths (above a third of the capacity) can share a bin at most in
  pairs, so they are matched greedily, each with the largest partner that fits;
* the remaining lengths go, longest first, to the fullest bin that still has
  room (best fit), and to new bins when none has.

Equal lengths are placed in bulk, as runs of bins that look alike, so the plan
is a short table of placements ``(length, first rank, ...)``. Each piece then
finds its bin from its length and its rank among the pieces of that length.
Ranks come from counts per (length, bucket), where frequent lengths get more
buckets, so no task holds all pieces of a hot length.

Repeated rows are packed as often as they occur. A null or empty text is the
single separator id. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import SAFE, Codec, Lexicon, compile_lexicon, merger
from .common import column_of, give_back, slices, written

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


_QUICK: dict[tuple, object] = {}
_BLANKS = re.compile(r"\s{1000}")


def endless(text: str) -> bool:
    """Whether a run of a thousand blanks or others may be in it: a splitter that backtracks gives up on those."""
    if len(text) < 1000:
        return False
    sizes = [len(w) for w in text.split()]
    spare = len(text) - sum(sizes) - len(sizes)  # blanks beyond one a word
    return max(sizes, default=0) >= 1000 or spare >= 998 and _BLANKS.search(text) is not None


class Encoder:
    """Ids as the tokenizers library gives them for a tokenizer file.

    With the same vocabulary as a rank file, ordinary texts take tiktoken, at a
    fifth of the time. Texts with endless runs, or with characters on which
    two libraries' Unicode tables could differ, take the exact encoder of
    :mod:`.bpe`; so do all without a rank file.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str | None, pattern: str | None, special: dict[str, int] | None = None):
        self.path, self.quick = tokenizer_path, None
        self.special = added_tokens(tokenizer_path) if special is None else special
        if ranks_path:
            import tiktoken

            key = (tokenizer_path, ranks_path, pattern)
            if key not in _QUICK:  # one per Python process
                with open(ranks_path, "rb") as lines:
                    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
                _QUICK[key] = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=self.special)
            self.quick = _QUICK[key]

    @cached_property
    def exact(self) -> Codec:
        """Only read by a worker that meets a text for it, since its tables take some 100 MB while they are read."""
        return Codec(merger(self.path), Lexicon(compile_lexicon([], [])))

    def ids(self, text: str) -> np.ndarray:
        if self.quick and SAFE.fullmatch(text) and not endless(text):
            return self.quick.encode_to_numpy(text, allowed_special=set(self.special))
        return self.exact.encode([text])[0]


def added_tokens(tokenizer_path: str) -> dict[str, int]:
    """Special tokens of a tokenizer file, whose strings in a text are single ids."""
    with open(tokenizer_path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


def token_pieces(docs: DataFrame, *, tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None, capacity: int, separator: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Cut every document into pieces of at most ``capacity`` ids, the rest first.

    Ids are those of :class:`Encoder`. One row per piece: its document's id,
    number, first id, length and the crc32 of its ids. The cut leaves the short
    piece in front, so that all later pieces fill a bin by themselves.
    """

    special = added_tokens(tokenizer_path)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer_path, ranks_path, pattern, special)
        for batch in batches:
            ids = column_of(batch, "doc_id").to_pylist()
            for first, texts in slices(column_of(batch, "text")):
                rows = []
                for at, text in enumerate(texts, first):
                    tokens = np.append(encoder.ids(text), separator).astype("<u4")
                    n = len(tokens)
                    start, end = 0, (n - 1) % capacity + 1
                    piece = 0
                    while start < n:
                        rows.append((ids[at], piece, start, end - start, zlib.crc32(tokens[start:end].tobytes())))
                        start, end, piece = end, end + capacity, piece + 1
                columns = list(zip(*rows))
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        give_back()

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(cut, PIECE_SCHEMA)


def plan_packing(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Placements for ``counts[length]`` pieces of each length.

    Rows of int64 ``(length, first rank, last rank + 1, first bin, pieces a
    bin, offset in the bin)``: the piece of rank r lies in bin
    ``first bin + (r - first rank) // pieces a bin``, behind ``offset`` and the
    pieces of the same placement before it.
    """
    left = {int(n): int(c) for n, c in counts.items() if c > 0}
    if any(n < 1 or n > capacity for n in left):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    used = dict.fromkeys(left, 0)
    plan: list[tuple[int, int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}  # free space -> runs of bins (first, number)
    bins = 0

    def put(length: int, number: int, first: int, each: int, offset: int) -> None:
        plan.append((length, used[length], used[length] + number, first, each, offset))
        used[length] += number
        left[length] -= number

    def keep(space: int, first: int, number: int) -> None:
        if space and number:
            room.setdefault(space, []).append((first, number))

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for length in large:
        while left[length]:
            mate = next((m for m in large if m <= capacity - length and left[m] > (m == length)), None)
            if mate is None:
                n = left[length]
                put(length, n, bins, 1, 0)
                keep(capacity - length, bins, n)
            elif mate == length:
                n = left[length] // 2
                put(length, 2 * n, bins, 2, 0)
                keep(capacity - 2 * length, bins, n)
            else:
                n = min(left[length], left[mate])
                put(length, n, bins, 1, 0)
                put(mate, n, bins, 1, length)
                keep(capacity - length - mate, bins, n)
            bins += n
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[length]:
            space = min((s for s in room if s >= length), default=None)
            if space is None:
                each = capacity // length
                first, number, offset = bins, -(-left[length] // each), 0
                bins += number
                space = capacity
            else:
                first, number = room[space].pop()
                if not room[space]:
                    del room[space]
                each, offset = space // length, capacity - space
            full = min(number, left[length] // each)
            if full:
                put(length, full * each, first, each, offset)
                keep(space - each * length, first, full)
            if full < number and left[length]:
                some = left[length]
                put(length, some, first + full, each, offset)
                keep(space - some * length, first + full, 1)
                full += 1
            keep(space, first + full, number - full)
    return np.array(sorted(plan), np.int64).reshape(-1, 6)


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with ``doc_id``, ``piece`` and ``length``.

    ``pieces`` is read three times and should be a written table. What reaches
    the driver is bounded: one count per length (at most ``capacity``) and per
    bucket (at most ``capacity`` plus 8 per shuffle partition).
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = plan_packing(counts, capacity)
    share = max(1, sum(counts.values()) // (8 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    buckets = spark.createDataFrame([(n, -(-c // share)) for n, c in counts.items()], "length long, buckets long")
    dealt = pieces.join(F.broadcast(buckets), "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.col("buckets")))
    before: list[tuple[int, int, int]] = []
    last, rank = None, 0
    for r in sorted(dealt.groupBy("length", "bucket").count().collect()):
        if r["length"] != last:
            last, rank = r["length"], 0
        before.append((r["length"], r["bucket"], rank))
        rank += r["count"]
    offsets = spark.createDataFrame(before, "length long, bucket long, before long")
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(within) - 1).join(F.broadcast(offsets), ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    sent = spark.sparkContext.broadcast(plan)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (column_of(batch, c).to_numpy() for c in ("length", "rank"))
            step = int(rows[:, 2].max()) + 1  # lengths and ranks as one ascending key
            at = np.searchsorted(rows[:, 0] * step + rows[:, 1], length * step + rank, side="right") - 1
            _, first, _, start, each, offset = rows[at].T
            inside = rank - first
            out = {"sequence_id": start + inside // each, "offset": offset + inside % each * length}
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([column_of(batch, c) for c in names] + [pa.array(v, pa.int64()) for v in out.values()], names=[*names, *out])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, PIECE_SCHEMA + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, *, capacity: int = 2048, **tokens) -> DataFrame:
    """Tokenise, cut and pack all documents; see :func:`token_pieces` and :func:`pack`."""
    return pack(written(token_pieces(docs, capacity=capacity, **tokens), "pieces"), capacity)
