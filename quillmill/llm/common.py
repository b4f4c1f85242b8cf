"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Python code takes texts in slices of about this many characters, whatever the Arrow batch size is.
SLICE_CHARS = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    ``spark.checkpoint.dir`` names it. Only a single-JVM session (tests) may
    run without it and then gets a temporary folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    held = getattr(spark.sparkContext, "_quillmill_dir", None)
    if held is None:
        held = "file://" + tempfile.mkdtemp(prefix="quillmill-")
        spark.sparkContext._quillmill_dir = held
    return held


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/quillmill-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder.

    It cuts the lineage: a lost executor costs no more than the tasks that
    ran on it, and each expensive pass over the texts runs once.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the tables that this application wrote to the shared folder."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/quillmill-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", counts: DataFrame | None = None, share: int = 4096, least: int = 200) -> DataFrame:
    """``left`` joined with ``right``, which has one row a key, however unevenly ``left`` holds the keys.

    Keys with more than a ``share``-th of the rows of ``left`` (so fewer than
    ``share`` keys, and of more than ``least`` rows) meet their row of
    ``right`` as a broadcast; all others meet in a shuffle. Rows with a null
    key match nothing and stay where they are. ``how`` is left, inner or
    left_semi. ``left`` is read up to four times and should be a written table;
    ``counts`` (the keys and ``n``) saves counting its keys once more.
    """
    some = F.lit(True)
    for c in on:
        some = some & F.col(c).isNotNull()
    known, none = left.where(some), left.where(~some)
    limit = max(least, left.count() / share)
    if counts is None:
        counts = known.groupBy(*on).agg(F.count("*").alias("n"))
    hot = written(counts.where(F.col("n") > limit).select(*on), "hot")
    if hot.isEmpty():
        out = known.join(right, on, how)
    else:
        few = F.broadcast(hot)
        own = known.join(few, on, "left_semi") if how == "left" else known  # else the join itself keeps the hot keys only
        out = own.join(F.broadcast(right.join(few, on, "left_semi")), on, how).unionByName(known.join(few, on, "left_anti").join(right, on, how))
    return out.unionByName(none, allowMissingColumns=True) if how == "left" else out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def most_frequent(counts: DataFrame, size: int, key: str, n: str = "n") -> DataFrame:
    """The ``size`` rows with the largest ``n``, ties by ``key``.

    ``counts`` is read twice. Counts are binned first (512 bins at most), so
    that the final sort only sees little more than ``size`` rows and no
    partition sends its own top rows to the driver.
    """
    band = F.floor(8 * F.log2(n)).cast("int")
    rows, found, least = sorted(counts.groupBy(band.alias("band")).count().collect(), reverse=True), 0, 0
    for r in rows:
        found, least = found + r["count"], r["band"]
        if found >= size:
            break
    return counts.where(band >= least).orderBy(F.desc(n), key).limit(size)


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of the id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def runs(texts: pa.Array, limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Runs of rows holding about ``limit`` bytes, as (first row, row after the last)."""
    n = len(texts)
    if not n:
        return
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), np.int64)
    block = np.cumsum(sizes) // limit
    edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), n]
    yield from zip(edges, edges[1:])


def slices(texts: pa.Array, limit: int = SLICE_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Runs of rows holding about ``limit`` bytes, as (first row, texts); a null text is empty."""
    for a, b in runs(texts, limit):
        yield a, [t or "" for t in texts.slice(a, b - a).to_pylist()]


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives on and serves the next stages.

    Without it, the allocator keeps what the largest slice has taken, in every
    worker, beside whatever the next stage takes. No effect without glibc.
    """
    global _TRIM
    pa.default_memory_pool().release_unused()
    if _TRIM is None:
        try:
            import ctypes

            _TRIM = ctypes.CDLL("libc.so.6").malloc_trim
        except (OSError, AttributeError):
            _TRIM = lambda _: 0
    _TRIM(0)


_TRIM = None


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the runs ``starts[i] .. starts[i] + lengths[i]``, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)


def joined(values: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of ``values`` one after another, with offsets (one more than values)."""
    values = list(values)
    offsets = np.zeros(len(values) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, values), np.int64, len(values)), out=offsets[1:])
    return np.frombuffer(b"".join(values), np.uint8), offsets


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
