import hashlib
import io
import zipfile
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmill.llm import media

ROWS = [(1, "Grüße"), (2, None), (3, ""), (1, "Grüße"), (None, "no id"), (4, "x" * 576), (5, "y" * 400_000), (-7, "negative")]


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=3000))
def test_png_round_trip(data):
    payload = media.padded(data)
    assert len(payload) % 576 == 0 and payload and payload.startswith(data)
    assert media.png_decode(media.png_encode(payload)) == payload


def test_damage_is_found():
    image = bytearray(media.png_encode(media.padded(b"abc")))
    image[-20] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        media.png_decode(bytes(image))
    with pytest.raises(ValueError):
        media.png_decode(b"GIF89a")


def test_archives_are_plain_zip():
    builder = media.ArchiveBuilder()
    for i in (5, None, -3):
        builder.add(i, b"data%d" % (i or 0))
    with zipfile.ZipFile(io.BytesIO(builder.close()[0])) as z:
        assert z.testzip() is None and [media.member_id(n.encode()) for n in z.namelist()] == [5, None, -3]
        assert z.read(z.namelist()[2]) == b"data-3"


def rows(spark):
    return spark.createDataFrame([(*r, b"clash") for r in ROWS], "doc_id long, text string, media binary")


def test_features(spark):
    out = media.media_features(media.media_rows(rows(spark), archive_bytes=500)).collect()
    expected = []
    for i, text in ROWS:
        data = (text or "").encode()
        payload = media.padded(data)
        expected.append((i, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])))
    assert sorted(((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in out), key=str) == sorted(expected, key=str)
    first, second = (r for r in out if r["doc_id"] == 1)
    assert first == second and first["media_bytes"] > 0 and first["feature"]


def test_feature_of_every_row(spark):
    """The feature string, recomputed from the padded text sample by sample."""
    import math
    from collections import Counter

    for r in media.media_features(media.media_rows(rows(spark))).collect():
        text = next(t for i, t in ROWS if i == r["doc_id"])
        counts = Counter(media.padded((text or "").encode()))
        n = sum(counts.values())
        mean = sum(b * c for b, c in counts.items()) / n
        std = math.sqrt(sum(c * (b - mean) ** 2 for b, c in counts.items()) / n)
        entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
        top = min(counts, key=lambda b: (-counts[b], b))
        got = dict(p.split("=") for p in r["feature"].split(";"))
        assert abs(float(got["mean"]) - mean) < 1e-3 and abs(float(got["std"]) - std) < 1e-3 and abs(float(got["entropy"]) - entropy) < 1e-4
        assert got["top"].split(":")[0] == str(top) and abs(float(got["top"].split(":")[1]) - counts[top] / n) < 1e-4


def test_ranges_cover_the_directory(spark, tmp_path):
    index = media.store_payloads(rows(spark).coalesce(1), f"file://{tmp_path}")
    assert spark.read.parquet(index).count() == 1
    reader = media.ArchiveReader({"folder": f"file://{tmp_path}", "rangebytes": 200, "batchbytes": 100})
    parts = reader.partitions()
    assert len(parts) == 4
    ids = [i for p in parts for b in reader.read(p) for i in b.column(0).to_pylist()]
    assert sorted(ids, key=str) == sorted((i for i, _ in ROWS), key=str)


def test_small_archives_share_partitions(spark, tmp_path):
    """The plan opens no archive, and a partition takes several of them up to its size."""
    index = media.store_payloads(rows(spark), f"file://{tmp_path}", archive_bytes=300)
    archives = spark.read.parquet(index).orderBy("archive").collect()
    assert len(archives) > 4
    held = {r["archive"]: (tmp_path / r["archive"]).read_bytes() for r in archives}
    for r in archives:
        (tmp_path / r["archive"]).unlink()
    reader = media.ArchiveReader({"folder": f"file://{tmp_path}", "partitionbytes": 1000})
    parts = reader.partitions()
    assert 1 < len(parts) < len(archives) and sorted(a for p in parts for a, _, _ in p.ranges) == sorted(held)
    for name, data in held.items():
        (tmp_path / name).write_bytes(data)
    ids = [i for p in parts for b in reader.read(p) for i in b.column(0).to_pylist()]
    assert sorted(ids, key=str) == sorted((i for i, _ in ROWS), key=str)


def test_members_are_retried_alone(spark, tmp_path, monkeypatch):
    media.store_payloads(rows(spark).coalesce(1), f"file://{tmp_path}")
    reader = media.ArchiveReader({"folder": f"file://{tmp_path}"})
    whole, calls = reader._bytes, []

    def flaky(store, path, at, size):
        calls.append((at, size))
        data = whole(store, path, at, size)
        if len(calls) == 2:  # the joint read of all members comes back damaged in the first
            return data[:20] + bytes([data[20] ^ 255]) + data[21:]
        if len(calls) == 3:
            raise OSError("no route")
        return data

    monkeypatch.setattr(reader, "_bytes", flaky)
    monkeypatch.setattr(media.time, "sleep", lambda s: None)
    images = [m for p in reader.partitions() for b in reader.read(p) for m in b.column(1).to_pylist()]
    assert len(images) == len(ROWS) and all(media.png_decode(m) for m in images)
    assert len(calls) == 4  # directory, joint read, a failed and a good retry of one member
    monkeypatch.setattr(reader, "_bytes", lambda store, path, at, size: whole(store, path, at, size) if size % 87 == 0 else bytes(size))
    with pytest.raises(ValueError, match="checksum"):
        [b for p in reader.partitions() for b in reader.read(p)]


def test_empty_table(spark):
    assert media.media_features(media.media_rows(rows(spark).limit(0))).count() == 0
