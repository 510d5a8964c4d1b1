"""Stored payloads, archives, retries."""

import hashlib
import io
import os
import struct
import zipfile
import zlib

import pytest

from tessera.llm import media


def test_images_are_lossless():
    for raw in (b"", b"a", bytes(range(256)) * 9, "é\U0001f600".encode(), os.urandom(5000)):
        payload = media.padded(raw)
        image = media.to_png(payload)
        assert len(payload) % 64 == 0 and payload and media.from_png(image) == payload
        assert struct.unpack(">II", image[16:24]) == (64, len(payload) // 64)


def test_round_trip(spark, docs, tmp_path):
    media.store(docs, f"file://{tmp_path}/a")
    back = media.described(media.load(spark, f"file://{tmp_path}/a")).collect()
    expected = []
    for r in docs.collect():
        raw = (r.text or "").encode()
        payload = media.padded(raw)
        image = media.to_png(payload)
        expected.append((r.doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(image), hashlib.sha256(image).hexdigest(), media.features(payload)))
    assert sorted(map(tuple, back), key=str) == sorted(expected, key=str)
    for name in os.listdir(tmp_path / "a"):
        if name.endswith(".zip"):
            with zipfile.ZipFile(tmp_path / "a" / name) as z:
                assert z.testzip() is None


def test_empty_table(spark, docs, tmp_path):
    media.store(docs.limit(0), f"{tmp_path}/none")
    assert media.described(media.load(spark, f"{tmp_path}/none")).count() == 0


def test_ranges_and_closed_archives(tmp_path, monkeypatch):
    monkeypatch.setattr(media, "ARCHIVE_BYTES", 2000)
    monkeypatch.setattr(media, "RANGE_BYTES", 500)
    monkeypatch.setattr(media, "BATCH_BYTES", 300)
    writer = media.ArchiveWriter(str(tmp_path))
    rows = [(k if k % 5 else None, k, os.urandom(k * 7)) for k in range(40)]
    writer.commit([writer.write(iter([media.as_batch(rows[:25]), media.as_batch(rows[25:])])), None])
    reader = media.ArchiveReader(str(tmp_path))
    parts = reader.partitions()
    assert len(parts) > 5 and len({p.name for p in parts}) > 1
    assert [tuple(r.values()) for p in parts for b in reader.read(p) for r in b.to_pylist()] == rows


def test_members_are_retried_alone():
    body = b"payload"
    calls = []

    class Flaky(io.BytesIO):
        def read_at(self, size, offset):
            calls.append(offset)
            return b"?" * size if len(calls) < 3 else body

    assert media.again(lambda: media.member(Flaky(), 10, len(body), zlib.crc32(body)), wait=0) == body and len(calls) == 3
    with pytest.raises(OSError):
        media.again(lambda: media.member(Flaky(), 10, len(body), 1), wait=0)


def test_writes_into_one_folder_add_up(spark, docs, tmp_path):
    for _ in range(2):
        media.store(docs.limit(3), f"{tmp_path}/twice")
    assert media.load(spark, f"{tmp_path}/twice").count() == 6


def test_lost_attempts_leave_nothing_in_the_manifest(tmp_path):
    writer = media.ArchiveWriter(str(tmp_path))
    writer.write(iter([media.as_batch([(1, 1, b"lost")])]))  # an attempt whose message never arrives
    writer.commit([writer.write(iter([media.as_batch([(2, 1, b"kept")])]))])
    reader = media.ArchiveReader(str(tmp_path))
    assert [r["doc_id"] for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()] == [2]
