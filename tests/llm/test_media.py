from __future__ import annotations

import hashlib
import os
import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from quirespark.llm.media import ArchiveReader, ArchiveSource, from_wav, media_column, to_wav, write_archives
from tests.llm.helpers import DOCS, awkward, clash


def expected(doc):
    raw = (doc[1] or "").encode()
    payload = raw + bytes(-len(raw) % 64 or (64 if not raw else 0))
    return (str(doc[0]), len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


@given(st.binary(max_size=300))
def test_wav_round_trip(raw):
    payload = from_wav(to_wav(raw))
    assert payload.startswith(raw) and len(payload) % 64 == 0 and payload and not payload[len(raw) :].strip(b"\0") and len(payload) - len(raw) <= 64


def test_awkward_rows(spark):
    docs = awkward()
    rows = media_column(clash(spark.createDataFrame(docs, DOCS)), range_bytes=700).collect()
    found = sorted((str(r["doc_id"]), r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows)
    assert found == sorted(map(expected, docs))
    by = {}
    for r in rows:
        by.setdefault(r["payload_sha256"], set()).add((r["media_sha256"], r["feature"], r["media_bytes"]))
    assert all(len(v) == 1 for v in by.values())


def test_ids_null_empty_and_very_long(spark):
    ids = [None, "", "a b", "x" * 100_000, "ü" * 70_000, "9"]
    docs = spark.createDataFrame([(i, f"text {n}") for n, i in enumerate(ids)], "doc_id string, text string")
    rows = media_column(docs, range_bytes=500).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or "", r["n_bytes"]) for r in rows) == sorted((i is None, i or "", 6) for i in ids)


def test_ids_of_many_members(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "t" * (i % 90)) for i in range(9000)], "doc_id long, text string").coalesce(1)
    rows = media_column(docs, range_bytes=50_000).collect()
    assert sorted((r["doc_id"], r["n_bytes"]) for r in rows) == [(i, i % 90) for i in range(9000)]


def test_empty_table(spark):
    assert media_column(spark.createDataFrame([], DOCS)).count() == 0


def test_ranges_read_each_member_once_whatever_their_size(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * (i * 13), None, None, None) for i in range(50)], DOCS).coalesce(2)
    assert write_archives(docs, f"file://{tmp_path}/a").collect()
    spark.dataSource.register(ArchiveSource)
    for span in (64, 1000, 1 << 20):
        got = spark.read.format("media_archive").option("rangebytes", span).load(f"{tmp_path}/a").collect()
        assert sorted(int(r["id"]) for r in got) == list(range(50))


def test_a_member_is_tried_again_alone_and_damage_is_told(spark, tmp_path):
    write_archives(spark.createDataFrame([(1, "hello", None, None, None)], DOCS), str(tmp_path)).collect()
    (name,) = [n for n in os.listdir(tmp_path) if n.endswith(".zip")]
    reader = ArchiveReader({"path": str(tmp_path), "tries": "2"})
    assert [b.num_rows for p in reader.partitions() for b in reader.read(p)] == [1]
    first, taken = reader.take, []
    reader.take = lambda f, info: taken.append(info.filename) or (first(f, info) if taken.count(info.filename) > 1 else (_ for _ in ()).throw(OSError("lost")))
    assert [b.num_rows for p in reader.partitions() for b in reader.read(p)] == [1] and taken.count("000000000.wav") == 2
    reader.take = first
    whole = (tmp_path / name).read_bytes()
    (tmp_path / name).write_bytes(whole[:60] + bytes([whole[60] ^ 255]) + whole[61:])
    with pytest.raises(OSError, match="member 000000000.wav"):
        [b for p in reader.partitions() for b in reader.read(p)]


def test_attempts_that_were_lost_are_not_read(spark, tmp_path):
    (tmp_path / "part-000000-9-x.zip.tmp").write_bytes(b"half")
    reader = ArchiveReader({"path": str(tmp_path)})
    assert [b for p in reader.partitions() for b in reader.read(p)] == []
