import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from treeline.llm import matroska as m


@given(st.binary(max_size=40000))
@settings(max_examples=60, deadline=None)
def test_round_trip_is_lossless(raw):
    payload = m.padded(raw)
    data = m.mux(payload)
    media = m.parse(data)
    assert len(payload) % 64 == 0 and payload[: len(raw)] == raw
    assert b"".join(data[a : a + n] for _, _, a, n, _, _ in media.packets) == payload
    assert [c for _, _, c in media.cues] == [data.index(b"\x1f\x43\xb6\x75", c) for _, _, c in media.cues]
    assert m.digest(data)[:3] == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


@given(st.lists(st.binary(max_size=700), min_size=1, max_size=20))
@settings(max_examples=60, deadline=None)
def test_every_lacing(frames):
    sizes = [len(f) for f in frames]
    flags, body = m.lace(frames)
    got = m.frame_ranges(body, 0, len(body), flags >> 1)
    assert [body[a : a + n] for a, n in got] == frames
    xiph = bytes([len(frames) - 1]) + b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1]) + b"".join(frames)
    assert [xiph[a : a + n] for a, n in m.frame_ranges(xiph, 0, len(xiph), 1)] == frames


def test_timestamps_follow_samples():
    media = m.parse(m.mux(bytes(64 * 1000)))
    assert [p[1] for p in media.packets] == [k * m.FRAME * 125_000 for k in range(len(media.packets))]
    assert len(media.clusters) == len(media.cues) == 4


def test_unknown_cluster_size_and_block_group():
    block = m.element(m.BLOCK, b"\x81\x00\x00\x00abc")
    cluster = m.CLUSTER.to_bytes(4, "big") + b"\xff" + m.uint(m.TIMESTAMP, 7) + m.element(m.BLOCK_GROUP, block)
    data = m._HEAD + m.element(m.SEGMENT, m._TRACK + cluster + cluster)
    media = m.parse(data)
    assert [(p[0], p[1], data[p[2] : p[2] + p[3]], p[4], p[5]) for p in media.packets] == [(1, 7_000_000, b"abc", False, 0), (1, 7_000_000, b"abc", False, 1)]


@pytest.mark.parametrize("data", [b"", b"\x00", b"junk that is no media", m.mux(bytes(64))[:-3]])
def test_bad_bytes_are_an_error(data):
    with pytest.raises(m.MediaError):
        m.parse(data)


def test_columns(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (2, None, "x"), (None, "", "x"), (1, "a", "y")], "doc_id long, text string, media string")
    rows = m.round_trip(docs).collect()
    assert len(rows) == 4 and {r.n_bytes for r in rows} == {0, 1}
    assert len({r.media_sha256 for r in rows if r.n_bytes == 1}) == 1
    stored = m.encode(docs).select("doc_id", "media").union(spark.createDataFrame([(9, b"bad"), (8, None)], "doc_id long, media binary"))
    table = m.packets(stored).collect()
    assert sorted((r.doc_id or -1, r.packet, r.error is None) for r in table if r.doc_id != 9) == [(-1, 0, True), (1, 0, True), (1, 0, True), (2, 0, True)]
    assert [r.error is not None for r in table if r.doc_id == 9] == [True]
    assert m.round_trip(docs.limit(0)).collect() == []
