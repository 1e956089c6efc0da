import hashlib
import os
import random
import zlib

import pytest

from lexloom.llm import ogg


def plain_crc(data: bytes) -> int:
    register = 0
    for byte in data:
        register ^= byte << 24
        for _ in range(8):
            register = (register << 1) ^ (0x04C11DB7 if register & 0x80000000 else 0)
            register &= 0xFFFFFFFF
    return register


def test_checksum_is_the_formats():
    for n in (0, 1, 27, 300):
        data = os.urandom(n)
        assert ogg.ogg_crc(data) == plain_crc(data)


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 3840, 3841, 70_000, 1_000_000])
def test_payload_comes_back(n):
    payload = ogg.padded(os.urandom(n))
    assert len(payload) % 192 == 0 and payload
    media = ogg.store(payload)
    back, feature = ogg.restore(media)
    assert back == payload and feature.startswith("ogg streams=2")
    assert ogg.store(payload) == media


def test_packets_of_any_size_span_pages():
    packets = [(b"head", 0)] + [(os.urandom(n), i + 1) for i, n in enumerate((0, 1, 254, 255, 256, 510, 65_025, 200_000, 0))]
    streams, damaged = ogg.demultiplex(b"".join(ogg.paged(7, packets)))
    assert damaged == 0 and streams[0].packets == [p for p, _ in packets] and streams[0].ended
    assert streams[0].granules[-1] == len(packets) - 1


def test_multiplexed_and_chained_streams_come_apart():
    a, b = (list(ogg.paged(s, [(b"h%d" % s, 0), (os.urandom(90_000), 5)], most=4096)) for s in (1, 2))
    mixed = [p for pair in zip(a, b, strict=True) for p in pair]
    streams, _ = ogg.demultiplex(b"".join(mixed) + b"".join(a))
    assert [s.serial for s in streams] == [1, 2, 1] and all(len(s.packets) == 2 for s in streams)
    assert streams[0].packets == streams[2].packets


def test_damage_loses_only_its_own_packets():
    packets = [(b"head", 0)] + [(bytes([i]) * 3000, i) for i in range(1, 40)]
    pages = list(ogg.paged(3, packets, most=9000))
    broken = bytearray(pages[4])
    broken[60] ^= 1
    streams, damaged = ogg.demultiplex(b"junk" + b"".join([*pages[:4], bytes(broken), *pages[5:]]))
    assert damaged == 1 and streams[0].gaps == 1
    assert {p for p in streams[0].packets} < {p for p, _ in packets} and len(streams[0].packets) >= 34
    with pytest.raises(ValueError):
        ogg.restore(b"".join(pages)[:-5])
    assert ogg.demultiplex(b"")[0] == [] and ogg.demultiplex(b"no pages OggS")[0] == []


def test_timestamps_follow_granules():
    media = ogg.store(b"x" * (3840 * 5))
    streams, _ = ogg.demultiplex(media)
    assert ogg.timestamps(streams[0], 8000)[1:] == [0.48, 0.96, 1.44]
    assert ogg.timestamps(streams[1], 8000)[-1] == 0.96


def test_query_matches_texts(spark, docs, no_docs, folder, rows):
    out = ogg.op1_ogg(spark, folder).collect()
    assert len(out) == len(rows)
    expected = sorted((n is None, n or 0, len((t or "").encode()), hashlib.sha256(ogg.padded((t or "").encode())).hexdigest()) for n, t, *_ in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.payload_sha256) for r in out) == expected
    assert all(r.payload_bytes % 192 == 0 for r in out)
    tails = {r.doc_id: r.tail_crc32 for r in out}
    assert tails[4] == zlib.crc32(ogg.padded(b"one two three")[-16:])
    assert ogg.read_back(ogg.stored(no_docs)).count() == 0
    media = ogg.stored(docs).filter("doc_id = 5")
    assert ogg.packets(media).groupBy("serial").count().count() == 2


def test_random_streams_never_break_the_reader():
    rnd = random.Random(5)
    for _ in range(200):
        data = bytearray(ogg.store(os.urandom(rnd.randrange(4000))))
        for _ in range(rnd.randrange(6)):
            data[rnd.randrange(len(data))] = rnd.randrange(256)
        ogg.demultiplex(bytes(data[: rnd.randrange(len(data) + 1)]))
