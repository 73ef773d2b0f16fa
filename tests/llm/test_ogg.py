import hashlib
import os
import zlib

import pytest

from noveltybench.llm import ogg


@pytest.mark.parametrize("size", [0, 1, 575, 576, 577, 576 * 160, 576 * 160 + 1, 300_000])
def test_round_trip(size):
    payload = ogg.padded(os.urandom(size))
    back, figures = ogg.read(ogg.write(payload))
    assert back == payload and len(payload) % 576 == 0 and figures["streams"] == 2
    assert figures["seconds"] == len(payload) / ogg.RATE


def test_checksum_is_the_container_polynomial():
    data, crc = b"OggS" + bytes(range(256)), 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = ((crc << 1) ^ (0x04C11DB7 if crc >> 31 else 0)) & 0xFFFFFFFF
    assert ogg.page_checksum(data) == crc


def test_damage_is_found():
    media = bytearray(ogg.write(ogg.padded(b"a" * 5000)))
    media[-10] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        ogg.read(bytes(media))
    with pytest.raises(ValueError):
        ogg.read(ogg.write(ogg.padded(b"a" * 200_000))[:-2000])


def test_packets_continue_across_pages():
    serial, packet = 7, os.urandom(1000)
    lacing = ogg.lacing_of(len(packet))
    pages = [
        ogg._page(serial, 0, 2, 0, ogg.lacing_of(3), b"abc"),
        ogg._page(serial, 1, 0, -1, lacing[:2], packet[:510]),
        ogg._page(serial, 2, 5, 1000, lacing[2:], packet[510:]),
    ]
    stream = ogg.demultiplex(b"".join(pages))[serial]
    assert stream.packets == [b"abc", packet] and stream.granules == [0, 1000]


def test_rows(odd_docs, no_docs):
    got = ogg.digest(odd_docs).collect()
    texts = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    assert len(got) == odd_docs.count() and all(r["n_bytes"] == len((texts[r["doc_id"]] or "").encode()) for r in got)
    assert ogg.digest(no_docs).collect() == []
    features = {}
    for r in got:
        text = (texts[r["doc_id"]] or "").encode()
        payload = text + b"\xff" * (max(1, -(-len(text) // 576)) * 576 - len(text))
        media = ogg.write(payload)
        want = (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest())
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == want
        assert features.setdefault(text, r["feature"]) == r["feature"]
    assert len(set(features.values())) > 3
    stored = ogg.store(odd_docs)
    n = ogg.packets(stored).groupBy("doc_id").count().collect()
    assert all(r["count"] == max(1, -(-len((texts[r["doc_id"]] or "").encode()) // 576)) for r in n if r["doc_id"] != 1)
