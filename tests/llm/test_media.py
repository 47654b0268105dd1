import hashlib
import zlib

import numpy as np
import pytest

from vigil.llm import media

from .cases import documents


@pytest.mark.parametrize("kind", [0, 1, 2])
@pytest.mark.parametrize("rows", [1, 2, 31, 33, 500])
def test_round_trip(kind, rows):
    x = np.random.default_rng(rows).integers(0, 256, (rows, media.WIDTH), dtype=np.uint8)
    assert (media.read_png(media.write_png(x, kind)) == x).all()


def test_unfilter_average_and_paeth_against_their_definition():
    r = np.random.default_rng(3)
    x = r.integers(0, 256, (6, 9)).astype(int)
    kinds = np.array([4, 3, 2, 4, 1, 3], np.uint8)
    lines = np.zeros((6, 9), np.uint8)
    for i in range(6):
        for j in range(9):
            a, b, c = (x[i, j - 1] if j else 0), (x[i - 1, j] if i else 0), (x[i - 1, j - 1] if i and j else 0)
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            lines[i, j] = (x[i, j] - {1: a, 2: b, 3: (a + b) // 2, 4: paeth}[int(kinds[i])]) % 256
    assert (media.unfilter(kinds, lines) == x).all()


def test_damage_is_found():
    data = bytearray(media.write_png(np.arange(640, dtype=np.uint8).reshape(10, 64)))
    for at in (1, 20, 45, len(data) - 2):
        broken = bytes(data[:at]) + bytes([data[at] ^ 1]) + bytes(data[at + 1 :])
        with pytest.raises(ValueError):
            media.read_png(broken)
    with pytest.raises(ValueError):
        media.read_png(bytes(data[:-12]))


def test_similar_images_have_similar_hashes():
    x = np.add.outer(np.arange(96), np.arange(64)).astype(np.uint8)
    far = np.random.default_rng(0).integers(0, 256, (96, 64), dtype=np.uint8)
    bits = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    noisy = x.copy()
    noisy[::17, ::9] += 3
    assert bits(media.cosine_hash(x), media.cosine_hash(noisy)) < bits(media.cosine_hash(x), media.cosine_hash(far))


def test_documents(spark):
    docs = documents(spark)
    out = {r.doc_id: r for r in media.read_media(media.write_media(docs)).collect()}
    stored = {r.doc_id: r.media for r in media.write_media(docs).collect()}
    assert len(out) == docs.count()
    seen = {}
    for r in docs.collect():
        raw = (r.text or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        o = out[r.doc_id]
        assert (o.n_bytes, o.payload_bytes, o.payload_sha256, o.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (o.media_bytes, o.media_sha256) == (len(stored[r.doc_id]), hashlib.sha256(stored[r.doc_id]).hexdigest())
        assert seen.setdefault(r.text or "", (o.media_sha256, o.feature)) == (o.media_sha256, o.feature)
    assert media.read_media(media.write_media(docs.limit(0))).count() == 0
