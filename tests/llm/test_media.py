import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from histoloom.llm import media


@settings(deadline=None, max_examples=60)
@given(st.integers(1, 12), st.integers(1, 12), st.integers(0, 2**32 - 1), st.booleans())
def test_png_round_trip_with_all_filters(height, width, seed, choose):
    r = np.random.default_rng(seed)
    pixels = r.integers(0, 256, (height, width), np.uint8)
    kinds = None if choose else r.integers(0, 5, height)
    assert (media.decode(media.encode(pixels, kinds=kinds)) == pixels).all()


def test_damage_is_found():
    png = media.encode(np.arange(576, dtype=np.uint8).reshape(3, 192))
    for i in (0, 20, len(png) // 2, len(png) - 5):
        bad = bytearray(png)
        bad[i] ^= 4
        with pytest.raises(ValueError):
            media.decode(bytes(bad))
    with pytest.raises(ValueError):
        media.decode(png[:-12])


def test_cosine_hash_of_a_brighter_image_is_the_same():
    r = np.random.default_rng(1)
    pixels = r.integers(0, 100, (64, 64)).astype(np.uint8)
    assert media.cosine_hash(pixels) == media.cosine_hash(pixels + 50)
    other = media.cosine_hash(r.integers(0, 100, (64, 64)).astype(np.uint8))
    assert (int(media.cosine_hash(pixels), 16) ^ int(other, 16)).bit_count() > 10


def test_texts_as_images(docs, cases, no_docs):
    got = media.through_media(docs).collect()
    want = Counter()
    for c in cases:
        data = (c[1] or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        want[c[0], len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    assert len({(r.payload_sha256, r.media_bytes, r.media_sha256, r.feature) for r in got}) == len({r.payload_sha256 for r in got})
    assert media.through_media(no_docs).count() == 0
