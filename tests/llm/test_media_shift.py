from collections import Counter

import numpy as np
import pytest

from quadrille.llm.media import AHEAD, BAND, FAN, FRAME, HOP, PEAKS, peak_pairs


@pytest.fixture(scope="module")
def texts(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) > 3000").orderBy("doc_id").limit(20).collect()
    return [r.text.encode() for r in rows]


def kept(texts, shift):
    """Share of a text's hashes that are found again when other bytes stand before it."""
    before = bytes(np.random.default_rng(3).integers(97, 123, shift, dtype=np.uint8))
    both = total = 0
    for b in texts:
        own, moved = (Counter(peak_pairs(x)[1].tolist()) for x in (b, before + b))
        both, total = both + (own & moved).total(), total + own.total()
    return both / total


def test_moved_copies_are_recognised(texts):
    assert min(kept(texts, s) for s in (64, 128, 256)) > 0.95
    assert min(kept(texts, s) for s in (32, 100)) > 0.6  # no multiples of the hop


def test_the_whole_zone_is_used(texts):
    dt = {h & 255 for b in texts for h in peak_pairs(b)[1].tolist()}
    assert dt == set(range(1, AHEAD + 1))


def test_zone_by_plain_loops():
    x = np.random.default_rng(1).integers(0, 256, 5000, dtype=np.uint8).tobytes()
    peaks = []
    for k in range(-(-(len(x) - FRAME) // HOP) + 1):
        part = np.zeros(FRAME, np.float32)
        own = np.frombuffer(x[k * HOP : k * HOP + FRAME], np.uint8).astype(np.float32) - 128
        part[: len(own)] = own
        power = np.round(np.log1p(np.abs(np.fft.rfft(part * np.hanning(FRAME).astype(np.float32))) ** 2), 3)
        high = [(-power[i], i) for i in range(2, FRAME // 2) if power[i] > power[i - 1] and power[i] >= power[i + 1] and power[i] > 0]
        peaks += sorted((k, i) for _, i in sorted(high)[:PEAKS])
    want = []
    for t, f in peaks:
        zone = [(u, g) for u, g in peaks if 1 <= u - t <= AHEAD and abs(g - f) <= BAND]
        want += [(t, f << 20 | g << 8 | u - t) for u, g in zone[:FAN]]
    assert list(zip(*(v.tolist() for v in peak_pairs(x)))) == sorted(want)


def test_short_samples():
    assert [len(v) for v in peak_pairs(b"\x80" * 64)] == [0, 0] and len(peak_pairs(b"a" * 64)[1]) == 0
