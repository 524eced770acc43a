import hashlib
import zlib

import numpy as np
from cases import awkward, empty, rows

from quadrille.llm import queries as Q
from quadrille.llm.media import FRAME, HOP, from_wav, padded, peak_pairs, to_wav, with_media


def test_query_by_brute_force(spark, sf):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = Q.op8_media(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        raw = docs[r.doc_id]
        pay = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        wav = to_wav(pay)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(wav), hashlib.sha256(wav).hexdigest()) and len(wav) == len(pay) + 44
        t, h = peak_pairs(pay)
        assert r.feature == " ".join(f"{a}:{b:x}" for a, b in zip(t.tolist(), h.tolist()))


def test_wave_form():
    for raw in (b"", b"a", bytes(range(256)) * 3, b"x" * 64):
        p = padded(raw)
        assert len(p) % 64 == 0 and p and from_wav(to_wav(p)) == p and p.startswith(raw)


def tone(*freqs, n=8000):
    t = np.arange(n) / 8000
    return np.round(127 + sum(40 * np.sin(2 * np.pi * f * t) for f in freqs)).astype(np.uint8).tobytes()


def test_peaks_are_the_tones():
    t, h = peak_pairs(tone(1000, 2500))
    bins = {1000 * FRAME // 8000, 2500 * FRAME // 8000}
    strong = [(int(x) >> 20, int(x) >> 8 & 4095) for x in h]
    assert sum(set(p) <= bins for p in strong) > 0.15 * len(strong)
    shifted = peak_pairs(bytes([128]) * HOP * 4 + tone(1000, 2500))
    later = {(int(a) + 4, int(b)) for a, b in zip(t, h)}
    assert len(later & set(zip(shifted[0].tolist(), shifted[1].tolist()))) > 0.9 * len(later)


def test_pairs_by_plain_loops():
    x = np.random.default_rng(1).integers(0, 256, 5000, dtype=np.uint8).tobytes()
    peaks = []
    n = -(-(len(x) - FRAME) // HOP) + 1
    for k in range(n):
        part = np.zeros(FRAME, np.float32)
        own = np.frombuffer(x[k * HOP : k * HOP + FRAME], np.uint8).astype(np.float32) - 128
        part[: len(own)] = own
        power = np.round(np.log1p(np.abs(np.fft.rfft(part * np.hanning(FRAME).astype(np.float32))) ** 2), 3)
        high = [(-power[i], i) for i in range(2, FRAME // 2) if power[i] > power[i - 1] and power[i] >= power[i + 1] and power[i] > 0]
        peaks += sorted((k, i) for _, i in sorted(high)[:3])
    want = sorted((a[0], a[1] << 20 | b[1] << 8 | b[0] - a[0]) for i, a in enumerate(peaks) for b in peaks[i + 1 : i + 4] if b[0] - a[0] <= 8)
    assert list(zip(*(v.tolist() for v in peak_pairs(x)))) == want


def test_awkward_documents(spark):
    got = with_media(awkward(spark), keep_media=True).collect()
    assert len(got) == len(rows())
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[0].n_bytes == 0 and by[0].payload_bytes == 64 and by[0].media_sha256 == by[1].media_sha256
    assert by[5].peak_hashes == by[6].peak_hashes and by[9].media_sha256 == by[10].media_sha256
    assert with_media(empty(spark)).count() == 0
