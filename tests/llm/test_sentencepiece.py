import struct
import zlib

import pytest
import sentencepiece
from cases import awkward, empty, rows
from hypothesis import given, settings
from hypothesis import strategies as st

from quadrille.llm import queries as Q
from quadrille.llm.sentencepiece import BYTE, NORMAL, Coder, build, decode, encode, encode_documents, parse_model

PATH = Q.vocabulary("piece_bpe_32k.model")


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(k, v):
    return varint(k << 3) + varint(v) if isinstance(v, int) else varint(k << 3 | 2) + varint(len(v)) + v


def unigram(words):
    """A small unigram model with byte fallback, as a protobuf."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{b:02X}>", -20.0, BYTE) for b in range(256)), *((w, s, NORMAL) for w, s in words)]
    body = b"".join(field(1, field(1, p.encode()) + varint(2 << 3 | 5) + struct.pack("<f", s) + field(3, k)) for p, s, k in pieces)
    return body + field(2, field(3, 1) + field(35, 1)) + field(3, field(1, b"identity") + field(3, 1) + field(4, 0) + field(5, 1))


SMALL = unigram([("▁", -3.0), ("▁the", -2.0), ("▁th", -3.5), ("e", -2.5), ("he", -2.7), ("t", -3.1), ("h", -3.2), ("▁then", -4.0), ("n", -2.9), ("en", -2.8)])


def test_query(spark, sf):
    own = sentencepiece.SentencePieceProcessor(model_file=PATH)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = Q.op9_sentencepiece(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = own.encode(docs[r.doc_id])
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))) and r.parity and r.round_trip


def test_unigram_scores_and_byte_fallback():
    own = sentencepiece.SentencePieceProcessor(model_proto=SMALL)
    t = build(parse_model(SMALL))
    texts = ["the then", "then he", "thé ✓", "ten", "the  the", "x", ""]
    assert encode(t, texts) == own.encode(texts)
    assert [x for x in decode(t, own.encode(texts))] == [own.decode(own.encode(x)) for x in texts]


coder = Coder(PATH, 2)
piece = st.one_of(st.sampled_from(["the", "▁", " ", "  ", "\n", "don't", "état", "漢字", "\U0001f600", "...", "</s>", "<0x41>", "\0", " "]), st.text(max_size=6))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(piece, max_size=8).map("".join), min_size=1, max_size=4))
def test_any_text_keeps_parity(texts):
    import pyarrow as pa

    ids, n = coder.encode(pa.array(texts, pa.string()))
    assert sum(coder.own.encode(texts), []) == ids.tolist() and len(n) == len(texts)
    assert [b.decode() for b in coder.decode(ids, n)] == [t.replace("▁", " ") for t in texts]


def test_damaged_models():
    with pytest.raises(ValueError, match="breaks off"):
        parse_model(SMALL[:-3])
    with pytest.raises(ValueError, match="no pieces"):
        parse_model(b"")


def test_awkward_documents(spark):
    got = encode_documents(awkward(spark), PATH, with_ids=True).collect()
    assert len(got) == len(rows()) and all(r.parity and r.round_trip for r in got)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[0].n_tokens == by[1].n_tokens == 0 and len(by[5].ids) == by[5].n_tokens
    assert encode_documents(empty(spark), PATH).count() == 0
