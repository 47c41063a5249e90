"""SentencePiece by the tokenizers library against the sentencepiece library, and its defined cases."""

from __future__ import annotations

import os

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tickloom.llm import sentencepiece_codec as sc
from tickloom.llm.queries import op1_sentencepiece

MODEL = sc.DEFAULT_MODEL
pytestmark = pytest.mark.skipif(not os.path.exists(MODEL), reason="no vocabulary file")


@pytest.fixture(scope="module")
def reference():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_model_is_read(reference):
    m = sc.parse_model(sc.model_bytes())
    assert len(m["pieces"]) == reference.get_piece_size() and m["byte_fallback"] == 1 and m["type"] == sc.BPE
    for k in range(0, len(m["pieces"]), 997):
        assert m["pieces"][k][0] == reference.id_to_piece(k) and m["pieces"][k][1] == pytest.approx(reference.get_score(k))


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet=" \n\taeth▁é🙂<0x4>s/", max_size=80))
def test_parity_and_decoding(text):
    own = sc.codec(sc.model_bytes())
    sp = own.reference
    ids = own.encode([text])[0].tolist()
    assert ids == sp.encode(text)
    assert own.decode([np.array(ids, np.int32)])[0] == sp.decode(ids) or "�" in sp.decode(ids) or not ids


def test_unigram_scores_and_byte_fallback():
    def message(number, payload):
        return bytes([number << 3 | 2, len(payload)]) + payload

    import struct

    def piece(text, score, kind):
        return message(1, message(1, text.encode()) + b"\x15" + struct.pack("<f", score) + bytes([0x18, kind]))

    words = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("▁ab", -1.0, 1), ("▁a", -1.5, 1), ("b", -2.0, 1), ("▁", -3.0, 1), ("a", -3.0, 1), ("abab", -2.5, 1)]
    data = b"".join(piece(*w) for w in words + [(f"<0x{b:02X}>", -9.0, 6) for b in range(256)])
    trainer = bytes([3 << 3, 1]) + bytes([0x98, 0x02, 1])  # unigram, byte_fallback
    normaliser = bytes([3 << 3, 1, 4 << 3, 0, 5 << 3, 1])
    own = sc.Codec(data + message(2, trainer) + message(3, normaliser))
    assert own.model["type"] == sc.UNIGRAM and own.model["byte_fallback"] == 1
    for text in ("ab", "abab a", "aé", "  ab", "b b", "abababab"):
        ids = own.encode([text])[0].tolist()
        assert ids == own.reference.encode(text) and own.decode([np.array(ids)]) == [text]


@pytest.mark.parametrize("at", range(9))
def test_every_text_is_verified(monkeypatch, at):
    own = sc.codec(sc.model_bytes())
    texts = [f"text number {k}" for k in range(9)]

    class Other:
        """A reference that differs in one text."""

        def encode(self, rows, num_threads=1):
            return [[7] if t == texts[at] else sp.encode(t) for t in rows]

    sp = own.reference
    own.encode(texts)
    monkeypatch.setattr(own, "reference", Other())
    with pytest.raises(ValueError, match=texts[at]):
        own.encode(texts)


def test_query_matches_reference(spark, reference):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op1_sentencepiece(spark, sf).collect()
    assert len(rows) == len(texts) and all(r.same and r.n_tokens == len(reference.encode(texts[r.doc_id])) for r in rows)
    own = sc.encoded(spark.read.parquet(f"{sf}/documents.parquet"), sc.model_bytes())
    rows = sc.decoded(own, sc.model_bytes()).collect()
    assert all(r.ids == reference.encode(r.text) and r.decoded == r.text for r in rows)


def test_defined_cases(spark):
    rows = [(1, None, [9]), (None, "", None), (2, "x " * 200_000, [1]), (2, "same", [1]), (2, "same", [1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>")
    got = sc.round_trip(docs, sc.model_bytes()).collect()
    assert [len(r.ids) for r in got][:2] == [0, 0] and got[0].decoded == "" and all(r.same for r in got) and len(got[2].ids) > 200_000
    assert got[3] == got[4] and sc.round_trip(docs.limit(0), sc.model_bytes()).count() == 0
