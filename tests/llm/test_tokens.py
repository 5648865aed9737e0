"""Texts that polynomials modulo 2**64 take for equal, whatever their base: the parity sequence and its complement."""

import numpy as np
import pyarrow as pa
import pytest

from agora.llm import neardup, pieces, quality, tokens
from agora.llm.queries import MODEL

PARITY = "".join("ab"[i.bit_count() % 2] for i in range(2048))
OTHER = PARITY.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("window", [1 << 19, 64])
def test_words_and_lines_differ(monkeypatch, window):
    monkeypatch.setattr(tokens, "WINDOW", window)
    h, at = tokens.word_hashes(*tokens.column(pa.array([f"{PARITY} {OTHER} {PARITY.upper()}", "", OTHER])))
    assert len(set(h.tolist())) == 2 and h[0] == h[2] and h[1] == h[3] and at.tolist() == [0, 3, 3, 4]
    buf = np.frombuffer(b"abcdefgh" * 3 + b"abcdefgh\0", np.uint8)
    spans = tokens.spans_hash(buf, np.array([0, 8, 16, 24, 33]), np.array([8, 16, 24, 33, 33]))
    assert spans[0] == spans[1] == spans[2] != spans[3] and len(set(spans.tolist())) == 3


def test_spans_are_equal_only_if_their_bytes_are():
    rng = np.random.default_rng(3)
    words = [bytes(rng.integers(97, 99, int(n)).astype(np.uint8)) for n in rng.integers(0, 20, 4000)]
    ends = np.cumsum([len(w) for w in words])
    h = tokens.spans_hash(np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], ends[:-1]]), ends)
    assert len(set(h.tolist())) == len(set(words)) == len(set(zip(h.tolist(), words, strict=True)))


def test_op1_op6_op9(spark):
    docs = spark.createDataFrame([(1, f"{PARITY} x"), (2, f"{OTHER} x"), (3, f"{PARITY}\n{OTHER}\n{PARITY}")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in neardup.cluster(docs, shingle=2, threshold=0.8).collect()} == {1: 1, 2: 2, 3: 3}
    assert {r.doc_id: r.n_dup_lines for r in quality.assess(docs).collect()} == {1: 0, 2: 0, 3: 1}
    assert all(r.exact for r in pieces.digests(pieces.encode(docs, MODEL), MODEL).collect())
