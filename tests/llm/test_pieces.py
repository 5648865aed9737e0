import random

import pytest
from sentencepiece import SentencePieceProcessor
from sentencepiece import sentencepiece_model_pb2 as pb

from agora.llm import pieces
from agora.llm.queries import MODEL

BLOB = open(MODEL.removeprefix("file:"), "rb").read()


def as_unigram():
    m = pb.ModelProto()
    m.ParseFromString(BLOB)
    m.trainer_spec.model_type = 1
    for p in m.pieces:
        p.score = -8.0 + 0.9 * len(p.piece) + (hash_of(p.piece) % 97) / 331 if p.type == 1 else p.score
    return m.SerializeToString()


def hash_of(s):
    import zlib

    return zlib.crc32(s.encode())


def chunked(m, text, size):
    e, parts = m.escape(text), []
    for a in range(0, len(e), size):
        low, b = max(0, a - m.longest), min(a + size, len(e))
        t = e[low : b + m.longest]
        parts.append((t, a - low, b - low, *m.transfer(t, a - low, b - low)))
    at = pieces.scan([p[5] for p in parts])
    return [i for k, (t, a, b, left, right, _) in enumerate(parts) for i in m.trace(t, a, b, left[at[k]], right[at[k + 1]])]


def texts(n, seed):
    rng = random.Random(seed)
    words = ["the", "information", "naïve", "中文字", "😀", "abcabcabc", "12345", "\n", "  ", "\t", "internationalisation", "ñandú", "x" * 30]
    return ["".join(rng.choice(words) + rng.choice([" ", "", ""]) for _ in range(rng.randint(1, 25))) for _ in range(n)]


def test_bpe_in_any_chunks_equals_the_library():
    m, sp = pieces.Model(BLOB), SentencePieceProcessor(model_proto=BLOB)
    for k, t in enumerate(texts(150, 1)):
        want = sp.encode(t)
        assert m.encode(t) == want
        assert chunked(m, t, (3, 7, 20, 64)[k % 4]) == want
        assert m.decode(want) == t


def test_merging_equals_the_library_kernel():
    m = pieces.Model(BLOB)
    for t in texts(40, 2):
        for s in m.segments(m.escape(t)):
            if len(s) < 40:
                assert m.numbers(m.merge(s)) == m.solve([s])
                assert m.numbers(m.path(s, (0, 0))) == m.solve([s])


def test_unigram_scores_in_chunks_equal_the_library():
    blob = as_unigram()
    m, sp = pieces.Model(blob), SentencePieceProcessor(model_proto=blob)
    assert not m.bpe
    score = lambda ids: sum(sp.get_score(i) for i in ids)
    for k, t in enumerate(x for x in texts(120, 3) if not set(x) & set("😀中文字\n\t")):
        want, got = sp.encode(t), chunked(m, t, (5, 11, 40)[k % 3])
        assert m.decode(got) == t and score(got) == pytest.approx(score(want), abs=1e-3)


def test_products_are_associative():
    import numpy as np

    rng = np.random.default_rng(0)
    a, b, c = (np.where(rng.random((3, 3)) < 0.3, pieces.NONE, rng.random((3, 3))) for _ in range(3))
    assert np.allclose(pieces.combine(pieces.combine(a, b), c), pieces.combine(a, pieces.combine(b, c)))


def test_operator_on_short_and_giant_texts(spark, odd, none):
    out = pieces.encode(odd, MODEL, chunk=5000)
    sp = SentencePieceProcessor(model_proto=BLOB)
    rows = out.collect()
    assert len(rows) == odd.count() and out.columns == [*odd.columns, "ids", "n_chunks"]
    assert all(r.ids is None if r.text is None else list(r.ids) == sp.encode(r.text) for r in rows)
    assert {r.doc_id: r.n_chunks for r in rows if r.doc_id in (2, 3, 7, 8)} == {2: 0, 3: 0, 7: 31, 8: 15}
    assert all(r.exact for r in pieces.digests(out, MODEL).collect())
    assert pieces.decode(out.drop("text"), MODEL).where("text is null").count() == 2
    assert pieces.encode(none, MODEL).count() == 0


def test_many_lattices_at_once_equal_the_library():
    m, sp = pieces.Model(BLOB), SentencePieceProcessor(model_proto=BLOB)
    import pyarrow as pa

    some = texts(400, 5) + ["", None, "▁a mark", "x" * 300, "  two  blanks  ", " 中文" * 50, "\n\n \t"]
    for chunk in (1, 2, 17, 10_000):
        ids, at, n = m.encoded(pa.array(some), chunk)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [sp.encode(t or "") for t in some]
        assert all(k == -(-len(m.escape(t or "")) // chunk) for k, t in zip(n.tolist(), some, strict=True))


def test_unigram_lattices_at_once_score_like_the_library():
    import pyarrow as pa

    blob = as_unigram()
    m, sp = pieces.Model(blob), SentencePieceProcessor(model_proto=blob)
    score = lambda ids: sum(sp.get_score(i) for i in ids)
    for t in (x for x in texts(60, 6) if not set(x) & set("😀中文字\n\t")):
        ids = m.encoded(pa.array([t]), 25)[0].tolist()
        assert m.decode(ids) == t and score(ids) == pytest.approx(score(sp.encode(t)), abs=1e-3)


def test_the_library_takes_no_part_in_encoding(monkeypatch):
    import sentencepiece

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", None)
    m = pieces.Model(BLOB)
    assert m.decode(m.encode("no kernel here")) == "no kernel here"


def test_memory_may_run_out(monkeypatch):
    monkeypatch.setattr(pieces, "MEMORY", 5)
    m, sp = pieces.Model(BLOB), SentencePieceProcessor(model_proto=BLOB)
    assert all(m.encode(t) == sp.encode(t) for t in texts(30, 7))


def test_lookup_keeps_what_is_put():
    import numpy as np

    t, keys = pieces.Lookup(4), np.arange(1, 5001, dtype=np.uint64) * np.uint64(977)
    for k in range(0, 5000, 100):
        t.put(keys[k : k + 100], np.arange(k, k + 100, dtype=np.int32))
    assert (t.get(keys) == np.arange(5000)).all() and (t.get(keys + np.uint64(1)) < 0).all()


def test_giants_are_dealt_out_and_encoded_alike(spark, odd):
    sp = SentencePieceProcessor(model_proto=BLOB)
    rows = pieces.encode(odd, MODEL, chunk=4000, spread=60_000).collect()
    assert len(rows) == odd.count()
    assert all(r.ids is None if r.text is None else list(r.ids) == sp.encode(r.text) for r in rows)
    assert {r.doc_id: r.n_chunks for r in rows if r.doc_id in (7, 8)} == {7: 38, 8: 18}


def test_decoding_ids_that_are_no_text(spark):
    m = pieces.Model(BLOB)
    broken = [m.byte[0xE4], m.byte[0xB8]]
    rows = spark.createDataFrame([(1, broken), (2, None), (3, []), (4, m.encode("fine"))], "doc_id long, ids array<int>")
    got = {r.doc_id: r.text for r in pieces.decode(rows, MODEL).collect()}
    assert got == {1: m.decode(broken), 2: None, 3: "", 4: "fine"}
