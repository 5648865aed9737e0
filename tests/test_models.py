import math
import zlib

import numpy as np
import pytest

from agora.operators import models, search
from agora.plans import records, searches  # noqa: F401  fills records.QUERIES


def wave(text, dim=32, length=256):
    """The stand-in's vector of a text, number by number."""
    words = [zlib.crc32(w.encode()) % 10_007 for w in (text or "").lower().split()[:length]]
    v = [sum(math.sin(w * k) for w in words) / max(1, len(words)) for k in range(1, dim + 1)]
    n = math.sqrt(sum(x * x for x in v))
    return [x / n if n else 0.0 for x in v]


def test_query_against_plain_numbers(spark, data):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = records.QUERIES["u1_text_embeddings"](spark, data).collect()
    assert len(got) == len(texts) and {r.model for r in got} == {"waves-32"}
    for r in got:
        assert np.allclose(r.embedding, wave(texts[r.doc_id]), atol=2e-4)


def test_pooling_leaves_padding_out():
    hidden, mask = np.arange(24.0).reshape(2, 3, 4), np.array([[1, 1, 0], [0, 0, 0]])
    assert models.mean_pool(hidden, mask).tolist() == [[2.0, 3.0, 4.0, 5.0], [0.0] * 4]
    e = models.stand_in(8, 3)
    assert np.allclose(e(["a b c d e"]), e(["a b c"])) and np.allclose(np.linalg.norm(e(["a", "b c d"]), axis=1), 1) and not e([""]).any()


class Way:
    def __init__(self, model="m", fails=0):
        self.model, self.dim, self.fails, self.asked = model, 1, fails, 0

    def __call__(self, texts):
        self.asked += 1
        if self.asked <= self.fails:
            raise TimeoutError
        return np.ones((len(texts), 1))


def test_order_of_ways():
    def broken():
        raise RuntimeError("none here")

    first, second = Way(fails=1), Way()
    f = models.Fallback([broken, lambda: first, lambda: second])
    assert f.now is first and f(["a"]).shape == (1, 1) and f.now is second and f(["a"]) is not None and (first.asked, second.asked) == (1, 2)
    with pytest.raises(TimeoutError):
        models.Fallback([lambda: Way(fails=9)])(["a"])
    with pytest.raises(RuntimeError, match="none here"):
        models.Fallback([broken])
    with pytest.raises(ValueError, match="no way"):
        models.Fallback([])
    with pytest.raises(ValueError, match="stand in"):
        models.Fallback([lambda: Way(fails=1), lambda: Way("other")])(["a"])


def test_batches_and_semantic_search(spark):
    rows = spark.createDataFrame([(1, "tax reform"), (2, "health care"), (3, None)], "id long, text string")
    out = models.embed_batches(rows, "text", [models.stand_in], "waves-32", size=2)
    best = search.semantic(out, "health care", models.stand_in(), 1, "id")
    assert [(r.id, r.score) for r in best.collect()] == [(2, 1.0)]
    with pytest.raises(Exception, match="in place of"):
        models.embed_batches(rows, "text", [models.stand_in], "another").collect()
