"""Term spans over a corpus against a plain count of the same rule."""

import math
import random
import re

from agora.llm import pii


def brute(docs):
    """{doc_id: terms that go}: every entity, every term near it, every document, in plain Python."""
    texts = {i: t.encode() for i, t in docs}
    spans = {i: pii.find(x) for i, x in texts.items()}
    words = {i: [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", x)] for i, x in texts.items()}
    free = lambda i, s, e: not any(a < e and s < b for a, _, b in spans[i])
    held, near, df = {}, {}, {}
    for i, x in texts.items():
        for t in {pii._fold(x[s:e]) for s, e in words[i]}:
            df[t] = df.get(t, 0) + 1
        for (a, kind, b), entity in zip(spans[i], pii._entities(x, spans[i]), strict=True):
            held.setdefault(entity, set()).add(i)
            before = [w for w in words[i] if w[1] <= a][-pii.REACH :]
            after = [w for w in words[i] if w[0] >= b][: pii.REACH]
            for s, e in before + after:
                if len(t := pii._fold(x[s:e])) > 1 and free(i, s, e):
                    near.setdefault((entity, t), set()).add(i)
    out = {i: set() for i in texts}
    n = len(texts)
    for (entity, t), met in near.items():
        share = len(held[entity]) / n
        told = (len(met) + pii.PRIOR * share) / (df[t] + pii.PRIOR)
        if share < 1 and math.log2(told / share) >= -pii.DISCLOSURE * math.log2(share):
            for i in held[entity]:
                out[i].add((entity, t))
    return {i: sum(1 for s, e in words[i] if free(i, s, e) and pii._fold(texts[i][s:e]) in {t for _, t in ts}) for i, ts in out.items()}


def corpus(n=300, seed=2):
    rng = random.Random(seed)
    common = [f"word{k}" for k in range(60)]
    out = []
    for i in range(n):
        w = [rng.choice(common) for _ in range(rng.randint(5, 40))]
        if i % 7 == 0:
            who = rng.randrange(25)
            at = rng.randrange(len(w))
            w.insert(at, f"user{who}@mail{who % 3}.org")
            w.insert(max(0, at - rng.randrange(8)), f"nick{who}")
        if i % 11 == 0:
            w.insert(rng.randrange(len(w)), f"10.0.{i % 5}.7")
        out.append((i, " ".join(w)))
    return out


def test_terms_of_a_corpus(spark):
    docs = corpus()
    got = {r.doc_id: r.n_term for r in pii.scan(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()}
    assert got == brute(docs)
    assert sum(got.values()) > 10


def test_terms_on_the_given_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").where("text is not null")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r.n_term for r in pii.scan(docs).collect()}
    assert got == brute(rows)


def test_many_entities_in_one_text_take_time_in_proportion():
    import time

    text = " ".join(f"w{k} a{k}@x.org" for k in range(20_000)).encode()
    t = time.time()
    assert len(pii._near(text, pii.find(text))) > 100_000 and len(pii._words(text, pii.find(text))) == 20_000
    assert time.time() - t < 20
