import random

import pytest

from agora.llm import graph, neardup, shared, tokens


def brute(docs, n=2, limit=80):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) or (frozenset([tuple(w)]) if w else frozenset())
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= limit * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(seed, groups=25, size=6):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    out, n = [], 0
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.randint(1, 60))]
        for _ in range(rng.randint(1, size)):
            t = list(base)
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(words)
            out.append((n := n + 1, " ".join(t)))
    return out + [(n + 1, ""), (n + 2, None), (n + 3, "  "), (n + 4, "Word"), (n + 5, "wORD\n")]


@pytest.mark.parametrize(("seed", "leaf"), [(1, 400), (2, 3)])
def test_against_brute_force(spark, monkeypatch, seed, leaf):
    monkeypatch.setattr(neardup, "LEAF", leaf)
    docs = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.cluster(spark.createDataFrame(docs, "doc_id long, text string"), shingle=2).collect()}
    assert got == brute(docs)


def test_large_mixed_nodes_keep_borderline_pairs(spark, monkeypatch):
    """Pairs at 0.8 among texts that are all just less alike: nodes of many components, far over LEAF."""
    monkeypatch.setattr(neardup, "LEAF", 6)
    common = [f"c{k}" for k in range(198)]
    docs = []
    for pair in range(120):
        own = [f"p{pair}x{k}" for k in range(3)]
        docs += [(2 * pair + half, " ".join(common + own + [f"d{pair}h{half}x{k}" for k in range(25)])) for half in range(2)]
    want = brute(docs, 1)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.cluster(spark.createDataFrame(docs, "doc_id long, text string"), shingle=1).collect()}
    assert got == want and len({c for _, c in want.values()}) == 120


def test_chain_of_borderline_copies(spark):
    """A chain in which only neighbours are alike is one component."""
    words = [f"t{k}" for k in range(400)]
    docs = [(k, " ".join(words[5 * k : 5 * k + 60])) for k in range(60)]
    assert brute(docs)[59][1] == 0
    got = {r.doc_id: r.component_id for r in neardup.cluster(spark.createDataFrame(docs, "doc_id long, text string"), shingle=2).collect()}
    assert set(got.values()) == {0}


def test_odd_rows(odd, none):
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.cluster(odd, shingle=2).collect()]
    assert len(got) == odd.count()
    assert sorted(g for g in got if g[0] in (1, 2, 3, 4, 5)) == [(1, 5, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (5, 5, 1, False), (5, 5, 1, False)]
    assert [g for g in got if g[0] is None] and all(g[2] is None and g[3] for g in got if g[0] is None)
    assert neardup.cluster(none).count() == 0


def test_sketches_estimate_similarity():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(3)
    base = [str(rng.random()) for _ in range(400)]
    other = base[:356] + [str(rng.random()) for _ in range(44)]  # similarity 0.8 of single words
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([" ".join(base), " ".join(other)])], names=["doc_id", "text"])
    out = next(neardup.features(1)(iter([batch])))
    a, b = (np.frombuffer(x.as_py(), np.uint8) for x in out.column("sketch"))
    assert 0.65 < (a == b).mean() < 0.93


@pytest.mark.parametrize("few", [500_000, 20])
def test_components_against_brute_force(spark, monkeypatch, few):
    for module in (graph, shared):
        monkeypatch.setattr(module, "BROADCAST_ROWS", few)
    rng = random.Random(4)
    e = [(rng.randrange(90), rng.randrange(90)) for _ in range(70)] + [(k, k + 1) for k in range(200, 240)] + [(300, k) for k in range(301, 340)]
    parent = {i: i for p in e for i in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in e:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert all(got.get(i, i) == root(i) for i in parent)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_word_hashes_do_not_depend_on_windows(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rng = random.Random(5)
    texts = ["".join(rng.choice("ab \nÉA") for _ in range(rng.randrange(300))) for _ in range(100)]
    whole = tokens.word_hashes(*tokens.column(pa.array(texts)))
    monkeypatch.setattr(tokens, "WINDOW", 37)
    parts = tokens.word_hashes(*tokens.column(pa.array(texts)))
    assert np.array_equal(whole[0], parts[0]) and np.array_equal(whole[1], parts[1])
    assert [int(b - a) for a, b in zip(whole[1], whole[1][1:], strict=False)] == [len(t.encode().split()) for t in texts]
    buf, offs = tokens.column(pa.array(texts))
    s, e = tokens.edges(buf, offs)
    assert np.array_equal(tokens.spans_hash(buf, s, e, tokens.FOLDED), whole[0])


def test_rows_of_one_id_keep_their_own_links(spark):
    x, y = (" ".join(f"{c}{k}" for k in range(40)) for c in "xy")
    rows = [(7, x), (7, y), (8, f"{x} q"), (9, f"{y} q"), (10, y)]
    for n in (1, 3):
        got = neardup.cluster(spark.createDataFrame(rows, "doc_id long, text string").repartition(n), shingle=2).collect()
        assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(7, 7, True), (7, 7, True), (8, 7, False), (9, 7, False), (10, 7, False)]
