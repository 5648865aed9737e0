import random

import pytest

from agora.llm import shards

DIMS = ("n_chars", "doc_id", "source")


def split(rows, leaves, first=0):
    """The k-d tree by brute force: all keys sorted, the weighted quantile taken exactly. {row: shard}."""
    if leaves == 1 or not rows:
        return {r.row: first for r in rows}
    half, total = leaves // 2, sum(r.size for r in rows)
    dim = max(range(len(DIMS)), key=lambda k: (max(r.k[k] for r in rows) - min(r.k[k] for r in rows), -k))
    weight = {}
    for r in rows:
        weight[r.k[dim]] = weight.get(r.k[dim], 0) + r.size
    below, want, at = 0, total * half / leaves, None
    for key in sorted(weight):
        if below + weight[key] >= want:
            at = key + 1 if want - below > below + weight[key] - want else key
            break
        below += weight[key]
    return split([r for r in rows if r.k[dim] < at], half, first) | split([r for r in rows if r.k[dim] >= at], leaves - half, first + half)


@pytest.mark.parametrize("n", [2, 5, 24])
def test_against_a_brute_force_tree(spark, monkeypatch, n):
    monkeypatch.setattr(shards, "CLOSE", 0.0)
    monkeypatch.setattr(shards, "BINS", 64)
    rng = random.Random(n)
    rows = [(k, "".join(rng.choice("ab ") for _ in range(rng.choice([3, 40, 300]))), rng.choice(["hot", "hot", "x", "y"]), rng.randrange(500)) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").coalesce(1)
    keyed = shards._keyed(df, n, DIMS)[0].collect()
    placed = split(keyed, n)
    want = {r.doc_id: placed[r.row] for r in keyed}
    assert {r.doc_id: r.shard for r in shards.assign(df, n, DIMS).collect()} == want


def test_equal_texts_stay_together_unless_they_are_too_many(spark):
    rng = random.Random(1)
    rows = [(k, f"own text {k} " * rng.randint(1, 30)) for k in range(600)]
    rows += [(1000 + 10 * g + c, f"copies {g} " * 8) for g in range(40) for c in range(5)]
    rows += [(5000 + k, "the hot one " * 10) for k in range(900)]
    rng.shuffle(rows)
    out = shards.assign(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 8).collect()
    where, sizes = {}, {}
    for r in out:
        where.setdefault(r.text_crc32, set()).add(r.shard)
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
    spread = sorted(map(len, where.values()))  # only the hot text, half of all bytes, is dealt out
    assert len(out) == len(rows) and spread[-2] == 1 and spread[-1] >= 4
    assert max(sizes.values()) <= 1.1 * min(sizes.values())
