import random
import re

import numpy as np
import pytest
import xxhash

from agora.llm import simhash
from agora.llm.queries import QUERIES
from agora.llm.shared import table


def brute_print(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [words[i : i + n] for i in range(len(words) - n + 1)] if len(words) >= n else [words] * bool(words)
    h = [xxhash.xxh64(" ".join(r).encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, most=4):
    """The component of each of prints, by comparing all pairs."""
    prints = np.array(prints, np.uint64)
    label = list(range(len(prints)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints[:i] ^ prints[i]) <= most):
            label[top(int(j))] = top(i)
    return [top(i) for i in range(len(prints))]


def expected(ids, prints):
    parts = brute_components(prints)
    least = {}
    for p, i in zip(parts, ids, strict=True):
        least[p] = min((x for x in (least.get(p), i) if x is not None), default=None)
    return sorted(((i, f"{f:016x}", least[p]) for i, f, p in zip(ids, prints, parts, strict=True)), key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def flipped(x, n, rng):
    for b in rng.sample(range(64), n):
        x ^= 1 << b
    return x


def test_query_equals_brute_force(spark, data):
    rows = table(spark, data, "documents").select("doc_id", "text").collect()
    got = QUERIES["op13_simhash_neardup"](spark, data)
    assert found(got) == expected([r[0] for r in rows], [brute_print(r[1]) for r in rows])
    assert any(r[0] != r[2] for r in got.collect())


def test_odd_rows(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert found(simhash.cluster(odd)) == expected([i for i, _ in rows], [brute_print(t) for _, t in rows])
    assert simhash.cluster(none).collect() == []


def test_pieces_do_not_change_a_fingerprint(monkeypatch):
    rng = random.Random(1)
    text = "".join(rng.choice(["a", "B", "ß", "word ", " ", "\n", "\t", " "]) for _ in range(5000))
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "PIECE", 7)
    assert simhash.fingerprint(text.encode()) == whole == brute_print(text)


@pytest.mark.parametrize("most", [0, 1, 2, 3, 4, 5])
def test_blocks_catch_all_pairs(most):
    rng = random.Random(most)
    parts = simhash.blocks(most)
    assert parts[0][0] == 0 and parts[-1][1] == 64 and all(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))
    for _ in range(2000):
        d = flipped(0, most, rng)
        assert any((d >> a & ((1 << (b - a)) - 1)).bit_count() <= budget for a, b, budget in parts)


@pytest.mark.parametrize("block", [16384, 64])
def test_links_equal_brute_force(spark, monkeypatch, block):
    """Chains of neighbours, a large group in one ball and strangers, in deep trees; small blocks deal the shards out by pairs."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "SHARD", 1)
    rng = random.Random(5)
    prints = [rng.getrandbits(64) for _ in range(300)]
    ball = rng.getrandbits(64)
    prints += [flipped(ball, rng.randint(0, 4), rng) for _ in range(300)]
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(6):
            prints.append(x)
            x = flipped(x, rng.choice([3, 4, 4, 5]), rng)
    prints = sorted(set(prints))
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long").repartition(5)
    links = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.links(df, len(prints)).collect()]
    assert all((a ^ b) for a, b in links) and len(links) < 20 * len(prints)
    label = {p: p for p in prints}

    def top(p):
        while label[p] != p:
            p = label[p]
        return p

    for a, b in links:
        label[top(a)] = top(b)
    same = lambda parts: sorted(sorted(g) for g in parts.values())
    got, want = {}, {}
    for p, c in zip(prints, brute_components(prints), strict=True):
        got.setdefault(top(p), []).append(p)
        want.setdefault(c, []).append(p)
    assert same(got) == same(want)


def test_many_copies_meet_once(spark):
    """Half of all rows are copies, others differ from them in a word; the copies are one vertex."""
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(i, text) for i in range(100, 400)] + [(i, text.replace(f"w{i} ", "other ")) for i in range(1, 60)] + [(i, f"alone {i} in its own words {i * 7}") for i in range(1000, 1060)]
    got = found(simhash.cluster(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)))
    assert got == expected([i for i, _ in rows], [brute_print(t) for _, t in rows])
