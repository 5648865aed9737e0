"""Ranked lexical search by Fagin's threshold algorithm, over shards of documents.

One pass over the texts writes the forward index: each document's length and the counts of the terms that items ask for. Corpus
figures are sums over it. Shards of it, at most DOCS documents or POSTINGS postings in a task, then hold for each term a list sorted
by impact. For each item the lists are read round-robin, STEP entries of each, then twice as many each time; a document met for the first time is scored
in full by lookups in the forward index; reading stops when the threshold, the score that the places reached could still give, is
strictly below the k-th best score, so that ties are never lost. A term in a third of all documents is a list in each shard, not a key
of one task. Shards hand on k documents for each item, of which the best k stay.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agora.llm.shared import cut, drop
from agora.llm.tokens import column, slices

#: Documents and postings of a shard, and entries of a list that are read at first.
DOCS, POSTINGS, STEP = 1 << 16, 1 << 21, 64
#: Items, and characters of their texts, that are searched at a time; more are searched in further blocks.
ITEMS, CHARS = 20_000, 1 << 25

#: Letters, digits and all bytes beyond ASCII belong to terms, A-Z as a-z; any other byte is a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_GRAIN = 1_000_000_000
_PIECE = 1 << 20
_INDEX = "doc_id long, n long, terms array<int>, tfs array<int>"


def terms(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, in lists of bounded length: pieces end at a byte that no term holds."""
    at = 0
    while at < len(data):
        to = at + _PIECE
        while to < len(data) and _FOLD[data[to]] != 32:
            to += 1
        yield data[at:to].translate(_FOLD).split()
        at = to


def _indexed(known: Broadcast):
    """For each document the number of its terms, and those that the dictionary has, by ascending number, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value.get
        for batch in batches:
            for part in slices(batch):
                buf, at = column(part.column("text"))
                lengths, ids, counts = [], [], []
                for a, b in zip(at[:-1], at[1:], strict=True):
                    n, got = 0, Counter()
                    for words in terms(buf[a:b].tobytes()):
                        n += len(words)
                        got.update(map(number, words))
                    got.pop(None, None)
                    order = sorted(got)
                    lengths.append(n)
                    ids.append(order)
                    counts.append([got[t] for t in order])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lengths, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], names=["doc_id", "n", "terms", "tfs"])

    return run


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


class Shard:
    """Documents, ascending by id (those without one last), with a forward index and a list for each term sorted by impact."""

    def __init__(self, ids: pa.Array, n: np.ndarray, sizes: np.ndarray, term: np.ndarray, tf: np.ndarray, vocabulary: int, total: int, length: int):
        order = pc.sort_indices(ids, null_placement="at_end").to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.ids, doc = ids.take(pa.array(order)), place[np.repeat(np.arange(len(sizes)), sizes)]
        m = 25 + 75 * n.astype(object) * total // length if int(n.max(initial=0)) * 75 * total >= 1 << 63 else 25 + 75 * n * total // length
        m = m.astype(np.int64)[order]
        impact = (_GRAIN * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 8 * m[doc])
        self.vocabulary = vocabulary
        forward = np.lexsort((term, doc))
        self.keys, self.impacts = doc[forward] * vocabulary + term[forward], impact[forward]
        lists = np.lexsort((doc, -impact, term))
        self.docs, self.falling = doc[lists], impact[lists]
        self.starts = np.searchsorted(term[lists], np.arange(vocabulary + 1))

    def scores(self, docs: np.ndarray, term: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Full scores, by a lookup in the forward index for each document and term."""
        keys = docs[:, None] * self.vocabulary + term[None]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.impacts[at], 0) @ weights

    def search(self, term: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the best k documents with a score above 0, ties by place."""
        held = (weights > 0) & (self.starts[term + 1] > self.starts[term])
        read, by = term[held], weights[held]
        at, end = self.starts[read].copy(), self.starts[read + 1]
        seen, step = np.zeros(len(self.ids), bool), STEP
        best = score = np.zeros(0, np.int64)
        while (at < end).any():
            met = np.zeros(len(seen), bool)
            for a, b in zip(at, end, strict=True):
                met[self.docs[a : min(a + step, b)]] = True
            new = np.flatnonzero(met & ~seen)
            seen |= met
            best, score = np.concatenate([best, new]), np.concatenate([score, self.scores(new, read, by)])
            order = np.lexsort((best, -score))[:k]
            best, score = best[order], score[order]
            at, step = np.minimum(at + step, end), 2 * step
            # The last entry read of each list bounds all that follow; a list at its end has none.
            threshold = int(np.where(at < end, self.falling[at - 1], 0) @ by)
            if len(best) == k and threshold < score[-1]:
                break
        ok = score > 0
        return best[ok], score[ok]


def _searched(asked: Broadcast, vocabulary: int, total: int, length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs, postings = [], 0, 0

        def shard() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            part = t.column("terms").combine_chunks()
            s = Shard(t.column("doc_id").combine_chunks(), t.column("n").to_numpy(), np.diff(part.offsets.to_numpy()), part.flatten().to_numpy(), t.column("tfs").combine_chunks().flatten().to_numpy(), vocabulary, total, length)
            for item, term, weights in asked.value:
                best, score = s.search(term, weights, k)
                if len(best):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), item, np.int64)), s.ids.take(pa.array(best)), pa.array(score)], names=["item", "doc_id", "score"])

        for batch in batches:
            sizes = pc.list_value_length(batch.column("terms")).to_numpy()
            at = 0
            while at < batch.num_rows:
                room = int(np.searchsorted(postings + np.cumsum(sizes[at:]), POSTINGS, "right"))
                to = min(batch.num_rows, at + DOCS - docs, at + max(room, 0 if docs else 1))
                if to > at:
                    held.append(batch.slice(at, to - at))
                    docs, postings = docs + to - at, postings + int(sizes[at:to].sum())
                if to < batch.num_rows:
                    yield from shard()
                    held, docs, postings = [], 0, 0
                at = to
        if held:
            yield from shard()

    return run


def _blocks(items: DataFrame) -> Iterator[list]:
    """Items in blocks of at most ITEMS rows and, but for one longer item, CHARS characters; one block at a time is on the driver."""
    block, chars = [], 0
    for r in items.toLocalIterator():
        n = len(r["text"])
        if block and (len(block) == ITEMS or chars + n > CHARS):
            yield block
            block, chars = [], 0
        block.append(r)
        chars += n
    if block:
        yield block


def rank(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item its k highest-scoring documents with a score above 0, ties by doc_id.

    Null and empty texts have no terms: such documents are found by no item, and such items find none. Repeated rows are documents,
    or items, of their own, and ranks stay unique for each row of items; a null doc_id ranks after others of its score. Empty tables
    give no rows; other columns are not read. Each block of items is one pass over the texts and one over its index.
    """
    spark = docs.sparkSession
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for block in _blocks(asked):
        found = _block(texts, block, k)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


def _block(texts: DataFrame, block: list, k: int) -> DataFrame:
    spark = texts.sparkSession
    wanted = [Counter(w for part in terms(r["text"].encode()) for w in part) for r in block]
    number = {t: i for i, t in enumerate(sorted(set().union(*wanted)))}
    known = spark.sparkContext.broadcast(number)
    index = cut(texts.mapInArrow(_indexed(known), _INDEX), "index")
    total, length = index.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    df = {r["t"]: r["df"] for r in index.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect()}  # a row for each term of the block
    held = [(i, sorted((number[t], times) for t, times in w.items() if number[t] in df)) for i, w in enumerate(wanted)]
    search = [(i, np.array([t for t, _ in ts]), np.array([weight(total, df[t]) * times for t, times in ts], np.int64)) for i, ts in held if ts]
    lists = spark.sparkContext.broadcast(search)
    found = cut(index.where(F.size("terms") > 0).mapInArrow(_searched(lists, max(1, len(number)), total or 0, max(1, length or 0), k), "item long, doc_id long, score long"), "found")
    drop(index)
    known.destroy()
    lists.destroy()
    by = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)  # Spark cuts each task's part to k rows first
    ids = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(block)], "item long, item_id long")
    return ranked.join(F.broadcast(ids), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")  # ITEMS rows at most
