"""Ranked lexical search of a query set by branch and bound over document FP-trees.

Every whole text becomes a vector of the query terms that it holds. A task sorts its vectors, most frequent term first, so
that documents that begin alike share a path of a trie; a subtree is a run of neighbours. The largest term frequencies and
the smallest length norm in a subtree bound the score of every document below it, and the search of an item goes down only
where that bound reaches the item's k-th best score so far. Each task returns its own best k of an item, and the best of
these are the result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterfold.llm.common import materialised, ship, text_or_empty, whole_numbers
from meterfold.llm.ragged import gathered, offsets_of, spread, tidy

#: A term is a run of digits, letters and characters beyond ASCII; only A-Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same for the bytes of UTF-8, in which all bytes beyond ASCII are parts of terms: others become spaces.
BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
#: Fixed values of the score.
ONE, TF_PART, M_PART = 1_000_000_000, 1000, 8


@dataclass(frozen=True)
class Params:
    """k: documents an item. block_terms: terms of the items that one pass over the documents looks for; more items take more passes."""

    k: int = 10
    block_terms: int = 100_000
    chunk_entries: int = 2_000_000
    leaf: int = 32
    #: Bytes of a text that are cut into terms at a time.
    piece: int = 4 << 20


def terms_of(text: str) -> Column:
    return F.regexp_extract_all(F.translate(text_or_empty(text), UPPER, LOWER), F.lit(TERM), F.lit(0))


def term_counts(data: bytes, piece: int) -> Counter:
    """How often each term occurs in a text, piece by piece so that a long text's terms are never all held."""
    out, at = Counter(), 0
    while at < len(data):
        part = data[at : at + piece].translate(BYTES)
        cut = len(part) if at + piece >= len(data) else part.rfind(b" ") + 1
        if not cut:  # a term longer than a piece
            whole = data[at:].translate(BYTES)
            cut = whole.find(b" ") + 1 or len(whole)
            part = whole
        out.update(part[:cut].split())
        at += cut
    return out


def vectors(docs: DataFrame, numbers: dict[bytes, int], p: Params, key: str, text: str) -> DataFrame:
    """key, n (all its terms with repeats), and of the numbered terms that it holds ids and tfs, for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbered = shared.value
        for batch in batches:
            n, ids, tfs = [], [], []
            for data in batch.column("data"):
                counts = term_counts(data.as_py(), p.piece)
                n.append(counts.total())
                held = [(numbered[t], c) for t, c in counts.items() if t in numbered]
                ids.append([t for t, _ in held])
                tfs.append([c for _, c in held])
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(n, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], ["key", "n", "ids", "tfs"])

    rows = docs.select(F.col(key).cast("long").alias("key"), text_or_empty(text).cast("binary").alias("data"))
    return rows.mapInArrow(tidy(run), "key long, n long, ids array<int>, tfs array<long>")


@dataclass(frozen=True)
class Items:
    """Terms of items end to end, by their place in the order of falling document frequency, and each term's weight."""

    terms: np.ndarray
    offsets: np.ndarray
    weights: np.ndarray

    def scores(self, tf: np.ndarray, m: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Score of each row of term frequencies for each of the items."""
        lengths = np.diff(self.offsets)[items]
        own = self.terms[spread(self.offsets[:-1][items], lengths)]
        x = tf[:, own]
        value = self.weights[own] * ((ONE * x) // (TF_PART * x + M_PART * m[:, None]))
        return np.add.reduceat(value, offsets_of(lengths)[:-1], axis=1)


class Best:
    """The k best documents of each item so far: scores falling, equal ones by rising key, null keys last."""

    def __init__(self, n_items: int, k: int):
        self.k, self.held = k, [[] for _ in range(n_items)]
        self.least = np.ones(n_items, dtype=np.int64)

    def add(self, item: int, scores: list[int], keys: list[int | None]) -> None:
        rows = self.held[item] + [(-s, d is None, d or 0) for s, d in zip(scores, keys, strict=True)]
        self.held[item] = rows = sorted(rows)[: self.k]
        if len(rows) == self.k:
            self.least[item] = -rows[-1][0]


class Tree:
    """Documents sorted by their terms. A node is the run of those whose first terms are alike; its children follow from where neighbours part."""

    def __init__(self, ids: np.ndarray, tfs: np.ndarray, offsets: np.ndarray, m: np.ndarray, keys: list[int | None], n_terms: int):
        rows = np.repeat(np.arange(len(m)), np.diff(offsets))
        by = np.lexsort((ids, rows))
        ids, tfs = ids[by], tfs[by]
        path = ids.astype(">u4").tobytes()
        order = np.array(sorted(range(len(m)), key=lambda i: path[4 * offsets[i] : 4 * offsets[i + 1]]), dtype=np.int64)
        lengths = np.diff(offsets)[order]
        at = spread(offsets[:-1][order], lengths)
        self.ids, self.tfs, self.offsets = ids[at], tfs[at], offsets_of(lengths)
        self.m, self.keys, self.n_terms = m[order], [keys[i] for i in order], n_terms
        both = np.minimum(lengths[:-1], lengths[1:])
        parts = offsets_of(both)
        differs = self.ids[spread(self.offsets[:-2], both)] != self.ids[spread(self.offsets[1:-1], both)]
        place = np.where(differs, np.arange(len(differs)) - np.repeat(parts[:-1], both), np.iinfo(np.int64).max)
        #: alike[i]: so many first terms document i shares with the one before it.
        self.alike = np.zeros(len(m), dtype=np.int64)
        if len(place):
            # every document has a term, so that no list is empty
            self.alike[1:] = np.minimum(np.minimum.reduceat(place, parts[:-1]), both)

    def children(self, lo: int, hi: int, leaf: int) -> list[tuple[int, int]]:
        """Subtrees of a node; small ones next to each other count as one, up to leaf documents."""
        inner = self.alike[lo + 1 : hi]
        cuts = [*(lo + 1 + np.flatnonzero(inner == inner.min())).tolist(), hi]
        out, start, last = [], lo, lo
        for cut in cuts:
            if cut - start > leaf and last > start:
                out.append((start, last))
                start = last
            last = cut
        out.append((start, hi))
        return out

    def entries(self, lo: int, hi: int) -> slice:
        return slice(int(self.offsets[lo]), int(self.offsets[hi]))

    def maxima(self, lo: int, hi: int) -> np.ndarray:
        own, out = self.entries(lo, hi), np.zeros((1, self.n_terms), dtype=np.int64)
        np.maximum.at(out[0], self.ids[own], self.tfs[own])
        return out

    def dense(self, lo: int, hi: int) -> np.ndarray:
        own, out = self.entries(lo, hi), np.zeros((hi - lo, self.n_terms), dtype=np.int64)
        out[np.repeat(np.arange(hi - lo), np.diff(self.offsets[lo : hi + 1])), self.ids[own]] = self.tfs[own]
        return out

    def search(self, items: Items, best: Best, leaf: int) -> None:
        stack = [(0, len(self.m), np.arange(len(items.offsets) - 1))]
        while stack:
            lo, hi, alive = stack.pop()
            bound = items.scores(self.maxima(lo, hi), self.m[lo:hi].min(keepdims=True), alive)[0]
            alive = alive[bound >= best.least[alive]]
            if not len(alive):
                continue
            if hi - lo > leaf:
                stack.extend((*child, alive) for child in reversed(self.children(lo, hi, leaf)))
                continue
            scores = items.scores(self.dense(lo, hi), self.m[lo:hi], alive)
            hit = scores >= best.least[alive]
            for j in np.flatnonzero(hit.any(axis=0)):
                found = np.flatnonzero(hit[:, j])
                best.add(int(alive[j]), scores[found, j].tolist(), [self.keys[lo + i] for i in found])


def norms(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """m of documents with so many terms each."""
    return 100 - 90 + (90 * n * documents) // terms


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _block(docs: DataFrame, rows: list, p: Params, key: str, text: str) -> DataFrame:
    """item (its number), doc_id and score: the best of each task for the items whose (number, term) pairs are given."""
    spark = docs.sparkSession
    numbers = {t: i for i, t in enumerate(sorted({r.term.encode("utf-8") for r in rows}))}
    held = materialised(vectors(docs, numbers, p, key, text), "vectors")
    total = held.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    counted = held.select(F.explode("ids").alias("id")).groupBy("id").count().collect()
    df = np.zeros(len(numbers), dtype=np.int64)
    for r in counted:
        df[r.id] = r["count"]
    place = np.empty(len(df), dtype=np.int64)
    place[np.lexsort((np.arange(len(df)), -df))] = np.arange(len(df))
    weights = np.zeros(len(df), dtype=np.int64)
    weights[place] = [weight(total.documents, int(n)) for n in df]
    order = sorted(((r.item, int(place[numbers[r.term.encode("utf-8")]])) for r in rows))
    names = sorted({i for i, _ in order})
    lengths = Counter(i for i, _ in order)
    items = Items(np.array([t for _, t in order], dtype=np.int64), offsets_of(np.array([lengths[i] for i in names])), weights)
    shared = spark.sparkContext.broadcast((items, place, names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, place, names = shared.value
        best = Best(len(names), p.k)
        for batch in gathered(batches, "ids", p.chunk_entries):
            ids, tfs = batch.column("ids"), batch.column("tfs")
            offsets = ids.offsets.to_numpy().astype(np.int64)
            m = norms(batch.column("n").to_numpy(), total.documents, total.terms)
            flat = place[ids.flatten().to_numpy()]
            Tree(flat, tfs.flatten().to_numpy(), offsets - offsets[0], m, batch.column("key").to_pylist(), len(place)).search(items, best, p.leaf)
        out = [(names[i], None if none else d, -s) for i, rows in enumerate(best.held) for s, none, d in rows]
        item, doc, score = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    return held.where(F.size("ids") > 0).mapInArrow(tidy(run), "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, p: Params = Params(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score of each item's p.k best documents with a score above 0.

    Equal scores go by rising doc_id, null ones last; rows that repeat an id are documents of their own, told apart by
    their ranks only. Items that repeat an id are one item with the terms of all; one without terms, or whose terms no
    document holds, has no rows. Null texts are empty. doc_id must be whole numbers; other columns aren't carried. The
    items' terms go to the driver and all tasks, p.block_terms at a time (an item with more is a block of its own), so
    that a larger query set takes more passes, not more memory.
    """
    ship(docs.sparkSession)
    whole_numbers(docs, key)
    own = items.select(F.col("item_id"), F.explode(F.array_distinct(terms_of("text"))).alias("term")).distinct()
    sizes = own.groupBy("item_id").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy(F.col("item_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1))
    number = F.row_number().over(Window.orderBy(F.col("item_id").asc_nulls_first())).cast("long")
    blocks = materialised(sizes.withColumn("block", F.floor(F.coalesce(upto, F.lit(0)) / p.block_terms)).withColumn("item", number), "items")
    numbered = own.join(blocks, own.item_id.eqNullSafe(blocks.item_id)).select("block", "item", "term")
    numbered = materialised(numbered, "terms")
    found = None
    for b in [r.block for r in blocks.select("block").distinct().orderBy("block").collect()]:
        part = _block(docs, numbered.where(F.col("block") == b).select("item", "term").collect(), p, key, text)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "item long, doc_id long, score long")
    ranked = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    best = found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= p.k)
    return best.join(F.broadcast(blocks.select("item", "item_id")) if blocks.count() <= 200_000 else blocks.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
