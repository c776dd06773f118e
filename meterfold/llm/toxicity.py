"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic examples are the positives; any other text is unlabelled, as most texts were never looked at. The risk
of a linear model is estimated from both with the class prior pi: pi * R_p(+) + max(0, R_u(-) - pi * R_p(-)), and a step
that would push the second part below zero is taken back instead, so that the model can't learn to call each unlabelled
text clean. Features are the presence of hashed words and word beginnings; a soft threshold keeps the weights sparse.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterfold.llm.common import materialised, ship, text_or_empty
from meterfold.llm.ragged import Pieces, Remembered, offsets_of, slices, spread, sums, tidy

BUCKETS = 1 << 18


@dataclass(frozen=True)
class Params:
    """positives, unlabelled and cells bound what the model is fitted on: rows of each kind, and distinct buckets of all rows of a kind; all else covers all rows.

    The soft threshold is sparsity over the root of the number of positives, as chance slopes are.
    """

    positives: int = 4000
    unlabelled: int = 10_000
    cells: int = 12_000_000
    beginning: int = 5
    steps: int = 150
    rate: float = 1.0
    momentum: float = 0.9
    sparsity: float = 0.06
    rarest: float = 0.002
    commonest: float = 0.5
    folds: int = 5


def held_out(key: Column, folds: int = 5) -> Column:
    """Whether a row is in the fold from which no label is learned."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == 0, F.lit(False))


def _words(text: str) -> Column:
    return F.regexp_extract_all(F.lower(text_or_empty(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _hashes(beginning: int) -> Remembered:
    def encode(words: list[str]) -> list[bytes]:
        out = []
        for w in words:
            code = [zlib.crc32(w.encode()) % BUCKETS]
            if len(w) >= beginning:
                code.append(zlib.crc32(f"^{w[:beginning]}".encode()) % BUCKETS)
            out.append(np.array(code, dtype="<u4").tobytes())
        return out

    return Remembered(encode)


def _features(part: pa.RecordBatch, hashes: Remembered) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct buckets, and the rows' offsets into them."""
    pieces = Pieces(part.column("pieces"))
    buckets, offsets = pieces.coded(hashes(pieces.distinct))
    rows = np.repeat(np.arange(part.num_rows), np.diff(offsets))
    seen = np.unique(rows * BUCKETS + buckets)
    return seen % BUCKETS, offsets_of(np.bincount(seen // BUCKETS, minlength=part.num_rows))


def risk(z: np.ndarray, n_p: int, prior: float) -> tuple[float, float]:
    """Both parts of the logistic risk of scores z, the first n_p of positives: prior * R_p(+) and R_u(-) - prior * R_p(-), which may not fall below zero."""
    as_positive, as_negative = np.logaddexp(0, -z), np.logaddexp(0, z)
    return prior * as_positive[:n_p].mean(), as_negative[n_p:].mean() - prior * as_negative[:n_p].mean()


def risk_slope(z: np.ndarray, n_p: int, prior: float) -> np.ndarray:
    """How a step treats each score: by the slope of the whole risk, or against that of its second part where this is below zero."""
    n_u = len(z) - n_p
    likely = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    slope = np.empty(len(z))
    if risk(z, n_p, prior)[1] >= 0:
        slope[:n_p], slope[n_p:] = -prior / n_p, likely[n_p:] / n_u
    else:
        slope[:n_p], slope[n_p:] = prior * likely[:n_p] / n_p, -likely[n_p:] / n_u
    return slope


def fit(positive: tuple[np.ndarray, np.ndarray], unlabelled: tuple[np.ndarray, np.ndarray], prior: float, p: Params) -> tuple[np.ndarray, float]:
    """Weights and intercept from (buckets, offsets) of positive and unlabelled rows."""
    n_p = len(positive[1]) - 1
    n = n_p + len(unlabelled[1]) - 1
    buckets = np.concatenate([positive[0], unlabelled[0]])
    rows = np.repeat(np.arange(n, dtype=np.int32), np.concatenate([np.diff(positive[1]), np.diff(unlabelled[1])]))
    seen = np.bincount(buckets, minlength=BUCKETS)
    used = (seen >= max(2, p.rarest * n)) & (seen <= p.commonest * n)
    rows, columns = rows[used[buckets]], (np.cumsum(used, dtype=np.int32) - 1)[buckets[used[buckets]]]
    size = int(used.sum())
    w, speed, b, b_speed = np.zeros(size), np.zeros(size), float(np.log(prior / max(1 - prior, 1e-9))), 0.0
    for step in range(p.steps):
        rate = p.rate * 0.5 * (1 + np.cos(np.pi * step / p.steps))
        slope = risk_slope(b + np.bincount(rows, weights=w[columns], minlength=n), n_p, prior)
        speed = p.momentum * speed - rate * np.bincount(columns, weights=slope[rows], minlength=size)
        b_speed = p.momentum * b_speed - 0.1 * rate * slope.sum()
        w, b = w + speed, b + b_speed
        w = np.sign(w) * np.maximum(np.abs(w) - rate * p.sparsity / np.sqrt(n_p), 0)
    weights = np.zeros(BUCKETS)
    weights[np.flatnonzero(used)] = w
    return weights, b


def train(docs: DataFrame, labels: DataFrame, p: Params, key: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[np.ndarray, float]:
    """Fit on at most p.positives keys labelled 1 and p.unlabelled others, those with the smallest hashes, one row each.

    Labels of the held-out fold are never read; the class prior is the share of 1 among the other labels, all of them.
    A key with several labels counts as toxic if one of them is 1. Without positives every score is the class prior,
    0.0 if there are no labels either. Of rows that share a key the one with the least text counts. Rows count whole: where
    those of a kind have more than p.cells buckets in all, the last of them in the order of hashes are left out.
    """
    own = labels.select(F.col(key), F.col(label).cast("int").alias("label")).where(F.col(key).isNotNull() & F.col("label").isNotNull() & ~held_out(F.col(key), p.folds))
    own = own.groupBy(key).agg(F.max("label").alias("label"))
    shares = own.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("label") == 1).cast("long")), F.lit(0)).alias("toxic")).first()
    prior = shares.toxic / shares.n if shares.n else 0.0
    constant = np.zeros(BUCKETS), float(np.log(max(prior, 1e-9) / max(1 - prior, 1e-9)))
    if not shares.toxic:
        return constant
    order = F.xxhash64(key), F.col(key)
    chosen = own.where("label = 1").select(key).orderBy(*order).limit(p.positives).select(key, F.lit(True).alias("positive"))
    others = docs.where(F.col(key).isNotNull() & ~held_out(F.col(key), p.folds)).select(key).distinct().orderBy(*order).limit(p.unlabelled).select(key, F.lit(False).alias("positive"))
    rows = docs.select(key, text).join(F.broadcast(chosen.unionByName(others)), key).groupBy(key, "positive").agg(F.min(text).alias("text"))
    rows = rows.select("positive", F.xxhash64(key).alias("hash"), _words("text").alias("pieces"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _hashes(p.beginning)
        for batch in batches:
            for part in slices(batch, "pieces"):
                buckets, offsets = _features(part, hashes)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(buckets.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("positive"), part.column("hash"), lists], ["positive", "hash", "buckets"])

    held = materialised(rows.mapInArrow(tidy(run), "positive boolean, hash long, buckets array<int>"), "training")
    upto = F.sum(F.size("buckets")).over(Window.partitionBy("positive").orderBy("hash"))
    last = held.select("positive", "hash", upto.alias("upto")).where(F.col("upto") <= p.cells).groupBy("positive").agg(F.max("hash").alias("last"))
    got = held.join(F.broadcast(last), "positive").where(F.col("hash") <= F.col("last")).orderBy("positive", "hash").select("positive", "buckets").toArrow().combine_chunks()
    sides = []
    for side in (True, False):
        lists = got.filter(pa.compute.equal(got["positive"], side))["buckets"].combine_chunks()
        sides.append((lists.flatten().to_numpy(zero_copy_only=False), offsets_of(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))))
    del got
    return fit(*sides, prior, p) if len(sides[0][1]) > 1 and len(sides[1][1]) > 1 else constant


def score(docs: DataFrame, model: tuple[np.ndarray, float], p: Params, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score and predicted of every whole text; a null text counts as empty, other columns aren't carried.

    A row's score follows from its text alone, so that repeated rows get equal ones. A row without key is in no fold.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _hashes(p.beginning)
        weights, intercept = shared.value
        for batch in batches:
            for part in slices(batch, "pieces"):
                buckets, offsets = _features(part, hashes)
                z = np.clip(intercept + sums(weights[buckets], offsets), -30, 30)
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(1 / (1 + np.exp(-z)))], ["key", "score"])

    kind = docs.schema[key].dataType.simpleString()
    scored = docs.select(F.col(key).alias("key"), _words(text).alias("pieces")).mapInArrow(tidy(run), f"key {kind}, score double")
    return scored.select(F.col("key").alias(key), held_out(F.col("key"), p.folds).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, by a model of labels outside the held-out fold.

    Null and empty texts get the score that follows from no words; repeated rows get equal scores; rows with a null id are
    scored and in no fold; without labels of 1 nothing is called toxic. Other columns aren't carried.
    """
    ship(docs.sparkSession)
    return score(docs, train(docs, labels, p), p)
