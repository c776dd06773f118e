"""Document quality by hierarchical empirical Bayes.

A small logistic model gives the evidence of a document itself. Grouped aggregation gathers that evidence over hosts and
over paths within hosts; each host's rate is shrunk towards the global one, and each path's towards its host's, with
prior strengths fitted from the spread between groups. A document's posterior odds are its own odds times the ratio of
its path's odds to the global ones, where its own share in the sums is taken out first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterfold.llm.common import dim_join, materialised, ship
from meterfold.llm.ragged import Pieces, Remembered, slices, sums, tidy
from meterfold.llm.words import BAR, CHARS, DIGITS, FIELDS, LETTERS, SHOUTS, SYMBOL, UPPER, word_codes, words

N_FEATURES = 10
#: Posteriors are summed as whole millionths, so that sums don't depend on the order of rows.
UNIT = 1_000_000


@dataclass(frozen=True)
class Params:
    """sample bounds the labelled rows that the document model is fitted on; group statistics cover all rows."""

    sample: int = 20_000
    steps: int = 400
    rate: float = 0.5
    ridge: float = 1e-3
    least_strength: float = 2.0
    most_strength: float = 1000.0
    clip: float = 0.02
    threshold: float = 0.5


def features(part: pa.RecordBatch, code: Remembered) -> np.ndarray:
    """Shares of symbols, capitals, digits, marks, bars and repeats, mean word length and size of each row."""
    pieces = Pieces(part.column("pieces"))
    at, index = pieces.offsets, pieces.index
    own = code(pieces.distinct).table(FIELDS).astype(np.int64)
    total = {k: sums(own[index, k], at) for k in (CHARS, UPPER, LETTERS, DIGITS, SYMBOL, SHOUTS, BAR)}
    n, chars = np.maximum(1, np.diff(at)), np.maximum(1, total[CHARS])
    rows = np.repeat(np.arange(part.num_rows), np.diff(at))
    twice = np.zeros(len(index), dtype=np.int64)
    if len(index) > 1:
        twice[1:] = (index[1:] == index[:-1]) & (rows[1:] == rows[:-1])
    distinct = np.bincount(np.unique(rows * (len(own) + 1) + index) // (len(own) + 1), minlength=part.num_rows)
    out = np.empty((part.num_rows, N_FEATURES))
    out[:, 0] = total[SYMBOL] / chars
    out[:, 1] = total[UPPER] / np.maximum(1, total[LETTERS])
    out[:, 2] = total[DIGITS] / chars
    out[:, 3] = total[SHOUTS] / n
    out[:, 4] = total[BAR] / n
    out[:, 5] = sums(twice, at) / n
    out[:, 6] = (distinct / n) * np.minimum(1, np.log1p(n) / 6)
    out[:, 7] = np.minimum(20, chars / n) / 20
    out[:, 8] = np.log1p(np.diff(at)) / 10
    out[:, 9] = np.diff(at) < 3
    return np.concatenate([out, np.sqrt(out[:, :6])], axis=1)


def fit(x: np.ndarray, y: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, scales and weights (the intercept last) of a ridge logistic model."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w, speed = np.zeros(z.shape[1]), np.zeros(z.shape[1])
    w[-1] = np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    for _ in range(p.steps):
        likely = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (likely - y) / len(y) + p.ridge * np.append(w[:-1], 0)
        speed = 0.9 * speed - p.rate * slope
        w = w + speed
    return mean, scale, w


def train(docs: DataFrame, labels: DataFrame, p: Params, key: str = "doc_id", text: str = "text", label: str = "quality"):
    """Fit on the labelled keys with the smallest hashes, p.sample at most; a key with several labels counts as bad if one is 0.

    Of rows that share a key the one with the least text counts.

    Without labels of both kinds there is no model, and every document's own evidence is even.
    """
    own = labels.select(F.col(key), F.col(label).cast("int").alias("label")).where(F.col(key).isNotNull() & F.col("label").isNotNull())
    own = own.groupBy(key).agg(F.min("label").alias("label"))
    chosen = own.orderBy(F.xxhash64(key), F.col(key)).limit(p.sample)
    rows = docs.select(key, text).join(F.broadcast(chosen), key).groupBy(key, "label").agg(F.min(text).alias("text")).select("label", words("text").alias("pieces"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Remembered(word_codes)
        for batch in batches:
            for part in slices(batch, "pieces"):
                x = features(part, code)
                flat = pa.array(x.ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([part.column("label"), lists], ["label", "x"])

    got = rows.mapInArrow(tidy(run), "label int, x array<double>").toArrow()
    y = got["label"].to_numpy().astype(float)
    if not 0 < y.sum() < len(y):
        return None
    x = np.array(got["x"].combine_chunks().flatten().to_numpy()).reshape(len(y), -1)
    order = np.lexsort([*x.T, y])
    return fit(x[order], y[order], p)


def evidence(docs: DataFrame, model, keys: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's key, group columns and own: the model's probability of good quality, in millionths. A null text counts as empty."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, model = Remembered(word_codes), shared.value
        for batch in batches:
            for part in slices(batch, "pieces"):
                if model is None:
                    likely = np.full(part.num_rows, 0.5)
                else:
                    mean, scale, w = model
                    z = (features(part, code) - mean) / scale @ w[:-1] + w[-1]
                    likely = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                own = np.clip(np.rint(likely * UNIT), 1, UNIT - 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("key"), *(part.column(k) for k in names), pa.array(own)], ["key", *names, "own"])

    names = [f"group_{k}" for k in range(len(keys))]
    groups = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(n) for k, n in zip(keys, names, strict=True)]
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), *groups, words(text).alias("pieces"))
    schema = ", ".join([f"key {kind}", *(f"{n} string" for n in names), "own long"])
    return rows.mapInArrow(tidy(run), schema)


def posteriors(docs: DataFrame, p: Params) -> DataFrame:
    """docs, as evidence() returns them for (host, path), with the rate of their path without their own share, and posterior.

    host_rate = (strength * global + sum) / (strength + n) over the host, path_rate likewise with host_rate as its prior.
    """
    paths = docs.groupBy("group_0", "group_1").agg(F.count("*").alias("n_path"), F.sum("own").alias("s_path"))
    hosts = paths.groupBy("group_0").agg(F.sum("n_path").alias("n_host"), F.sum("s_path").alias("s_host"))
    paths, hosts = materialised(paths, "paths"), materialised(hosts, "hosts")
    whole = hosts.agg(F.sum("n_host").alias("n"), F.sum("s_host").alias("s")).first()
    mean = min(max(whole.s / whole.n / UNIT, p.clip), 1 - p.clip) if whole.n else 0.5

    def strength(groups: DataFrame, n: str, s: str) -> float:
        """Between-group variance by moments; where groups differ no more than chance the prior is as strong as allowed."""
        rate = F.col(s) / F.col(n) / UNIT
        x = groups.agg(F.sum(n).alias("n"), F.count("*").alias("k"), F.sum(F.col(n) * (rate - mean) * (rate - mean)).alias("d"), F.sum(F.col(n).cast("double") * F.col(n)).alias("nn")).first()
        if not x.n or x.k < 2 or x.n * x.n <= x.nn:
            return p.most_strength
        within = mean * (1 - mean)
        between = (x.d - (x.k - 1) * within) / (x.n - x.nn / x.n)
        return p.most_strength if between <= 0 else round(min(max(within / between - 1, p.least_strength), p.most_strength), 3)

    k_host, k_path = strength(hosts, "n_host", "s_host"), strength(paths, "n_path", "s_path")
    groups = materialised(paths.join(hosts, "group_0"), "groups")
    joined = dim_join(docs, groups, ["group_0", "group_1"])
    own = F.col("own") / UNIT
    host = (k_host * mean + F.col("s_host") / UNIT - own) / (k_host + F.col("n_host") - 1)
    path = (k_path * F.col("host_rate") + F.col("s_path") / UNIT - own) / (k_path + F.col("n_path") - 1)
    odds = lambda x: x / (1 - x)
    bounded = F.greatest(F.lit(p.clip), F.least(F.lit(1 - p.clip), F.col("path_rate")))
    joined = joined.withColumn("own_p", own).withColumn("host_rate", host).withColumn("path_rate", path)
    joined = joined.withColumn("odds", odds(F.col("own_p")) * odds(bounded) / (mean / (1 - mean)))
    return joined.withColumn("posterior", F.col("odds") / (1 + F.col("odds")))


def quality(docs: DataFrame, labels: DataFrame, p: Params = Params(), host: str = "source", path: str = "lang", key: tuple[DataFrame, str] | None = None) -> DataFrame:
    """Every document's own evidence, host and path rates, posterior and kept (posterior >= p.threshold).

    A null host or path is the group ''; repeated rows count as often as they occur and get equal results; a document
    alone on its host gets the global prior. Other columns aren't carried. key: docs with a column that tells rows
    apart better than doc_id, and its name; its values then stand under doc_id.
    """
    ship(docs.sparkSession)
    keyed, name = key or (docs, "doc_id")
    own = materialised(evidence(keyed, train(docs, labels, p), [host, path], name), "evidence")
    out = posteriors(own, p)
    return out.select(F.col("key").alias("doc_id"), F.col("own_p").alias("evidence"), "host_rate", "path_rate", "posterior", (F.col("posterior") >= p.threshold).alias("kept"))
