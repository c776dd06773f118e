"""Helpers for work on groups of rows: whole groups from sorted partitions, pairs within groups, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterfold.llm.common import materialised
from meterfold.llm.ragged import spread


def group_starts(table: pa.Table | pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Where a new group begins, in rows that are sorted by keys."""
    new = np.zeros(table.num_rows, dtype=bool)
    if table.num_rows:
        new[0] = True
    for k in keys:
        values = table.column(k).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column(k).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from the batches of a partition sorted by keys; only a group in progress is held back."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = group_starts(batch, keys)
        first = tuple(batch.column(k)[0].as_py() for k in keys)
        if last is not None and first != last and held:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        cut = int(starts[-1])
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
            held = []
        held.append(batch.slice(cut))
        last = tuple(batch.column(k)[-1].as_py() for k in keys)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def partner_ranges(starts: np.ndarray, side: np.ndarray, crossed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the rows that it is paired with, as [low, high), in groups sorted by side.

    Where a group crosses two blocks, a row of side 1 meets each of side 0, which may be none; elsewhere a group is one
    block, in which each row meets those before it.
    """
    n = len(side)
    sizes = np.diff(np.append(starts, n))
    first = np.repeat(starts, sizes)
    zeros = np.repeat(np.add.reduceat((side == 0).astype(np.int64), starts), sizes) if n else first
    return first, np.where(crossed, np.where(side == 1, first + zeros, first), np.arange(n))


def pair_chunks(low: np.ndarray, high: np.ndarray, limit: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs (row, partner), about limit at a time, in the order of rows."""
    rows = np.flatnonzero(high > low)
    counts = (high - low)[rows]
    upto, at = np.cumsum(counts), 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + limit, side="right")))
        yield np.repeat(rows[at:to], counts[at:to]), spread(low[rows[at:to]], counts[at:to])
        at = to


def join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after each a[i] is joined with b[i]: the smallest place in its component."""
    while len(a):
        x, y = labels[a], labels[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        if not len(a):
            break
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            further = labels[labels]
            if (further == labels).all():
                break
            labels = further
    return labels


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """node and its component's smallest node, for each node of edges (u, v), by alternating large and small stars.

    Each round is two grouped aggregations and joins over the edges, written to the shared folder; the number of edges
    never grows, and rounds grow with the logarithm of a component's diameter. It ends when nothing changes any more, and
    raises an error if that takes more than so many rounds, rather than to return parts of components.
    """
    links = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links, before = materialised(links, "links"), None
    for _ in range(rounds):
        seen = links.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        if (seen.n, seen.h) == before:
            break
        before = seen.n, seen.h
        if not seen.n:
            break
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written first, so that both sides of the join are plain exchanges, whose skewed parts Spark can split
        least = materialised(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialised(large, "large-star")
        least = materialised(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v")
        links = materialised(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "small-star")
    else:
        raise RuntimeError(f"components still changed after {rounds} rounds")
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).groupBy("node").agg(F.min("component").alias("component"))
