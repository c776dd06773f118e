"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint is cut into blocks. Two that differ in at most `distance` bits agree in all but so many blocks, so a row for
each choice of the blocks that agree brings every close pair together under one key; distinct fingerprints under a key are
compared bit by bit. No step writes the pairs: a task returns edges that span what it has found connected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterfold.llm.common import dim_join, materialised, ship, text_or_empty, whole_numbers
from meterfold.llm.groups import components, group_starts, join_labels, pair_chunks, partner_ranges, whole_groups
from meterfold.llm.ragged import tidy


@dataclass(frozen=True)
class Params:
    """With 5 blocks and 3 bits, 2 blocks agree: 10 keys a fingerprint, of 25 or 26 bits. More blocks give more, longer keys."""

    width: int = 3
    distance: int = 3
    blocks: int = 5
    seed: int = 42
    block_rows: int = 2048
    #: Shingles whose bits are counted at a time, and bytes of a text that are cut into words at a time.
    shingles: int = 100_000
    piece: int = 4 << 20


def words_of(data: bytes, piece: int) -> Iterator[list[bytes]]:
    """Words of a text in lists, in order; bytes.lower and bytes.split know ASCII only, which is what words are told by here."""
    at = 0
    while at < len(data):
        if at + piece >= len(data):
            yield data[at:].lower().split()
            return
        end = at + piece
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield data[at:end].lower().split()
        at = end


def fingerprint(data: bytes, p: Params) -> int:
    """Bit i is 1 if it is so in over half the hashes of the text's shingles; 0 for a text without words."""
    digest = partial(xxhash.xxh64_digest, seed=p.seed)
    ones, n, carried = np.zeros(64, dtype=np.int64), 0, []
    for part in words_of(data, p.piece):
        words = carried + part
        carried = words[max(0, len(words) - p.width + 1) :]
        for at in range(0, len(words) - p.width + 1, p.shingles):
            own = words[at : at + p.shingles + p.width - 1]
            hashes = b"".join(map(digest, map(b" ".join, zip(*(own[k:] for k in range(p.width)), strict=False))))
            bits = np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8), axis=1)
            ones += bits.sum(axis=0, dtype=np.int64)
            n += len(bits)
    if not n and carried:
        ones, n = np.unpackbits(np.frombuffer(digest(b" ".join(carried)), dtype=np.uint8)).astype(np.int64), 1
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, p: Params = Params(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and fingerprint (its bits as a signed long) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [fingerprint(data.as_py(), p) for data in batch.column("data")]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(own, pa.int64())], ["key", "fingerprint"])

    whole_numbers(docs, key)
    rows = docs.select(F.col(key).cast("long").alias("key"), text_or_empty(text).cast("binary").alias("data"))
    return rows.mapInArrow(tidy(run), "key long, fingerprint long")


def block_keys(fingerprint: Column, p: Params) -> list[Column]:
    """A key for each choice of blocks that agree: their bits after the number of the choice."""
    ends = [64 * k // p.blocks for k in range(p.blocks + 1)]
    parts = [(F.shiftrightunsigned(fingerprint, lo).bitwiseAND(F.lit((1 << hi - lo) - 1)), hi - lo) for lo, hi in zip(ends, ends[1:], strict=False)]
    out = []
    for number, chosen in enumerate(combinations(parts, p.blocks - p.distance)):
        one = F.lit(number).cast("long")
        for bits, size in chosen:
            one = F.shiftleft(one, size).bitwiseOR(bits)
        out.append(one)
    return out


def close_edges(nodes: DataFrame, p: Params) -> DataFrame:
    """Edges (u, v) that span what links of at most p.distance bits connect, among distinct fingerprints (node).

    A key with many fingerprints is cut into blocks, and a task compares two of these.
    """
    rows = nodes.select("node", F.explode(F.array(*block_keys(F.col("node"), p))).alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
    members = rows.join(shared, "bucket").withColumn("n_blocks", F.ceil(F.col("m") / p.block_rows))
    members = members.withColumn("own", F.pmod(F.xxhash64("node"), F.col("n_blocks")))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
    keys = ["bucket", "one", "two"]
    dealt = members.select("bucket", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node")
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys, "side", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys):
            starts = group_starts(table, keys)
            node = table.column("node").to_numpy()
            crossed = table.column("one").to_numpy() != table.column("two").to_numpy()
            labels = np.arange(len(node))
            for a, b in pair_chunks(*partner_ranges(starts, table.column("side").to_numpy(), crossed)):
                apart = labels[a] != labels[b]
                a, b = a[apart], b[apart]
                near = np.bitwise_count((node[a] ^ node[b]).view(np.uint64)) <= p.distance
                labels = join_labels(labels, a[near], b[near])
            linked = np.flatnonzero(labels != np.arange(len(node)))
            yield pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[labels[linked]])], ["u", "v"])

    return dealt.mapInArrow(tidy(run), "u long, v long")


def near_duplicates(docs: DataFrame, p: Params = Params(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id that links reach, of every document.

    Documents link whose fingerprints differ in at most p.distance bits; equal ones do, so copies and rows that repeat an
    id are links like others, and all texts without words are one component with any text whose fingerprint is near zero.
    A null text counts as empty. A null doc_id is smaller than none, and a component of only such has a null one. doc_id
    must be whole numbers; other columns aren't carried.
    """
    ship(docs.sparkSession)
    signed = materialised(fingerprints(docs, p, key, text), "fingerprints")
    nodes = materialised(signed.groupBy(F.col("fingerprint").alias("node")).agg(F.min("key").alias("least"), F.count("*").alias("copies")), "nodes")
    linked = materialised(components(close_edges(nodes, p)), "components")
    joined = nodes.join(linked, "node")
    smallest = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    several = joined.join(smallest, "component").select("node", "component_id")
    alone = nodes.where("copies > 1").join(linked, "node", "left_anti").select("node", F.col("least").alias("component_id"))
    found = materialised(several.unionByName(alone).withColumnRenamed("node", "fingerprint"), "found")
    # what isn't found has a fingerprint of its own
    out = dim_join(signed, found.withColumn("shared", F.lit(True)), ["fingerprint"])
    return out.select(F.col("key").alias("doc_id"), F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), F.when(F.col("shared"), F.col("component_id")).otherwise(F.col("key")).alias("component_id"))
