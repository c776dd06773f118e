"""Byte-level BPE encoding and decoding by corpus-level merge replay.

Spark splits every text into pre-tokens and counts them over the corpus, with a partial count in each task. The merges
are replayed over that vocabulary: an inverted index leads from each token pair to the positions where it stands, ranks
are taken in rising order, a rank's places are merged at once in all words, and only the two neighbours of a place get
new entries. The codes are written to Parquet, and every text is encoded against them.

What tasks get of the vocabulary is bounded: the pieces that recur most, HEAD of them at most. The others, nearly all of
which the corpus has a few times, are replayed by the same index in the task that meets them, over windows of a million
pieces. A join of all rows with the whole vocabulary would give the same ids, as a piece's codes depend on nothing else.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterfold.llm.common import materialised, ship, text_or_empty
from meterfold.llm.ragged import Pieces, Remembered, gathered, offsets_of, slices, spread, tidy

#: Pieces of the corpus vocabulary that every task gets, some 10 MB: those that recur most.
HEAD = 1 << 18
#: Pieces of the vocabulary that one replay takes, pieces of texts that a task looks at together, and that it gives out at once.
REPLAY, WINDOW, PART = 1 << 16, 1_500_000, 150_000
#: The characters with Unicode's White_Space property, for Java's regular expressions.
WHITE_SPACE = r"\t-\r\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def java_pattern(pattern: str) -> str:
    """A pre-token pattern of the rank files in Java's syntax, where \\s alone would mean ASCII only."""
    return pattern.replace(r"[^\s", f"[^{WHITE_SPACE}").replace(r"\S", f"[^{WHITE_SPACE}]").replace(r"\s", f"[{WHITE_SPACE}]")


def pre_tokens(pattern: str, text: str = "text"):
    return F.regexp_extract_all(text_or_empty(text), F.lit(java_pattern(pattern)), F.lit(0))


class MergeReplay:
    """The merges of a rank file, replayed over many byte strings at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs.append((rank, a, b))
        # a pair's number rises with the rank of what it gives, so that the pairs of a rank follow each other
        self.rank, self.left, self.right = np.array(sorted(pairs), dtype=np.int32).T.copy()
        keys = self.left.astype(np.int64) << 32 | self.right
        self.number = np.argsort(keys)
        self.keys = keys[self.number]
        size = max(ranks.values()) + 1
        self.first = np.searchsorted(self.rank, np.arange(size + 1)).tolist()
        # ranks after whose merge a pair of a lower rank may stand there, which comes before the rank's other places
        self.sinks = np.zeros(size, dtype=bool)
        for side in (self.left, self.right):
            self.sinks[side[self.rank < side]] = True
        by_id = [b""] * size
        for token, rank in ranks.items():
            by_id[rank] = token
        self.token_bytes, self.token_lengths, self.token_starts = _joined(by_id)
        self.decimals = _joined([str(k).encode() + b" " for k in range(size)])

    def encode(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece, as little-endian unsigned 32-bit integers."""
        raw = [p.encode("utf-8") for p in pieces]
        out = [self.ranks.get(r) for r in raw]
        rest = [i for i, r in enumerate(out) if r is None]
        out = [b"" if r is None else r.to_bytes(4, "little") for r in out]
        for at in range(0, len(rest), REPLAY):
            some = rest[at : at + REPLAY]
            for i, ids in zip(some, self._replay([raw[i] for i in some]), strict=True):
                out[i] = ids
        return out

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the pairs merge, and the numbers of those."""
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        there = np.flatnonzero(self.keys[at] == keys)
        return there, self.number[at[there]]

    def _replay(self, words: list[bytes]) -> list[bytes]:
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        sym = self.single[np.frombuffer(b"".join(words), dtype=np.uint8)]
        n = len(sym)
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        ends = np.cumsum(lengths)[lengths > 0]
        after[ends - 1] = -1
        before[ends - lengths[lengths > 0]] = -1
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []
        waiting: set[int] = set()

        def note(places: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
            there, numbers = self._pairs(left, right)
            if not len(there):
                return
            order = np.argsort(numbers, kind="stable")
            numbers, places = numbers[order], places[there[order]]
            cuts = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), len(numbers)]
            for pair, lo, hi in zip(numbers[cuts[:-1]].tolist(), cuts[:-1], cuts[1:], strict=True):
                held = index.get(pair)
                if held is None:
                    index[pair] = [places[lo:hi]]
                    rank = int(self.rank[pair])
                    if rank not in waiting:
                        waiting.add(rank)
                        heapq.heappush(heap, rank)
                else:
                    held.append(places[lo:hi])

        starts = np.flatnonzero(after >= 0).astype(np.int32)
        note(starts, sym[starts], sym[starts + 1])
        while heap:
            rank = heapq.heappop(heap)
            waiting.discard(rank)
            found = []
            for pair in range(self.first[rank], self.first[rank + 1]):
                places = index.pop(pair, None)
                if places is not None:
                    p = np.concatenate(places) if len(places) > 1 else places[0]
                    q = after[p]
                    p = p[(sym[p] == self.left[pair]) & (q >= 0) & (sym[q] == self.right[pair])]
                    if len(p):
                        found.append(p)
            if not found:
                continue
            p = np.unique(np.concatenate(found))
            if len(p) > 1:
                if self.sinks[rank]:  # the leftmost place of a word goes first, the others wait for what may arise there
                    first = np.concatenate([[True], word[p[1:]] != word[p[:-1]]])
                    rest = p[~first]
                    p = p[first]
                else:
                    rest = p[:0]
                    linked = np.concatenate([[False], p[1:] == after[p[:-1]]])
                    if linked.any():  # of places that overlap, each second one goes, from the left
                        k = np.arange(len(p))
                        p = p[(k - np.maximum.accumulate(np.where(linked, 0, k))) % 2 == 0]
            else:
                rest = p[:0]
            q = after[p]
            r = after[q]
            sym[p], sym[q], after[p] = rank, -1, r
            right = r >= 0
            before[r[right]] = p[right]
            left = before[p]
            has = left >= 0
            left, own, r = left[has], p[right], r[right]
            merged = np.full(len(left) + len(own), rank, dtype=np.int32)
            note(np.concatenate([left, own]), np.concatenate([sym[left], merged[: len(own)]]), np.concatenate([merged[: len(left)], sym[r]]))
            if len(rest):
                q = after[rest]
                rest, q = rest[q >= 0], q[q >= 0]
                note(rest, sym[rest], sym[q])

        alive = sym >= 0
        ids = sym[alive].astype("<u4").tobytes()
        cut = (offsets_of(np.bincount(word[alive], minlength=len(words))) * 4).tolist()
        return [ids[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids in order, and how many each has."""
        lengths = self.token_lengths[ids]
        return self.token_bytes[spread(self.token_starts[ids], lengths)], lengths


def _joined(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte strings end to end, their lengths and where each begins."""
    lengths = np.fromiter(map(len, values), dtype=np.int64, count=len(values))
    return np.frombuffer(b"".join(values), dtype=np.uint8), lengths, np.cumsum(lengths) - lengths


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def replayer(path: str) -> MergeReplay:
    return MergeReplay(read_ranks(path))


def vocabulary(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", head: int = HEAD) -> DataFrame:
    """piece and ids (binary, little-endian 32-bit) of the pieces that recur most in the corpus, replayed by hash partition.

    All pieces of all rows are counted. A histogram of the counts, eight bins a doubling, tells from which bin on there are
    head pieces at most; so no task sorts them. A null text has none.
    """
    ship(docs.sparkSession)
    counts = docs.select(F.explode(pre_tokens(pattern, text)).alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))
    counts = materialised(counts.where("n > 1").select("piece", F.floor(8 * F.log2("n")).cast("int").alias("bin")), "vocabulary")
    least, size = None, 0
    for r in sorted(counts.groupBy("bin").agg(F.count("*").alias("n")).collect(), reverse=True):
        size += r.n
        if size > head:
            break
        least = r.bin
    often = counts.where(F.col("bin") >= least).select("piece") if least is not None else counts.where("false").select("piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, held = replayer(rank_file), [pa.array([], pa.string())]
        for batch in batches:
            held.append(batch.column("piece"))
        pieces = pa.concat_arrays(held)
        yield pa.RecordBatch.from_arrays([pieces, pa.array(merges.encode(pieces.to_pylist()), pa.binary())], ["piece", "ids"])

    parts = max(1, -(-often.count() // REPLAY))
    return materialised(often.repartition(parts, "piece").mapInArrow(tidy(run), "piece string, ids binary"), "codes")


def shared_codes(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", head: int = HEAD) -> Broadcast:
    """The codes of vocabulary(), which has at most head rows, for all tasks."""
    got = vocabulary(docs, rank_file, pattern, text, head).toArrow()
    pieces = pa.concat_arrays([pa.array([], pa.string()), *got["piece"].chunks])
    ids = got["ids"].to_pylist()
    known = pieces, np.frombuffer(b"".join(ids), dtype="<u4"), np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
    return docs.sparkSession.sparkContext.broadcast(known)


def _coded(batches: Iterator[pa.RecordBatch], rank_file: str, known) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows, the ids of all of them in order, and the rows' offsets into these."""
    code = Remembered(replayer(rank_file).encode, known=known)
    for window in gathered(batches, "pieces", WINDOW):
        pieces = Pieces(window.column("pieces"))
        codes, at = code(pieces.distinct), 0
        for part in slices(window, "pieces", PART):
            yield part, *pieces.part(at, part.num_rows).coded(codes)
            at += part.num_rows


def encode(docs: DataFrame, rank_file: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Token ids of every whole text: columns key and token_ids (array<int>); other columns aren't carried.

    A null text counts as empty and has no ids. Each row is encoded for itself, so repeated rows give repeated results.
    rank_file must be readable at the same path on every executor.
    """
    known = shared_codes(docs, rank_file, pattern, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, offsets in _coded(batches, rank_file, known.value):
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column("key"), lists], ["key", "token_ids"])

    kind = docs.schema[key].dataType.simpleString()
    pieces = docs.select(F.col(key).alias("key"), pre_tokens(pattern, text).alias("pieces"))
    return pieces.mapInArrow(tidy(run), f"key {kind}, token_ids array<int>").withColumnRenamed("key", key)


def decode(encoded: DataFrame, rank_file: str, key: str = "doc_id", ids: str = "token_ids") -> DataFrame:
    """Bytes of every list of ids: columns key, ids and decoded (binary). A null list counts as empty."""
    ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = replayer(rank_file)
        for batch in batches:
            for part in slices(batch, "ids", 1_500_000):
                lists = part.column("ids")
                offsets = lists.offsets.to_numpy().astype(np.int64)
                data, lengths = merges.decode(lists.flatten().to_numpy(zero_copy_only=False))
                ends = offsets_of(lengths)[offsets - offsets[0]].astype(np.int32)
                decoded = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([part.column("key"), lists, decoded], ["key", "ids", "decoded"])

    kind = encoded.schema[key].dataType.simpleString()
    lists = encoded.select(F.col(key).alias("key"), F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("ids"))
    return lists.mapInArrow(tidy(run), f"key {kind}, ids array<int>, decoded binary").toDF(key, ids, "decoded")


def _digests(data: np.ndarray, ends: np.ndarray, less: int = 0) -> list[str]:
    """SHA-256 of each row's bytes, without the last few."""
    view = memoryview(data)
    return [hashlib.sha256(view[a : max(a, b - less)]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def round_trip(docs: DataFrame, rank_file: str, pattern: str, ids: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Digests of every document's ids and of the bytes that they decode to; ids: with the ids themselves.

    Rows as encode() takes them; encoding and decoding share one pass, so that a task needs one Python worker.
    """
    known = shared_codes(docs, rank_file, pattern, text)
    names = ["key", "n_tokens", "ids_sha256", "decoded_sha256", *(["token_ids"] if ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = replayer(rank_file)
        for part, own, offsets in _coded(batches, rank_file, known.value):
            data, lengths = merges.decode(own)
            decoded = _digests(data, offsets_of(lengths)[offsets])
            text, lengths, starts = merges.decimals
            lengths = lengths[own]
            written = _digests(text[spread(starts[own], lengths)], offsets_of(lengths)[offsets], less=1)
            out = [part.column("key"), pa.array(np.diff(offsets)), pa.array(written), pa.array(decoded)]
            if ids:
                out.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(own.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(out, names)

    kind = docs.schema[key].dataType.simpleString()
    pieces = docs.select(F.col(key).alias("key"), pre_tokens(pattern, text).alias("pieces"))
    schema = f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", token_ids array<int>" if ids else "")
    return pieces.mapInArrow(tidy(run), schema).withColumnRenamed("key", key)
