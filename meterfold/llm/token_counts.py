"""Token counts by rank-synchronous array merging.

Pre-tokens lie as ragged numpy arrays of symbols. In each round every sequence finds its lowest-rank adjacent pair and
all sequences merge theirs in the same step, at each place where it stands, from the left; only behind a place where a
pair of a lower rank arises the others wait. Sequences without a pair leave. What a sequence counts is the symbols that
survive, a character outside the vocabulary counting its UTF-8 bytes (byte fallback). Beforehand a pre-token is cut
between characters that no piece of the vocabulary holds side by side, as no merge can cross there.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterfold.llm.common import ship, text_or_empty
from meterfold.llm.ragged import Pieces, Remembered, gathered, offsets_of, sums, tidy

#: Fixed value: the mark that stands for a space in SentencePiece vocabularies.
MARK = 0x2581
NONE = np.int64(1 << 40)
#: Pre-tokens that a task looks at together.
WINDOW = 1_000_000


def marked_pieces(text: str = "text") -> Column:
    """Parts of a text that SentencePiece merges apart: each is a run of spaces and the other characters after it.

    The text gets the space that the library puts before it; an empty text has no parts. No piece of the vocabulary
    has a mark behind another character, so that no merge crosses a part's bounds.
    """
    whole = text_or_empty(text)
    parts = F.regexp_extract_all(F.concat(F.lit(" "), whole), F.lit("[ ▁]*[^ ▁]+|[ ▁]+"), F.lit(0))
    return F.when(F.length(whole) == 0, F.array().cast("array<string>")).otherwise(parts)


class PieceMerges:
    """The merges of a SentencePiece BPE model without normalisation."""

    def __init__(self, model_file: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        plain = [p for p in model.pieces if p.type == p.NORMAL]
        if model.trainer_spec.model_type != model.trainer_spec.BPE or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not (spec.add_dummy_prefix and spec.escape_whitespaces and model.trainer_spec.byte_fallback) or any(p.type in (p.USER_DEFINED, p.UNUSED) for p in model.pieces) or any(chr(MARK) in p.piece.lstrip(chr(MARK)) for p in plain):
            raise ValueError("only BPE models with byte fallback, a leading space and no normalisation are counted")
        scores = sorted({p.score for p in plain}, reverse=True)
        rank_of = {s: k for k, s in enumerate(scores)}
        rank = {p.piece: rank_of[p.score] for p in plain}
        names = {p.piece: k for k, p in enumerate(plain)}
        chars = sorted({c for p in plain for c in p.piece})
        for c in chars:
            names.setdefault(c, len(names))
        self.size = len(names)
        self.codes = np.array([ord(c) for c in chars], dtype=np.int64)
        self.code_symbols = np.array([names[c] for c in chars], dtype=np.int64)
        self.is_piece = np.zeros(self.size, dtype=bool)
        self.is_piece[: len(plain)] = True
        table = {}
        for piece in rank:
            for k in range(1, len(piece)):
                a, b = names.get(piece[:k]), names.get(piece[k:])
                if a is not None and b is not None:
                    table[a * self.size + b] = (rank[piece], names[piece])
        self.keys = np.array(sorted(table), dtype=np.int64)
        self.ranks, self.merged = np.array([table[k] for k in self.keys.tolist()], dtype=np.int64).T.copy()
        self.adjacent = np.array(sorted({names[a] * self.size + names[b] for piece in rank for a, b in zip(piece, piece[1:], strict=False)}), dtype=np.int64)
        # symbols after whose merge a pair of a lower rank may stand there
        self.sinks = np.zeros(self.size, dtype=bool)
        own = np.full(self.size, -1, dtype=np.int64)
        own[self.merged] = self.ranks
        for side in (self.keys // self.size, self.keys % self.size):
            self.sinks[side[self.ranks <= own[side]]] = True

    def lookup(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the pairs (NONE where there is no merge) and their places in the table."""
        keys = np.where((a >= 0) & (b >= 0), a * self.size + b, -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NONE), at

    def count(self, pieces: list[str]) -> np.ndarray:
        """Surviving symbols of each piece."""
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        codes = np.frombuffer("".join(pieces).encode("utf-32-le"), dtype="<u4").astype(np.int64)
        codes = np.where(codes == 0x20, MARK, codes)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        known = self.codes[at] == codes
        symbols = np.where(known, self.code_symbols[at], -1)
        cost = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
        cost = np.where(known & self.is_piece[np.maximum(symbols, 0)], 1, cost)
        out = np.zeros(len(pieces), dtype=np.int64)
        whole = np.repeat(np.arange(len(pieces)), lengths)
        if not len(whole):
            return out
        keys = np.where((symbols[:-1] >= 0) & (symbols[1:] >= 0), symbols[:-1] * self.size + symbols[1:], -1)
        at = np.minimum(np.searchsorted(self.adjacent, keys), len(self.adjacent) - 1)
        owner = offsets_of((self.adjacent[at] != keys) | (whole[1:] != whole[:-1]))
        alone = np.bincount(owner)[owner] == 1
        np.add.at(out, whole[alone], cost[alone])
        whole = whole[np.flatnonzero(np.diff(owner, prepend=-1))]
        symbols, cost, owner = symbols[~alone], cost[~alone], owner[~alone]
        while len(symbols):
            ranks, places = self.lookup(symbols[:-1], symbols[1:])
            ranks = np.append(np.where(owner[:-1] == owner[1:], ranks, NONE), NONE)
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            lowest = np.minimum.reduceat(ranks, starts)
            sizes = np.diff(np.append(starts, len(owner)))
            ended = lowest == NONE
            if ended.any():
                np.add.at(out, whole[owner[starts[ended]]], np.add.reduceat(cost, starts)[ended])
            hits = self._from_the_left(np.flatnonzero((ranks == np.repeat(lowest, sizes)) & (ranks != NONE)), symbols, owner, ranks, places)
            symbols[hits], cost[hits] = self.merged[places[hits]], 1
            stays = np.repeat(~ended, sizes)
            stays[hits + 1] = False
            symbols, cost, owner = symbols[stays], cost[stays], owner[stays]
        return out

    def _from_the_left(self, hits: np.ndarray, symbols: np.ndarray, owner: np.ndarray, ranks: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Of the places of the lowest pairs those that merge now: none that overlaps one before it, none behind one that lets a lower pair arise."""
        if len(hits) < 2:
            return hits
        k = np.arange(len(hits))
        linked = np.concatenate([[False], hits[1:] == hits[:-1] + 1])
        hits = hits[(k - np.maximum.accumulate(np.where(linked, 0, k))) % 2 == 0]
        merged = self.merged[places[hits]]
        sinks = np.flatnonzero(self.sinks[merged])
        if not len(sinks):
            return hits
        at, own = hits[sinks], merged[sinks]
        touched = (sinks > 0) & (hits[np.maximum(sinks - 1, 0)] == at - 2)
        before = np.where(touched, merged[np.maximum(sinks - 1, 0)], symbols[np.maximum(at - 1, 0)])
        before = np.where((at > 0) & (owner[np.maximum(at - 1, 0)] == owner[at]), before, -1)
        behind = np.minimum(at + 2, len(symbols) - 1)
        after = np.where((at + 2 < len(symbols)) & (owner[behind] == owner[at]), symbols[behind], -1)
        arises = np.minimum(self.lookup(before, own)[0], self.lookup(own, after)[0]) <= ranks[at]
        stops = np.zeros(len(hits), dtype=np.int64)
        stops[sinks[arises]] = 1
        earlier = np.cumsum(stops) - stops
        first = np.flatnonzero(np.concatenate([[True], owner[hits[1:]] != owner[hits[:-1]]]))
        return hits[earlier == np.repeat(earlier[first], np.diff(np.append(first, len(hits))))]


@lru_cache(maxsize=2)
def counter(model_file: str) -> Remembered:
    merges = PieceMerges(model_file)

    def count(pieces: list[str]) -> list[bytes]:
        raw = merges.count(pieces).astype("<u4").tobytes()
        return [raw[k : k + 4] for k in range(0, len(raw), 4)]

    return Remembered(count)


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_tokens and over_limit of every whole text; other columns aren't carried.

    A null text counts as empty: no bytes, no tokens. Each row is counted for itself, repeated ones as often as they
    occur. model_file must be readable at the same path on every executor.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model_file)
        for part in gathered(batches, "pieces", WINDOW):
            pieces = Pieces(part.column("pieces"))
            own = count(pieces.distinct).table(1)[:, 0].astype(np.int64)
            totals = sums(own[pieces.index], pieces.offsets)
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("n_bytes"), pa.array(totals)], ["key", "n_bytes", "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.octet_length(text_or_empty(text)).cast("long").alias("n_bytes"), marked_pieces(text).alias("pieces"))
    counted = rows.mapInArrow(tidy(run), f"key {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
