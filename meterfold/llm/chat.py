"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole and encoded once with offsets; the sorted spans of the assistant's texts are then
intersected with the sorted spans of the tokens by binary search. A turn is

    <|im_start|>role<|im_sep|>text<|im_end|>

The three control strings are tokens of their own, so that no token reaches from a text into what stands around it.
Inside roles and texts a backslash becomes two, and <| becomes <\\|, so that no text can hold a control string.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterfold.llm.common import dim_join, materialised, ship, whole_numbers
from meterfold.llm.ragged import offsets_of, tidy

OPEN, MIDDLE, CLOSE = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
TURN = re.compile(r"<\|im_start\|>(.*?)<\|im_sep\|>(.*?)<\|im_end\|>", re.DOTALL)
#: Characters that are encoded at a time; a cut is at a turn's end, where no token can cross.
PIECE = 500_000
#: Characters of a conversation, its control strings included, up to which it is one row.
ROW = 4_000_000


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """Formatted turns, and the span of each turn's text in them."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape(role)}{MIDDLE}", escape(text)
        spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, CLOSE]
        at = spans[-1][1] + len(CLOSE)
    return "".join(out), spans


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens share a character with one of the spans; tokens and spans are in order."""
    change = np.zeros(len(starts) + 1, dtype=np.int64)
    wide = np.array([s for s in spans if s[1] > s[0]], dtype=np.int64).reshape(-1, 2)
    low, high = np.searchsorted(ends, wide[:, 0], side="right"), np.searchsorted(starts, wide[:, 1], side="left")
    np.add.at(change, low, 1)
    np.add.at(change, np.maximum(low, high), -1)
    return np.cumsum(change[:-1]) > 0


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    """The file's tokenizer, to which the control strings are added."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import AddedToken, Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.add_special_tokens([AddedToken(c, normalized=False, special=True) for c in (OPEN, MIDDLE, CLOSE)])
    return tokenizer


FORMATTED = "conv_id long, segment long, whole boolean, n_turns long, formatted string, token_ids array<int>, token_starts array<int>, token_ends array<int>, loss array<boolean>"


def _columns(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))


def _placed(rows: DataFrame, most: int) -> DataFrame:
    """rows with whole, and segment: how many times most characters of its conversation come before a turn.

    Nearly all conversations have fewer characters than that, which a sum tells. The turns of the others are dealt by
    ranges of their order; what comes before a turn is the sum of its conversation in the ranges before, of which there
    are no more than partitions, and of the turns before it in its own range. So segments don't depend on the partitions.
    """
    size = (F.length("role") + F.length("text")).cast("long") + len(OPEN + MIDDLE + CLOSE)
    keys = ["_none", "_conv"]  # a null key, too, is joined
    keyed = rows.withColumn("_none", F.col("conv_id").isNull()).withColumn("_conv", F.coalesce("conv_id", F.lit(0).cast("long")))
    large = materialised(keyed.groupBy(*keys).agg(F.sum(size).alias("n")).where(F.col("n") > most).select(*keys), "large-conversations")
    if large.isEmpty():
        return rows.select("*", F.lit(0).cast("long").alias("segment"), F.lit(True).alias("whole"))
    small = dim_join(keyed, large, keys, "left_anti").select(*rows.columns, F.lit(0).cast("long").alias("segment"), F.lit(True).alias("whole"))
    ranged = dim_join(keyed, large, keys, "left_semi").repartitionByRange(*keys, "turn", "role", F.substring("text", 1, 32))
    turns = materialised(ranged.select(*rows.columns, *keys, F.spark_partition_id().alias("_part")), "large-turns")
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = turns.groupBy(*keys, "_part").agg(F.sum(size).alias("_n")).select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    here = Window.partitionBy(*keys, "_part").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("_before") + F.coalesce(F.sum(size).over(here), F.lit(0))
    cut = dim_join(turns, parts, [*keys, "_part"]).select(*rows.columns, F.floor(at / most).alias("segment"), F.lit(False).alias("whole"))
    return small.unionByName(cut)


def format_chats(turns: DataFrame, tokenizer_file: str, trained_role: str = "assistant", row: int = ROW) -> DataFrame:
    """Formatted conversations: conv_id, segment, whole, n_turns, formatted, token_ids, token_starts, token_ends and loss.

    turns has conv_id (whole numbers), turn, role, text; turns are in the order of turn, then role and text, nulls first.
    A null role or text counts as empty. A null conv_id is a conversation of its own. A conversation is one row, whole,
    with offsets in code points of its text. One of more than row characters, which no row should hold, has a row for
    each segment of whole turns instead: a turn is in the segment that the characters before it tell, so that rows are
    the same however the input is partitioned, and offsets are those of the segment. Several tasks format such a
    conversation, each in the memory of one segment and one turn. Other columns aren't carried.
    """
    ship(turns.sparkSession)
    whole_numbers(turns, "conv_id")
    arrays = {"token_ids": pa.int32(), "token_starts": pa.int32(), "token_ends": pa.int32(), "loss": pa.bool_()}
    kinds = {"conv_id": pa.int64(), "segment": pa.int64(), "whole": pa.bool_(), "n_turns": pa.int64(), "formatted": pa.string(), **{k: pa.list_(t) for k, t in arrays.items()}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(tokenizer_file)

        def encoded(held: list[tuple[str, str]]) -> tuple:
            text, spans = render(held)
            code = tokenizer.encode(text, add_special_tokens=False)
            starts, ends = np.array(code.offsets, dtype=np.int32).reshape(-1, 2).T
            mask = loss_mask(starts, ends, [s for s, (role, _) in zip(spans, held, strict=True) if role == trained_role])
            return len(held), text, np.array(code.ids, dtype=np.int32), starts, ends, mask

        def joined(key: tuple, pieces: list[tuple]) -> tuple:
            counts, texts, ids, starts, ends, masks = zip(*pieces, strict=True)
            at = offsets_of(np.fromiter(map(len, texts), dtype=np.int32, count=len(texts))).astype(np.int32)
            starts, ends = ([x + a for x, a in zip(some, at, strict=False)] for some in (starts, ends))
            return *key, sum(counts), "".join(texts), *map(np.concatenate, (ids, starts, ends, masks))

        done: list[tuple] = []
        key, pieces, held, size, waiting = None, [], [], 0, 0
        for batch in batches:
            for conv, segment, whole, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "segment", "whole", "role", "text")), strict=True):
                own = conv, segment, whole
                if held and (own != key or size >= PIECE):
                    pieces.append(encoded(held))
                    held, size = [], 0
                if pieces and own != key:
                    done.append(joined(key, pieces))
                    pieces = []
                    waiting += len(done[-1][4])
                    if waiting > PIECE:
                        yield _columns(done, kinds)
                        done, waiting = [], 0
                key = own
                held.append((role, text))
                size += len(role) + len(text)
        if held:
            done.append(joined(key, [*pieces, encoded(held)]))
        if done:
            yield _columns(done, kinds)

    empty = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in ("role", "text")]
    rows = _placed(turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *empty), row)
    order = ["conv_id", "segment", "turn", "role", "text"]
    rows = rows.repartition("conv_id", "segment").sortWithinPartitions(*order).select("conv_id", "segment", "whole", "role", "text")
    return rows.mapInArrow(tidy(run), FORMATTED)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what formatted conversations hold, as format_chats returns them, in any order of rows.

    All that stands under the loss mask counts, wherever it stands. A conversation of one row is digested where it lies;
    the segments of others meet in their order, as a digest is a sequence.
    """
    kinds = {"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        conv, state = None, None

        def close() -> None:
            if state:
                rows.append((conv, state["turns"], state["all"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["size"]))

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in ("conv_id", "formatted")]
            masks = [[batch.column(k).slice(i, 1).flatten().to_numpy(zero_copy_only=False) for k in ("token_starts", "token_ends", "loss")] for i in range(batch.num_rows)]
            for own, text, (starts, ends, mask) in zip(*columns, masks, strict=True):
                if state is None or own != conv:
                    close()
                    conv, state = own, {"turns": 0, "all": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "size": 0}
                state["size"] += len(text)
                for m in TURN.finditer(text):
                    state["turns"] += 1
                    state["all"].update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                change = np.zeros(len(text) + 1, dtype=np.int64)
                np.add.at(change, starts[mask], 1)
                np.add.at(change, ends[mask], -1)
                edges = np.flatnonzero(np.diff(np.concatenate([[False], np.cumsum(change[:-1]) > 0, [False]]))).tolist()
                for low, high in zip(edges[::2], edges[1::2], strict=True):
                    said = unescape(text[low:high])
                    state["chars"] += len(said)
                    state["loss"].update(said.encode())
            if len(rows) > 1000:
                yield _columns(rows, kinds)
                rows.clear()
        close()
        if rows:
            yield _columns(rows, kinds)

    def digests(df: DataFrame) -> DataFrame:
        return df.select("conv_id", "formatted", "token_starts", "token_ends", "loss").mapInArrow(tidy(run), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

    apart = formatted.where("NOT whole").repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return digests(formatted.where("whole")).unionByName(digests(apart))
