"""Repair of conversation structure at the least cost.

A conversation's rows are checked (blank, duplicate, truncated), and the cheapest edits are sought that make its role
initials `(s?(ua)+)?`: Keep, Rerole, Delete and Insert. States are what has been written so far: nothing, a system row, a
user row, an assistant row. The cost to the end is worked out backwards over the rows. Among the cheapest edits the ones
that read least are told by prefix doubling: nodes on optimal arcs are ranked by the next 1, 2, 4, ... letters of their
audits, each round from pairs of the ranks of the one before; an arc goes by its letter and its target's rank, and the
path is read off by doubled pointers.

Conversations are cut into segments of neighbouring rows, so that one of any length is spread over tasks. What a segment
does to costs is a (min, +) matrix of four by four states; these fold into the cost at each segment's end, segments
are solved for each state that they may begin in, and a pass over the segments picks one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterfold.llm.common import materialised, ship, whole_numbers
from meterfold.llm.groups import group_starts, whole_groups
from meterfold.llm.ragged import offsets_of, spread, tidy

#: Costs of the edits, and their letters in ASCII order.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
LETTERS = b"DIKR"
NOT_BLANK = r"[^\x20\x09-\x0D]"
#: States: nothing, system, user, assistant written last. What a written user or assistant row leads to, and what a kept row of initial s, u, a or another does (4: nowhere).
WRITTEN = np.array([2, 2, 3, 2])
KEPT = np.array([[1, 2, 4, 4], [4, 2, 4, 4], [4, 4, 3, 4], [4, 2, 4, 4]])
FAR = 1 << 40
#: Cost after the last row: an assistant row, or a user and an assistant row, may be missing.
AT_END = np.array([0, 2 * INSERT, INSERT, 0])
#: Rows of one task's partition that a segment has at most, as a power of two.
SEGMENT_BITS = 14
#: Stands for a null conv_id in joins and groups.
NO_KEY = -(1 << 63)
#: A row's code: initial (0 to 3), and whether it must go and is truncated.
GO, SHORT = 4, 8


def faulty(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows in order, as conv, pos (rises in a conversation), role and text, and as conv, seg, pos, turn, fault ('', blank, duplicate or truncated) and code.

    Order is by turn (null ones first), then role and text. A row is a duplicate if role and text came up in an earlier one.
    """
    rows = turns.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_KEY)).alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    order = ["conv", F.col("turn").asc_nulls_first(), "role"]
    rows = rows.repartitionByRange(*order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text")
    rows = rows.withColumn("pos", F.monotonically_increasing_id()).withColumn("said", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    initial = F.substring("role", 1, 1)
    rows = rows.withColumn("initial", F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3))
    rows = materialised(rows.withColumn("blank", ~F.col("text").rlike(NOT_BLANK)).withColumn("short", ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")), "turns")
    again = F.row_number().over(Window.partitionBy("conv", "said").orderBy("pos")) > 1
    fault = F.when(F.col("blank"), "blank").when(again, "duplicate").when(F.col("short"), "truncated").otherwise("")
    told = rows.select("conv", F.shiftright("pos", SEGMENT_BITS).alias("seg"), "pos", "turn", "initial", fault.alias("fault"))
    code = F.col("initial") + F.when(F.col("fault").isin("blank", "duplicate"), GO).when(F.col("fault") == "truncated", SHORT).otherwise(0)
    return rows.select("conv", "pos", "role", "text"), materialised(told.withColumn("code", code).drop("initial"), "faults")


def costs(code: np.ndarray, offsets: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Least cost to the end from each state before each row and, as each segment's last entry, after all its rows.

    ends: cost in each state after a segment's last row.
    """
    n = np.diff(offsets)
    base = offsets[:-1] + np.arange(len(n))
    out = np.empty((len(code) + len(n), 4), dtype=np.int64)
    out[base + n] = ends
    order = np.argsort(-n, kind="stable")
    longest = n[order]
    for t in range(1, int(longest[0]) + 1 if len(n) else 1):
        own = order[: int(np.searchsorted(-longest, -t, side="right"))]
        row = offsets[own] + n[own] - t
        at = base[own] + n[own] - t
        after = np.concatenate([out[at + 1], np.full((len(own), 1), FAR)], axis=1)
        kind = code[row]
        extra = np.where(kind & SHORT, TRUNCATED, 0)[:, None] + np.where(kind & GO, FAR, 0)[:, None]
        kept = np.take_along_axis(after, KEPT[:, kind & 3].T, axis=1) + KEEP
        best = np.minimum(after[:, :4] + DELETE, np.minimum(kept, after[:, WRITTEN] + REROLE) + extra)
        user, assistant = best[:, 2].copy(), best[:, 3].copy()
        best[:, 2], best[:, 3] = np.minimum(user, assistant + INSERT), np.minimum(assistant, user + INSERT)
        best[:, :2] = np.minimum(best[:, :2], best[:, 2:3] + INSERT)
        out[at] = np.minimum(best, FAR)
    return out


def audits(code: np.ndarray, offsets: np.ndarray, ends: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, list[list[bytes]], np.ndarray]:
    """For each segment and state that it may begin in: cost, least audit and the state that it ends in.

    Nodes are (row, state), arcs those of least cost. After its last row a segment ends, unless it is its conversation's
    last: rows may be inserted there.
    """
    n = np.diff(offsets)
    base = offsets[:-1] + np.arange(len(n))
    cost = costs(code, offsets, ends)
    size = 4 * len(cost)
    layer, state = np.divmod(np.arange(size), 4)
    flat = np.append(cost.reshape(-1), FAR)
    final = np.zeros(len(cost), dtype=bool)
    final[base + n] = True
    open_end = np.zeros(len(cost), dtype=bool)
    open_end[(base + n)[last]] = True
    kind = np.zeros(len(cost), dtype=np.int64)
    kind[~final] = code
    own, ended = kind[layer], final[layer]
    extra = np.where(own & SHORT, TRUNCATED, 0)
    kept = KEPT[state, own & 3]
    forward = lambda to: np.where(ended | (to == 4), size, 4 * (layer + 1) + to)
    must = (own & GO) > 0
    there = np.stack([forward(state), np.where(~ended | open_end[layer], 4 * layer + WRITTEN[state], size), np.where(must, size, forward(kept)), np.where(must, size, forward(WRITTEN[state]))], axis=1)
    price = np.stack([np.full(size, DELETE), np.full(size, INSERT), KEEP + extra, REROLE + extra], axis=1)
    best = (flat[there] + price == flat[:size, None]) & (flat[:size, None] < FAR)

    # ranks of the least audits' first 1, 2, 4, ... letters. A letter leaves a node by one arc at most, so the node after
    # the least first letters is one as well; a node without arcs has the empty audit, which is least.
    letter = np.where(best.any(axis=1), best.argmax(axis=1), -1)
    to = np.where(letter >= 0, there[np.arange(size), np.maximum(letter, 0)], np.arange(size))
    rank, jump = letter + 1, to
    while (jump[jump] != jump).any():
        rank = np.unique(rank * (int(rank.max()) + 1) + rank[jump], return_inverse=True)[1]
        jump = jump[jump]
    rank = np.unique(rank * (int(rank.max()) + 1) + rank[jump], return_inverse=True)[1]

    # the arc to take has the least letter and the least rest; pointers of 1, 2, 4, ... arcs, and how many letters they stand for
    ranked = np.append(rank, 0)[there] + np.arange(4) * (int(rank.max()) + 1 if size else 1)
    chosen = np.where(best, ranked, np.iinfo(np.int64).max).argmin(axis=1)
    letter = np.where(best.any(axis=1), chosen, -1)
    pointers = [np.where(letter >= 0, there[np.arange(size), chosen], np.arange(size))]
    counts = (letter >= 0).astype(np.int64)
    while (pointers[-1][pointers[-1]] != pointers[-1]).any():
        counts = counts + counts[pointers[-1]]
        pointers.append(pointers[-1][pointers[-1]])
    whole = pointers[-1]
    start = (4 * base[:, None] + np.arange(4)).reshape(-1)
    lengths = counts[start]
    node = np.repeat(start, lengths)
    step = spread(np.zeros(len(start), dtype=np.int64), lengths)
    for k, pointer in enumerate(pointers):
        node = np.where(step >> k & 1, pointer[node], node)
    text = np.frombuffer(LETTERS, dtype=np.uint8)[letter[node]].tobytes()
    cuts = offsets_of(lengths)
    pieces = [[text[cuts[4 * i + q] : cuts[4 * i + q + 1]] for q in range(4)] for i in range(len(n))]
    return flat[start].reshape(-1, 4), pieces, (whole[start] % 4).reshape(-1, 4)


def _codes(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the rows, and the offsets of their segments."""
    starts = group_starts(table, ["conv", "seg"])
    return table.column("code").to_numpy().astype(np.int64), np.append(starts, table.num_rows)


def _dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df with what belongs together in one task, in order; the last key only sorts."""
    return df.repartition(*keys[:-1]).sortWithinPartitions(*keys)


def _matrices(faults: DataFrame) -> DataFrame:
    """For each segment its 16 costs, its first and last initials, and adjacent ones that are wrong."""
    units = np.where(np.eye(4, dtype=bool), 0, FAR)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["conv", "seg"]):
            code, offsets = _codes(table)
            base = offsets[:-1] + np.arange(len(offsets) - 1)
            matrix = np.stack([costs(code, offsets, np.tile(u, (len(base), 1)))[base] for u in units], axis=2)
            initial = code & 3
            wrong = ~np.isin(4 * initial[:-1] + initial[1:], [1, 6, 9])  # su, ua, au
            inside = np.concatenate([[0], np.cumsum(wrong)])
            illegal = inside[offsets[1:] - 1] - inside[offsets[:-1]]
            at = pa.array(offsets[:-1])
            cells = pa.ListArray.from_arrays(pa.array(np.arange(0, 16 * len(base) + 1, 16, dtype=np.int32)), pa.array(matrix.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*(table.column(k).combine_chunks().take(at) for k in ("conv", "seg")), cells, pa.array(initial[offsets[:-1]]), pa.array(initial[offsets[1:] - 1]), pa.array(illegal)], ["conv", "seg", "matrix", "first", "final", "illegal"])

    return _dealt(faults.select("conv", "seg", "pos", "code"), "conv", "seg", "pos").mapInArrow(tidy(run), "conv long, seg long, matrix array<long>, first long, final long, illegal long")


def _ends(matrices: DataFrame) -> DataFrame:
    """For each segment the cost in each state after its last row, and whether it is its conversation's last; one row in 2^14 turns is gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["conv"]):
            conv, seg = table.column("conv").to_numpy(), table.column("seg").to_numpy()
            matrix = table.column("matrix").combine_chunks().flatten().to_numpy().reshape(-1, 4, 4)
            first, final = table.column("first").to_numpy(), table.column("final").to_numpy()
            last = np.append(conv[1:] != conv[:-1], True)
            ends = np.tile(AT_END, (len(conv), 1))
            for i in np.flatnonzero(~last)[::-1]:
                ends[i] = np.minimum((matrix[i + 1] + ends[i + 1]).min(axis=1), FAR)
            wrong = np.append(~np.isin(4 * final[:-1] + first[1:], [1, 6, 9]), False) & ~last
            own = [pa.array(conv), pa.array(seg), *(pa.array(ends[:, q]) for q in range(4)), pa.array(last), pa.array(table.column("illegal").to_numpy() + wrong)]
            yield pa.RecordBatch.from_arrays(own, ["conv", "seg", "e0", "e1", "e2", "e3", "last", "illegal"])

    return _dealt(matrices, "conv", "seg").mapInArrow(tidy(run), "conv long, seg long, e0 long, e1 long, e2 long, e3 long, last boolean, illegal long")


def _choices(faults: DataFrame, ends: DataFrame) -> DataFrame:
    """For each segment and each state that it may begin in: cost, audit, and the state that it ends in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["conv", "seg"]):
            code, offsets = _codes(table)
            at = offsets[:-1]
            end = np.stack([table.column(f"e{q}").to_numpy()[at] for q in range(4)], axis=1)
            cost, pieces, out = audits(code, offsets, end, table.column("last").to_numpy()[at])
            own = [table.column(k).combine_chunks().take(pa.array(at)) for k in ("conv", "seg")]
            own += [pa.array(cost[:, 0]), *(pa.array([p[q].decode() for p in pieces]) for q in range(4)), *(pa.array(out[:, q]) for q in range(4))]
            yield pa.RecordBatch.from_arrays(own, ["conv", "seg", "cost", "p0", "p1", "p2", "p3", "x0", "x1", "x2", "x3"])

    rows = faults.select("conv", "seg", "pos", "code").join(ends.drop("illegal"), ["conv", "seg"])
    return _dealt(rows, "conv", "seg", "pos").mapInArrow(tidy(run), "conv long, seg long, cost long, p0 string, p1 string, p2 string, p3 string, x0 long, x1 long, x2 long, x3 long")


def _plan(choices: DataFrame) -> DataFrame:
    """conv, seg, entry (the state that a segment begins in), piece (its part of the audit) and, in its first one, the conversation's cost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, 0
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                fresh = row["conv"] != conv
                conv, state = row["conv"], 0 if fresh else state
                out.append((conv, row["seg"], state, row[f"p{state}"], row["cost"] if fresh else None))
                state = row[f"x{state}"]
            yield pa.RecordBatch.from_pylist([dict(zip(("conv", "seg", "entry", "piece", "cost"), r, strict=True)) for r in out], schema=pa.schema([("conv", pa.int64()), ("seg", pa.int64()), ("entry", pa.int64()), ("piece", pa.string()), ("cost", pa.int64())]))

    return _dealt(choices, "conv", "seg").mapInArrow(tidy(run), "conv long, seg long, entry long, piece string, cost long")


def _edited(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """The rows that the plan leaves, with inserted ones: conv, seg, at (rises in a segment), role, text and edit.

    A segment's plan comes before its rows, as a row of its own.
    """
    head = plan.select("conv", "seg", F.lit(-1).cast("long").alias("pos"), F.col("entry").cast("string").alias("role"), F.col("piece").alias("text"))
    both = rows.select("conv", F.shiftright("pos", SEGMENT_BITS).alias("seg"), "pos", "role", "text").unionByName(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, place, state, at = "", 0, 0, 0
        for batch in batches:
            out: list[tuple] = []
            for conv, seg, pos, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv", "seg", "pos", "role", "text")), strict=True):
                if pos < 0:
                    piece, place, state, at = text, 0, int(role), 0
                else:
                    edit, place = piece[place], place + 1
                    if edit != "D":
                        initial = "sua".find(role[:1]) if role else 3
                        state = int(WRITTEN[state] if edit == "R" else KEPT[state, initial])
                        out.append((conv, seg, at, role if edit == "K" else ("", "", "user", "assistant")[state], text, edit))
                        at += 1
                while place < len(piece) and piece[place] == "I":
                    state, place = int(WRITTEN[state]), place + 1
                    out.append((conv, seg, at, ("", "", "user", "assistant")[state], "", "I"))
                    at += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], ["conv", "seg", "at", "role", "text", "edit"])

    return _dealt(both, "conv", "seg", "pos").mapInArrow(tidy(run), "conv long, seg long, at long, role string, text string, edit string")


def _conv(name: str = "conv") -> Column:
    return F.when(F.col(name) != NO_KEY, F.col(name)).alias("conv_id")


def digests(edited: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256 of each conversation's rows as `role:text`, joined by newlines; a task streams them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest = None, hashlib.sha256()
        for batch in batches:
            done: list[tuple[int, str]] = []
            for conv, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv", "role", "text")), strict=True):
                if conv != last:
                    if last is not None:
                        done.append((last, digest.hexdigest()))
                    last, digest = conv, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            yield _digested(done)
        if last is not None:
            yield _digested([(last, digest.hexdigest())])

    rows = edited.select(F.coalesce("conv_id", F.lit(NO_KEY)).alias("conv"), "seg", "at", "role", "text")
    out = rows.repartition("conv").sortWithinPartitions("conv", "seg", "at").mapInArrow(tidy(run), "conv long, repaired_sha256 string")
    return out.select(_conv(), "repaired_sha256")


def _digested(done: list[tuple[int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], pa.int64()), pa.array([d for _, d in done], pa.string())], ["conv", "repaired_sha256"])


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What was wrong with each conversation, and its rows after the cheapest edits.

    turns: conv_id (whole numbers), turn, role, text; rows go by turn, null ones first, then by role and text. A null role
    or text is one space. The first table has conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit; the
    second conv_id, seg and at (which order a conversation's rows), role, text and edit (K, R or I). A null conv_id is a
    conversation of its own, the smallest long key reads as null. A role whose initial is none of s, u and a can't be
    kept. Other columns aren't carried. An audit is one value, put together in one task from a piece a segment.
    """
    ship(turns.sparkSession)
    whole_numbers(turns, "conv_id")
    rows, faults = faulty(turns)
    ends = materialised(_ends(_matrices(faults)), "ends")
    plan = materialised(_plan(_choices(faults, ends)), "plan")
    count = lambda fault: F.count_if(F.col("fault") == fault).alias(fault)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps")
    told = faults.groupBy("conv").agg(gaps, count("blank"), count("duplicate"), count("truncated"))
    wrong = ends.groupBy("conv").agg(F.sum("illegal").alias("illegal"))
    edits = plan.groupBy("conv").agg(F.max("cost").alias("cost"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "piece"))), lambda x: x.piece), "").alias("audit"))
    report = told.join(wrong, "conv").join(edits, "conv").select(_conv(), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return report, _edited(rows, plan).select(_conv(), "seg", "at", "role", "text", "edit")
