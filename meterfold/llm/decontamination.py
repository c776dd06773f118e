"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders. Windows of the templates that result are joined by hash between
documents and benchmark items; the values that stand in the placeholders must then map consistently from item to
document, so that a question asked again with other numbers is caught and a chance likeness isn't. Beside the templates
stands the exact window of each whole item, its lower-cased tokens, whatever its length and however few are literal.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterfold.llm.common import dim_join, is_small, materialised, ship, text_or_empty
from meterfold.llm.ragged import Pieces, Remembered, offsets_of, slices, tidy

#: Units of measure and number words that become placeholders.
UNITS = frozenset(
    "% $ € £ ¥ ° mm cm m km mg g kg t ml cl l s ms min h hr hrs mph kmh kwh w kw v hz mb gb tb inch inches foot feet yard yards mile miles ounce ounces pound pounds gram grams kilogram kilograms tonne tonnes ton tons litre litres liter liters gallon gallons meter meters metre metres centimeter centimeters centimetre centimetres kilometer kilometers kilometre kilometres second seconds minute minutes hour hours day days week weeks month months year years dollar dollars euro euros cent cents percent degree degrees celsius fahrenheit watt watts volt volts".split()
)
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half".split())
#: Scripts that write no spaces between words, a token a character: Thai, Lao, Burmese, Khmer, kana, Han, Yi.
_SPACED = r"[\p{L}\p{M}&&[\x00-\u0DFF\u0F00-\u0FFF\u10A0-\u177F\u1800-\u303F\u3100-\u31EF\u3200-\u33FF\uA4D0-\uF8FF\uFB00-\x{1FFFF}\x{40000}-\x{10FFFF}]]"
#: Loops are possessive: what follows a run never begins like it, and the engine takes such a loop without recursion.
TOKEN = rf"\p{{N}}++(?:[.,:/]\p{{N}}++)*+|(?<=\p{{N}} ?)[-+*/=×÷^<>](?= ?\p{{N}})|{_SPACED}++(?:['’]{_SPACED}++)*+|\p{{L}}\p{{M}}*+|[%$€£¥°]|[.!?]|\n"
LITERAL, NUMBER, UNIT, NAME, OPERATOR, END = range(6)
#: Bits of the filter of benchmark windows that every task gets: its size is fixed, a fuller one lets more rows pass.
FILTER_BITS = 1 << 24
#: Stands for the place of an exact window in a text of fewer tokens than Params.alone.
BRIEF = -1
#: An odd number and what it is multiplied with to give 1 modulo 2^64.
BASE = np.uint64(0xD1342543DE82EF95)
INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))


@dataclass(frozen=True)
class Params:
    """A document holds an item if one occurrence has coverage of its windows, and consistent of its values agree there.

    An item of fewer tokens than width has a single window of its own length, one of fewer than least only its exact one.
    A window needs literals tokens that aren't placeholders. An item without such a window, like a short sum, has one
    window of its own length in which only numbers and units are placeholders, if it has one of those and worded other
    tokens. An item of fewer tokens than alone, like `Yes`, is held by documents that say nothing else; by others only if
    they are a single one, or at most rare of all documents.
    """

    width: int = 8
    least: int = 4
    literals: int = 3
    worded: int = 2
    alone: int = 2
    rare: float = 0.0001
    coverage: float = 0.6
    consistent: float = 0.8


def tokens(text: str = "text") -> Column:
    return F.regexp_extract_all(text_or_empty(text), F.lit(TOKEN), F.lit(0))


def _codes(distinct: list[str]) -> list[bytes]:
    """Kind, hash as a template's token and hash as it stands, lower-cased; a capital is a NAME wherever it stands.

    An operator between numbers stands for itself, but is no literal: lists of numbers aren't wording.
    """
    out = np.zeros((len(distinct), 3), dtype="<u8")
    for k, w in enumerate(distinct):
        low = w.lower()
        if w in ".!?\n":
            out[k] = END, 0, 0
            continue
        own = xxhash.xxh3_64_intdigest(low.encode("utf-8"))
        if w[0].isnumeric() or low in NUMBER_WORDS:
            out[k] = NUMBER, NUMBER, own
        elif w in "-+*/=×÷^<>":
            out[k] = OPERATOR, own, own
        elif low in UNITS:
            out[k] = UNIT, UNIT, own
        elif w[0].isupper():
            out[k] = NAME, NAME, own
        else:
            out[k] = LITERAL, own, own
    raw = out.tobytes()
    return [raw[k : k + 24] for k in range(0, len(raw), 24)]


class Templates:
    """Canonical tokens of a slice: kinds, hashes as templates and as they stand, places in pieces, and the rows' offsets."""

    def __init__(self, lists: pa.ListArray, code: Remembered):
        self.pieces = Pieces(lists)
        index, at = self.pieces.index, self.pieces.offsets
        own = code(self.pieces.distinct).table(3)
        stays = own[index, 0] != END
        self.place = index[stays]
        self.kind, self.value, self.raw = own[self.place, 0].astype(np.int64), own[self.place, 1], own[self.place, 2]
        self.offsets = offsets_of(stays)[at]
        self.row = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))
        n = len(self.raw)
        with np.errstate(over="ignore"):
            self.back, self.powers = np.cumprod(np.full(n, INVERSE)), np.cumprod(np.full(n, BASE))
        self.upto = self._upto(self.raw)

    def _upto(self, values: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * self.powers)])

    @cached_property
    def measured(self) -> np.ndarray:
        """Whether a token is a number or a unit."""
        return (self.kind == NUMBER) | (self.kind == UNIT)

    @cached_property
    def typed_upto(self) -> np.ndarray:
        return self._upto(np.where(self.measured, self.value, self.raw))

    def exact(self, start: np.ndarray, width: int, typed: bool = False) -> np.ndarray:
        """Hashes of the tokens as they stand in windows of so many tokens: a polynomial modulo 2^64, from running sums.

        typed: numbers and units by their types.
        """
        upto = self.typed_upto if typed else self.upto
        with np.errstate(over="ignore"):
            total = (upto[start + width] - upto[start]) * self.back[start]
            total = (total ^ (total >> np.uint64(32)) ^ np.uint64(2 * width + typed)) * np.uint64(0x9E3779B97F4A7C15)
        return total ^ (total >> np.uint64(29))

    def inside(self, width: int) -> np.ndarray:
        """Starts of all windows of so many tokens that lie in one row."""
        n = len(self.raw) - width + 1
        return np.flatnonzero(self.row[:n] == self.row[width - 1 :]) if n > 0 else np.empty(0, dtype=np.int64)

    def windows(self, width: int, literals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, start and hash of each window of so many tokens with enough literals."""
        n = len(self.kind) - width + 1
        if n <= 0:
            return (np.empty(0, dtype=np.int64),) * 2 + (np.empty(0, dtype=np.uint64),)
        row = self.row
        plain = np.concatenate([[0], np.cumsum(self.kind == LITERAL)])
        start = np.flatnonzero((row[:n] == row[width - 1 :]) & (plain[width:] - plain[:n] >= literals))
        total = np.full(len(start), width, dtype=np.uint64)
        for k in range(width):
            total = (total ^ self.value[start + k]) * np.uint64(0x9E3779B97F4A7C15)
            total ^= total >> np.uint64(29)
        return row[start], start, total

    def slots(self, start: int, width: int, last: int = NAME) -> list[str]:
        """The values that stand in a window's placeholders, lower-cased; last: names are some, or numbers and units only."""
        return [self.pieces.distinct[self.place[k]].as_py().lower() for k in range(start, start + width) if NUMBER <= self.kind[k] <= last]


FIELDS = ["hash", "at", "slots"]
RESULT = ["n_windows", "matched", "n_slots", "n_consistent", "n_changed", "verbatim"]


def _rows(key: pa.Array, templates: Templates, row: np.ndarray, start: np.ndarray, hashes: np.ndarray, width: int, more: list[tuple[str, pa.Array]], last: int = NAME) -> pa.RecordBatch:
    slots = pa.array([templates.slots(s, width, last) for s in start.tolist()], pa.list_(pa.string()))
    at = start - templates.offsets[row]
    return pa.RecordBatch.from_arrays([key.take(pa.array(row)), pa.array(hashes.view(np.int64)), pa.array(at), slots, *(v for _, v in more)], ["key", *FIELDS, *(n for n, _ in more)])


def item_windows(items: DataFrame, p: Params, key: str = "item_id", text: str = "text") -> DataFrame:
    """key, width, hash, at, slots of each window of each item, n_windows of its item, and whether only numbers and units are its placeholders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Remembered(_codes, "<u8")
        for batch in batches:
            for part in slices(batch, "pieces"):
                templates = Templates(part.column("pieces"), code)
                size = np.diff(templates.offsets)
                bare = size > 0
                for width in range(p.least, p.width + 1):
                    row, start, hashes = templates.windows(width, p.literals)
                    own = (size[row] == width) | ((width == p.width) & (size[row] > width))
                    row, start, hashes = row[own], start[own], hashes[own]
                    n = np.bincount(row, minlength=part.num_rows)[row]
                    bare[row] = False
                    yield _rows(part.column("key"), templates, row, start, hashes, width, _more(width, n, False))
                within = np.concatenate([[0], np.cumsum(templates.measured)])
                slots = within[templates.offsets[1:]] - within[templates.offsets[:-1]]
                bare &= (slots > 0) & (size - slots >= p.worded)
                for width in np.unique(size[bare]).tolist():
                    row = np.flatnonzero(bare & (size == width))
                    start = templates.offsets[row]
                    yield _rows(part.column("key"), templates, row, start, templates.exact(start, width, True), width, _more(width, np.ones(len(row), np.int64), True), UNIT)

    kind = items.schema[key].dataType.simpleString()
    rows = items.select(F.col(key).alias("key"), tokens(text).alias("pieces"))
    return rows.mapInArrow(tidy(run), f"key {kind}, hash long, at long, slots array<string>, width int, n_windows long, typed boolean")


def _more(width: int, n_windows: np.ndarray, typed: bool) -> list[tuple[str, pa.Array]]:
    n = len(n_windows)
    return [("width", pa.array(np.full(n, width, dtype=np.int32))), ("n_windows", pa.array(n_windows)), ("typed", pa.array(np.full(n, typed)))]


def item_exact(items: DataFrame, p: Params, key: str = "item_id", text: str = "text") -> DataFrame:
    """key, n tokens, head and hash: the exact window of each item that has a token, and that of its first p.width tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Remembered(_codes, "<u8")
        for batch in batches:
            for part in slices(batch, "pieces"):
                templates = Templates(part.column("pieces"), code)
                size = np.diff(templates.offsets)
                for n in np.unique(size[size > 0]).tolist():
                    row = np.flatnonzero(size == n)
                    start = templates.offsets[row]
                    head, whole = (templates.exact(start, w).view(np.int64) for w in (min(n, p.width), n))
                    yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(row)), pa.array(np.full(len(row), n)), pa.array(head), pa.array(whole)], ["key", "n", "head", "hash"])

    kind = items.schema[key].dataType.simpleString()
    rows = items.select(F.col(key).alias("key"), tokens(text).alias("pieces"))
    return rows.mapInArrow(tidy(run), f"key {kind}, n long, head long, hash long")


def _exact_hits(templates: Templates, lengths: list[int], heads: np.ndarray, wholes: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and hash of the windows that pass both filters, each once a row, and whether a row is shorter than p.alone: heads are looked for, whole items where one is."""
    out = []
    starts = {}
    for n in lengths:
        short = min(n, p.width)
        if short not in starts:
            inside = templates.inside(short)
            starts[short] = inside[_passes(heads, templates.exact(inside, short))]
        start = starts[short]
        start = start[start + n <= templates.offsets[templates.row[start] + 1]]
        found = templates.exact(start, n)
        own = _passes(wholes, found)
        out.append(np.stack([templates.row[start[own]].astype(np.uint64), found[own]], axis=1))
    both = np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 2), np.uint64)
    row = both[:, 0].astype(np.int64)
    return row, both[:, 1], np.diff(templates.offsets)[row] < p.alone


def _passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = (hashes & np.uint64(FILTER_BITS - 1)).astype(np.int64)
    return (bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0


def doc_windows(docs: DataFrame, widths: list[int], typed: list[int], bits: np.ndarray, lengths: list[int], heads: np.ndarray, wholes: np.ndarray, p: Params, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, hash, at, slots of the windows of every whole text that pass the filters of the benchmark; exact ones have no at, or BRIEF."""
    shared = docs.sparkSession.sparkContext.broadcast((bits, heads, wholes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Remembered(_codes, "<u8")
        bits, heads, wholes = shared.value
        for batch in batches:
            for part in slices(batch, "pieces"):
                templates = Templates(part.column("pieces"), code)
                for width in widths:
                    row, start, hashes = templates.windows(width, p.literals)
                    own = _passes(bits, hashes)
                    if own.any():
                        yield _rows(part.column("key"), templates, row[own], start[own], hashes[own], width, [])
                for width in typed:
                    start = templates.inside(width)
                    hashes = templates.exact(start, width, True)
                    own = _passes(bits, hashes)
                    if own.any():
                        yield _rows(part.column("key"), templates, templates.row[start[own]], start[own], hashes[own], width, [], UNIT)
                row, hashes, brief = _exact_hits(templates, lengths, heads, wholes, p)
                if len(row):
                    own = pa.array(np.full(len(row), BRIEF), mask=~brief), pa.nulls(len(row), pa.list_(pa.string()))
                    yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(row)), pa.array(hashes.view(np.int64)), *own], ["key", *FIELDS])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), tokens(text).alias("pieces"))
    return rows.mapInArrow(tidy(run), f"key {kind}, hash long, at long, slots array<string>")


def _filter(windows: DataFrame, column: str = "hash") -> np.ndarray:
    """A bit for each bucket of benchmark windows: at most FILTER_BITS distinct ones come to the driver."""
    got = windows.select(F.col(column).bitwiseAND(F.lit(FILTER_BITS - 1)).alias("bit")).distinct().toArrow()["bit"].to_numpy()
    flags = np.zeros(FILTER_BITS, dtype=bool)
    flags[got] = True
    return np.packbits(flags, bitorder="little")


def candidates(found: DataFrame, known: DataFrame, p: Params) -> DataFrame:
    """Windows of documents beside equal windows of items, for the pairs of document and item that can reach coverage.

    Of an item's n windows a document needs c, so that it has one of any n - c + 1. The rarest ones in the documents are
    taken: a window that many items and documents share doesn't bring all of them together.
    """
    often = found.groupBy("hash").agg(F.count("*").alias("often"))
    rarest = Window.partitionBy("item").orderBy("often", "item_at")
    rare = known.join(often, "hash").withColumn("missing", F.col("n_windows") - F.count("*").over(Window.partitionBy("item"))).withColumn("k", F.row_number().over(rarest))
    # windows that no document has are the rarest of all
    rare = rare.where(F.col("k") + F.col("missing") <= F.col("n_windows") - F.ceil(p.coverage * F.col("n_windows")) + 1)
    rare = materialised(rare.select("item", "hash").distinct(), "rare")
    pairs = found.select("doc", "hash").distinct().join(F.broadcast(rare) if is_small(rare) else rare, "hash").select("doc", "item").distinct()
    wide = pairs.join(F.broadcast(known) if is_small(known, weight=F.size("item_slots")) else known, "item")
    return wide.join(found, ["doc", "hash"])


def occurrences(hits: DataFrame, p: Params) -> DataFrame:
    """The best qualifying occurrence of each doc and item, from hits (doc, item, at, slots, item_at, item_slots, n_windows, width, typed).

    A hit's shift is at - item_at. Copies of an item stand at shifts that lie its length or more apart, and words put in
    or left out move a copy's later windows. So shifts fall into buckets as wide as the item, twice, the second time half
    a bucket further: a copy that moves by up to half its length is whole in one of them, and no bucket holds two whole
    copies. Where windows recur in the item, the shift with the most hits in the bucket decides. In a typed window a
    value that stands for another one of the item's isn't consistent: the same numbers in another order are another item.
    """
    pair = ["doc", "item"]
    shifted = hits.withColumn("shift", F.col("at") - F.col("item_at"))
    able = shifted.groupBy(*pair).agg(F.countDistinct("item_at").alias("n"), F.min("shift").alias("first"), F.max("shift").alias("last"), F.max("n_windows").alias("n_windows"), F.max("width").alias("width"))
    able = able.where(F.col("n") >= p.coverage * F.col("n_windows")).select(*pair, F.when(F.col("first") == F.col("last"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1))).alias("grids"))
    wide = F.col("n_windows") + F.col("width") - 1
    placed = shifted.join(able, pair).withColumn("grid", F.explode("grids")).withColumn("bucket", F.floor((F.col("shift") + F.col("grid") * F.floor(wide / 2)) / wide))
    own = [*pair, "grid", "bucket"]
    support = placed.groupBy(*own, "shift").agg(F.count("*").alias("support"))
    chosen = placed.join(support, [*own, "shift"]).groupBy(*own, "item_at").agg(F.max_by(F.struct("item_slots", "slots", "n_windows", "typed"), F.struct("support", -F.col("shift"))).alias("x")).select(*own, "x.*")
    covered = chosen.groupBy(*own).agg(F.count("*").alias("matched"), F.max("n_windows").alias("n_windows")).where(F.col("matched") >= p.coverage * F.col("n_windows"))
    values = chosen.select(*own, F.when(F.col("typed"), F.col("item_slots")).alias("others"), F.explode(F.arrays_zip("item_slots", "slots")).alias("x")).groupBy(*own, F.col("x.item_slots").alias("was")).agg(F.min("x.slots").alias("low"), F.max("x.slots").alias("high"), F.any_value("others").alias("others"))
    crossed = (F.col("low") != F.col("was")) & F.coalesce(F.array_contains("others", F.col("low")), F.lit(False))
    one = (F.col("low") == F.col("high")) & ~crossed
    slots = values.groupBy(*own).agg(F.count("*").alias("n_slots"), F.sum(one.cast("long")).alias("n_consistent"), F.sum((one & (F.col("low") != F.col("was"))).cast("long")).alias("n_changed"))
    both = covered.join(slots, own, "left").fillna(0, ["n_slots", "n_consistent", "n_changed"]).where(F.col("n_consistent") >= p.consistent * F.col("n_slots"))
    verbatim = (F.col("n_changed") == 0) & (F.col("n_consistent") == F.col("n_slots"))
    order = F.struct(verbatim.alias("verbatim"), "matched", "n_consistent", "n_windows", "n_slots", "n_changed")
    return both.groupBy(*pair).agg(F.max(order).alias("x")).select(*pair, "x.*")


def leaks(docs: DataFrame, items: DataFrame, p: Params = Params(), doc_key: str = "doc_id", item_key: str = "item_id") -> DataFrame:
    """One row for each document and item that it holds: doc_key, item_key, n_windows, matched, n_slots, n_consistent, n_changed, verbatim.

    Each occurrence of an item in a document is judged apart, and the best one that qualifies is told, a verbatim one
    first. n_slots counts the distinct values in matched placeholders of the item, n_consistent those that stand for one
    value in the occurrence throughout, n_changed those of them that differ there. An item that only its exact window finds has
    this one window. Null texts count as empty and match nothing; whole texts of any length are looked through, and runs of
    any length are one token. Rows that share an id count as one document or item. Other columns aren't carried.
    """
    ship(docs.sparkSession)
    known = materialised(item_windows(items, p, item_key).withColumnRenamed("key", "item"), "item-windows")
    whole = materialised(item_exact(items, p, item_key).withColumnRenamed("key", "item"), "items")
    sizes = known.select("typed", "width").distinct().collect()
    widths, typed = (sorted(r.width for r in sizes if r.typed == own) for own in (False, True))
    lengths = sorted(r.n for r in whole.select("n").distinct().collect())
    filters = _filter(known), lengths, _filter(whole, "head"), _filter(whole)
    found = materialised(doc_windows(docs, widths, typed, *filters, p, doc_key).withColumnRenamed("key", "doc"), "found")
    known = known.select("item", "hash", F.col("at").alias("item_at"), F.col("slots").alias("item_slots"), "n_windows", "width", "typed")
    hits = materialised(candidates(found.where("at >= 0"), materialised(known, "known"), p), "hits")
    held = found.where(F.col("at").isNull() | (F.col("at") == BRIEF)).select("doc", "hash", F.col("at").isNotNull().alias("brief"))
    exact = dim_join(held, whole.where(F.col("n") >= p.alone).select("item", "hash"), ["hash"], "inner").select("doc", "item")
    if lengths and lengths[0] < p.alone:
        single = dim_join(held, whole.where(F.col("n") < p.alone).select("item", "hash"), ["hash"], "inner")
        few = single.groupBy("item").agg(F.count("*").alias("often")).where(F.col("often") <= F.greatest(F.lit(1), F.floor(F.lit(p.rare) * docs.count()))).select("item", F.lit(True).alias("few"))
        exact = exact.unionByName(dim_join(single, few, ["item"]).where("brief OR few").select("doc", "item"))
    exact = exact.distinct()
    best = occurrences(hits, p)
    one = {"n_windows": F.lit(1), "matched": F.lit(1)}
    both = best.withColumn("exact", F.lit(False)).unionByName(exact.select("doc", "item", *[one.get(c, F.lit(0)).cast("boolean" if c == "verbatim" else "long").alias(c) for c in RESULT], F.lit(True).alias("exact")))
    order = F.struct(~F.col("exact"), *RESULT)
    rows = both.groupBy("doc", "item").agg(F.max_by(F.struct(*RESULT), order).alias("x"), F.max("exact").alias("exact"))
    rows = rows.select(F.col("doc").alias(doc_key), F.col("item").alias(item_key), "x.*", "exact")
    return rows.withColumn("verbatim", F.col("verbatim") | F.col("exact")).drop("exact")
