"""Quality rules with tokeniser fertility.

Public vocabularies measure each text: characters per token under two of them, the share of byte-fallback tokens and
the entropy of the token distribution. What is usual differs by language, so each language gets rejection bands from
the histograms of its texts that pass the base rules, gathered in one grouped aggregation; a text that lies outside a
band goes. The base rules, on length and on repeated five-word windows, stand before.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterfold.llm.common import dim_join, materialised, ship, text_or_empty
from meterfold.llm.ragged import Pieces, Remembered, gathered, slices, sums, tidy
from meterfold.llm.words import CHARS, FIELDS, SYMBOL, repeated_window_words, word_codes, words

#: Characters a token up to which bins are equally wide.
LINEAR = 20
#: Words that a task looks at together.
WINDOW = 600_000
METRICS = ("piece_chars", "byte_chars", "fallback", "evenness")


@dataclass(frozen=True)
class Params:
    """A band reaches from the median `reach` times as far as the quartiles do (`even_reach` for evenness), at least `least`.

    It is wider for short texts, by the root of 1 + slack / tokens, and where few rows tell what is usual, by the root of
    1 + enough / rows; but it never goes below half the median nor past half of what a share leaves above it, so that
    every bound can be crossed. fallback has no lower bound, evenness no upper one. Texts have evenness bands by the
    logarithm of their length where `enough` rows share it, and their language's elsewhere.
    """

    min_words: int = 10
    max_repeat_percent: int = 20
    bins: int = 1000
    reach: float = 6.0
    even_reach: float = 3.0
    least: float = 0.04
    slack: float = 100.0
    enough: int = 20


@lru_cache(maxsize=2)
def _vocabularies(piece_model: str, rank_file: str, pattern: str):
    import sentencepiece
    import tiktoken

    from meterfold.llm.bpe import read_ranks

    pieces = sentencepiece.SentencePieceProcessor(model_file=piece_model)
    ranks = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(rank_file), special_tokens={})
    is_byte = np.array([pieces.is_byte(k) for k in range(pieces.get_piece_size())])

    def encode(distinct: list[str]) -> list[bytes]:
        return [np.array(x, dtype="<u4").tobytes() for x in pieces.encode(distinct, num_threads=1)]

    def count(distinct: list[str]) -> list[bytes]:
        return [len(ranks.encode_ordinary(" " + w)).to_bytes(4, "little") for w in distinct]

    return Remembered(encode), Remembered(count), is_byte


def _evenness(ids: np.ndarray, offsets: np.ndarray, vocabulary: int) -> np.ndarray:
    """Entropy of each list's token distribution over the most that its length allows; 1 for less than two tokens."""
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    total = np.diff(offsets)
    seen, count = np.unique(rows * vocabulary + ids, return_counts=True)
    row = seen // vocabulary
    share = count / total[row]
    entropy = np.bincount(row, weights=-share * np.log2(share), minlength=len(total))
    return np.where(total > 1, entropy / np.log2(np.maximum(2, np.minimum(total, vocabulary))), 1.0)


def measure(docs: DataFrame, piece_model: str, rank_file: str, pattern: str, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Counts and fertility of every whole text, one row each: key, lang, the base counts and METRICS.

    Vocabularies see words, each with the space before it, so that white space between words doesn't count as tokens.
    A null text has no words; metrics of a text without words are null. A null language becomes 'und'.
    """
    ship(docs.sparkSession)
    vocabulary = 1 << 20
    numbers = ["n_words", "word_chars", "n_symbols", "n_repeat_words", "n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Remembered(word_codes)
        encode, count, is_byte = _vocabularies(piece_model, rank_file, pattern)
        for window in gathered(batches, "pieces", WINDOW):
            for part in slices(window, "pieces", WINDOW):
                pieces = Pieces(part.column("pieces"))
                at, index = pieces.offsets, pieces.index
                own = code(pieces.distinct).table(FIELDS).astype(np.int64)
                ids, offsets = pieces.coded(encode(pieces.distinct))
                tokens = np.diff(offsets)
                second = count(pieces.distinct).table(1)[:, 0].astype(np.int64)
                chars = sums(own[index, CHARS], at)
                with np.errstate(divide="ignore", invalid="ignore"):
                    found = (chars / tokens, chars / sums(second[index], at), sums(is_byte[ids].astype(np.int64), offsets) / tokens, _evenness(ids, offsets, vocabulary))
                none = tokens == 0
                values = [np.diff(at), chars, sums(own[index, SYMBOL], at), repeated_window_words(index, at), tokens]
                out = [part.column("key"), part.column("lang"), part.column("n_dup_lines"), *map(pa.array, values), *(pa.array(x, mask=none) for x in found)]
                yield pa.RecordBatch.from_arrays(out, ["key", "lang", "n_dup_lines", *numbers, *METRICS])

    kind = docs.schema[key].dataType.simpleString()
    lines = F.filter(F.split(text_or_empty(text), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), lines.alias("lines"), words(text).alias("pieces"))
    rows = rows.select("key", "lang", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "pieces")
    schema = f"key {kind}, lang string, n_dup_lines long, " + ", ".join(f"{x} long" for x in numbers) + ", " + ", ".join(f"{x} double" for x in METRICS)
    return rows.mapInArrow(tidy(run), schema).withColumnRenamed("key", key)


def bands(measured: DataFrame, p: Params) -> DataFrame:
    """lang, and for each metric the median and the reach below and above it, in bins, from exact histograms.

    Only rows that pass the base rules count, and quartiles hold as long as less than a quarter of them is junk on one
    side. One row a language comes out; evenness_sizes has the bands of the lengths that enough rows have. The histograms
    have p.bins bins a share, p.bins / 5 a character a token up to LINEAR ones and logarithmic ones beyond, without end.
    """
    every = [F.struct(F.lit(m).alias("metric"), F.lit(-1).alias("size"), _bin(m, p).alias("bin")) for m in METRICS]
    every.append(F.struct(F.lit("evenness").alias("metric"), _size().alias("size"), _bin("evenness", p).alias("bin")))
    counts = measured.where((F.col("n_tokens") > 0) & ~_failed(p)).select("lang", F.explode(F.array(*every)).alias("x")).groupBy("lang", "x.metric", "x.size", "x.bin").count()
    key = Window.partitionBy("lang", "metric", "size")
    ranked = counts.withColumn("upto", F.sum("count").over(key.orderBy("bin"))).withColumn("total", F.sum("count").over(key))
    quantile = {q: F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("bin"))) for q in (0.25, 0.5, 0.75)}
    wide = ranked.groupBy("lang", "metric", "size").agg(F.max("total").alias("total"), *[x.alias(f"q{round(100 * q)}") for q, x in quantile.items()])
    times = F.when(F.col("metric") == "evenness", p.even_reach).otherwise(p.reach)
    unit = F.when(F.col("metric").endswith("chars"), _per_one("chars", p)).otherwise(_per_one("share", p))
    few = F.sqrt(1 + p.enough / F.col("total"))
    reach = [few * F.greatest(unit * p.least, times * d) for d in (F.col("q50") - F.col("q25"), F.col("q75") - F.col("q50"))]
    wide = wide.where((F.col("size") < 0) | (F.col("total") >= p.enough)).select("lang", "metric", "size", F.struct(F.col("q50").alias("mid"), reach[0].alias("below"), reach[1].alias("above")).alias("band"))
    whole = [F.max(F.when((F.col("metric") == m) & (F.col("size") < 0), F.col("band"))).alias(f"{m}_band") for m in METRICS]
    sizes = F.collect_list(F.when(F.col("size") >= 0, F.struct("size", "band")))
    return wide.groupBy("lang").agg(*whole, F.map_from_entries(sizes).alias("evenness_sizes"))


def _per_one(metric: str, p: Params) -> int:
    """Bins of one character a token, or of a whole share."""
    return p.bins // 5 if metric.endswith("chars") else p.bins


def _bin(metric: str, p: Params) -> Column:
    even = F.floor(F.col(metric) * _per_one(metric, p))
    if not metric.endswith("chars"):
        return even.cast("int")
    top = LINEAR * _per_one(metric, p)
    return F.when(F.col(metric) <= LINEAR, even).otherwise(top + F.floor(top * F.log(F.col(metric) / LINEAR))).cast("int")


def _size() -> Column:
    """The length of a text as the whole logarithm of its tokens: an entropy's share falls as texts grow."""
    return F.floor(F.log2(F.greatest(F.col("n_tokens"), F.lit(1)))).cast("int")


def _failed(p: Params) -> Column:
    return (F.col("n_words") < p.min_words) | (100 * F.col("n_repeat_words") > p.max_repeat_percent * F.col("n_words"))


def judge(measured: DataFrame, bands: DataFrame, p: Params) -> DataFrame:
    """measured with base_failed, fertile (within all bands) and kept."""
    wider = F.sqrt(1 + p.slack / F.greatest(F.col("n_tokens"), F.lit(1)))
    fertile = F.lit(True)
    for m in METRICS:
        band = F.col(f"{m}_band")
        if m == "evenness":
            band = F.coalesce(F.try_element_at("evenness_sizes", _size()), band)
        mid, off = band["mid"], _bin(m, p) - band["mid"]
        if m != "fallback":
            fertile = fertile & (off >= -F.least(wider * band["below"], mid / 2))
        if m != "evenness":
            above = wider * band["above"]
            fertile = fertile & (off <= (above if m.endswith("chars") else F.least(above, (p.bins - mid) / 2)))
    joined = dim_join(measured, bands, ["lang"])
    joined = joined.withColumn("base_failed", _failed(p)).withColumn("fertile", F.coalesce(fertile, F.lit(False)))
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("fertile"))


def quality_rules(docs: DataFrame, piece_model: str, rank_file: str, pattern: str, p: Params = Params()) -> DataFrame:
    """Every document's counts, base_failed and kept. Rows are judged each for itself, repeated ones alike; other columns aren't carried."""
    measured = materialised(measure(docs, piece_model, rank_file, pattern), "fertility")
    judged = judge(measured, materialised(bands(measured, p), "bands"), p)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fertile", "n_tokens", *METRICS)
