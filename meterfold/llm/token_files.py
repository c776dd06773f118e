"""Token ids as binary files of independent zstandard frames with a trailing seek table.

A file holds, one after the other:

* for each document one zstandard frame of its ids, little-endian unsigned 32-bit integers;
* a skippable frame (magic 0x184D2A50) with the documents' keys, little-endian signed 64-bit integers, the smallest
  value standing for null;
* a skippable frame (magic 0x184D2A5E) with the seek table of the public seekable format: for each frame its compressed
  size, its size and the lower 32 bits of the XXH64 of its ids, then the number of frames, a flag byte and 0x8F92EAB1.

Any zstandard tool can unpack a file as a whole. A reader that wants some documents reads the tables at the end and
unpacks their frames only, checking each frame's checksum.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterfold.llm.bpe import pre_tokens
from meterfold.llm.common import ship, text_or_empty, whole_numbers
from meterfold.llm.ragged import Pieces, Remembered, gathered, slices, tidy

#: Fixed values of the public zstandard seekable format, and the skippable frame for keys.
SEEK_MAGIC, SEEKABLE, KEY_MAGIC = 0x184D2A5E, 0x8F92EAB1, 0x184D2A50
ENTRY, FOOTER = struct.Struct("<III"), struct.Struct("<IBI")
NO_KEY = -(1 << 63)
#: Pieces that a task looks at together, and distinct ones whose ids a worker remembers.
WINDOW, KNOWN = 1_500_000, 500_000
FILE_FIELDS = "part int, path string, n_docs long, n_ids long, n_bytes long"


class FileWriter:
    """Writes documents' ids one at a time; nothing but the tables stays in memory."""

    def __init__(self, out, level: int = 3):
        self.out, self.packer = out, zstandard.ZstdCompressor(level=level)
        self.keys, self.entries, self.n_ids, self.n_bytes = [], [], 0, 0

    def add(self, key: int | None, ids: bytes) -> None:
        frame = self.packer.compress(ids)
        self.out.write(frame)
        self.keys.append(NO_KEY if key is None else key)
        self.entries.append(ENTRY.pack(len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF))
        self.n_ids += len(ids) // 4
        self.n_bytes += len(frame)

    def close(self) -> None:
        keys = np.array(self.keys, dtype="<i8").tobytes()
        table = b"".join(self.entries) + FOOTER.pack(len(self.entries), 0x80, SEEKABLE)
        tail = struct.pack("<II", KEY_MAGIC, len(keys)) + keys + struct.pack("<II", SEEK_MAGIC, len(table)) + table
        self.out.write(tail)
        self.n_bytes += len(tail)
        self.out.close()


class FileReader:
    """The tables of one file, and the frames of the documents asked for."""

    def __init__(self, source, size: int):
        self.source = source
        count, flags, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != SEEKABLE or not flags & 0x80:
            raise ValueError("the file has no seek table")
        start = size - FOOTER.size - count * ENTRY.size
        self.entries = np.frombuffer(self._at(start, count * ENTRY.size), dtype="<u4").reshape(count, 3)
        self.keys = np.frombuffer(self._at(start - 8 - 8 * count, 8 * count), dtype="<i8")
        self.starts = np.cumsum(self.entries[:, 0], dtype=np.int64) - self.entries[:, 0]
        self.first = np.cumsum(self.entries[:, 1], dtype=np.int64) // 4 - self.entries[:, 1] // 4
        self.unpacker = zstandard.ZstdDecompressor()

    def _at(self, start: int, size: int) -> bytes:
        self.source.seek(start)
        return self.source.read(size)

    def ids(self, k: int) -> bytes:
        packed, size, checksum = map(int, self.entries[k])
        data = self.unpacker.decompress(self._at(int(self.starts[k]), packed), max_output_size=size) if size else b""
        if len(data) != size or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {k} doesn't match its checksum")
        return data


@lru_cache(maxsize=2)
def library(tokenizer_file: str):
    """The tokenizers library's encoder of distinct pre-tokens, and of texts that hold a special string."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file)

    def encode(pieces: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    return encode, Remembered(encode, limit=KNOWN)


def special_strings(tokenizer_file: str) -> list[str]:
    from tokenizers import Tokenizer

    return [t.content for t in Tokenizer.from_file(tokenizer_file).get_added_tokens_decoder().values()]


def write(docs: DataFrame, tokenizer_file: str, pattern: str, folder: str, end_id: int | None = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode docs with a byte-level tokenizers file, and write the ids in ascending order of key, a column of whole numbers.

    Returns one row a file (part, path, n_docs, n_ids, n_bytes), read from the index that lies beside the files; parts
    are in key order. A null text counts as empty, null keys come first, rows of equal keys are in the order of their
    texts' hashes; other columns aren't carried. Pre-tokens are split by pattern, as the library would, and the library
    encodes each distinct one of a window; a text with one of its special strings goes to the library whole. A task writes under
    a name of its own attempt and renames at its end, so that a repeated task leaves one whole file; the files that
    count are those in the index.
    """
    spark = docs.sparkSession
    ship(spark)
    whole_numbers(docs, key)
    specials = special_strings(tokenizer_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, distinct = library(tokenizer_file)
        end = b"" if end_id is None else end_id.to_bytes(4, "little")
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        part = TaskContext.get().partitionId()
        name, out = f"{base}/.{part}-{uuid.uuid4().hex}", None
        for window in gathered(batches, "pieces", WINDOW):
            pieces = Pieces(window.column("pieces"))
            codes, at = distinct(pieces.distinct), 0
            for rows in slices(window, "pieces"):
                if out is None:
                    out = FileWriter(fs.open_output_stream(name))
                values, offsets = pieces.part(at, rows.num_rows).coded(codes)
                at += rows.num_rows
                for k, (doc, own) in enumerate(zip(rows.column("key").to_pylist(), rows.column("special").to_pylist(), strict=True)):
                    ids = whole([own])[0] if own is not None else values[offsets[k] : offsets[k + 1]].tobytes()
                    out.add(doc, ids + end)
        if out is not None:
            out.close()
            path = f"{base}/part-{part:06d}.zst"
            fs.move(name, path)
            done = [part], [path], [len(out.keys)], [out.n_ids], [out.n_bytes]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(done, (pa.int32(), pa.string(), *[pa.int64()] * 3), strict=True)], ["part", "path", "n_docs", "n_ids", "n_bytes"])

    rows = docs.select(F.col(key).cast("long").alias("key"), text_or_empty(text).alias("text"))
    # equal rows may stand in any order, so that many of them can be split over files by where they come from
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("copy", F.monotonically_increasing_id())
    rows = rows.repartitionByRange("key", "tie", "copy").sortWithinPartitions("key", "tie", "copy")
    special = F.lit(False)
    for s in specials:
        special = special | F.col("text").contains(s)
    pieces = F.when(special, F.array().cast("array<string>")).otherwise(pre_tokens(pattern))
    rows = rows.select("key", F.when(special, F.col("text")).alias("special"), pieces.alias("pieces"))
    rows.mapInArrow(tidy(run), FILE_FIELDS).write.parquet(f"{folder}/_index")
    return spark.read.schema(FILE_FIELDS).parquet(f"{folder}/_index")


def read(files: DataFrame, folder: str, only: list[int] | None = None) -> DataFrame:
    """Documents of files as write() returns them: doc_id, start, n_tokens, ids (little-endian 32-bit integers).

    start counts the ids of all documents before it, over all files. only: the keys to read, a short list; other
    documents' frames aren't touched. The running sum over files is one small row a file.
    """
    ship(files.sparkSession)
    wanted = None if only is None else np.array(sorted(set(only)), dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                fs, _ = pafs.FileSystem.from_uri(folder)
                with fs.open_input_file(path) as source:
                    reader = FileReader(source, source.size())
                    chosen = range(len(reader.keys)) if wanted is None else np.flatnonzero(np.isin(reader.keys, wanted)).tolist()
                    rows, held = [], 0
                    for n, k in enumerate(chosen, 1):
                        ids = reader.ids(k)
                        doc = int(reader.keys[k])
                        rows.append((None if doc == NO_KEY else doc, base + int(reader.first[k]), len(ids) // 4, ids))
                        held += len(ids)
                        if held > 8 << 20 or n == len(chosen):
                            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "start", "n_tokens", "ids"])
                            rows, held = [], 0

    base = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = files.withColumn("base", F.coalesce(base, F.lit(0))).select("path", "base", "part")
    tasks = max(1, min(files.count(), 10_000))
    return parts.repartition(tasks, "part").select("path", "base").mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids binary")


def with_checksum(docs: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of each document's ids."""
    return docs.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
