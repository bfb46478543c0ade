"""Token ids as files: frequency-ranked, byte-aligned, with separate control bytes.

An id is replaced by its rank in the corpus (0: most frequent; ties by id). A
rank takes one to four bytes, least first; the number of bytes less one is a
two-bit code, four to a control byte, and control bytes stand apart from data
bytes. Each document starts a new control byte. The decoder looks control bytes
up in a 256-row table of lengths and takes all ranks of a block at once.

A file is a row group table of blocks: documents in ascending id order, with
ids, token counts, control and data bytes of about `block_tokens` tokens. Spark's
writer commits the files, so a retried task leaves no second copy, and any store
that Spark writes to can hold them. The rank table is a file of its own.

Defined results: null or empty text is its end id alone; null ids come first;
equal ids are ordered by their number of tokens, then as they come; equal rows and null
ids are split over files like any others; ids are whole numbers of at most 64 bits, and any
other type is an error before anything runs; an empty table gives empty files; other
columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from . import tokens
from .shared import python_workers, shared_dir, written

#: Bytes of the four ranks that a control byte describes.
LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)
BLOCK = "part int, block int, part_start long, n_tokens long, doc_ids binary, nulls binary, counts binary, control binary, data binary"


class Encoded(NamedTuple):
    control: bytes
    data: bytes


def encode(ranks: np.ndarray, counts: np.ndarray) -> Encoded:
    """Documents on end: all their ranks, and how many each has."""
    ranks = ranks.astype("<u4")
    size = 1 + (ranks > 0xFF).astype(np.int64) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    slot, words = _slots(counts)
    codes = np.zeros(4 * words, np.uint8)
    codes[slot] = size - 1
    control = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return Encoded(control.tobytes(), data.tobytes())


def _slots(counts: np.ndarray) -> tuple[np.ndarray, int]:
    """Each rank's code among all codes, and the number of control bytes."""
    words = -(-counts // 4)
    first = 4 * (np.cumsum(words) - words)
    return np.arange(int(counts.sum())) + np.repeat(first - (np.cumsum(counts) - counts), counts), int(words.sum())


def decode(control: bytes, data: bytes, counts: np.ndarray) -> np.ndarray:
    """The ranks of all documents on end."""
    slot, _ = _slots(counts)
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[slot]
    out = np.zeros((len(size), 4), np.uint8)
    out[np.arange(4) < size[:, None]] = np.frombuffer(data, np.uint8)
    return out.reshape(-1).view("<u4")


def tokenized(docs: DataFrame, tokenizer: str, *, end: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n, ids, row: little-endian unsigned 32-bit ids, or 16-bit where the vocabulary allows; row numbers the documents."""
    if not isinstance(docs.schema[doc_id].dataType, IntegralType):
        raise TypeError(f"{doc_id} holds {docs.schema[doc_id].dataType.simpleString()}: the files keep ids as 64-bit numbers")
    python_workers(docs.sparkSession)
    kind = _width(tokenizer)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokens.loaded(tokenizer, spaced=False)
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in tokens.text_slices(texts):
                flat, sizes = tokens.with_end(*t.ids(texts[a:b]), end)
                row = pa.array(np.arange(number, number + b - a), pa.int64())
                number += b - a
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(sizes, pa.int64()), _cells(flat.astype(kind), sizes), row], ["doc_id", "n", "ids", "row"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(make, "doc_id long, n long, ids binary, row long")


def _cells(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A cell of bytes for each document of a run, over the ids' own buffer."""
    ends = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=ends[1:])
    cells = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends * flat.itemsize), pa.py_buffer(flat)])
    return cells.cast(pa.binary())


def _flat(cells: pa.Array, kind: np.dtype) -> np.ndarray:
    """The ids of all cells on end, without a copy."""
    offsets = np.frombuffer(cells.buffers()[1], np.int32)[cells.offset : cells.offset + len(cells) + 1]
    return np.frombuffer(cells.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind) if len(cells) and offsets[-1] > offsets[0] else np.zeros(0, kind)


def _width(tokenizer: str) -> np.dtype:
    from tokenizers import Tokenizer

    return np.dtype("<u2" if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else "<u4")


def id_counts(ids: DataFrame, kind: np.dtype) -> list[tuple[int, int]]:
    """(id, occurrences), most frequent first: as many rows as the vocabulary has at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            c = np.bincount(_flat(batch.column(0), kind), minlength=len(total))
            c[: len(total)] += total
            total = c
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "c"])

    counts = ids.select("ids").mapInArrow(count, "id long, c long").groupBy("id").agg(F.sum("c").alias("c"))
    return sorted(((r["id"], r["c"]) for r in counts.collect()), key=lambda x: (-x[1], x[0]))


def write_files(docs: DataFrame, tokenizer: str, path: str, *, end: int = 1, block_tokens: int = 1 << 20, **columns) -> None:
    """`path`/blocks and `path`/ranks."""
    spark, kind = docs.sparkSession, _width(tokenizer)
    ids = written(tokenized(docs, tokenizer, end=end, **columns), "ids")
    order = [i for i, _ in id_counts(ids, kind)]
    rank_of = np.zeros(max(order, default=0) + 1, np.uint32)
    rank_of[order] = np.arange(len(order))

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, start = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []
        held_tokens = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, start, held, held_tokens
            docs_, n, raw = zip(*held, strict=True)
            e = encode(rank_of[np.frombuffer(b"".join(raw), kind)], np.array(n, np.int64))
            row = [part, number, start, held_tokens, np.array([d or 0 for d in docs_], "<i8").tobytes(), bytes(d is None for d in docs_), np.array(n, "<u4").tobytes(), e.control, e.data]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
            number, start, held, held_tokens = number + 1, start + held_tokens, [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], [c.split()[0] for c in BLOCK.split(", ")])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                held_tokens += row[1]
                if held_tokens >= block_tokens:
                    yield flush()
        if held:
            yield flush()

    # The row number splits a range of equal ids, even of equal rows.
    order_by = [F.col("doc_id").asc_nulls_first(), F.col("n"), F.col("row")]
    in_order = ids.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    in_order.select("doc_id", "n", "ids").mapInArrow(block, BLOCK).write.option("compression", "zstd").parquet(f"{path}/blocks")
    spark.createDataFrame([(np.array(order, "<u4").tobytes(),)], "ids binary").coalesce(1).write.parquet(f"{path}/ranks")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit), ids_crc32 of every document."""
    order = np.frombuffer(spark.read.parquet(f"{path}/ranks").first()[0], "<u4")
    blocks = spark.read.schema(BLOCK).parquet(f"{path}/blocks")
    # One row a part: as many as the write had partitions.
    w = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    placed = blocks.join(F.broadcast(parts), "part").select((F.col("before") + F.col("part_start")).alias("start"), "doc_ids", "nulls", "counts", "control", "data")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, doc_ids, nulls, counts, control, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = np.frombuffer(counts, "<u4").astype(np.int64)
                raw = order[decode(control, data, n)].astype("<u4").tobytes()
                ends = np.cumsum(n)
                rows = [raw[4 * i : 4 * j] for i, j in zip((ends - n).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.frombuffer(doc_ids, "<i8"), pa.int64(), mask=np.frombuffer(nulls, np.uint8).astype(bool)),
                        pa.array(start + ends - n, pa.int64()),
                        pa.array(n, pa.int64()),
                        pa.array(rows, pa.binary()),
                        pa.array([zlib.crc32(r) for r in rows], pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids", "ids_crc32"],
                )

    return placed.mapInArrow(take, "doc_id long, start long, n_tokens long, ids binary, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write `docs` as files in the shared folder and read them back."""
    path = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_files(docs, tokenizer, path, **options)
    return read_files(docs.sparkSession, path)
