"""Packing into token windows by Karmarkar-Karp multiway differencing.

A document is its token ids and an end id. What fills a whole window becomes one
and meets no other piece; the rest is cut into pieces of at most `most_piece` ids. Pieces are
dealt by a hash of their number into groups of about `group_windows` windows, so equal
rows spread like any others, and in each group k-way
largest differencing balances them: partial partitions wait in a heap by their
imbalance, and the two worst are merged with opposing orders, fullest with
emptiest, until one is left. k starts at the fewest windows that can hold the group
and rises by one while the fullest exceeds the capacity.

Tokenizing runs once: pieces, numbered, go to a table in the shared folder before grouping, so a
task that is run again deals the same ones.

Defined results: null or empty text is its end id alone; null and repeated ids
are documents like any other, ids keep their type, of whatever it is; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .shared import python_workers, written

#: Columns after doc_id, which has the type of the input. `row` numbers the pieces.
PIECES = "start long, length long, ids_crc32 long, doc_tokens long, row long"
PACKED = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Sequence ids of whole windows are a piece's number above this; those of groups are below.
WHOLE = 1 << 61


def cut(n: int, capacity: int, most_piece: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole windows, then near-equal parts of the rest."""
    whole = n // capacity
    out = [(i * capacity, capacity) for i in range(whole)]
    rest = n - whole * capacity
    parts = -(-rest // most_piece)
    at = whole * capacity
    for i in range(parts):
        size = rest // parts + (i < rest % parts)
        out.append((at, size))
        at += size
    return out


def pieces(docs: DataFrame, tokenizer: str, *, end: int = 1, capacity: int = 2048, most_piece: int = 512, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    python_workers(docs.sparkSession)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokens.loaded(tokenizer, spaced=True)
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in tokens.text_slices(texts):
                flat, sizes = tokens.with_end(*t.ids(texts[a:b]), end)
                raw, out = memoryview(flat.astype("<u4").tobytes()), []
                at = 0
                for d, n in enumerate(sizes.tolist(), a):
                    out += [(d, s, m, zlib.crc32(raw[4 * (at + s) : 4 * (at + s + m)]), n) for s, m in cut(n, capacity, most_piece)]
                    at += n
                owner, *cols = (pa.array(c, pa.int64()) for c in zip(*out, strict=True))
                rows = pa.array(np.arange(number, number + len(out)), pa.int64())
                number += len(out)
                yield pa.RecordBatch.from_arrays([ids.take(owner), *cols, rows], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "row"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(make, f"doc_id {kind}, {PIECES}")


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp: item numbers of k parts with near-equal sums."""
    if k == 1:
        return [[*range(len(sizes))]]
    heap, tie = [], 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        # A partial partition: sums above its least one, descending; the parts themselves as linked lists.
        heap.append((-sizes[i], tie, np.array([sizes[i], *[0] * (k - 1)]), [(i, None), *[None] * (k - 1)]))
        tie += 1
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, s, p = heapq.heappop(heap)
        _, _, u, q = heapq.heappop(heap)
        sums = s + u[::-1]
        parts = [x if y is None else y if x is None else (x, y) for x, y in zip(p, reversed(q), strict=True)]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        heapq.heappush(heap, (-int(sums[0] - sums[-1]), tie, sums - sums[-1], [parts[i] for i in order]))
        tie += 1
    return [_items(p) for p in heap[0][3]] if heap else [[] for _ in range(k)]


def _items(part) -> list[int]:
    out, stack = [], [part]
    while stack:
        x = stack.pop()
        if isinstance(x, int):
            out.append(x)
        elif x is not None:
            stack += x
    return sorted(out)


def balance(sizes: list[int], capacity: int) -> list[list[int]]:
    """Parts with near-equal sums of at most `capacity` each; every size is at most the capacity."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        parts = differencing(sizes, k)
        if max(sum(sizes[i] for i in p) for p in parts) <= capacity:
            return [p for p in parts if p]
        k += 1


def pack(docs: DataFrame, tokenizer: str, *, end: int = 1, capacity: int = 2048, most_piece: int = 512, group_windows: int = 64, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id and PACKED. sequence_id is unique, offset gapless from 0 in it."""
    cutted = written(pieces(docs, tokenizer, end=end, capacity=capacity, most_piece=most_piece, doc_id=doc_id, text=text), "pieces")
    part = cutted.where(F.col("length") < capacity)
    total = part.agg(F.sum("length")).first()[0] or 0
    groups = max(1, round(total / (group_windows * capacity)))
    whole = cutted.where(F.col("length") == capacity).withColumns({"sequence_id": F.col("row") + F.lit(WHOLE), "offset": F.lit(0).cast("long")}).drop("row")

    def fill(group: pa.Table) -> pa.Table:
        tokens.emptied()
        group = group.sort_by("row")
        sizes = group.column("length").to_numpy()
        seq, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for n, p in enumerate(balance(sizes.tolist(), capacity)):
            seq[p], offset[p] = n, np.cumsum(sizes[p]) - sizes[p]
        seq += group.column("g")[0].as_py() << 32
        return group.drop_columns(["row", "g"]).append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(offset))

    kind = cutted.schema["doc_id"].dataType.simpleString()
    dealt = part.withColumn("g", F.pmod(F.xxhash64("row"), F.lit(groups)))
    return dealt.groupBy("g").applyInArrow(fill, f"doc_id {kind}, {PACKED}").unionByName(whole)
