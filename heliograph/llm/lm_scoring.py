"""Katz backoff language model: trained on part of the documents, scoring all.

A document is its words (A-Z lowered) and an end token. Counts r of pairs of
neighbours up to `k` get Good-Turing discounts d_r, and what they free goes to
unseen words by the backoff weight of the context:

    P(v | u) = d_r r / c(u)          if the pair was seen r times in training
             = alpha(u) P(v)         else
    P(v)     = d_c c / N             if the word was seen c times
             = the freed mass        for any unknown word, as one event
    alpha(u) = (1 - sum P(v | u)) / (1 - sum P(v)),  both over the seen v

so probabilities of all words and the unknown event sum to one for each context. A
context with nothing freed counts one more occurrence. An unknown context leaves P(v).

How it runs. Documents become chunks of about 700k tokens with a vocabulary of
their own. Chunk vocabularies, hashed to 64
bits, are summed in partitions by word; each chunk gets ids and counts of its words back.
Then each chunk sends its pairs, as compressed columns, to partitions by context:
there pair counts, discounts and backoff weights are made and every token is
evaluated, and sums go back by document. Contexts with more than a partition's share
are split by the following word; only their sums, as many as there are splits,
reach the driver. Everything is linear in the tokens, and nothing that
grows with the vocabulary is held in one place.

A chunk meets its words' answers, and its documents their sums, in a partition by a mix of its number, of
which there are as many as the tokens need: a task holds a few chunks, however large the splits that
documents are read in.

RDDs of packed columns are used, as one shuffle then serves both the counts of
counts and the scores; lost outputs are made anew from the documents. So the documents must come in the same
order each time they are read, as those of a table do; a frame that is the result of a shuffle is written
first (shared.written). Chunks are not written themselves: that would take 0.8 of the input in disk, and the
shuffles take 3.7 of the 4 allowed.

The order is two: of each word the one before it is the context, so backing off has one step. Triples would
carry a third column through the largest shuffle, 1.6 times the input as it is, and pass that limit.

Defined results: null or empty text is its end token alone; null ids are
trained on; an empty table, or one with no training documents, gives c = 0, N = 0
and the unknown event probability one; repeated rows and ids each get a row;
other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import xxhash
import zstandard
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import python_workers

END = b"\n"  # no word has white space


def planes(a: np.ndarray) -> bytes:
    """The bytes of 32-bit numbers, all least bytes first, compressed."""
    return zstandard.compress(np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(4, -1).T).reshape(-1).view("<u4")


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def chunks(docs: DataFrame, held: str, *, chunk_tokens: int, doc_id: str = "doc_id", text: str = "text") -> RDD:
    """Documents as Chunk rows. held: name of the boolean column that keeps a document out of training.

    Made anew, the same way, wherever it is read. Rows come straight to the one Python
    worker that cuts chunks and goes on with them, for the executor's memory.
    """
    return docs.select(F.col(doc_id), F.col(text), F.col(held)).rdd.mapPartitions(partial(_chunked, chunk_tokens))


def _chunked(chunk_tokens: int, rows: Iterator) -> Iterator:
    words, ids, out_of, counts, parts, size = _Words(), [], [], [], [], 0

    def row() -> tuple:
        hashes = np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), ">u8").astype("<u8")
        return ids, out_of, planes(np.array(counts)), hashes.tobytes(), planes(np.concatenate(parts))

    for d, t, h in rows:
        found = t.encode("utf-8", "replace").lower().split() if t else []
        found.append(END)
        ids.append(d)
        out_of.append(h)
        counts.append(len(found))
        parts.append(np.fromiter(map(words.__getitem__, found), np.uint32, len(found)))
        size += len(found)
        if size >= chunk_tokens:
            yield row()
            words, ids, out_of, counts, parts, size = _Words(), [], [], [], [], 0
    if ids:
        yield row()


class Chunk(NamedTuple):
    ids: list
    held: np.ndarray
    counts: np.ndarray
    words: np.ndarray
    tokens: np.ndarray

    @classmethod
    def of(cls, row) -> Chunk:
        return cls(row[0], np.array(row[1], bool), unplanes(row[2]).astype(np.int64), np.frombuffer(row[3], "<u8"), unplanes(row[4]).astype(np.int64))


def discounts(n: np.ndarray, k: int) -> np.ndarray:
    """d[r] for r = 0 ... k + 1 (d[k + 1]: all greater counts) from n[r] kinds seen r times, r = 1 ... k + 1.

    Too few kinds for k thresholds give fewer; with none valid nothing is discounted.
    """
    for most in range(k, 0, -1):
        r = np.arange(1, most + 1)
        if (n[1 : most + 2] > 0).all():
            a = (most + 1) * n[most + 1] / n[1]
            if a < 1:
                d = ((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a)
                if ((d > 0) & (d < 1)).all():
                    return np.concatenate([[1.0], d, np.ones(k + 1 - most)])
    return np.ones(k + 2)


class Unigrams(NamedTuple):
    total: int  # N
    kinds: int  # V
    d: np.ndarray
    scale: float
    unknown: float

    @classmethod
    def of(cls, total: int, kinds: int, n: np.ndarray, k: int) -> Unigrams:
        d = discounts(n, k)
        r = np.arange(len(n))
        free = float(((1 - d[1 : k + 1]) * r[1 : k + 1] * n[1 : k + 1]).sum()) / total if total else 1.0
        return cls(total, kinds, d, 1.0, free) if free > 0 else cls(total, kinds, d, total / (total + 1), 1 / (total + 1))

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.scale * self.d[np.minimum(c, len(self.d) - 1)] * c / max(1, self.total), self.unknown)


def _send_words(n_parts: int, index: int, rows: Iterator) -> Iterator:
    """(partition of words, (chunk's partition, chunk, hashes, training counts))"""
    for at, row in enumerate(rows):
        c = Chunk.of(row)
        train = np.repeat(~c.held, c.counts)
        count = np.bincount(c.tokens[train], minlength=len(c.words))
        to = (c.words % np.uint64(n_parts)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        for b, piece in _split(to[order], order):
            yield b, (index, at, c.words[piece].tobytes(), planes(count[piece]))


def _split(keys: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Runs of sorted keys."""
    cuts = np.flatnonzero(np.diff(keys)) + 1
    for part, first in zip(np.split(values, cuts), np.concatenate([[0], cuts]), strict=True):
        if len(part):
            yield int(keys[first]), part


def _sum_words(rows: Iterator) -> tuple[list, np.ndarray, np.ndarray, list[np.ndarray]]:
    pieces = sorted((x[1] for x in rows), key=lambda x: x[:2])
    hashes = [np.frombuffer(x[2], "<u8") for x in pieces]
    if not pieces:
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64), []
    known, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
    count = np.bincount(inverse, np.concatenate([unplanes(x[3]) for x in pieces]), len(known)).astype(np.int64)
    return pieces, count, inverse, np.split(inverse, np.cumsum([len(h) for h in hashes])[:-1])


def _word_stats(k: int, index: int, rows: Iterator) -> Iterator:
    _, count, _, _ = _sum_words(rows)
    kinds = np.bincount(np.minimum(count, k + 2), minlength=k + 3)[: k + 2]
    yield int(count.sum()), int((count > 0).sum()), kinds, [(index, len(count))]


def _answer_words(starts: dict[int, int], n_places: int, index: int, rows: Iterator) -> Iterator:
    """(place of a chunk, (chunk, partition of words, ids, counts)); ids of words that training has not are 0."""
    pieces, count, _, parts = _sum_words(rows)
    for x, at in zip(pieces, parts, strict=True):
        c = count[at]
        yield _place(x[0], x[1], n_places), ((x[0], x[1]), index, planes(np.where(c > 0, starts[index] + at + 1, 0)), planes(c))


def _place(part: int, at: int, n_places: int) -> int:
    """The partition in which a chunk, the at-th of a partition of documents, meets what belongs to it."""
    return int(_mix(np.array([part << 24 | at]))[0] % np.uint64(n_places))


def _own_chunks(n_places: int, index: int, rows: Iterator) -> Iterator:
    """Chunks on their way to where their words' answers go."""
    for at, row in enumerate(rows):
        yield _place(index, at, n_places), ((index, at), row)


def _together(rows: Iterator) -> Iterator:
    """(chunk's row, (ids, counts) of its words) of each chunk of a partition."""
    own, answers = {}, defaultdict(list)
    for _, x in rows:
        if len(x) == 2:
            own[x[0]] = x[1]
        else:
            answers[x[0]].append(x[1:])
    for key in sorted(own):
        pieces = sorted(answers.pop(key))
        yield key, (own.pop(key), (b"".join(unplanes(x[1]).tobytes() for x in pieces), b"".join(unplanes(x[2]).tobytes() for x in pieces)))


def _known(row, answer: tuple[bytes, bytes], n_parts: int) -> tuple[Chunk, np.ndarray, np.ndarray]:
    """The chunk, and of each of its words the id and the training count."""
    c = Chunk.of(row)
    order = np.argsort((c.words % np.uint64(n_parts)).astype(np.int64), kind="stable")
    ids, count = np.zeros(len(c.words), np.int64), np.zeros(len(c.words), np.int64)
    ids[order], count[order] = np.frombuffer(answer[0], "<u4"), np.frombuffer(answer[1], "<u4")
    return c, ids, count


def _contexts(c: Chunk, ids: np.ndarray, start: int) -> np.ndarray:
    """The id before each token; `start` before a document's first."""
    before = np.concatenate([[start], ids[c.tokens[:-1]]])
    before[np.cumsum(c.counts) - c.counts] = start
    return before


def _spread(count: np.ndarray, total: int, n_parts: int) -> np.ndarray:
    """Partitions over which a context with that count is split; together at most 4 n_parts more than contexts."""
    return np.minimum(n_parts, 1 + (4 * n_parts * count) // max(1, total))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(31))


def _send_pairs(u1: Unigrams, n_words: int, n_pairs: int, start: int, starts: int, rows: Iterator) -> Iterator:
    """(partition of contexts, (chunk, columns)): context, token, token's count, 4 document + 2 training + split."""
    for (index, at), (row, answer) in _together(rows):
        c, ids, count = _known(row, answer, n_words)
        u, v, cv = _contexts(c, ids, start), ids[c.tokens], count[c.tokens]
        cu = np.concatenate([[starts], cv[:-1]])
        cu[np.cumsum(c.counts) - c.counts] = starts
        doc = np.repeat(np.arange(len(c.counts)), c.counts)
        keep = np.flatnonzero(u > 0)
        u, v, cv, cu, doc = u[keep], v[keep], cv[keep], cu[keep], doc[keep]
        del keep
        over = _spread(cu, u1.total, n_pairs)
        tag = 4 * doc + 2 * ~c.held[doc] + (over > 1)
        del cu, doc
        to = ((_mix(u) + _mix(v + 1) % over.astype(np.uint64)) % np.uint64(n_pairs)).astype(np.int64)
        order = np.argsort(u << 32 | v, kind="stable")
        order = order[np.argsort(to[order], kind="stable")]
        for b, piece in _split(to[order], order):
            yield b, (index, at, planes(np.diff(u[piece], prepend=0)), planes(v[piece]), planes(cv[piece]), planes(tag[piece]))


class Pairs(NamedTuple):
    """The pairs of a partition of contexts: kinds in order of context and token, and the entries that name them."""

    pieces: list
    u: np.ndarray
    r: np.ndarray
    p1: np.ndarray
    split: np.ndarray
    kind: np.ndarray
    doc: np.ndarray
    piece: np.ndarray

    @classmethod
    def of(cls, u1: Unigrams, rows: Iterator) -> Pairs | None:
        pieces = sorted((x[1] for x in rows), key=lambda x: x[:2])
        if not pieces:
            return None
        u, v, cv, tag = ([unplanes(x[i]).astype(np.int64) for x in pieces] for i in (2, 3, 4, 5))
        piece = np.repeat(np.arange(len(pieces)), [len(x) for x in u])
        u, v, cv, tag = np.concatenate([np.cumsum(x) for x in u]), np.concatenate(v), np.concatenate(cv), np.concatenate(tag)
        key, first, kind = np.unique(u << 32 | v, return_index=True, return_inverse=True)
        r = np.bincount(kind, tag >> 1 & 1, len(key)).astype(np.int64)
        return cls(pieces, key >> 32, r, u1.p(cv[first]), (tag[first] & 1).astype(bool), kind, tag >> 2, piece)


def _pair_stats(u1: Unigrams, k: int, rows: Iterator) -> Iterator:
    """(kinds of pairs by their count, sums of each split context: by count 1 ... k, all greater, P of the seen tokens)."""
    x = Pairs.of(u1, rows)
    if x is None:
        yield np.zeros(k + 2, np.int64), {}
        return
    kinds = np.bincount(np.minimum(x.r, k + 2), minlength=k + 3)[: k + 2]
    at = np.flatnonzero(x.split & (x.r > 0))
    name, inverse = np.unique(x.u[at], return_inverse=True)
    sums = np.zeros((len(name), k + 2))
    np.add.at(sums, (inverse, np.minimum(x.r[at], k + 1) - 1), x.r[at])
    np.add.at(sums, (inverse, k + 1), x.p1[at])
    yield kinds, {int(u): s for u, s in zip(name, sums, strict=True)}


def _add_stats(a, b):
    out = dict(a[1])
    for u, s in b[1].items():
        out[u] = out[u] + s if u in out else s
    return a[0] + b[0], out


def _weights(sums: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each context, by its sums: (the divisor c(u), alpha(u))."""
    total = sums[:, :-1].sum(1)
    mass = sums[:, :-1] @ d[1:]
    divisor = np.where(total - mass <= 1e-9 * total, total + 1, total)
    return divisor, (1 - mass / divisor) / np.maximum(1 - sums[:, -1], 1e-300)


def _score_pairs(u1: Unigrams, d: np.ndarray, k: int, table, n_places: int, rows: Iterator) -> Iterator:
    """(place of a chunk, (chunk, documents, sums of log10 P))"""
    x = Pairs.of(u1, rows)
    if x is None:
        return
    name, at = np.unique(x.u, return_inverse=True)
    sums = np.zeros((len(name), k + 2))
    seen = x.r > 0
    np.add.at(sums, (at[seen], np.minimum(x.r[seen], k + 1) - 1), x.r[seen])
    np.add.at(sums, (at[seen], k + 1), x.p1[seen])
    divisor, alpha = _weights(sums, d)
    divisor[sums[:, :-1].sum(1) == 0], alpha[sums[:, :-1].sum(1) == 0] = 1, 1
    for i in np.unique(at[x.split]).tolist():
        divisor[i], alpha[i] = table.value.get(int(name[i]), (1.0, 1.0))
    p = np.where(seen, d[np.minimum(x.r, k + 1)] * x.r / divisor[at], alpha[at] * x.p1)
    log = np.log10(np.maximum(p, 1e-300))
    for i, (part, n) in enumerate((y[0], y[1]) for y in x.pieces):
        mine = slice(*np.searchsorted(x.piece, [i, i + 1]))
        doc = x.doc[mine]
        total = np.bincount(doc, log[x.kind[mine]])
        used = np.unique(doc)
        yield _place(part, n, n_places), ((part, n), used.astype("<u4").tobytes(), total[used].astype("<f8").tobytes())


def _documents(u1: Unigrams, n_words: int, start: int, n_places: int, rows: Iterator) -> Iterator:
    """(place of a chunk, per-document columns); score: of tokens after unknown words."""
    for (index, at), (row, answer) in _together(rows):
        c, ids, count = _known(row, answer, n_words)
        first = np.cumsum(c.counts) - c.counts
        cv = count[c.tokens]
        base = np.log10((cv + 0.5) / (u1.total + 0.5 * (u1.kinds + 1)))
        alone = np.where(_contexts(c, ids, start) > 0, 0.0, np.log10(np.maximum(u1.p(cv), 1e-300)))
        add = lambda x, first=first: np.add.reduceat(x, first)
        yield _place(index, at, n_places), ((index, at), c.ids, c.held.tolist(), c.counts.tolist(), add((cv > 0).astype(np.int64)).tolist(), add(base).tolist(), add(alone).tolist())


def _join(total: int, rows: Iterator) -> Iterator:
    docs, sums = {}, defaultdict(list)
    for _, x in rows:
        if len(x) == 3:
            sums[x[0]].append(x[1:])
        else:
            docs[x[0]] = x[1:]
    for key in sorted(docs):
        ids, held, n, known, base, score = docs[key]
        score = np.array(score)
        for used, s in sorted(sums[key]):
            score[np.frombuffer(used, "<u4")] += np.frombuffer(s, "<f8")
        yield from zip(ids, held, n, known, [total] * len(ids), base, score.tolist(), strict=True)


#: Columns after doc_id, which has the type of the input.
RESULT = "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _as_is(x: int) -> int:
    return x


def _dealt(rdd: RDD, n: int) -> RDD:
    return rdd.partitionBy(n, _as_is)


def _side_by_side(a: RDD, b: RDD, n: int) -> RDD:
    """Both dealt by their keys, with each key's elements in one partition. Spark lays
    equally dealt RDDs side by side, so a task has one Python worker."""
    x, y = _dealt(a, n), _dealt(b, n)
    out = x.union(y)
    return out if out.getNumPartitions() == x.getNumPartitions() else _dealt(a.union(b), n)


def katz_scores(docs: DataFrame, held: str, *, k: int = 5, chunk_tokens: int = 700_000, part_tokens: int = 1_200_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and RESULT for every document; rows whose boolean column `held` is true are not trained on."""
    spark = docs.sparkSession
    python_workers(spark, 500)
    result = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, {RESULT}"
    shape = docs.agg(F.count("*").alias("docs"), F.count(F.when(~F.col(held), 1)).alias("trained"), F.sum(F.octet_length(F.col(text))).alias("bytes")).first()
    if not shape["docs"]:
        return spark.createDataFrame([], result)
    rows = chunks(docs, held, chunk_tokens=chunk_tokens, doc_id=doc_id, text=text)
    fewest = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def dealt(rdd: RDD, n: int, make) -> tuple[RDD, int]:
        """make(n) of rdd by its keys over n partitions, or as many as the session deals to."""
        out = _dealt(make(n), n)
        more = out.getNumPartitions()
        return (out, n) if more == n else (_dealt(make(more), more), more)

    words, n_words = dealt(rows, max(fewest, -(-(shape["bytes"] or 0) // (20 * part_tokens))), lambda n: rows.mapPartitionsWithIndex(partial(_send_words, n)))
    total, kinds, n, sizes = words.mapPartitionsWithIndex(partial(_word_stats, k)).reduce(lambda a, b: (a[0] + b[0], a[1] + b[1], a[2] + b[2], a[3] + b[3]))
    starts, at = {}, 0
    for i, size in sorted(sizes):
        starts[i], at = at, at + size
    u1, start = Unigrams.of(total, kinds, n, k), at + 1
    tokens = max(total, 1) * 5 // 4
    # A few chunks in each place.
    n_places = max(fewest, -(-tokens // (4 * chunk_tokens)))
    answers = words.mapPartitionsWithIndex(partial(_answer_words, starts, n_places))
    both = _side_by_side(answers, rows.mapPartitionsWithIndex(partial(_own_chunks, n_places)), n_places)

    pairs, n_pairs = dealt(both, max(fewest, -(-tokens // part_tokens)), lambda n: both.mapPartitions(partial(_send_pairs, u1, n_words, n, start, shape["trained"])))
    kinds_by_count, split = pairs.mapPartitions(partial(_pair_stats, u1, k)).treeReduce(_add_stats)
    d = discounts(kinds_by_count, k)
    names = sorted(split)
    divisor, alpha = _weights(np.array([split[u] for u in names]).reshape(-1, k + 2), d)
    weights = spark.sparkContext.broadcast(dict(zip(names, zip(divisor.tolist(), alpha.tolist(), strict=True), strict=True)))
    scores = pairs.mapPartitions(partial(_score_pairs, u1, d, k, weights, n_places))
    per_chunk = both.mapPartitions(partial(_documents, u1, n_words, start, n_places))
    joined = _side_by_side(per_chunk, scores, n_places).mapPartitions(partial(_join, total))
    return spark.createDataFrame(joined, result)
