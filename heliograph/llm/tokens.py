"""Exact token ids of whole texts, with bounded caches of text chunks and words.

A pre-tokenizer never lets a token cross a single space between two other
characters, so the ids of a text are those of its space-separated chunks in
order. Arrow splits a batch and numbers its distinct chunks; each is looked up once,
and the texts are put together from the cached ids with numpy. A new chunk that
is a word of Latin letters with at most one mark after it is two pre-tokens, so
its word is looked up by itself; anything else, and each new word, is encoded by
the tokenizers library. Texts for which the rule could fail are encoded whole.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks, and words, kept by a worker, about 150 bytes each; beyond, the caches start anew.
CACHE_CHUNKS = 700_000
#: A word of letters that lower-casing and normal forms treat one by one, and a run of marks.
LETTERS = r"[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+"
PLAIN = re.compile(rf"([ \n]?{LETTERS})([!-/:-@\[-`{{-~]*)")
WORD = re.compile(rf"[ \n]?{LETTERS}")
#: Stands for a line break while a batch is split; of private use, and a text that has it is encoded whole.
LINE = "\ue000"

_loaded: dict[tuple[str, bool], ChunkTokenizer] = {}


class _Index(dict):
    """chunk -> its number; a new chunk gets the next one and is noted as pending."""

    def __init__(self) -> None:
        super().__init__()
        self.pending: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = n = len(self)
        self.pending.append(chunk)
        return n


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: itself if printable in Latin-1, else the next from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return {b: chr(b if b in plain else next(rest)) for b in range(256)}


class _Lists:
    """Numbered lists of ids, on end in one array that grows."""

    def __init__(self) -> None:
        self.n = self.used = 0
        self.sizes, self.starts, self.flat = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.uint32)

    def append(self, sizes: np.ndarray, flat: np.ndarray) -> None:
        while self.n + len(sizes) > len(self.sizes):
            self.sizes, self.starts = np.concatenate([self.sizes, 0 * self.sizes]), np.concatenate([self.starts, 0 * self.starts])
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, 0 * self.flat])
        self.sizes[self.n : self.n + len(sizes)] = sizes
        self.starts[self.n : self.n + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : self.used + len(flat)] = flat
        self.n, self.used = self.n + len(sizes), self.used + len(flat)

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of lists `at` on end, where each ends, from 0 on)."""
        sizes = self.sizes[at]
        ends = np.zeros(len(at) + 1, np.int32 if len(at) < 1 << 24 else np.int64)
        np.cumsum(sizes, out=ends[1:])
        return self.flat[np.repeat(self.starts[at] - ends[:-1], sizes) + np.arange(int(ends[-1]), dtype=ends.dtype)], ends


class ChunkTokenizer:
    """chunk -> one or two units (a pre-tokenized word and its marks, or anything else whole) -> ids."""

    def __init__(self, path: str, spaced: bool) -> None:
        """spaced: a chunk takes the space before it along, as byte-level BPE does; else white space
        only separates and case is lowered."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.spaced, self.letters = Tokenizer.from_file(path), spaced, _byte_letters()
        self.newline = self._encode(["\n"])[0]
        self._reset()

    def _reset(self) -> None:
        self.index, self.units = _Index(), _Index()
        self.chunk_ids, self.unit_ids = _Lists(), _Lists()

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _encode_units(self, units: list[str]) -> list[list[int]]:
        """A word goes to the model as the letters of its bytes; other units take the whole way."""
        model, letters, newline = self.tokenizer.model.tokenize, self.letters, self.newline

        def word(u: str) -> list[int]:
            if u[0] == "\n":
                return newline + word(u[1:])
            return [t.id for t in model(u if u.isascii() and u[0] != " " else u.encode().decode("latin-1").translate(letters))]

        out: list = [word(u) if WORD.fullmatch(u) else None for u in units]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(rest, self._encode([units[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def _fill(self) -> None:
        new, self.index.pending = self.index.pending, []
        if not new:
            return
        unit, plain, lower = self.units.__getitem__, PLAIN.fullmatch, not self.spaced
        pairs, none = [], unit("")
        for chunk in new:
            if m := plain(chunk):
                word, marks = m.groups()
                word = word.lower() if lower else word
                # A word alone shares its text with the chunk.
                pairs.append(unit(chunk if word == chunk else word))
                pairs.append(unit(marks) if marks else none)
            else:
                pairs += (unit(chunk), none)
        missing, self.units.pending = self.units.pending, []
        encoded = self._encode_units(missing)
        sizes = np.fromiter(map(len, encoded), np.int32, len(missing))
        self.unit_ids.append(sizes, np.fromiter(chain.from_iterable(encoded), np.uint32, int(sizes.sum())))
        flat, ends = self.unit_ids.take(np.array(pairs, np.int32))
        self.chunk_ids.append(np.diff(ends[::2]), flat)

    def ids(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts on end as uint32, number of ids of each text)."""
        if len(self.index) > CACHE_CHUNKS or len(self.units) > CACHE_CHUNKS:
            self._reset()
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        whole = np.zeros(0, np.int64)
        if self.spaced:
            has = lambda x: pc.match_substring(texts, x)
            odd = pc.or_(pc.or_(has("  "), has("<|")), has(LINE))
            whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
            # A lone line break is a token of its own, and what follows it begins a chunk.
            lines = pc.invert(pc.or_(pc.or_(has("\n\n"), has("\n ")), has(" \n")))
            texts_ = pc.if_else(lines, pc.replace_substring(texts, "\n", " " + LINE), texts)
            texts_ = pc.if_else(odd, "", texts_) if len(whole) else texts_
        else:
            texts_ = pc.replace_substring(texts, "\n", " ")
        parts = pc.split_pattern(texts_, pattern=" ")
        counts = parts.value_lengths().to_numpy().astype(np.int64)
        coded = parts.flatten().dictionary_encode()
        code, chunks = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        number = self.index.__getitem__
        if self.spaced:
            at = np.fromiter((number("\n" + c[1:] if c[:1] == LINE else " " + c) for c in chunks), np.int32, len(chunks))[code]
            first = np.cumsum(counts) - counts
            leading, inverse = np.unique(code[first], return_inverse=True)
            at[first] = np.fromiter((number(chunks[i]) for i in leading), np.int32, len(leading))[inverse]
        else:
            at = np.fromiter(map(number, chunks), np.int32, len(chunks))[code]
        self._fill()
        flat, ends = self.chunk_ids.take(at)
        ends = ends[np.concatenate([[0], np.cumsum(counts)])].astype(np.int64)
        if not len(whole):
            return flat, np.diff(ends)
        out = np.split(flat, ends[1:-1])
        for i, ids in zip(whole.tolist(), self._encode([texts[i].as_py() for i in whole.tolist()]), strict=True):
            out[i] = np.array(ids, np.uint32)
        return np.concatenate(out), np.array([len(x) for x in out], np.int64)


def with_end(flat: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's ids followed by `end`."""
    return np.insert(flat, np.cumsum(sizes), np.uint32(end)), sizes + 1


def loaded(path: str, spaced: bool) -> ChunkTokenizer:
    """The tokenizer of this worker process, with the cache that it has so far."""
    if (path, spaced) not in _loaded:
        _loaded[path, spaced] = ChunkTokenizer(path, spaced)
    return _loaded[path, spaced]


def emptied() -> None:
    """Frees what this worker keeps from tokenizing, for a stage that needs none of it; the tokenizers stay."""
    for t in _loaded.values():
        if len(t.index):
            t._reset()


def text_slices(texts: pa.Array, most_bytes: int = 12_000_000):
    """(from, to) of runs of texts that hold about most_bytes together."""
    begin = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        size += n
        if size >= most_bytes:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)
