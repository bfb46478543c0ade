"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text accepts every substring of
it. A text is parsed by each automaton into longest matches; a language whose
text resembles it needs few phrases. A phrase costs log2 of the automaton's text
length in bits, and the language with the fewest bits per symbol wins.

Symbols are lower-cased letters, with one space for any run of others. A text is
parsed whole, by numpy: its stretches of `stretch` symbols first run side by side, each as if a
phrase began there; then each runs again from the state that the one before it ends in, until
it meets the states of the first run, and so on until nothing changes. The phrases are those
of one pass over the text.

An automaton's transitions are a table of states by the letters of its own sample while that has
at most `CELLS` cells, and sorted pairs of state and letter beyond (many letters); both give the same.

The automata learn a documented sample: about `most_docs` labelled documents of each language, those
with the lowest hash of the id, and at most `sample_chars` symbols of these, of a longer text its
beginning; predictions read every text whole.

Defined results: text that is null or has no letter gives `und` with score 0.0;
so does all text if nothing can be learned; ties go to the language with more
labelled documents, then by name; null labels and ids teach nothing; repeated
rows each get a row; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import python_workers, held_out_fold

NEW = 1 << 30  # flag: this symbol begins a phrase
PAD, OTHER = 0, 1
#: Most cells of a table, of 4 bytes each.
CELLS = 1 << 22

_folded: list[np.ndarray] = []
_tables: dict[int, Tables] = {}


def _fold() -> np.ndarray:
    """Code point -> lower-cased letter's code point, or 0 for what is no letter."""
    if not _folded:
        table = np.zeros(0x110000, np.int32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _folded.append(table)
    return _folded[0]


def normalised(text: str) -> np.ndarray:
    """Code points of letters, 0 for each run of other characters between them."""
    codes = _fold()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    keep = codes != 0
    keep[1:] |= codes[:-1] != 0
    codes = codes[keep]
    return codes[:-1] if len(codes) and codes[-1] == 0 else codes


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings; state 0 is the root."""
    steps, link, length, last = [{}], [-1], [0], 0
    for c in symbols:
        cur = len(steps)
        steps.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in steps[p]:
            steps[p][c] = cur
            p = link[p]
        if p >= 0:
            q = steps[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(steps)
                steps.append(dict(steps[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and steps[p].get(c) == q:
                    steps[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return steps


class Automaton:
    """One language's automaton: state and symbol to the next state, with NEW where a phrase begins."""

    def __init__(self, symbols: np.ndarray, n_symbols: int, cells: int = CELLS) -> None:
        """symbols: numbers below n_symbols, none of them PAD or OTHER."""
        letters = np.unique(symbols)
        self.local = np.full(n_symbols, OTHER, np.int32)
        self.local[PAD] = PAD
        self.local[letters] = 2 + np.arange(len(letters))
        self.width = width = 2 + len(letters)
        self.bits = np.log2(max(2, len(symbols)))
        steps = suffix_automaton(self.local[symbols].tolist())
        # Where a state has no transition, the phrase ends and the root takes the symbol.
        self.first = np.full(width, NEW, np.int32)
        for c, t in steps[0].items():
            self.first[c] = t | NEW
        rows = np.fromiter((i for i, d in enumerate(steps) for _ in d), np.int64)
        cols = np.fromiter((c for d in steps for c in d), np.int64)
        to = np.fromiter((t for d in steps for t in d.values()), np.int32)
        inner = rows > 0
        keys, to = rows[inner] * width + cols[inner], to[inner]
        self.table = None
        if len(steps) * width <= cells:
            table = np.tile(self.first, (len(steps), 1))
            table[:, PAD] = np.arange(len(steps))
            self.table = table.reshape(-1)
            self.table[keys] = to
        else:
            order = np.argsort(keys)
            self.keys, self.to = keys[order], to[order]

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table[state * self.width + symbol]
        key = state.astype(np.int64) * self.width + symbol
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = self.keys[at] == key if len(self.keys) else np.zeros(len(key), bool)
        return np.where(symbol == PAD, state, np.where(known, self.to[at] if len(self.keys) else 0, self.first[symbol])).astype(np.int32)

    def begun(self, steps: np.ndarray, follows: np.ndarray) -> np.ndarray:
        """Phrases begun in each stretch (column of steps). follows: whether the stretch goes on from the one before it."""
        steps = self.local[steps]
        seen, state = np.empty_like(steps), np.zeros(steps.shape[1], np.int32)
        for j, row in enumerate(steps):
            seen[j] = got = self.step(state, row)
            state = got & (NEW - 1)
        entered = np.zeros(steps.shape[1], np.int32)
        while True:
            ends = np.where(follows, np.roll(seen[-1] & (NEW - 1), 1), 0)
            lanes = np.flatnonzero(ends != entered)
            if not len(lanes):
                return (seen >> 30).sum(0)
            entered[lanes] = state = ends[lanes]
            for j, row in enumerate(steps):
                got = self.step(state, row[lanes])
                state = got & (NEW - 1)
                apart = state != seen[j, lanes] & (NEW - 1)
                seen[j, lanes] = got
                if not apart.all():
                    lanes, state = lanes[apart], state[apart]
                    if not len(lanes):
                        break


class Tables:
    """The automata of all languages, over one numbering of the letters."""

    def __init__(self, samples: list[np.ndarray], cells: int = CELLS) -> None:
        letters = np.unique(np.concatenate([np.zeros(1, np.int32), *samples]))
        self.symbol = np.full(0x110000, OTHER, np.int32)
        self.symbol[letters] = 2 + np.arange(len(letters))
        self.automata = [Automaton(self.symbol[s], 2 + len(letters), cells) for s in samples]
        self.bits = [a.bits for a in self.automata]

    def phrases(self, texts: list[np.ndarray], stretch: int) -> np.ndarray:
        """Phrases that each language (column) needs for each text (row)."""
        sizes = np.array([-(-len(t) // stretch) for t in texts])
        grid = np.full((int(sizes.sum()), stretch), PAD, np.int32)
        flat, at = grid.reshape(-1), 0
        for t, n in zip(texts, sizes.tolist(), strict=True):
            flat[at : at + len(t)] = self.symbol[t]
            at += n * stretch
        steps = np.ascontiguousarray(grid.T)
        owner = np.repeat(np.arange(len(texts)), sizes)
        follows = np.diff(owner, prepend=-1) == 0
        out = np.zeros((len(texts), len(self.automata)))
        for k, a in enumerate(self.automata):
            out[:, k] = np.bincount(owner, a.begun(steps, follows), len(texts))
        return out


def language_samples(docs: DataFrame, *, sample_chars: int = 40_000, most_docs: int = 96, folds: int = 5, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> list[tuple[str, int, np.ndarray]]:
    """(language, labelled documents, learned symbols), most documents first."""
    known = docs.where(F.col(lang).isNotNull() & F.col(doc_id).isNotNull() & (held_out_fold(F.col(doc_id), folds) != 0))
    counts = {r[0]: r[1] for r in known.groupBy(F.col(lang)).agg(F.count("*")).collect()}
    if not counts:
        return []
    # About most_docs documents of each language, by a hash of the id.
    u = F.pmod(F.xxhash64(F.col(doc_id), F.lit("language")), F.lit(1 << 40)) / float(1 << 40)
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, most_docs / n)))])
    rows = known.where(u < F.try_element_at(share, F.col(lang))).select(F.col(lang).alias("l"), F.substring(F.col(text), 1, 4 * sample_chars).alias("t"), u.alias("u"), F.col(doc_id).cast("string").alias("i")).where("t is not null").orderBy("u", "i").limit(4 * most_docs * len(counts)).collect()
    out = []
    for name, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        parts, size, seen = [], 0, set()
        for r in rows:
            if r["l"] == name and r["t"] not in seen and size < sample_chars:
                seen.add(r["t"])
                part = normalised(r["t"])
                parts += [part, np.zeros(1, np.int32)]
                size += len(part) + 1
        if size > len(parts) // 2:
            out.append((name, n, np.concatenate(parts)[:sample_chars]))
    return out


def identify(docs: DataFrame, samples: list[tuple[str, int, np.ndarray]], *, stretch: int = 256, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every document.

    score: the share of the winner when each language counts as 2 to the minus
    its bits, over at most 64 bits' worth of difference.
    """
    python_workers(docs.sparkSession)
    names, learned = [s[0] for s in samples], [s[2] for s in samples]
    version = hash(tuple(s.tobytes() for s in learned))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if names and version not in _tables:
            _tables.clear()
            _tables[version] = Tables(learned)
        for batch in batches:
            texts = [normalised(t) if t else np.zeros(0, np.int32) for t in batch.column(1).to_pylist()]
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            full = [i for i, t in enumerate(texts) if len(t)] if names else []
            for part in _by_size(full, texts, 2_000_000):
                t = _tables[version]
                bits = t.phrases([texts[i] for i in part], stretch) * np.array(t.bits)
                best = bits.argmin(1)
                odds = np.exp2(-np.minimum(bits - bits.min(1, keepdims=True), 64))
                score[part] = 1 / odds.sum(1)
                for i, k in zip(part, best.tolist(), strict=True):
                    lang[i] = names[k]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def _by_size(rows: list[int], texts: list[np.ndarray], most: int) -> Iterator[list[int]]:
    part, size = [], 0
    for i in rows:
        part.append(i)
        size += len(texts[i])
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part
