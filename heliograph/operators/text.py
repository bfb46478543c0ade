"""Full-text search: postings, BM25, boolean, phrase, prefix, fuzzy and boosted queries."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
QUERY = re.compile(r'([+-]?)(?:"([^"]*)"|([\w*]+))(?:~(\d+))?(?:\^(\d+(?:\.\d+)?))?', re.U)


@dataclass
class Clause:
    terms: list[str]
    must: bool = False
    never: bool = False
    prefix: bool = False
    boost: float = 1.0
    slop: int = 0


def once(value: Column, body) -> Column:
    """body(value) with `value` computed once a row, not once for each element that a lambda in body looks at."""
    return F.element_at(F.transform(F.array(value), body), 1)


def terms_of(text):
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def postings(docs: DataFrame) -> DataFrame:
    """id, term, pos of docs (id, text): the whole index as a table."""
    return docs.select("id", F.posexplode(terms_of(F.col("text"))).alias("pos", "term"))


def parse_query(text: str) -> list[Clause]:
    """AND binds its neighbours, NOT and - exclude, quotes make phrases, ~n lets n other words into one, * ends a prefix, ^n weighs."""
    out: list[Clause] = []
    both = never = False
    for sign, phrase, word, slop, boost in QUERY.findall(text or ""):
        if word == "AND":
            both = True
            if out:
                out[-1].must = True
            continue
        if word == "NOT":
            never = True
            continue
        if word == "OR":
            continue
        prefix = word.endswith("*")
        terms = re.findall(r"\w+", (phrase or word).lower().replace("*", " "))
        if terms:
            out.append(Clause(terms, both or sign == "+", never or sign == "-", prefix, float(boost or 1), int(slop or 0)))
        both = never = False
    return out


def search(docs: DataFrame, query: str, fuzzy: bool = False, k1: float = K1, b: float = B) -> DataFrame:
    """id, score of docs (id, text) that match, by BM25: the sum over matching clauses.

    A row's terms are made once and counted for all clauses; the statistics are one row,
    broadcast to a second pass that scores. Nothing is shuffled by document. fuzzy: a term also
    stands for terms at edit distance 1.
    """
    clauses = parse_query(query)
    if not clauses:
        return docs.select("id", F.lit(0.0).alias("score")).where(F.lit(False))

    def counted(w: Column) -> Column:
        return F.struct(F.size(w).alias("dl"), F.array(*[F.size(_spots(w, c)) if len(c.terms) > 1 else F.size(F.filter(w, _matcher(c, fuzzy))) for c in clauses]).alias("tf"))

    rows = docs.select("id", once(terms_of(F.coalesce("text", F.lit(""))), counted).alias("x")).select("id", "x.*")
    tf = [F.get("tf", F.lit(i)) for i in range(len(clauses))]
    stats = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((t > 0).cast("long")).alias(f"df{i}") for i, t in enumerate(tf)])
    hit = F.lit(False)
    for t, c in zip(tf, clauses, strict=True):
        hit |= (t > 0) if not c.never else F.lit(False)
    found = rows.where(hit)
    total = F.lit(0.0)
    for i, (t, c) in enumerate(zip(tf, clauses, strict=True)):
        if c.never:
            found = found.where(t == 0)
            continue
        if c.must:
            found = found.where(t > 0)
        idf = F.ln(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        total += F.when(t > 0, c.boost * idf * t * (k1 + 1) / (t + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))).otherwise(0.0)
    return found.join(F.broadcast(stats), F.lit(True)).select("id", total.alias("score"))


def _matcher(c: Clause, fuzzy: bool):
    term = c.terms[0]
    if c.prefix:
        return lambda w: F.startswith(w, F.lit(term))
    if fuzzy:
        return lambda w: F.levenshtein(w, F.lit(term)) <= 1
    return lambda w: w == term


def _spots(w: Column, c: Clause) -> Column:
    """Where in w the phrase begins; with slop, up to so many other words may stand between its terms."""
    n = len(c.terms)
    phrase = F.array(*map(F.lit, c.terms))
    starts = F.filter(F.transform(w, lambda x, i: F.when(x == c.terms[0], i + 1)), lambda p: p.isNotNull())
    if not c.slop:
        return F.filter(starts, lambda p: F.slice(w, p, n) == phrase)

    def reached(part: Column) -> Column:
        step = lambda at, t: F.when(at > 0, once(F.array_position(F.slice(part, at + 1, n + c.slop), t).cast("int"), lambda q: F.when(q > 0, at + q).otherwise(0))).otherwise(0)
        return F.aggregate(F.slice(phrase, 2, n), F.lit(1), step) > 0

    return F.filter(starts, lambda p: once(F.slice(w, p, n + c.slop), reached))


def snippet(text, term: str, around: int = 30):
    """The text about a term's first occurrence, with the term between marks."""
    at = F.instr(F.lower(text), term.lower())
    start = F.greatest(at - around, F.lit(1))
    cut = F.substring(text, start, F.lit(2 * around + len(term)))
    return F.when(at > 0, F.regexp_replace(cut, "(?i)(" + re.escape(term) + ")", "<b>$1</b>"))
