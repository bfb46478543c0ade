"""Quality rules with cross-document line frequency.

Base rules look at one text: too few words, or too many words in repeated
three-word windows. The method's rule looks across texts: lines are normalised
(A-Z lowered, white space runs to one space) and hashed, the distinct documents
with a line are counted per host, and a line above the host's limit counts as
boilerplate. A document is depleted, and rejected, if boilerplate lines hold
more than `max_removed` of its words.

The limit of a host is `max(line_docs, line_share * documents of the host)`, and with
`most_line_docs` no more than that: so many documents suffice, however large the host.
Documents are counted by distinct text, a departure on purpose: a text that is copied often would
otherwise make every line of its own boilerplate, and all copies would go, where
deduplication is to keep one. Hashes have 64 bits.

Each text is read once: its metrics and the hashes of its lines go to a table in the shared
folder, from which lines are counted and looked up. Boilerplate lines, hot keys by nature,
are broadcast while there are at most `broadcast_lines` of them, and beyond that joined with
both sides dealt by a salt.

Defined results: null text has no words and fails the base rules; null hosts are
a host of their own; repeated rows and ids each get a row; an empty table gives
an empty result; columns of the input other than id, text and host are kept
where documents are returned, and never read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, bind, unused, written

GAP = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.filter(F.split(text, GAP), lambda w: w != "")


def _repeat_words(w: Column) -> Column:
    """Words of w that lie in a three-word window found twice or more."""

    def covered(q: Column) -> Column:
        gaps = F.transform(q, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(q, i + 1) - p, F.lit(3))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def repeated(p: Column) -> Column:
        same = lambda x, i: F.get(p, i)["h"] == x["h"]
        twice = F.filter(p, lambda x, i: F.coalesce((i > 0) & same(x, F.greatest(i - 1, F.lit(0))), F.lit(False)) | F.coalesce(same(x, i + 1), F.lit(False)))
        return bind(F.sort_array(F.transform(twice, lambda x: x["i"])), covered)

    def of(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(bind(pairs, repeated))

    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) > 3, bind(hashes, of)).otherwise(F.lit(0))


def _has_word(line: Column) -> Column:
    return F.rlike(line, F.lit(r"[^\x20\x09-\x0D]"))


def base_metrics(text: Column) -> Column:
    """Struct w (n words, c characters in them, r repeated words), n_symbols, n_dup_lines of a text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), _has_word)
    of_words = lambda w: F.struct(F.size(w).cast("long").alias("n"), F.char_length(F.array_join(w, "")).cast("long").alias("c"), _repeat_words(w).cast("long").alias("r"))
    return F.struct(
        bind(words(text), of_words).alias("w"),
        (F.char_length(text) - F.char_length(F.regexp_replace(text, "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )


def _host(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s:"), source.cast("string")), F.lit("null"))


def _normalised(line: Column) -> Column:
    """A line's words with one space between; '' without words."""
    return F.trim(F.regexp_replace(line, GAP, " "))


def _line_key(line: Column) -> Column:
    return bind(_normalised(line), lambda x: F.xxhash64(ascii_lower(x)))


def _lines(text: Column) -> Column:
    """Hash and number of words of each line that has one."""
    lines = F.filter(F.transform(F.split(ascii_lower(text), "\n"), _normalised), lambda x: x != "")
    return F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("line"), (F.char_length(x) - F.char_length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("in_line")))


def read_once(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """row (a number), doc_id, k, host, t (hash of the text), m (base metrics), lines of every document, written."""
    body = F.coalesce(F.col(text), F.lit(""))
    return written(
        docs.select(
            F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(doc_id), F.col(text)).alias("k"),
            _host(F.col(source)).alias("host"), F.xxhash64(body).alias("t"), base_metrics(F.col(text)).alias("m"), _lines(body).alias("lines"),
        ),
        "lines",
    )


def boilerplate_lines(read: DataFrame, line_docs: int = 20, line_share: float = 0.01, *, most_line_docs: int | None = None) -> DataFrame:
    """host, line, docs of read_once(): lines found in more distinct texts of a host than its limit."""
    lines = read.select("host", "t", F.explode(F.array_distinct("lines.line")).alias("line"))
    counts = lines.distinct().groupBy("host", "line").agg(F.count("*").alias("docs"))
    hosts = read.select("host", "t").distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    above = F.col("docs") > F.col("host_docs") * line_share
    if most_line_docs is not None:
        above |= F.col("docs") > most_line_docs
    return counts.where(F.col("docs") > line_docs).join(hosts, "host").where(above).select("host", "line", "docs")


def quality_report(docs: DataFrame, *, line_docs: int = 20, line_share: float = 0.01, most_line_docs: int | None = None, max_removed: float = 0.5, broadcast_lines: int = 200_000, salts: int = 16, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: doc_id, k, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, removed_words, removed_lines (hashes), base_failed, kept."""
    read = read_once(docs, doc_id=doc_id, text=text, source=source)
    common = written(boilerplate_lines(read, line_docs, line_share, most_line_docs=most_line_docs).select("host", "line"), "boilerplate")
    rows = read.select("row", "host", F.explode("lines").alias("x")).select("row", "host", "x.*")
    if common.count() <= broadcast_lines:
        met = rows.join(F.broadcast(common), ["host", "line"])
    else:
        dealt = common.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int")).join(dealt, ["host", "line", "salt"])
    cut = met.groupBy("row").agg(F.sum("in_line").alias("cut_words"), F.collect_set("line").alias("cut_lines"))
    base = read.select("row", "doc_id", "k", F.col("m.w.n").alias("n_words"), F.col("m.w.c").alias("word_chars"), "m.n_symbols", "m.n_dup_lines", F.col("m.w.r").alias("n_repeat_words"))
    out = base.join(cut, "row", "left")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    removed = F.coalesce(F.col("cut_words"), F.lit(0)).cast("long")
    return out.select(
        "doc_id", "k", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        removed.alias("removed_words"), F.coalesce("cut_lines", F.array().cast("array<bigint>")).alias("removed_lines"),
        failed.alias("base_failed"), (~failed & (removed <= F.col("n_words") * max_removed)).alias("kept"),
    )


def apply_quality_rules(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs that are kept, without their boilerplate lines; the columns stay."""
    d, k, lines = (unused(docs.columns, x) for x in ("d", "k", "l"))
    report = quality_report(docs, doc_id=doc_id, text=text, **options)
    kept = report.where("kept").select(F.col("doc_id").alias(d), F.col("k").alias(k), F.col("removed_lines").alias(lines)).dropDuplicates([d, k])
    joined = docs.join(kept, F.col(doc_id).eqNullSafe(F.col(d)) & (F.xxhash64(F.col(doc_id), F.col(text)) == F.col(k)))
    stays = F.filter(F.split(F.col(text), "\n"), lambda x: ~F.array_contains(F.col(lines), _line_key(x)))
    cleaned = F.when(F.size(lines) > 0, F.array_join(stays, "\n")).otherwise(F.col(text))
    return joined.select([cleaned.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
