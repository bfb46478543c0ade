"""Benchmark decontamination against a broadcast hash set of test n-grams.

Benchmark items become windows of n consecutive normalised words (an item of
fewer words is one shorter window). Each document is scanned once: a fixed-size
bitmap of the windows' first two words, a constant in the plan, picks candidate
positions inside the row; only candidates leave the row, and a hash join on the
whole window text verifies them, so a hit is exact.

The set is broadcast while it counts at most `broadcast_windows` windows; beyond,
both joins on window texts are dealt by a salt too, so a window that very many
documents hold is spread, and rows that stand for documents stay out of the join's hot keys. The bitmap never grows; a fuller one only lets more
candidates through to the exact join.

Defined results: null text has no words; null ids are ids like any other;
repeated rows each get their row; an empty benchmark hits nothing; an empty
table gives an empty result; other columns are kept where documents are
returned and are never read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import ascii_lower, bind, unused, written

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), lambda w: w != "")


def _gram(w: Column, start: Column, length) -> Column:
    return F.array_join(F.slice(w, start + 1, length), " ")


def _start(w: Column, i: Column, bits: int) -> Column:
    """Bit of the bitmap for a window that starts at word i: its first two words, or the one it has."""
    return F.pmod(F.xxhash64(F.get(w, i), F.get(w, i + 1)), F.lit(bits))


def benchmark_windows(benchmark: DataFrame, n: int = 8, bits: int = 1 << 18, *, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, gram, len, bit: the distinct windows of each item."""

    def of(w: Column) -> Column:
        length = F.least(F.size(w), F.lit(n))
        spots = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.size(w) - length)).otherwise(F.array().cast("array<int>"))
        one = F.size(w) == 1  # documents look up single words on their own
        return F.transform(spots, lambda i: F.struct(_gram(w, i, length).alias("gram"), length.alias("len"), F.when(one, F.pmod(F.xxhash64(F.get(w, F.lit(0))), F.lit(bits))).otherwise(_start(w, i, bits)).alias("bit")))

    return benchmark.select(F.col(item_id).alias("item_id"), F.explode(bind(words(F.col(text)), of)).alias("x")).select("item_id", "x.*").distinct()


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = 8, *, doc_id: str = "doc_id", text: str = "text", bits: int = 1 << 18, broadcast_windows: int = 500_000, salts: int = 16) -> tuple[DataFrame, DataFrame, bool]:
    """(rows, windows, whether windows are few). rows: doc_id, k (hash of id and text), pos, len, gram, copies:
    one row with pos -1 for each distinct document, whose len is its number of words,
    and one for each verified occurrence of a window."""
    windows = written(benchmark_windows(benchmark, n, bits), "windows")
    grams = windows.select("gram").distinct()
    # Bounded: `bits`/64 words of the bitmap and n lengths, whatever the benchmark's size.
    by_len = {r["len"]: r["c"] for r in windows.groupBy("len").agg(F.count("*").alias("c")).collect()}
    flags = {}
    for single in (False, True):
        part = windows.where((F.col("len") == 1) if single else (F.col("len") > 1))
        cells = part.groupBy(F.floor(F.col("bit") / 64).alias("cell")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("m")).collect()
        packed = [0] * (bits // 64)
        for r in cells:
            packed[r["cell"]] = r["m"]
        flags[single] = F.expr(f"cast(split('{','.join(map(str, packed))}', ',') as array<bigint>)") if cells else None

    def marked(flag: Column, bit: Column) -> Column:
        return F.getbit(F.get(flag, F.floor(bit / 64).cast("int")), (bit % 64).cast("int")) == 1

    def of_length(w: Column, spots: Column, length: int) -> Column:
        fit = F.filter(spots, lambda i: i + length <= F.size(w))
        return F.transform(fit, lambda i: F.struct(i.alias("pos"), F.lit(length).alias("len"), _gram(w, i, F.lit(length)).alias("gram")))

    def scan(w: Column) -> Column:
        head = F.array(F.struct(F.lit(-1).alias("pos"), F.size(w).alias("len"), F.lit(None).cast("string").alias("gram")))
        every = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.size(w) - 1)).otherwise(F.array().cast("array<int>"))
        found = [head]
        longer = sorted(x for x in by_len if x > 1)
        if longer:
            spots = F.filter(every, lambda i: marked(flags[False], _start(w, i, bits)))
            found += [of_length(w, spots, length) for length in longer]
        if 1 in by_len:
            spots = F.filter(every, lambda i: marked(flags[True], F.pmod(F.xxhash64(F.get(w, i)), F.lit(bits))))
            found.append(F.transform(spots, lambda i: F.struct(i.alias("pos"), F.lit(1).alias("len"), F.get(w, i).alias("gram"))))
        return F.concat(*found) if len(found) > 1 else head

    seen = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(doc_id), F.col(text)).alias("k"), F.explode(bind(words(F.col(text)), scan)).alias("x")).select("doc_id", "k", "x.*")
    small = sum(by_len.values()) <= broadcast_windows
    known = grams.withColumn("known", F.lit(True))
    if small:
        hits = seen.join(F.broadcast(known), "gram", "left")
    else:
        # A document's own row has no window; a text of its own keeps it from meeting all others at null.
        own = F.concat(F.lit("\n"), F.monotonically_increasing_id().cast("string"))
        lone = seen.withColumn("g", F.coalesce("gram", own)).withColumn("salt", _salt(salts, "k", "pos"))
        hits = lone.join(_salted(known, salts).withColumnRenamed("gram", "g"), ["g", "salt"], "left").drop("g", "salt")
    hits = hits.where((F.col("pos") < 0) | F.col("known"))
    rows = hits.groupBy("doc_id", "k", "pos", "len", "gram").agg(F.count("*").alias("copies"))
    return written(rows, "hits"), windows, small


def _salt(salts: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int")


def _salted(df: DataFrame, salts: int) -> DataFrame:
    """Each row once for every salt."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def decontamination_report(docs: DataFrame, benchmark: DataFrame, n: int = 8, min_items: int = 2, **options) -> DataFrame:
    """One row per document: doc_id, k, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    spans: the hit stretches of words as structs (from, to), in order. Contaminated
    documents hold windows of at least `min_items` items.
    """
    rows, windows, small = find_hits(docs, benchmark, n, **options)
    end = F.when(F.col("pos") >= 0, F.col("pos") + F.col("len"))
    before = F.coalesce(F.max(end).over(Window.partitionBy("doc_id", "k").orderBy("pos", "len").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fresh = F.when(F.col("pos") >= 0, F.greatest(F.lit(0), end - F.greatest(F.col("pos"), F.col("before"))))
    per_doc = (
        rows.withColumn("before", before)
        .withColumn("fresh", fresh)
        .groupBy("doc_id", "k")
        .agg(
            F.max(F.when(F.col("pos") < 0, F.col("len"))).cast("long").alias("n_words"),
            F.coalesce(F.sum("fresh"), F.lit(0)).cast("long").alias("n_hit"),
            F.max(F.when(F.col("pos") < 0, F.col("copies"))).alias("copies"),
            F.array_sort(F.collect_list(F.when(F.col("fresh") > 0, F.struct((end - F.col("fresh")).alias("from"), end.alias("to"))))).alias("spans"),
        )
    )
    met, named = rows.where("pos >= 0").select("doc_id", "k", "gram").distinct(), windows.select("gram", "item_id")
    salts = options.get("salts", 16)
    items = (
        (met.join(F.broadcast(named), "gram") if small else met.withColumn("salt", _salt(salts, "doc_id", "k")).join(_salted(named, salts), ["gram", "salt"]))
        .groupBy(F.col("doc_id").alias("d"), F.col("k").alias("kk"))
        .agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )
    both = per_doc.join(items, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("k") == F.col("kk")), "left")
    listed = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return both.select(
        "doc_id", "k", "n_words", "n_hit",
        F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join(listed, ","), "UTF-8"), 256).alias("items_sha256"),
        (F.size(listed) >= min_items).alias("contaminated"),
        "spans", "copies",
    )


def per_row(report: DataFrame) -> DataFrame:
    """The report with a row for every copy of a repeated row."""
    return report.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copy", "copies")


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 8, min_items: int = 2, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs without contaminated documents; from the others, hit words are cut out.

    Only documents with a hit change: each hit stretch goes, from its first word to
    its last, and what stands between words elsewhere stays as it is.
    """
    d, k, c, spans = (unused(docs.columns, x) for x in ("d", "k", "c", "s"))
    report = decontamination_report(docs, benchmark, n, min_items, doc_id=doc_id, text=text, **options)
    hit = report.where("n_hit > 0").select(F.col("doc_id").alias(d), F.col("k").alias(k), F.col("contaminated").alias(c), F.col("spans").alias(spans))
    key = F.xxhash64(F.col(doc_id), F.col(text))
    joined = docs.join(hit, F.col(doc_id).eqNullSafe(F.col(d)) & (key == F.col(k)), "left").where(~F.coalesce(F.col(c), F.lit(False)))
    # Words and the gaps before them, in order: [gap, word] ... and the last gap.
    parts = F.regexp_extract_all(F.col(text), F.lit(r"([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*)([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"), 0)
    tail = F.regexp_extract(F.col(text), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*$", 0)

    def cut(p: Column) -> Column:
        stays = F.filter(p, lambda _, i: ~F.exists(F.col(spans), lambda s: (s["from"] <= i) & (i < s["to"])))
        return F.concat(F.array_join(stays, ""), tail)

    cleaned = F.when(F.size(spans) > 0, bind(parts, cut)).otherwise(F.col(text))
    return joined.select([cleaned.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
