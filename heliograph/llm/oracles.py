"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations


def _crc32_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ 0xEDB88320 if n & 1 else n >> 1
        out.append(n)
    return out


#: crc32 of a text's UTF-8 bytes, by the byte-wise table method.
CRC32 = f"""
xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode({{0}})), '..'), lambda b: ('0x' || b)::BIGINT)),
    lambda c, b: xor(c >> 8, list_extract({[*_crc32_table()]}::BIGINT[], (xor(c, b) & 255) + 1))))::BIGINT
""".strip()

OP2 = f"""
WITH keyed AS (
  SELECT doc_id, (octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS size, {CRC32.format("coalesce(text, '')")} AS text_crc32,
         coalesce('s:' || source, 'null') AS stratum,
         ('0x' || substr(md5('interleave-1:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h, doc_id, text_crc32, size) AS r, count(*) OVER (PARTITION BY stratum) AS n FROM keyed),
fraction AS (
  SELECT *, ((r - 1)::DOUBLE + ('0x' || substr(md5('interleave-1/' || stratum), 1, 15))::BIGINT / 1152921504606846976::DOUBLE) / n::DOUBLE AS f FROM ranked),
placed AS (
  SELECT *, row_number() OVER (ORDER BY f, stratum, h, doc_id, text_crc32, size) - 1 AS p, count(*) OVER () // 8 AS base, count(*) OVER () % 8 AS extra FROM fraction),
cut AS (
  SELECT *, CASE WHEN p < extra * (base + 1) THEN p // (base + 1) ELSE extra + (p - extra * (base + 1)) // greatest(base, 1) END AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard::INTEGER AS shard,
       (p - CASE WHEN p < extra * (base + 1) THEN shard * (base + 1) ELSE extra * (base + 1) + (shard - extra) * base END)::BIGINT AS slot,
       NULL::INTEGER AS grown_shard
FROM cut
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP6 = r"""
WITH docs AS (
  SELECT row_number() OVER () AS n, doc_id, coalesce('s:' || source, 'null') AS host, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT n, doc_id, host, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs),
win AS (
  SELECT n, i, count(*) OVER (PARTITION BY n, w[i], w[i + 1], w[i + 2]) AS c FROM words, unnest(range(1, len(w) - 1)) AS x(i)),
rep AS (
  SELECT n, count(DISTINCT i + d) AS n_repeat_words FROM win, (VALUES (0), (1), (2)) AS y(d) WHERE c > 1 GROUP BY n),
lines AS (
  SELECT n, host, text, l, list_aggregate(list_transform(regexp_extract_all(l, '[^\x20\x09-\x0D]+'),
         lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')), 'string_agg', ' ') AS line, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS k
  FROM docs, unnest(string_split(text, chr(10))) AS y(l) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dup AS (SELECT n, count(*) - count(DISTINCT l) AS n_dup_lines FROM lines GROUP BY n),
hosts AS (SELECT host, count(DISTINCT text) AS host_docs FROM docs GROUP BY host),
common AS (
  SELECT host, line FROM lines JOIN hosts USING (host) GROUP BY host, line, host_docs HAVING count(DISTINCT text) > 20 AND count(DISTINCT text) > host_docs * 0.01::DOUBLE),
cut AS (SELECT n, sum(k)::BIGINT AS removed FROM lines JOIN common USING (host, line) GROUP BY n),
base AS (
  SELECT n, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(removed, 0)::BIGINT AS removed_words
  FROM words LEFT JOIN rep USING (n) LEFT JOIN dup USING (n) LEFT JOIN cut USING (n)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND removed_words <= n_words * 0.5::DOUBLE AS kept, removed_words
FROM judged
"""

_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP8 = f"""
WITH docs AS (SELECT row_number() OVER () AS n, doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 8) AS k, array_to_string(w[i:i + least(len(w), 8) - 1], ' ') AS g
  FROM items, unnest(range(1, len(w) - least(len(w), 8) + 2)) AS x(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT k FROM windows),
grams AS (
  SELECT n, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM docs, sizes, unnest(range(1, len(w) - k + 2)) AS x(i)),
hits AS (SELECT n, i, k, item_id FROM grams JOIN windows USING (k, g)),
covered AS (SELECT n, count(DISTINCT i + d) AS n_hit FROM hits, unnest(range(0, k)) AS y(d) GROUP BY n),
found AS (
  SELECT n, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT n, item_id::VARCHAR AS item FROM hits) GROUP BY n)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM docs LEFT JOIN covered USING (n) LEFT JOIN found USING (n)
"""

ORACLES = {"op2_sharding": OP2, "op6_quality_rules": OP6, "op8_decontamination": OP8}
