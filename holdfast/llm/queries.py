"""The operators of this package as queries over whole tables, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from holdfast.llm import decontaminate, exact_dedup, langid, license_scan, minhash, mixing, prefix_trie, quality_gam, quality_rules, secrets, sharding, target_resampling, token_planes
from holdfast.llm.common import table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.scan(table(spark, sf_dir, "documents")))


def op2_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_planes.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), shared_values=True)
    return found.select("doc_id", "item_id", "coverage", "verdict", "n_places")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("frequent")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.digest(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


def op13_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_resampling.resample_plan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_quality_gam, op3_token_planes, op4_decontaminate, op5_exact_dedup, op6_sharding, op7_langid, op8_mixing, op9_secrets, op10_minhash, op11_quality_rules, op12_prefix_trie, op13_target_resampling)}


FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5 = f"""
WITH d AS (SELECT doc_id, {FOLD} AS t FROM documents),
g AS (SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
"""

OP6 = """
WITH crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
d AS (
  SELECT doc_id, (octet_length(encode(coalesce(text, ''))) + 8)::BIGINT AS size,
    regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS bytes FROM documents),
c AS (
  SELECT doc_id, size, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(bytes, lambda b: ('0x' || b)::BIGINT)),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)))::BIGINT AS text_crc32 FROM d, crc_table),
p AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total FROM c),
s AS (SELECT *, least(23, (2 * upto - size) * 24 // (2 * total))::INTEGER AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM s
"""

OP8 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) AS key FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS w
  FROM d GROUP BY source),
fill AS (
  SELECT 0 AS step, []::VARCHAR[] AS full_, (SELECT sum(source_size) / sum(w) FROM s)::DOUBLE AS level
  UNION ALL
  SELECT step + 1, f.full_, coalesce((SELECT ((SELECT sum(source_size) FROM s) - coalesce(sum(3.0 * source_size) FILTER (list_contains(f.full_, coalesce(source, chr(1)))), 0)) / sum(w) FILTER (NOT list_contains(f.full_, coalesce(source, chr(1)))) FROM s), 0)::DOUBLE
  FROM (SELECT step, level, (SELECT coalesce(list(coalesce(source, chr(1))), []) FROM s WHERE fill.level * w >= 3.0 * source_size) AS full_, fill.full_ AS old FROM fill) f
  WHERE len(f.full_) > len(f.old)),
last_ AS (SELECT * FROM fill ORDER BY step DESC LIMIT 1),
t AS (
  SELECT source, source_size, CASE WHEN list_contains(full_, coalesce(source, chr(1))) THEN 3.0 * source_size ELSE level * w END::DOUBLE AS target FROM s, last_),
r AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END::DOUBLE AS rate,
    ('0x' || substr(md5(key || ':' || (row_number() OVER (PARTITION BY key) - 1) || ':8'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS coin
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies
FROM (SELECT *, (floor(rate) + (coin < rate - floor(rate))::INTEGER)::BIGINT AS copies FROM r)
"""


OP10 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({FOLD}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS sh FROM d),
e AS (SELECT doc_id, len(sh) AS n, hash(unnest(sh)) AS h FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common, any_value(a.n) AS x, any_value(b.n) AS y
  FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * common >= 85 * (x + y - common)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, seen) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT u.b, r.seen FROM r JOIN u ON u.a = r.doc_id),
c AS (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY 1)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c USING (doc_id)
""".replace("{FOLD}", FOLD)


OP11 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
v AS (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) > 8),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(w[i:i + 7], ' ')) AS n FROM v),
c AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM g WHERE n > 1) GROUP BY r),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    len(l)::BIGINT AS n_lines, len(list_filter(w, lambda x: list_contains({STOPS}, lower(x))))::BIGINT AS n_stop_words,
    len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1]))::BIGINT AS n_same_words,
    length(regexp_replace(t, '[^!?]', '', 'g'))::BIGINT AS n_marks, length(regexp_replace(t, '[^0-9]', '', 'g'))::BIGINT AS n_digits,
    len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]')))::BIGINT AS n_bullet_lines,
    len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$')))::BIGINT AS n_ellipsis_lines
  FROM d LEFT JOIN c USING (r)),
b AS (SELECT *, array_to_string(list_sort(list_filter([{RULES}], lambda x: x IS NOT NULL)), ',') AS broken FROM m)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, broken = '' AS kept FROM b
"""


def _rule_sql(rule: quality_rules.Rule) -> str:
    value, per = (rule.count, "1") if rule.per is None else (f"100 * {rule.count}", rule.per)
    bounds = [f"{value} {sign} {bound} * {per}" for sign, bound in (("<", rule.least), (">", rule.most)) if bound is not None]
    return f"CASE WHEN {per} > 0 AND ({' OR '.join(bounds)}) THEN '{rule.name}' END"


def op11_sql() -> str:
    """The table of thresholds goes into the SQL as it goes into the projection."""
    return OP11.replace("{STOPS}", str(quality_rules.STOP_WORDS)).replace("{RULES}", ", ".join(map(_rule_sql, quality_rules.RULES)))


OP12 = r"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
o AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, ''))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
h AS (
  SELECT c, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(c::VARCHAR)), '..'), lambda b: ('0x' || b)::BIGINT)),
    lambda x, b: xor(t[(xor(x, b) & 255) + 1], x >> 8))) % 4 AS h FROM (SELECT DISTINCT c FROM o), crc_table),
r AS (
  SELECT h.c, b.pos, b.role, b.text FROM h JOIN o b ON b.c = h.c - h.c % 20 AND b.pos < h.h
  UNION ALL SELECT h.c, o.pos - h.h + least(h.h, (SELECT count(*) FROM o b WHERE b.c = h.c - h.c % 20)), o.role, o.text FROM h JOIN o ON o.c = h.c AND o.pos >= h.h),
p AS (
  SELECT c, pos + 1 AS d, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
    string_agg(sha256(length(role) || ':' || role || ':' || text), '' ORDER BY pos) OVER (PARTITION BY c ORDER BY pos) AS path FROM r
  UNION ALL SELECT c, 0, 0, '' FROM h),
m AS (SELECT c, d, words, min(c) OVER (PARTITION BY d, path) AS rep, max(d) OVER (PARTITION BY c) AS len FROM p),
n AS (
  SELECT rep, d, count(*) AS n_convs, any_value(words) AS words, max(len) = d AS leaf,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len = d), '')) AS ends_sha256 FROM m GROUP BY rep, d),
above AS (SELECT n.*, m.rep AS parent FROM n LEFT JOIN m ON m.c = n.rep AND m.d = n.d - 1),
under AS (
  SELECT m.rep, m.d, count(*) FILTER (x.leaf AND x.d >= m.d) AS n_leaves, sum((x.n_convs - 1) * x.words) FILTER (x.d >= m.d) AS saved
  FROM m JOIN n x ON x.rep = m.c GROUP BY ALL),
kids AS (SELECT parent AS rep, d - 1 AS d, count(*) AS n_children FROM above WHERE d > 0 GROUP BY ALL)
SELECT rep AS conv_id, d::BIGINT AS depth, parent AS parent_conv_id, n_convs::BIGINT AS n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves,
  coalesce(saved, 0)::BIGINT AS saved_tokens, ends_sha256
FROM above JOIN under USING (rep, d) LEFT JOIN kids USING (rep, d)
"""

OP13 = r"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
w AS (
  SELECT side, r, doc_id, regexp_extract_all({FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT 's' AS side, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT 't', row_number() OVER (), NULL, text FROM benchmark)),
f AS (SELECT side, r, array_to_string(w[i:i + n - 1], ' ') AS f FROM (SELECT side, r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS n))),
h AS (
  SELECT f, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda b: ('0x' || b)::BIGINT)),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 10000 AS bucket FROM (SELECT DISTINCT f FROM f), crc_table),
n AS (SELECT side, bucket, count(*) AS n FROM f JOIN h USING (f) GROUP BY ALL),
sums AS (SELECT coalesce(sum(n) FILTER (side = 's'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 't'), 0)::DOUBLE AS t FROM n),
gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(max(n) FILTER (side = 't'), 0)::DOUBLE + 1) * (any_value(sums.s) + 10000)
    / ((coalesce(max(n) FILTER (side = 's'), 0)::DOUBLE + 1) * (any_value(sums.t) + 10000))))::BIGINT AS g FROM n, sums GROUP BY bucket),
d AS (
  SELECT w.r, any_value(doc_id) AS doc_id, any_value(len(w)) AS words, count(f)::BIGINT AS n_features, coalesce(sum(g), 0)::BIGINT AS weight
  FROM w LEFT JOIN f ON f.side = 's' AND f.r = w.r LEFT JOIN h USING (f) LEFT JOIN gain USING (bucket) WHERE w.side = 's' GROUP BY w.r),
k AS (
  SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d),
p AS (
  SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features)::BIGINT AS place,
    5 * count(*) FILTER (words >= 20) OVER () // 100 AS k FROM k)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND place <= k THEN place END AS rank, words::BIGINT AS n_words FROM p
""".replace("{FOLD}", FOLD)


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": OP5, "op6_sharding": OP6, "op8_mixing": OP8, "op10_minhash": OP10, "op11_quality_rules": op11_sql(), "op12_prefix_trie": OP12, "op13_target_resampling": OP13}
