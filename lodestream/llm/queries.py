"""The registered queries of the corpus operators, and their SQL where SQL can say it.

Each query is thin: rows come from the operator, and the digest columns are derived from them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, html_text, language_id, line_dedup, near_dedup, quality, secrets, suffix_dedup, toxicity
from .common import table, with_small


def _sha(x: Column) -> Column:
    return F.sha2(x, 256)


def _is(value) -> Callable[[Column], Column]:
    return lambda x: x == value


def _fold(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"), length=50)
    n_removed = F.col("n_bytes") - F.length("kept").cast("long")
    return out.select(F.col("id").alias("doc_id"), "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), _sha(F.col("kept")).alias("kept_sha256"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words=2, percent=80)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tok = bpe.public_tokenizer()
    coded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), tok), tok)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), _sha(ids.cast("binary")).alias("ids_sha256"), _sha(F.col("decoded")).alias("decoded_sha256"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), html_text.default_labeller())
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.train(docs))
    joined = {c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",") for c in ("__base", "__spans")}
    counts = [F.size(F.filter(F.col("__base.rank"), _is(k))).cast("long").alias(f"n_{kind}") for k, (kind, *_) in enumerate(secrets.PATTERNS)]
    return found.select("doc_id", *counts, _sha(joined["__base"].cast("binary")).alias("base_sha256"), joined["__spans"].alias("spans"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = _fold(5) == 0
    net = language_id.fit(docs.where(~held_out))
    return language_id.identify(docs.select("doc_id", "text"), net).select("doc_id", held_out.alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held_out = _fold(3) == 1
    labels = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    train = with_small(docs.where(~held_out), labels, "doc_id")
    model = toxicity.fit(train, "text", "toxic", half="crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 = 0")
    score = F.col("__toxic")
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), score.alias("score"), F.when(score >= 0.7, 1).otherwise(0).alias("predicted"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), _sha(F.coalesce("text", F.lit("")).cast("binary")).alias("kept_sha256"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    found = decontaminate.find_contamination(docs, bench, window=10)
    n_hit = F.aggregate("__spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    items = F.array_join(F.array_sort(F.transform("__items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", F.col("__n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("__items").cast("long").alias("n_items"), _sha(items.cast("binary")).alias("items_sha256"), (F.size("__spans") > 0).alias("contaminated"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = quality.score_quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    failed = (F.col("__n_words") < 50) | (100 * F.col("__n_repeat_words") > 50 * F.col("__n_words"))
    cols = [F.col(f"__{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return m.select("doc_id", *cols, failed.alias("base_failed"), (~failed & F.col("__ok")).alias("kept"), F.col("__coverage").alias("coverage"))


def base_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op5 says of the fixed patterns, which SQL can say too."""
    return op5_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def base_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op10 says without the method's verdict."""
    return op10_quality(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_near_dedup": op2_near_dedup,
    "op3_bpe": op3_bpe,
    "op4_html_text": op4_html_text,
    "op5_secrets": op5_secrets,
    "op6_language_id": op6_language_id,
    "op7_line_dedup": op7_line_dedup,
    "op8_decontamination": op8_decontamination,
    "op9_toxicity": op9_toxicity,
    "op10_quality": op10_quality,
    "base_secrets": base_secrets,
    "base_quality": base_quality,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL: dict[str, str] = {
    "op1_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
pl AS (SELECT doc_id, unnest(range(0, length(h) // 2 - 49)) AS p, h FROM d WHERE length(h) >= 100),
s AS (SELECT doc_id, p, md5_number(substring(h, 2 * p + 1, 100)) AS x FROM pl),
marked AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY x) AS least FROM s) WHERE least < doc_id),
starts AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER w + 50 THEN 0 ELSE 1 END AS new FROM marked WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
runs AS (SELECT doc_id, run, min(p) AS a, max(p) + 50 AS b FROM (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM starts) GROUP BY ALL),
gaps AS (SELECT doc_id, run, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS after FROM runs),
kept AS (SELECT g.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans,
  string_agg(substring(h, 2 * before + 1, 2 * (a - before)) || CASE WHEN after IS NULL THEN substring(h, 2 * b + 1) ELSE '' END, '' ORDER BY a) AS h
  FROM gaps g JOIN d ON d.doc_id = g.doc_id GROUP BY g.doc_id)
SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(k.h, d.h))) AS kept_sha256
FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id""",
    "op2_near_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]) END) AS s FROM w),
one AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
inner_ AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS same
  FROM one a JOIN one b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2),
links AS (SELECT a, b FROM inner_ WHERE 100 * same >= 80 * (na + nb - same)),
both_ AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS id, b AS r FROM both_ UNION SELECT reach.id, both_.b FROM reach JOIN both_ ON reach.r = both_.a)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(m, s.doc_id)) AS component_id, least(s.doc_id, coalesce(m, s.doc_id)) = s.doc_id AS kept
FROM s LEFT JOIN (SELECT id, min(r) AS m FROM reach GROUP BY id) r ON s.doc_id = r.id""",
    "op7_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, u.line, u.pos,
         translate(trim(u.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key
  FROM documents, LATERAL (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos) u),
gone AS (SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(g.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE g.key IS NULL), '')) AS kept_sha256
FROM lines l LEFT JOIN gone g ON l.key = g.key GROUP BY doc_id""",
    "op8_decontamination": f"""
WITH dw AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
bw AS (SELECT item_id AS id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT id, least(len(w), 10) AS n, array_to_string(w[k : k + 9], ' ') AS s FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
places AS (SELECT id, n, k, array_to_string(w[k : k + n - 1], ' ') AS s FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM dw, sizes WHERE len(w) >= n)),
hits AS (SELECT p.id, p.k, p.n, win.id AS item FROM places p JOIN win ON p.n = win.n AND p.s = win.s),
words AS (SELECT id, count(DISTINCT pos) AS n_hit FROM (SELECT id, unnest(range(k, k + n)) AS pos FROM hits) GROUP BY id),
items AS (SELECT id, count(*) AS n_items, string_agg(CAST(item AS VARCHAR), ',' ORDER BY CAST(item AS VARCHAR)) AS s FROM (SELECT DISTINCT id, item FROM hits) GROUP BY id)
SELECT dw.id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items.s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (id) LEFT JOIN items USING (id)""",
    "base_secrets": """
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
pat AS (SELECT * FROM (VALUES (0, 'assign', '(?i:password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 6), (1, 'access', '(AKIA[A-Z0-9]+)', 20), (2, 'hex', '([0-9a-f]+)', 24)) v(rank, kind, re, least)),
m AS (SELECT doc_id, rank, kind, least, regexp_extract_all(t, re) AS own, regexp_extract_all(t, re, 1) AS val, string_split_regex(t, re) AS gap FROM t, pat),
k AS (SELECT *, unnest(range(1, len(own) + 1)) AS i FROM m WHERE len(own) > 0),
p AS (SELECT doc_id, rank, kind, coalesce(list_sum(list_transform(gap[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(own[1:i - 1], lambda x: length(x))), 0) AS a, length(own[i]) AS n FROM k WHERE length(val[i]) >= least),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + n AS BIGINT), ',' ORDER BY a, rank) AS s FROM p GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(s, '')) AS base_sha256 FROM t LEFT JOIN g USING (doc_id)""",
    "base_quality": """
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM t),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM t),
grams AS (SELECT doc_id, k, w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS k FROM w WHERE len(w) >= 3)),
again AS (SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
inside AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest([k, k + 1, k + 2]) AS pos FROM again) GROUP BY doc_id),
out AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(inside.n, 0) AS n_repeat_words FROM w JOIN lines USING (doc_id) LEFT JOIN inside USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM out""",
}
