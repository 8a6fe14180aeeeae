"""Registered queries of the operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (align, bpe, decontaminate, exact_dedup, filter_audit, language, line_dedup, lm,
               quality, simhash, sketch, suffix_dedup, url_filter)
from .common import cut, prepare

QUERIES = {}
ORACLES = {}


def query(fn):
    """Register under the function's own name."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(prepare(spark), sf_dir)
    QUERIES[fn.__name__] = run
    return fn


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def tokenizer() -> tuple[str, str]:
    """Rank file and pre-token pattern of the installed public tokenizers."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@query
def op1_suffix_array_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


ORACLES["op1_suffix_array_dedup"] = """
WITH d AS (SELECT doc_id, row_number() OVER () AS n, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT n, i, hash(array_slice(b, i + 1, i + 400)) AS h
      FROM (SELECT n, b, unnest(range(octet_length(b) - 399)) AS i FROM d WHERE octet_length(b) >= 400)),
s AS (SELECT n, i FROM w SEMI JOIN (SELECT h FROM w GROUP BY h HAVING count(*) > 1) r USING (h)),
g AS (SELECT n, i, sum(new) OVER (PARTITION BY n ORDER BY i) AS run FROM (
        SELECT n, i, CASE WHEN i <= lag(i) OVER (PARTITION BY n ORDER BY i) + 400 THEN 0 ELSE 1 END AS new FROM s)),
r AS (SELECT n, min(i) AS a, max(i) + 400 AS z FROM g GROUP BY n, run),
k AS (SELECT n, a, z, coalesce(lag(z) OVER (PARTITION BY n ORDER BY a), 0) AS before FROM r),
p AS (SELECT n, count(*) AS n_spans, sum(z - a) AS n_removed, max(z) AS last,
             string_agg(substring(hex(b), 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head
      FROM k JOIN d USING (n) GROUP BY n)
SELECT doc_id, octet_length(b) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || substring(hex(b), 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN p USING (n)
"""


@query
def op2_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.rule_table(spark))


ORACLES["op2_url_filter"] = """
WITH p AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r
  FROM pages),
h AS (
  SELECT page_id, coalesce(translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                           'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM p),
u AS (SELECT *, row_number() OVER () AS n FROM h),
rules(rule_host, rule_path, action) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
  ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fit AS (
  SELECT n, rule_host || rule_path AS rule, action,
         row_number() OVER (PARTITION BY n ORDER BY length(rule_host || rule_path) DESC) AS place
  FROM u JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host))
                    AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict
FROM u LEFT JOIN fit ON fit.n = u.n AND place = 1
"""


@query
def op3_language_id(spark, sf_dir):
    """Documents whose remainder is 2 are held out; the machines see text and lang only."""
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(4) == 2
    model = language.fit(docs.filter(~held_out).select("text", "lang"))
    return docs.select("doc_id", held_out.alias("held_out"), language.predict(model).alias("p")) \
        .select("doc_id", "held_out", "p.lang_pred", "p.score")


@query
def op4_byte_bpe(spark, sf_dir):
    ranks, pattern = tokenizer()
    encoded = bpe.encode(table(spark, sf_dir, "documents"), ranks, pattern)
    return bpe.decode(encoded, ranks, pattern).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256)
        .alias("ids_sha256"), F.sha2("body", 256).alias("decoded_sha256"))


def quality_model(spark, sf_dir, docs, *more):
    """Statistics of all documents once, the model from the labelled ones that are not held out.

    ``more`` columns are written beside the statistics.
    """
    rows = cut(docs.select("doc_id", quality.stats().alias("stats"), *more))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return rows, quality.fit(rows.filter(remainder(3) != 1).join(labels, "doc_id"))


@query
def op5_quality(spark, sf_dir):
    rows, model = quality_model(spark, sf_dir, table(spark, sf_dir, "documents"))
    return rows.select("doc_id", (remainder(3) == 1).alias("held_out"),
                       quality.score_of_stats(model).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


@query
def op6_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", "fingerprint", "component_id")


@query
def op7_lm_scores(spark, sf_dir):
    return lm.scores(table(spark, sf_dir, "documents"))


@query
def op8_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents")).drop("k1", "k2")


ORACLES["op8_exact_dedup"] = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
r AS (
  SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
         row_number() OVER w AS place, first_value(doc_id) OVER w AS keep_id
  FROM n WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""


@query
def op9_decontamination(spark, sf_dir):
    rows = decontaminate.contamination(table(spark, sf_dir, "documents"),
                                       table(spark, sf_dir, "benchmark"))
    return rows.select(
        "doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"))


ORACLES["op9_decontamination"] = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS n,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size,
         array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
place AS (
  SELECT n, i, size, array_to_string(w[i:i + size - 1], ' ') AS t
  FROM (SELECT n, w, size, unnest(range(1, len(w) - size + 2)) AS i
        FROM d, sizes WHERE len(w) >= size)),
hit AS (SELECT n, i, win.size, item_id FROM place JOIN win ON place.size = win.size AND place.t = win.t),
words AS (
  SELECT n, count(DISTINCT k) AS n_hit
  FROM (SELECT n, unnest(range(i, i + size)) AS k FROM (SELECT DISTINCT n, i, size FROM hit)) GROUP BY n),
items AS (
  SELECT n, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT n, item_id FROM hit) GROUP BY n)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON words.n = d.n LEFT JOIN items ON items.n = d.n
"""


@query
def op10_line_dedup(spark, sf_dir):
    """Documents without the lines that ten or more sources share."""
    return line_dedup.clean_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256)
        .alias("kept_sha256"))


ORACLES["op10_line_dedup"] = r"""
WITH d AS (SELECT doc_id, source, row_number() OVER () AS n,
                  string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT n, source, unnest(parts) AS line, generate_subscripts(parts, 1) AS i FROM d),
wide AS (SELECT line FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY line HAVING count(DISTINCT source) >= 10),
kept AS (
  SELECT n, string_agg(line, chr(10) ORDER BY i) AS text, count(*) AS n_kept
  FROM l WHERE line NOT IN (SELECT line FROM wide) GROUP BY n)
SELECT doc_id, CAST(len(parts) AS BIGINT) AS n_lines, len(parts) - coalesce(n_kept, 0) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.n = d.n
"""


@query
def op11_filter_audit(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op11_filter_audit"] = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
firsts AS (SELECT t, min(doc_id) AS first_id FROM d GROUP BY t),
lab AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
               max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(ws) < 100 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 2 ELSE 0 END
         + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t)
                THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN first_id < w.doc_id THEN 16 ELSE 0 END AS mask
  FROM w JOIN firsts USING (t) LEFT JOIN lab ON lab.doc_id = w.doc_id),
l(f, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order,
         [a.b, b.b, c.b, d.b, e.b] AS bits
  FROM l a, l b, l c, l d, l e WHERE a.b + b.b + c.b + d.b + e.b = 31
    AND a.b | b.b | c.b | d.b | e.b = 31),
s AS (
  SELECT filter_order, step, bits[step] AS own, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INTEGER) AS earlier
  FROM o, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step)),
x AS (
  SELECT part, filter_order, step, own, good, toxic, mask & own <> 0 AS fails,
         mask & earlier <> 0 AS gone, mask FROM m, s),
g AS (
  SELECT part, filter_order, step, own, count(*) FILTER (NOT fails AND NOT gone) AS kept,
         count(*) FILTER (fails AND NOT gone) AS removed, count(*) FILTER (fails AND gone) AS redundant,
         count(*) FILTER (mask = own) AS unique_fails,
         CAST(coalesce(sum(good) FILTER (fails AND NOT gone), 0) AS BIGINT) AS good_lost,
         CAST(coalesce(sum(toxic) FILTER (fails AND NOT gone), 0) AS BIGINT) AS toxic_lost
  FROM x GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM g
"""


@query
def op12_document_fingerprints(spark, sf_dir):
    return sketch.fingerprints(table(spark, sf_dir, "documents"))


ORACLES["op12_document_fingerprints"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
e AS (
  SELECT doc_id, t, coalesce(lead(t) OVER w, first_value(t) OVER w) AS next_t,
         coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id
  FROM d WINDOW w AS (ORDER BY doc_id)),
f AS (
  SELECT doc_id, next_id, t, next_t, left(t, length(t) - length(t) // 2) || left(next_t, length(t) // 2) AS edited
  FROM e),
u AS (SELECT DISTINCT t FROM (SELECT t FROM f UNION ALL SELECT edited FROM f)),
w AS (SELECT t, regexp_extract_all(t, '[^ 	-
]+') AS ws FROM u),
h AS (
  SELECT t, md5(array_to_string(ws[i:i + 4], ' '))[1:16] AS x
  FROM (SELECT t, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
s AS (
  SELECT t, list_sort(list_distinct(list(x))) AS sk
  FROM (SELECT t, x, min(x) OVER (PARTITION BY t) AS least FROM h)
  WHERE x < '2000000000000000' OR x = least GROUP BY t),
k AS (
  SELECT f.doc_id, next_id, length(f.t) AS n_chars, sha256(f.edited) AS edited_sha256,
         coalesce(a.sk, []) AS own, coalesce(b.sk, []) AS ed, coalesce(c.sk, []) AS nx
  FROM f LEFT JOIN s a ON a.t = f.t LEFT JOIN s b ON b.t = f.edited LEFT JOIN s c ON c.t = f.next_t)
SELECT doc_id, next_id, n_chars, edited_sha256, array_to_string(own, '') AS fingerprint,
       array_to_string(ed, '') AS edited_fingerprint,
       CASE WHEN len(own) = 0 THEN CASE WHEN len(ed) = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
            ELSE len(list_intersect(own, ed)) / len(own) END AS near_edited,
       CASE WHEN len(own) = 0 THEN CASE WHEN len(nx) = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
            ELSE len(list_intersect(own, nx)) / len(own) END AS near_next
FROM k
"""


@query
def op13_tokenizer_alignment(spark, sf_dir):
    import public_tokenizers
    return align.alignment(table(spark, sf_dir, "documents"),
                           public_tokenizers.path("byte_bpe_50k.json"),
                           public_tokenizers.path("piece_bpe_32k.model"))
