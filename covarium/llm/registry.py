"""The registered queries of the training-data operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from covarium.llm import decontam, exact_dedup, language_id, merkle, packing, secret_scan, simhash, suffix_dedup, toxicity, url_filter
from covarium.llm.base import table


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), digest_all=True)


def op2_merkle_fixity(spark, sf_dir):
    """Archives made of all pages, against a replica that lost some records and has others altered."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    first = merkle.index(pages)
    altered = F.sha2(F.concat(F.lit("altered"), "sha256"), 256)
    second = first.where(~F.coalesce(F.col("page_id") % 211 == 5, F.lit(False))).withColumn("sha256", F.when(F.col("page_id") % 101 == 7, altered).otherwise(F.col("sha256")))
    return merkle.audit(first, second)


def op3_best_fit_packing(spark, sf_dir):
    return packing.best_fit(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark, sf_dir):
    return suffix_dedup.repeats(table(spark, sf_dir, "documents"))


def op5_simhash(spark, sf_dir):
    return simhash.near_classes(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark, sf_dir):
    return secret_scan.secrets(table(spark, sf_dir, "documents"))


def op7_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.scores(docs, *toxicity.train(docs, table(spark, sf_dir, "labels")))


def op8_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language_id.languages(docs, language_id.train(docs))


def op9_decontamination(spark, sf_dir):
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_url_filter(spark, sf_dir):
    return url_filter.judged(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (
    op1_exact_dedup, op2_merkle_fixity, op3_best_fit_packing, op4_suffix_dedup, op5_simhash,
    op6_secret_scan, op7_toxicity, op8_language_id, op9_decontamination, op10_url_filter,
)}

_LOW = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Runs of other characters than words have.
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

ORACLE_SQL = {
    "op1_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({_LOW.format('text')}) AS h FROM documents),
             g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS n FROM d GROUP BY h)
        SELECT d.doc_id, g.keep_id, CAST(g.n AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept, d.h AS text_sha256
        FROM d JOIN g USING (h)""",
    "op2_merkle_fixity": """
        WITH t AS (
          SELECT page_id, CAST(floor(page_id / 1000) AS BIGINT) AS archive,
                 concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: response', chr(13), chr(10), 'WARC-Record-ID: <urn:page:', page_id, '>', chr(13), chr(10),
                        'WARC-Target-URI: ', coalesce(url, ''), chr(13), chr(10), 'Content-Type: text/html', chr(13), chr(10), 'Content-Length: ',
                        strlen(coalesce(html, '')), chr(13), chr(10), chr(13), chr(10), coalesce(html, ''), chr(13), chr(10), chr(13), chr(10)) AS rec
          FROM pages),
        r AS (
          SELECT archive, page_id, CAST(strlen(rec) AS BIGINT) AS length, sha256(rec) AS a,
                 CAST(coalesce(sum(strlen(rec)) OVER (PARTITION BY archive ORDER BY page_id, sha256(rec) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
          FROM t)
        SELECT archive, "offset", length, page_id, a AS sha256_a,
               CASE WHEN page_id % 211 = 5 THEN NULL WHEN page_id % 101 = 7 THEN sha256('altered' || a) ELSE a END AS sha256_b,
               CASE WHEN page_id % 211 = 5 THEN 'missing' WHEN page_id % 101 = 7 THEN 'corrupt' ELSE 'ok' END AS status
        FROM r""",
    "op4_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
             s AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 800)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 399)) AS i FROM d WHERE n >= 400)),
             r AS (SELECT k FROM s GROUP BY k HAVING count(*) > 1),
             q AS (SELECT doc_id, i, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) AS gap FROM s SEMI JOIN r USING (k)),
             z AS (SELECT *, sum(CASE WHEN gap > 400 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM q),
             u AS (SELECT doc_id, run, min(i) AS lo, max(i) + 400 AS hi FROM z GROUP BY 1, 2),
             p AS (SELECT u.*, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS since FROM u),
             m AS (SELECT p.doc_id, sum(hi - lo) AS removed, count(*) AS spans, max(hi) AS last, string_agg(substr(h, 2 * since + 1, 2 * (lo - since)), '' ORDER BY lo) AS kept FROM p JOIN d ON p.doc_id = d.doc_id GROUP BY 1)
        SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
               sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
        FROM d LEFT JOIN m ON d.doc_id = m.doc_id""",
    "op9_decontamination": f"""
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOW.format('text')}, '{_GAP}'), lambda x: x <> '') AS w FROM documents),
             b AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array({_LOW.format('text')}, '{_GAP}'), lambda x: x <> '') AS w FROM benchmark),
             bw AS (SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[j + 1 : j + 10], ' ') AS k FROM (SELECT item, w, unnest(range(0, greatest(len(w) - 9, 1))) AS j FROM b WHERE len(w) > 0)),
             dw AS (SELECT doc_id, i, size, array_to_string(w[i + 1 : i + size], ' ') AS k FROM (SELECT doc_id, w, size, unnest(range(0, len(w) - size + 1)) AS i FROM d, (SELECT DISTINCT size FROM bw))),
             hit AS (SELECT doc_id, item, i, dw.size FROM dw JOIN bw ON dw.k = bw.k AND dw.size = bw.size),
             n AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS at FROM hit) GROUP BY 1),
             t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN t ON d.doc_id = t.doc_id""",
}
