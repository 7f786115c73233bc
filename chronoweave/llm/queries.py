"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_encode
from .cap_filters import near_vectors
from .license_scan import license_scan
from .mixing import mix_sources
from .ngram_join import ngram_jaccard_join
from .pii_surrogates import replace_pii
from .quality import quality_metrics
from .secret_scan import secret_scan
from .sharding import shard_documents
from .url_filters import url_verdicts

#: Fixed values of the url query: host, path, verdict.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def _table(name: str):
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet")


_docs, _pages, _vectors = _table("documents"), _table("pages"), _table("embeddings")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files three directories deep under their source."""
    docs = _docs(spark, sf_dir)
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.expr("doc_id div 10000"), F.expr("doc_id div 100"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return license_scan(docs.select("doc_id", path.alias("path"), "text"))


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(_docs(spark, sf_dir).select("doc_id", "lang", "source", "text"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(_pages(spark, sf_dir), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(_docs(spark, sf_dir))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_docs(spark, sf_dir))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(_docs(spark, sf_dir))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_metrics(_docs(spark, sf_dir))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(_docs(spark, sf_dir))


def op9_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_vectors(spark, sf_dir))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_docs(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_license_scan, op2_pii_surrogates, op3_url_filters, op4_bpe, op5_mixing, op6_secret_scan, op7_quality_rules, op8_ngram_join, op9_cap_filters, op10_sharding)}

_WS, _WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]+"
_SUFFIX = "(host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}')"


def _case(then) -> str:
    ranked = sorted(URL_RULES, key=lambda r: -len(r[0] + r[1]))
    return "CASE " + " ".join(f"WHEN {_SUFFIX.format(h=h, p=p)} THEN '{then(h, p, v)}'" for h, p, v in ranked)


_COMPONENTS = """
reach(node, low) AS (
  SELECT a, b FROM both_ways UNION SELECT r.node, l.b FROM reach r JOIN both_ways l ON r.low = l.a
), comp AS (SELECT node, min(low) AS low FROM reach GROUP BY 1)
"""

SQL: dict[str, str] = {
    "op3_url_filters": f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS h, regexp_extract(rest, '^[^?#]*') AS bare FROM u),
q AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(bare, length(h) + 1) AS path FROM p)
SELECT page_id, host, path, {_case(lambda h, p, v: h + p)} END AS rule, {_case(lambda h, p, v: v)} ELSE 'allow' END AS verdict FROM q""",
    "op7_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{_WORD}') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM d),
x AS (SELECT r, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) > 2),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS n FROM x),
rep AS (SELECT r, count(DISTINCT i + k) AS n_rep FROM g, range(0, 3) o(k) WHERE n > 1 GROUP BY r),
m AS (
  SELECT w.r, doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '{_WS}', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(n_rep, 0)::BIGINT AS n_repeat_words, length(t) - length(regexp_replace(t, '[!?]', '', 'g')) AS marks, len(ls) AS n_lines,
    len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS lettered,
    length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS upper, length(t) - length(regexp_replace(t, '[a-z]', '', 'g')) AS lower
  FROM w LEFT JOIN rep USING (r)
), b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 2 * marks > n_words OR NOT word_chars BETWEEN 2 * n_words AND 15 * n_words
    OR 10 * lettered < 7 * n_words OR upper > 2 * lower OR 10 * n_dup_lines > 5 * n_lines) AS kept
FROM b""",
    "op8_ngram_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links UNION SELECT a, a FROM links UNION SELECT b, b FROM links),
{_COMPONENTS}
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(low, w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN comp ON node = w.doc_id""",
    "op9_cap_filters": f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
links AS (SELECT l.vec_id AS a, r.vec_id AS b FROM v l JOIN v r ON l.vec_id < r.vec_id WHERE list_cosine_similarity(l.x, r.x) >= 0.95),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links UNION SELECT a, a FROM links UNION SELECT b, b FROM links),
{_COMPONENTS},
deg AS (SELECT a, count(*) AS n FROM (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) GROUP BY 1)
SELECT vec_id, coalesce(deg.n, 0)::BIGINT AS n_links, coalesce(low, vec_id) AS component_id, coalesce(low, vec_id) = vec_id AS kept FROM v LEFT JOIN comp ON node = vec_id LEFT JOIN deg ON a = vec_id""",
}
