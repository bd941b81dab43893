"""Queries over the filters: URL rules, quality rules, personal data, HTML text, quality scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_text, pii, quality, url_filter
from .common import table

#: The rule list of the contract.
URL_RULES = [
    url_filter.UrlRule.parse("allow", "org/"),
    url_filter.UrlRule.parse("block", "example.org/es/"),
    url_filter.UrlRule.parse("block", "example.org/en/1"),
    url_filter.UrlRule.parse("allow", "com/fr/"),
    url_filter.UrlRule.parse("block", "com/de/"),
]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "template")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    said = lambda spans: F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
    )
    base = F.filter("spans", lambda x: x["kind"].isin("email", "ip", "card", "phone"))
    return found.select(
        "doc_id", *(count(kind).alias(f"n_{kind}") for kind in pii.KINDS),
        F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"),
        F.coalesce(F.array_min(F.transform("spans", lambda x: x["score"])), F.lit(1.0)).alias("least_score"),
    )


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = html_text.extract_pages(table(spark, sf_dir, "pages"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_quality_rules": op2_quality_rules,
    "op3_pii": op3_pii,
    "op5_html_extraction": op5_html_extraction,
}

_STOP_LIST = ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(set(quality.STOP_WORDS)))



def _url_oracle() -> str:
    """The whole method as SQL: rules, chains, one pair of subqueries per level of the tree, and the judgement."""
    case = " ".join(
        f"WHEN (host = '{r.host}' OR host LIKE '%.{r.host}') AND starts_with(path, '{r.path}') THEN {{'rule': '{r.text}', 'verdict': '{r.verdict}'}}"
        for r in sorted(URL_RULES, key=lambda r: -len(r.text))
    )
    levels, top = "", url_filter.TREE_LEVELS
    few = f"HAVING count(*) >= {url_filter.MIN_CHILDREN} AND sum(n) <= {url_filter.MAX_MEAN_URLS} * count(*)"
    for d in range(1, top + 1):
        prefix, before = f"array_to_string(tpl[1:{d - 1}], '/')", f"t{d - 1}"
        levels += f"""
v{d} AS (
  SELECT host, prefix FROM (
    SELECT host, {prefix} AS prefix, tpl[{d}] AS seg, sum(n) AS n FROM {before}
    WHERE len(tpl) >= {d} AND NOT contains(tpl[{d}], '*') GROUP BY ALL)
  GROUP BY host, prefix {few}),
t{d} AS (
  SELECT t.host, chain, n, bad, good,
         CASE WHEN v.host IS NOT NULL AND len(tpl) >= {d} AND NOT contains(tpl[{d}], '*')
              THEN tpl[1:{d - 1}] || ['*'] || tpl[{d + 1}:] ELSE tpl END AS tpl
  FROM {before} t LEFT JOIN v{d} v ON t.host = v.host AND {prefix} = v.prefix),"""
    return f"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) END AS rest FROM pages),
h AS (
  SELECT page_id, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
         coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host
  FROM u),
p AS (
  SELECT page_id, host, path, hit.rule AS rule, hit.verdict AS label,
         list_filter(string_split(regexp_replace(path, '[0-9]+', '*', 'g'), '/'), lambda x: x <> '') AS chain
  FROM (SELECT *, CASE {case} END AS hit FROM h)),
t0 AS (
  SELECT host, chain, count(*) AS n, count(*) FILTER (label = 'block') AS bad, count(*) FILTER (label = 'allow') AS good, chain AS tpl
  FROM p GROUP BY host, chain),{levels}
below AS (
  SELECT host, prefix, place, seg, sum(n) AS n FROM (
    SELECT host, array_to_string(tpl[1:{top}], '/') AS prefix, n, unnest(range({top} + 1, len(tpl) + 1)) AS place, unnest(tpl[{top} + 1:]) AS seg FROM t{top})
  WHERE NOT contains(seg, '*') GROUP BY ALL),
deep AS (SELECT host, prefix, list(place) AS places FROM (SELECT host, prefix, place FROM below GROUP BY host, prefix, place {few}) GROUP BY host, prefix),
named AS (
  SELECT t.host, chain, bad, good,
         array_to_string(CASE WHEN places IS NULL THEN tpl ELSE
           list_transform(tpl, lambda x, i: CASE WHEN list_contains(places, i) AND NOT contains(x, '*') THEN '*' ELSE x END) END, '/') AS template
  FROM t{top} t LEFT JOIN deep ON t.host = deep.host AND array_to_string(tpl[1:{top}], '/') = prefix),
leaves AS (SELECT host, template, sum(bad) AS bad, sum(good) AS good FROM named GROUP BY ALL),
counts AS (
  SELECT *, sum(bad) OVER (PARTITION BY template) AS pb, sum(good) OVER (PARTITION BY template) AS pg,
         coalesce(sum(bad) OVER () / nullif(sum(bad + good) OVER (), 0), 0) AS rate
  FROM leaves),
rates AS (
  SELECT *, pb / nullif(pb + pg, 0) AS pooled, bad + good AS seen, pb + pg - bad - good AS others,
         abs(bad / nullif(bad + good, 0) - (pb - bad) / nullif(pb + pg - bad - good, 0)) AS apart
  FROM counts),
merging AS (
  SELECT *, coalesce(apart < {url_filter.SAME_Z} * sqrt(pooled * (1 - pooled) * (1 / nullif(seen, 0) + 1 / nullif(others, 0))), apart = 0, true) AS merged
  FROM rates),
judged AS (SELECT host, template, rate, CASE WHEN merged THEN pb ELSE bad END AS b, CASE WHEN merged THEN pg ELSE good END AS g FROM merging),
tree AS (
  SELECT n.host, chain, '/' || n.template AS template,
         CASE WHEN (b + {url_filter.SMOOTHING} * rate) / (b + g + {url_filter.SMOOTHING}) >= {url_filter.BLOCK_AT} AND b + g >= {url_filter.MIN_LABELS}
              THEN 'block' ELSE 'allow' END AS verdict
  FROM named n JOIN judged j ON n.host = j.host AND n.template = j.template)
SELECT page_id, p.host, path, rule, coalesce(label, CASE WHEN p.host <> '' THEN tree.verdict END, 'allow') AS verdict, template
FROM p LEFT JOIN tree ON p.host = tree.host AND p.chain = tree.chain
"""


ORACLE_SQL = {
    "op1_url_filters": _url_oracle(),
    "op2_quality_rules": rf"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
win AS (
  SELECT r, unnest(range(1, len(ws) - 6)) AS p,
         unnest(list_transform(range(1, len(ws) - 6), lambda i: array_to_string(ws[i:i + 7], ' '))) AS w
  FROM t WHERE len(ws) >= 8),
again AS (SELECT r, p FROM win QUALIFY count(*) OVER (PARTITION BY r, w) > 1),
covered AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + 8)) AS q FROM again) GROUP BY r),
c AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words,
         length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         len(regexp_extract_all(x, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words,
         len(ls) AS n_lines,
         len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS n_stutter,
         len(list_intersect(list_distinct(ws), [{_STOP_LIST}])) AS n_stop,
         len(regexp_extract_all(x, '[!?]')) AS n_bangs,
         len(regexp_extract_all(x, '\p{{Lu}}')) AS n_upper,
         length(regexp_replace(x, '[^\p{{L}}\p{{M}}]+', '', 'g')) AS n_letters,
         len(list_filter(ls, lambda l: regexp_matches(l, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullet,
         len(list_filter(ls, lambda l: regexp_matches(l, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis
  FROM t LEFT JOIN covered USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed
       AND word_chars::DOUBLE / n_words BETWEEN 2.0 AND 14.0
       AND n_symbols::DOUBLE / n_words <= 0.1
       AND n_bangs::DOUBLE / n_words <= 0.25
       AND coalesce(n_upper::DOUBLE / nullif(n_letters, 0), 0) <= 0.5
       AND n_letters::DOUBLE / word_chars >= 0.6
       AND n_stop >= 2
       AND n_stutter::DOUBLE / n_words <= 0.3
       AND n_dup_lines::DOUBLE / n_lines <= 0.5
       AND n_bullet::DOUBLE / n_lines <= 0.9
       AND n_ellipsis::DOUBLE / n_lines <= 0.3 AS kept
FROM b
""",
}
