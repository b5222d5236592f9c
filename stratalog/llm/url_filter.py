"""URL filters: rules on a host and its subdomains and on the beginning of the path.

A URL is expanded into expressions, a suffix of its host (whole labels) followed by a beginning of its path; only as many
labels and such lengths as some rule has. Expressions meet rules by an equi-join on a short prefix of their SHA-256; the
full digest confirms a match. Of a URL's rules the longest decides, of equally long ones a blocking one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Digest characters that the join uses, and the most rules that are broadcast (about 150 bytes each).
SHORT, BROADCAST_RULES = 8, 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    after = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)([^?#]*)", 1), F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)([^?#]*)", 2)
    return F.coalesce(F.translate(after[0], UPPER, LOWER), F.lit("")), F.coalesce(after[1], F.lit(""))


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` as the struct ``row`` with ``host``, ``path``, ``rule`` (null: none) and ``verdict``.

    ``rules(host, path, verdict)``; host and path must be given as they are compared, nulls never match. A null url or one
    without ``://`` has empty host and path, which no rule fits. Repeated rows and urls get the same verdict; very long urls
    are expanded to as many labels and such lengths as rules have; an empty table gives an empty one; other columns come
    back in ``row``, whatever their names.

    Rows without a host are dealt by a hash of the row, and what was found for a url is written before rows meet it, so that
    adaptive execution can split a url that very many rows share.
    """
    host, path = host_and_path(pages[url_col])
    rows = pages.select(F.struct(*(pages[c] for c in pages.columns)).alias("row"), host.alias("host"), path.alias("path"))
    rules = rules.select("host", "path", "verdict").where("host is not null and path is not null and host != ''")
    bounds = rules.agg(F.count("*").alias("rules"), F.max(F.size(F.split("host", r"\."))).alias("labels"), F.sort_array(F.collect_set(F.length("path"))).alias("lengths")).collect()[0]
    if not bounds["rules"]:
        return rows.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    distinct = rows.select("host", "path").where("host != ''").distinct()
    labels = distinct.withColumn("labels", F.slice(F.reverse(F.split("host", r"\.")), 1, bounds["labels"]))
    suffixes = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda n: F.array_join(F.reverse(F.slice("labels", 1, n)), "."))
    suffixed = labels.select("host", "path", F.explode(suffixes).alias("suffix"))
    beginnings = F.transform(F.filter(F.array(*(F.lit(n) for n in bounds["lengths"])), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    expressions = suffixed.select("host", "path", "suffix", F.explode(beginnings).alias("beginning"))
    expressions = expressions.select("host", "path", F.concat("suffix", "beginning").alias("expression"))
    digest = F.sha2("expression", 256)
    expressions = expressions.select("host", "path", digest.alias("digest"), F.substring(digest, 1, SHORT).alias("short"))

    expression = F.concat("host", "path")
    known = rules.groupBy(expression.alias("rule")).agg(F.max(F.col("verdict") == "block").alias("blocks"))
    known = known.select("rule", "blocks", F.sha2("rule", 256).alias("rule_digest"), F.substring(F.sha2("rule", 256), 1, SHORT).alias("short"))
    if bounds["rules"] <= BROADCAST_RULES:
        known = F.broadcast(known)
    matches = expressions.join(known, "short").where("digest = rule_digest")
    best = matches.groupBy("host", "path").agg(F.max_by(F.struct("rule", "blocks"), F.struct(F.length("rule"), "blocks", "rule")).alias("best"))
    best = best.select(F.col("host").alias("of_host"), F.col("path").alias("of_path"), "best")
    best = Scratch(pages.sparkSession, "url-filter").table("best", best)
    dealt = F.when(F.col("host") != "", F.col("host")).otherwise(F.concat(F.lit("/"), F.xxhash64("row")))  # no host holds a slash
    judged = rows.withColumn("dealt", dealt).join(best, (F.col("dealt") == F.col("of_host")) & (F.col("path") == F.col("of_path")), "left")
    verdict = F.when(F.col("best").isNull(), F.lit(default)).otherwise(F.when(F.col("best.blocks"), F.lit("block")).otherwise(F.lit("allow")))
    return judged.select("row", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))


ORACLE_SQL = """
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages
), rules(rule_host, rule_path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), fits AS (
  SELECT p.host, p.path, max_by(r.rule_host || r.rule_path, length(r.rule_host || r.rule_path)) AS rule, max_by(r.verdict, length(r.rule_host || r.rule_path)) AS verdict
  FROM (SELECT DISTINCT host, path FROM parts) p JOIN rules r
    ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
  GROUP BY p.host, p.path
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON p.host = f.host AND p.path = f.path
"""
