"""Operator 8: URL filters by pattern rules indexed by their rarest literal token (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: (verdict, rule): a rule is host and path; it fits the host and its subdomains where the URL's path starts with its path.
RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]
#: The verdict on a URL that no rule fits: the lists name what to block, so the rest is allowed.
DEFAULT_VERDICT = "allow"
#: An index of up to so many rules is broadcast (under 100 MB at 1 kB a rule); beyond it the join is shuffled and salted.
BROADCAST_RULES = 100_000
SALTS = 64


def host_of(url: Column) -> Column:
    """Between the first :// and the next / ? # or the end, A-Z in lower case; empty without :// or for null."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_tokens(host: Column) -> Column:
    return F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))


def path_tokens(path: Column) -> Column:
    return F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), x))


def compile_rules(rules: DataFrame) -> DataFrame:
    """rule, verdict, size, regex and tokens of rules(rule, verdict).

    The tokens are the literals that every fitting URL must hold whole: all labels of the host, and the segments of
    the path but the last, which the URL may continue.
    """
    host, path = F.regexp_extract("rule", "^([^/]*)", 1), F.regexp_extract("rule", "(?s)^[^/]*(.*)$", 1)
    quoted = lambda c: F.regexp_replace(c, r"([^\p{L}\p{N}/_\s])", r"\\$1")
    whole = F.regexp_extract(path, "(?s)^(.*)/[^/]*$", 1)
    return rules.filter(F.col("rule").isNotNull()).dropDuplicates(["rule"]).select(
        "rule",
        "verdict",
        F.length("rule").alias("size"),
        F.concat(F.lit(r"(?s)^(?:[^/]*\.)?"), quoted(host), F.lit("/"), quoted(path)).alias("regex"),
        F.array_distinct(F.concat(host_tokens(host), F.when(path.contains("/"), path_tokens(whole)).otherwise(F.array().cast("array<string>")))).alias("tokens"),
    )


def rarest_index(compiled: DataFrame, tokens: DataFrame) -> DataFrame:
    """Each rule under the token that the fewest URLs hold (ties: the first in order). tokens: a row per URL and token."""
    literal = compiled.select("rule", F.explode("tokens").alias("token"))
    counts = tokens.join(F.broadcast(literal.select("token").distinct()) if _small(compiled) else literal.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    seen = literal.join(counts, "token", "left").groupBy("rule").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token"))
    return compiled.drop("tokens").join(seen, "rule")


def _small(compiled: DataFrame) -> bool:
    return compiled.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES


def url_filter(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    Of the rules that fit, the longest decides (ties: the later in order). A URL that is null or has no :// has an
    empty host and path and gets the default verdict, as does one that no rule fits; its rule is null. Repeated rows
    give repeated rows. No rules: every verdict is the default. Null rules are passed over. Other columns are not read.
    """
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    urls = urls.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    # The token null stands for the row itself: it keeps rows without candidates and counts repeats.
    every = F.concat(F.array(F.lit(None).cast("string")), F.array_distinct(F.concat(host_tokens(F.col("host")), path_tokens(F.col("path")))))
    tokens = urls.select("page_id", "host", "path", F.explode(every).alias("token"))
    compiled = compile_rules(rules)
    small = _small(compiled)
    index = rarest_index(compiled, tokens.select("token"))
    if small:
        met = tokens.join(F.broadcast(index), "token", "left")
    else:
        spread = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = tokens.withColumn("salt", F.pmod(F.xxhash64("page_id", "host", "path"), F.lit(SALTS)).cast("int"))
        met = salted.join(spread, ["token", "salt"], "left")
    # No host holds a slash, so the first one ends it, whatever else stands in either.
    fits = F.expr("regexp_like(concat(host, '/', path), regex)")
    best = F.max(F.when(fits, F.struct("size", "rule", "verdict")))
    # All rows of a page come from one row of the input, so they are combined before the shuffle.
    found = met.groupBy("page_id", "host", "path").agg(best.alias("best"), F.count(F.when(F.col("token").isNull(), 1)).alias("n"))
    once = found.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"), "n")
    return once.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("n")


def rules_table(spark: SparkSession, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame([(rule, verdict) for verdict, rule in rules], "rule string, verdict string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(shared.table(spark, sf_dir, "pages"), rules_table(spark))


_FITS = "\n  UNION ALL\n".join(
    f"  SELECT page_id, host, path, '{rule}' AS rule, '{verdict}' AS verdict, {len(rule)} AS size FROM parts "
    f"WHERE (host = '{rule.split('/')[0]}' OR ends_with(host, '.{rule.split('/')[0]}')) AND starts_with(path, '/{rule.split('/', 1)[1]}')"
    for verdict, rule in RULES
)
SQL = f"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, lower(regexp_extract(rest, '^[^/?#]*')) AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), fits AS (
{_FITS}
), best AS (
  SELECT page_id, arg_max(rule, size) AS rule, arg_max(verdict, size) AS verdict FROM fits GROUP BY page_id
)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, '{DEFAULT_VERDICT}') AS verdict
FROM parts p LEFT JOIN best b ON p.page_id = b.page_id
"""
