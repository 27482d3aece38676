"""URL filters: host-suffix and path-prefix rules by hashed equi-join.

Every distinct (host, path) is expanded into the host suffixes and path
prefixes that some rule could name: suffixes with as many labels as a rule's
host has, prefixes as long as a rule's path is. Each expression is hashed; an
equi-join on the first four bytes finds candidate rules, the full SHA-256
digest confirms them, and the longest confirmed rule decides.

Only distinct addresses are expanded, so a host or address that holds a third
of the table costs one expansion; the verdict returns to the rows by an
equi-join that adaptive execution splits when one address is hot. Rules are
joined without a hint: Spark broadcasts them only if they are small.

Defined results: a null url, or one without ``://``, has empty host and path
and takes the default verdict; repeated rows are each judged; an empty rule
table leaves every url at the default; equal-length rules are decided by the
longer host, then block before allow, then the rule text. Rules with a null or
empty host never fit. Columns besides the id and the url are not read, so
names that clash with the results are harmless.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The rules of the registered query (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hexadecimal digits of the digest that the join compares first (four bytes).
SHORT = 8


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules])
    return spark.range(1).select(F.inline(rows))


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(F.regexp_extract(tail, r"\A[^?#]*", 0), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat_ws("\n", host, path), 256)


def judge_urls(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per input row: id, url, host, path, rule (or null), verdict."""
    host, path = host_and_path(F.col(url_col))
    rows = urls.select(F.col(id_col).alias(id_col), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"))
    known = rules.filter(F.length("host") > 0).select(
        F.col("host").alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), F.col("verdict").alias("rule_verdict"))
    # How many labels rule hosts have and how long rule paths are: at most as many numbers as the longest rule has characters.
    shape = known.agg(F.collect_set(F.size(F.split("rule_host", r"\."))).alias("labels"), F.collect_set(F.length("rule_path")).alias("lengths")).first()
    labels = F.split("host", r"\.")
    suffixes = [F.when(F.size(labels) >= n, F.array_join(F.slice(labels, -n, n), ".")) for n in sorted(shape["labels"])]
    prefixes = [F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sorted(shape["lengths"])]
    none = F.array().cast("array<string>")
    address = rows.select("host", "path").distinct()
    expanded = (address.withColumn("suffix", F.explode(F.array_compact(F.array(*suffixes)) if suffixes else none))
                .withColumn("prefix", F.explode(F.array_compact(F.array(*prefixes)) if prefixes else none))
                .withColumn("digest", _digest(F.col("suffix"), F.col("prefix")))
                .select("host", "path", "digest", F.substring("digest", 1, SHORT).alias("short")))
    keyed = known.withColumn("rule_digest", _digest(F.col("rule_host"), F.col("rule_path"))).withColumn("short", F.substring("rule_digest", 1, SHORT))
    rank = F.struct((F.length("rule_host") + F.length("rule_path")).alias("n"), F.length("rule_host").alias("h"),
                    (F.col("rule_verdict") == "block").alias("b"), F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict"))
    best = (expanded.join(keyed, "short").filter(F.col("digest") == F.col("rule_digest"))
            .groupBy("host", "path").agg(F.max(rank).alias("best")))
    return rows.join(best, ["host", "path"], "left").select(
        id_col, "url", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


ORACLE = """
with p as (
  select page_id, url, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages
), h as (
  select page_id, url, rest, regexp_extract(rest, '^[^/?#]*') as raw from p
), a as (
  select page_id, url, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from h
), r(verdict, rh, rp) as (values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), d as (
  select distinct host, path from a
), m as (
  select host, path, arg_max(rh || rp, length(rh) + length(rp)) as rule, arg_max(verdict, length(rh) + length(rp)) as verdict
  from d join r on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by host, path
)
select page_id, url, a.host, a.path, m.rule as rule, coalesce(m.verdict, 'allow') as verdict
from a left join m on a.host = m.host and a.path = m.path
"""
