"""URL filters: host-suffix and path-prefix expressions, joined with rules on short hash prefixes.

Each url is expanded into every host suffix (at label bounds) times those of its path
prefixes that are as long as some rule's path; each expression and each rule gets a
SHA-256 digest. Expressions meet rules on the first 8 hex digits; the full digest
then confirms. Of a url's matching rules the longest (host and path together) decides;
among equally long ones the longer host, then block before allow. If none matches,
``default`` does. All DataFrame operations.

Nulls and urls without ``://`` have empty host and path and match nothing but a rule
of those. Repeated pages are judged one by one; repeated rules count once; null rules
are left out. Empty tables: no pages give no rows, no rules give the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"(?s)^([^?#]*)", 1)
    return F.translate(host, upper, upper.lower()), path


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", carry: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The carried columns with host, path, rule (host and path of the deciding rule) and verdict.

    rules: (host, path, verdict). The set of rule path lengths, bounded by the longest
    path, is the only thing collected. The rules' table is broadcast by Spark if its
    size allows and shuffled otherwise; skewed prefixes are split by adaptive execution.
    """
    clean = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL").select(
        F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
    clean = clean.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("rule_verdict"))  # block sorts after allow
    lengths = sorted(r[0] for r in clean.select(F.length("rule_path")).distinct().collect())
    digest = lambda h, p: F.sha2(F.concat(h, F.lit("\x00"), p), 256)
    clean = clean.withColumn("rule_digest", digest(F.col("rule_host"), F.col("rule_path"))).withColumn("short", F.substring("rule_digest", 1, PREFIX))
    host, path = host_and_path(F.col(url))
    d = pages.select(*carry, host.alias("host"), path.alias("path")).withColumn("_row", F.monotonically_increasing_id())
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter(F.lit(lengths).cast("array<int>") if lengths else F.array().cast("array<int>"), lambda n: n <= F.length("path"))
    x = d.withColumn("_suffix", F.explode(suffixes)).withColumn("_length", F.explode_outer(fitting))
    x = x.withColumn("_digest", digest(F.col("_suffix"), F.substring(F.col("path"), F.lit(1), F.col("_length"))))
    met = x.join(clean, (F.substring("_digest", 1, PREFIX) == F.col("short")) & (F.col("_digest") == F.col("rule_digest")), "left")
    rank = F.when(F.col("rule_host").isNotNull(), F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("n"), F.length("rule_host").alias("h"), F.col("rule_verdict").alias("v"), F.concat("rule_host", "rule_path").alias("rule")))
    best = met.groupBy("_row").agg(*[F.first(c).alias(c) for c in (*carry, "host", "path")], F.max(rank).alias("best"))
    return best.select(*carry, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.v", F.lit(default)).alias("verdict"))
