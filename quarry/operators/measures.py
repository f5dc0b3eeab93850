"""Telemetry and evaluation: percentiles, daily series, summaries, comparisons."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import materialise

INPUT_PRICE, OUTPUT_PRICE = 1.25e-6, 5e-6


def cost(input_tokens: Column, output_tokens: Column) -> Column:
    return input_tokens * INPUT_PRICE + output_tokens * OUTPUT_PRICE


def at_ranks(values: DataFrame, value: str, ranks: dict[str, Callable[[Column], Column]], by: Sequence[str] = ()) -> DataFrame:
    """One row a group with the values at ranks (from 1), each given by the group's number of values.

    Equal values are counted first. Spark then deals the different ones to ranges, whose bounds it
    samples, so one far-off value crowds no range; ranges are counted, and only those that hold a
    rank are put in order. So neither a group nor all rows meet in one task.
    """
    keys = [*by] or ["_all"]
    v = values.withColumn("_all", F.lit(0)).where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    v = materialise(v.repartitionByRange(parts, *keys, value).withColumn("_range", F.spark_partition_id()))
    own = W.partitionBy(*keys)  # of ranges
    sums = v.groupBy(*keys, "_range").agg(F.sum("_c").alias("_in"))
    sums = sums.withColumns({"_before": F.sum("_in").over(own.orderBy("_range")) - F.col("_in"), "_n": F.sum("_in").over(own)})
    wanted = [rank(F.col("_n")) for rank in ranks.values()]
    holds = F.lit(False)
    for rank in wanted:
        holds = holds | ((F.col("_before") < rank) & (rank <= F.col("_before") + F.col("_in")))
    inside = v.join(sums.where(holds), [*keys, "_range"])
    last = F.col("_before") + F.sum("_c").over(W.partitionBy(*keys, "_range").orderBy(value))
    placed = inside.withColumn("_last", last).withColumn("_first", F.col("_last") - F.col("_c"))
    hit = lambda rank: (F.col("_first") < rank) & (rank <= F.col("_last"))
    return placed.groupBy(*keys).agg(*[F.max(F.when(hit(rank), F.col(value))).alias(name) for name, rank in zip(ranks, wanted, strict=True)], F.first("_n").alias("_n")).drop("_all")


def truncating(values: DataFrame, value: str, percents: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """(by, p<percent>): the value at position max(1, floor(n * p / 100)) in order."""
    return at_ranks(values, value, {f"p{p}": lambda n, p=p: F.greatest(F.lit(1), F.floor(n * p / 100)) for p in percents}, by).drop("_n")


def linear(values: DataFrame, value: str, percents: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """(by, p<percent>): interpolated between the two values around position p / 100 * (n - 1)."""
    at = lambda n, p: (n - 1) * p / F.lit(100.0)
    ranks = {f"{end}{p}": lambda n, p=p, more=more: F.least(n, F.floor(at(n, p)) + more) for p in percents for end, more in (("lo", 1), ("hi", 2))}
    found = at_ranks(values, value, ranks, by)
    part = lambda p: at(F.col("_n"), p) - F.floor(at(F.col("_n"), p))
    return found.select(*by, *[(F.col(f"lo{p}") + part(p) * (F.col(f"hi{p}") - F.col(f"lo{p}"))).alias(f"p{p}") for p in percents])


def daily(logs: DataFrame) -> DataFrame:
    """One row a day of logs (ts, latency_ms, input_tokens, output_tokens)."""
    d = logs.withColumn("date", F.date_format("ts", "yyyy-MM-dd"))
    sums = d.groupBy("date").agg(
        F.round(F.avg("latency_ms"), 6).alias("avg_latency_ms"), F.count("*").alias("query_count"), F.round(F.avg("input_tokens"), 6).alias("avg_input_tokens"),
        F.round(F.sum(cost(F.col("input_tokens"), F.col("output_tokens"))), 9).alias("cost_usd"))
    return sums.join(truncating(d, "latency_ms", (50, 95), ("date",)), "date", "left")


def last_days(logs: DataFrame, n: int) -> DataFrame:
    """(date, query_count) of the n latest days."""
    days = logs.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("date")).agg(F.count("*").alias("query_count"))
    return days.orderBy(F.desc("date")).limit(n)


def summary(logs: DataFrame) -> DataFrame:
    total = F.sum(cost(F.col("input_tokens"), F.col("output_tokens")))
    nought = lambda c: F.coalesce(c, F.lit(0.0))
    sums = logs.agg(
        F.count("*").alias("total_queries"), nought(F.round(F.avg("latency_ms"), 6)).alias("avg_latency_ms"), nought(F.round(total, 9)).alias("total_cost_usd"),
        nought(F.round(F.try_divide(total, F.count("*")), 12)).alias("cost_per_query_usd"))
    both = sums.join(F.broadcast(truncating(logs, "latency_ms", (50, 95))), F.lit(True), "left")
    return both.select(*sums.columns, nought(F.col("p50")).alias("p50"), nought(F.col("p95")).alias("p95"))


def stat_cards(summaries: DataFrame) -> DataFrame:
    """The five figures shown of a summary, as text: rounded half away from nought, with commas between thousands."""
    shown = lambda c, digits: F.format_number(F.round(c, digits), digits)  # noqa: E731  format_number alone rounds half to even
    return summaries.select(
        F.format_number("total_queries", 0).alias("total_queries"),
        F.concat(shown("avg_latency_ms", 0), F.lit(" ms")).alias("avg_latency"),
        F.concat(shown("p95", 0), F.lit(" ms")).alias("p95_latency"),
        F.concat(F.lit("$"), shown("total_cost_usd", 4)).alias("total_cost"),
        F.concat(F.lit("$"), shown("cost_per_query_usd", 5)).alias("cost_per_query"),
    )


def eval_summary(results: DataFrame) -> DataFrame:
    """One row of results (status, category, latency_ms, input_tokens, output_tokens, correctness, hallucination, faithfulness, precision)."""
    ok = F.col("status") == "ok"
    own = lambda c: F.when(ok, F.col(c))
    mean = lambda c: F.round(F.avg(c), 4)
    sums = results.agg(
        F.count("*").alias("num_queries"), F.count(F.when(~ok, 1)).alias("failed_queries"), F.round(F.avg(own("latency_ms")), 1).alias("avg_latency_ms"),
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), mean(own("correctness")).alias("avg_correctness"), mean(own("hallucination")).alias("avg_hallucination"),
        mean(own("faithfulness")).alias("avg_faithfulness"), mean(F.when(F.col("category") != "out-of-scope", own("precision"))).alias("avg_context_precision"))
    p = linear(results.where(ok), "latency_ms", (50, 95))
    both = sums.join(F.broadcast(p), F.lit(True), "left")
    return both.select(*sums.columns, F.round("p50", 1).alias("p50_latency_ms"), F.round("p95", 1).alias("p95_latency_ms"))


def category_scores(results: DataFrame) -> DataFrame:
    return results.where("correctness IS NOT NULL").groupBy("category").agg(F.round(F.avg("correctness"), 1).alias("correctness"), F.round(F.avg("faithfulness"), 1).alias("faithfulness"))


def footer(results: DataFrame, metrics: Sequence[str], category: str | None = None, leave_out: dict[str, str] | None = None) -> DataFrame:
    """Means of metrics over the successful rows of a category (None: of all); leave_out names a category that a metric skips."""
    rows = results if category is None else results.where(F.col("category") == category)
    skipped = leave_out or {}
    own = lambda m: F.when(F.col("category") != skipped[m], F.col(m)) if m in skipped else F.col(m)
    return rows.where("status = 'ok'").agg(*[F.avg(own(m)).alias(f"avg_{m}") for m in metrics])


def band(value: Column, good: float, fair: float, low_is_good: bool = False) -> Column:
    at = (lambda x: value <= x) if low_is_good else (lambda x: value >= x)
    return F.when(at(good), "green").when(at(fair), "amber").when(value.isNotNull(), "red")


def compare_runs(a: DataFrame, b: DataFrame, least: float = 0.5) -> DataFrame:
    """(query_id, d_correctness, d_faithfulness, changed) of two runs' common queries, b less a."""
    met = a.alias("a").join(b.alias("b"), "query_id")
    d = {f"d_{c}": F.col(f"b.{c}") - F.col(f"a.{c}") for c in ("correctness", "faithfulness")}
    out = met.select("query_id", *[v.alias(k) for k, v in d.items()])
    return out.withColumn("changed", F.coalesce((F.abs("d_correctness") > least) | (F.abs("d_faithfulness") > least), F.lit(False)))


def mean_deltas(compared: DataFrame) -> DataFrame:
    """Mean differences over the queries that both runs scored."""
    return compared.agg(F.avg("d_correctness").alias("d_correctness"), F.avg("d_faithfulness").alias("d_faithfulness"), F.count("d_correctness").alias("pairs"))


def ratio(part: Column, whole: Column) -> Column:
    """Precision, or the share of unsupported claims: 0 of none."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))
