"""Numbering and percentiles by sampled ranges: outliers, wide, text and repeated values."""

import math
import random

from pyspark.sql import functions as F

from quarry.operators import blocks as B
from quarry.operators import measures as M


def test_numbers_of_any_ids(spark):
    rng = random.Random(1)
    wide = [rng.randint(-(2**63), 2**63 - 1) for _ in range(3000)] + [2**63 - 1, -(2**63)]
    for ids, kind in ((sorted(set(wide)), "long"), (sorted(f"{k:x}" for k in range(2000)), "string"), ([*range(5000), 10**15], "long"), ([None, 3, 9], "long"), ([], "long")):
        df = spark.createDataFrame([(i,) for i in random.Random(2).sample(ids, len(ids))], f"id {kind}").repartition(5)
        assert {r["n"]: r["id"] for r in B.number(df, "id").collect()} == dict(enumerate(ids))


def test_one_far_value_crowds_no_range(spark):
    """Most values lie in the first millionth between the least and the greatest; ranges still share them."""
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        df = spark.range(50_000).select(F.col("id").cast("double").alias("x")).unionByName(spark.createDataFrame([(1e12,)], "x double"))
        spread = df.repartitionByRange(64, "x").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert spread < 0.05 * 50_001
        assert M.truncating(df, "x", (1, 50, 95, 100)).first().asDict() == {"p1": 499.0, "p50": 24_999.0, "p95": 47_499.0, "p100": 1e12}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)


def test_percentiles_by_group(spark):
    rng = random.Random(3)
    rows = [(g, None if rng.random() < 0.1 else float(rng.choice([1, 2, 2, 3, 1e9, -5]) * rng.randint(1, 4))) for g in "abc" for _ in range(rng.randint(1, 200))]
    df = spark.createDataFrame(rows, "g string, x double").repartition(4)
    cut = {r["g"]: (r["p50"], r["p95"]) for r in M.truncating(df, "x", (50, 95), ("g",)).collect()}
    line = {r["g"]: (r["p50"], r["p95"]) for r in M.linear(df, "x", (50, 95), ("g",)).collect()}
    for g in "abc":
        v = sorted(x for k, x in rows if k == g and x is not None)
        at = [p / 100 * (len(v) - 1) for p in (50, 95)]
        assert cut[g] == tuple(v[max(1, len(v) * p // 100) - 1] for p in (50, 95))
        assert all(math.isclose(a, v[int(k)] + (k % 1) * (v[min(int(k) + 1, len(v) - 1)] - v[int(k)])) for a, k in zip(line[g], at, strict=True))
