"""Vector search by scan and over lists against plain cosines."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import retrieval as R
from quarry.operators import vectors as V


def plain(rows, queries, top):
    """{(query, id, score, rank)}: rows without length or of another width score 0."""
    out = set()
    for q, v in queries:
        if v is None:
            continue
        scored = []
        for i, w in rows:
            if w is None:
                continue
            length = math.sqrt(sum(x * x for x in v) * sum(x * x for x in w))
            s = sum(x * y for x, y in zip(v, w, strict=False)) / length if len(v) == len(w) and length else 0.0
            scored.append((-round(s, 6) + 0.0, i))
        out |= {(q, i, -s + 0.0, k + 1) for k, (s, i) in enumerate(sorted(scored)[:top])}
    return out


def found(df):
    rows = df.collect()
    out = {(r["qid"], r["id"], r["score"] + 0.0, r["rank"]) for r in rows}
    assert len(out) == len(rows)
    return out


def clusters(n=600, width=8, seed=4):
    """Clusters, a vector that a third of the rows have, ties, opposite directions, lengths from tiny to huge."""
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(12)]
    rows = []
    for k in range(n):
        c = rng.choice(centres)
        size = 10.0 ** rng.randint(-5, 5)
        rows.append((k, centres[0] if k % 3 == 0 else [size * (x + rng.gauss(0, 0.15)) for x in c]))
    return rows


def ragged():
    return [(1000, [1.0, 0.0]), (1001, [0.0, 2.0]), (1002, [1.0, 0.0, 0.0]), (1003, []), (1004, None), (1005, [0.0] * 8), (1006, [-1.0, 0.5]), (1007, [0.0, 0.0])]


@pytest.fixture(scope="module")
def table(spark):
    rows = clusters() + ragged()
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4).cache()


def asked(table, some=lambda i: i % 37 == 0 or i >= 1000):
    return [(i, v) for i, v in table[0] if some(i)], table[1].where(F.col("vec_id").isin([i for i, _ in table[0] if some(i)])).withColumnRenamed("vec_id", "qid")


@pytest.mark.parametrize("lists, rows", [(1, 10_000), (12, 20), (40, 7)])
def test_lists_find_what_a_scan_finds(table, lists, rows):
    queries, df = asked(table)
    want = plain(table[0], queries, 7)
    own = V.build(table[1], n_lists=lists, rows=rows)
    assert found(V.search(own, df, 7)) == want
    if lists == 1:
        assert found(V.scan(table[1], df, 7)) == want


def test_lists_spare_rows(table):
    """With tight clusters most questions meet few rows; the share is what ``rows_read`` says."""
    queries, df = asked(table, lambda i: i < 600 and i % 37 == 1)
    own = V.build(table[1], n_lists=40, rows=20)
    read = {r["qid"]: r["n"] for r in V.rows_read(own, df, 5).collect()}
    assert set(read) == {i for i, _ in queries} and sum(read.values()) < 0.5 * len(read) * len(table[0])


def test_wrong_bounds_lose_rows(table):
    """Rings that are too narrow lose rows, so the bounds are what keeps the lists exact."""
    queries, df = asked(table, lambda i: i < 600 and i % 11 == 1)
    own = V.build(table[1], n_lists=40, rows=7)
    narrow = own._replace(pieces=own.pieces.withColumn("high", F.col("low")).withColumn("low", F.col("low") * 3))
    assert found(V.search(narrow, df, 20)) != plain(table[0], queries, 20) == found(V.search(own, df, 20))


def test_a_wide_row_silences_no_batch(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0, 1.0])], "qid long, embedding array<double>")
    got = R.vector_search(v, q).collect()
    assert {(r["vec_id"], r["score"]) for r in got if r["qid"] == 0} == {(0, 1.0), (1, 0.0), (2, 0.0)} and len(got) == 6


def test_text_ids(spark):
    rows = [(f"c{k:02d}", [math.sin(k), math.cos(k)]) for k in range(40)]
    v = spark.createDataFrame(rows, "vec_id string, embedding array<double>")
    q = v.where("vec_id < 'c05'").withColumnRenamed("vec_id", "qid")
    want = plain(rows, rows[:5], 6)
    assert found(V.scan(v, q, 6)) == want and found(V.search(V.build(v, n_lists=3, rows=5), q, 6)) == want


def test_many_queries(spark):
    """Beyond FEW questions go over lists; neither they nor the products are held whole."""
    v = spark.range(300).select(F.col("id").alias("vec_id"), F.array(F.sin("id"), F.cos("id")).alias("embedding"))
    q = spark.range(100_000).select(F.col("id").alias("qid"), F.array(F.sin("id"), F.cos("id")).alias("embedding"))
    got = R.vector_search(v, q, 1)
    assert got.count() == 100_000 and got.where("qid < 300").where("vec_id = qid").count() == 300


def test_stored_lists(spark, table, tmp_path):
    _, df = asked(table)
    own = V.build(table[1], n_lists=6, rows=50)
    V.write(own, str(tmp_path / "lists"))
    assert found(V.search(V.read(spark, str(tmp_path / "lists")), df, 5)) == found(V.search(own, df, 5))


def test_nothing(spark, table):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    q = table[1].where("vec_id < 3").withColumnRenamed("vec_id", "qid")
    assert not R.vector_search(none, q).count() and not V.search(V.build(none), q).count()
    assert not R.vector_search(table[1], q.limit(0)).count() and not V.search(V.build(table[1]), q.limit(0)).count()
    with pytest.raises(ValueError):
        V.search(V.build(table[1]), q, V.LONGEST + 1)


def test_small_pieces_share_a_block(spark, table):
    """A question meets a block once, however many pieces it reads there."""
    queries, df = asked(table)
    own = V.build(table[1], n_lists=3, rows=5)
    blocks = V._blocks(own)
    assert own.pieces.count() > 100 and blocks.count() < 10  # a block a list and width
    pairs = V._first_pieces(own, blocks, V._asks(df, "qid", "embedding"), 20).collect()
    assert pairs and len({(r["qid"], r["block"]) for r in pairs}) == len(pairs) < sum(len(r["own"]) for r in pairs)
    assert found(V.search(own, df, 20)) == plain(table[0], queries, 20)


def test_centres_come_from_a_bounded_sample(spark, monkeypatch):
    """What reaches the driver doesn't grow with the rows or the partitions."""
    monkeypatch.setattr(V, "SAMPLE", 40)
    seen = []
    monkeypatch.setattr(V, "_fitted", lambda x, k, f=V._fitted: seen.append(len(x)) or f(x, k))
    v = spark.range(3000).repartition(30).select(F.col("id").alias("vec_id"), F.array(F.sin("id"), F.cos("id")).alias("embedding"))
    written = []
    monkeypatch.setattr(V, "materialise", lambda df, f=V.materialise: written.append(df._jdf.queryExecution().optimizedPlan().toString()) or f(df))
    own = V.build(v)
    assert seen == [40] and "xxhash64" in written[0] and "<=" in written[0]
    q = v.where("vec_id < 4").withColumnRenamed("vec_id", "qid")
    assert found(V.search(own, q, 3)) == found(V.scan(v, q, 3))


def test_pairs_of_questions_and_blocks_are_not_broadcast(spark, table):
    """They grow with the square of the table, and compressed files of them look small: Spark would gather them on the driver."""
    _, df = asked(table)
    own = V.build(table[1], n_lists=12, rows=20)
    blocks, asks = V._blocks(own), V._asks(df, "qid", "embedding")
    read = V.materialise(V._first_pieces(own, blocks, asks, 7))
    hits = V._scored(own, blocks, asks, read, 7, V.DIGITS)
    more = V._other_pieces(own, blocks, asks, V.materialise(hits), read, 7)
    for made in (hits, more):
        assert made.collect()
        plan = made._jdf.queryExecution().executedPlan().toString()  # as it ran
        assert "SortMergeJoin [qid" in plan and "BroadcastHashJoin [qid" not in plan


def test_lists_are_built_once_for_several_tables_of_queries(table, monkeypatch):
    monkeypatch.setattr(V, "FEW", 10)
    built = []
    monkeypatch.setattr(V, "build", lambda *a, f=V.build, **b: built.append(1) or f(*a, **b))
    sets = [asked(table, lambda i, k=k: i % 37 == k) for k in (1, 2)] + [asked(table, lambda i: i < 3)]
    got = V.nearest_each(table[1], [q for _, q in sets], 5)
    assert [found(x) for x in got] == [plain(table[0], queries, 5) for queries, _ in sets] and len(built) == 1
