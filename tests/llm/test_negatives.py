"""Hard negatives against plain lists of all scores."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from quarry.llm import negatives
from tests.llm.test_operators import rows_of

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain_mine(rows, is_anchor, k=5, m=5):
    """(anchor, positive, rank, negative, positive score, negative score) of (id, vector of whole numbers, label)."""
    out = set()
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    for anchor, v, label in rows:
        if not is_anchor(anchor):
            continue
        scored = sorted((-dot(v, w), other, own) for other, w, own in rows)
        for s, positive, _ in [x for x in scored if x[2] == label and x[1] != anchor][:k]:
            fit = [(n, other) for n, other, own in scored if own != label and 80 * -s <= 100 * -n <= 100 * -s]
            out |= {(anchor, positive, r + 1, other, -s, -n) for r, (n, other) in enumerate(fit[:m])}
    return out


def whole(v):
    return [int(256 * x // 1) for x in v]


def mined(df, is_anchor="id % 4 = 0", **kw):
    rows = rows_of(negatives.mine(negatives.eligible(df), is_anchor, **kw))
    out = {tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in rows}
    assert len(out) == len(rows)
    return out


def some_vectors(n=260, width=6, labels=3, seed=2):
    """Clusters with mixed labels, a vector that a third of the rows have, negative scores, zeros."""
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(width)] for _ in range(5)]
    common = [rng.uniform(-1, 1) for _ in range(width)]
    rows = []
    for k in range(n):
        c = rng.choice(centres)
        v = common if k % 3 == 0 else [0.0] * width if k % 29 == 0 else [round(x + rng.gauss(0, 0.2), 3) for x in c]
        rows.append((k, v, rng.randrange(labels)))
    return rows


@pytest.mark.parametrize("pivots", [1, 3, 40])
def test_against_all_scores(spark, pivots):
    rows = some_vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    want = plain_mine([(i, whole(v), y) for i, v, y in rows], lambda i: i % 4 == 0)
    assert len(want) > 500 and mined(df, n_pivots=pivots) == want


def test_groups_in_pieces(spark, monkeypatch):
    """Groups cut into a grid of pieces give the same lists."""
    monkeypatch.setattr(negatives, "ANCHORS", 5)
    monkeypatch.setattr(negatives, "ROWS", 16)
    rows = some_vectors(150)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert mined(df, n_pivots=3) == plain_mine([(i, whole(v), y) for i, v, y in rows], lambda i: i % 4 == 0)


def test_odd_rows(spark):
    """Nulls and components that aren't finite take no part; short vectors end in zeros; repeated rows and clashing columns."""
    nan, inf = float("nan"), float("inf")
    good = [(k, [0.1 * (k % 5), 0.3, 0.2 * (k % 3)], k % 2) for k in range(0, 40)] + [(41, [0.5], 0), (44, [0.4, 0.2], 1), (48, [], 1)]
    odd = [(100, None, 1), (104, [0.1, None, 0.3], 1), (108, [nan, 0.0, 0.0], 1), (112, [inf, 1.0, 1.0], 0), (116, [0.3, 0.3, 0.3], None), (None, [0.3, 0.3, 0.3], 1), good[3], good[8]]
    df = spark.createDataFrame(good + odd, SCHEMA).withColumns({c: F.lit("x") for c in ("id", "v", "cell", "d", "grp", "piece", "wanted", "rank", "low", "i", "j")})
    import numpy as np

    plain = [(i, whole([float(np.float32(x)) for x in v]), y) for i, v, y in good]
    assert mined(df) == plain_mine(plain, lambda i: i % 4 == 0)


def test_text_ids(spark):
    rows = [(f"r{k:03d}", [float(k % 7), 1.0, float(k % 5)], "xyz"[k % 3]) for k in range(60)]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>, label string")
    assert mined(df, "id LIKE '%0'") == plain_mine([(i, whole(v), y) for i, v, y in rows], lambda i: i.endswith("0"))


def test_wide_scores(spark):
    """Scores beyond 2^53 stay exact."""
    rows = [(k, [3e6 + k, 1.0 * k], k % 2) for k in range(24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = plain_mine([(i, whole(v), y) for i, v, y in rows], lambda i: i % 4 == 0)
    assert mined(df) == want and max(r[4] for r in want) > 2**53


def test_nothing(spark):
    assert not mined(spark.createDataFrame([], SCHEMA)) and not mined(spark.createDataFrame([(4, [1.0], 1), (5, [1.0], 2)], SCHEMA))


def test_leading_copies(spark):
    """Of a vector and label as many rows stay as can matter, those of the smallest ids."""
    df = spark.createDataFrame([(k, [1.0], 1) for k in range(30)] + [(40, [1.0], 2)], SCHEMA)
    ids = collections.Counter((r["label"], r["id"]) for r in rows_of(negatives.leading(negatives.eligible(df), 6)))
    assert set(ids) == {(1, k) for k in range(6)} | {(2, 40)}
