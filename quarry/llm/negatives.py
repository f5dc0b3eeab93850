"""Hard-negative mining by a Voronoi-partitioned kNN join.

For every anchor: the POSITIVES best rows of its label by inner product, and for each of
them the NEGATIVES best rows of other labels that score between MARGIN of the positive's
score and that score.

Inner products become distances by augmentation: with M the largest norm, a row x becomes
(x, sqrt(M^2 - |x|^2)) and an anchor q becomes (q, 0); then |q - x|^2 = |q|^2 + M^2 - 2 q.x,
so the nearest rows are those of the highest products. Rows go to the nearest of PIVOTS
pivots, anchors too, which makes cells and groups of anchors. By the triangle inequality a
row at a distance d from its pivot lies no nearer to any anchor of a group than
|pivot - pivot| - U - d and no further than |pivot - pivot| + U + d, U the group's radius.
From the counts of a cell's nearest rows a group knows a radius in which the k-th positive of
each of its anchors must lie; the positives found bound the negatives' distances from both
sides. Rows are sent only to groups whose ring they might reach, and joined there exactly.

Pivots come from a bounded sample (SAMPLE rows of the smallest hashes); they decide what
a join costs, never what it finds. A group's join is cut into pieces: anchors by ANCHORS,
rows by ROWS, so no label, cell or vector meets in one task. Equal vectors of one label
score alike, and only the first of them by id can come among the first few: the others leave
before anything else (each task keeps that many of a vector and label, so copies don't
crowd the shuffle).

Products are whole numbers: exact in float64 while they stay below 2^53, which is checked against
the largest norm, and beyond it in Python's integers, slowly.

Defined cases: ids name rows. Rows with a null label, vector, id or component, or a component that isn't
finite, take no part. Vectors shorter than the longest count zeros at their end. Rows equal in id,
label and vector are one row; "other" rows have another id. Without rows of the same label an
anchor has no positives and returns nothing. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, runs

POSITIVES = NEGATIVES = 5
MARGIN = (80, 100)
PIVOTS, SAMPLE, ROUNDS = 64, 4096, 5
ANCHORS, ROWS = 256, 16384
EXACT = 2.0**53
#: Relative slack of bounds that are computed in floating point.
SLACK = 1e-6


# ---------------------------------------------------------------- rows


def eligible(rows: DataFrame, vector: str = "embedding", label: str = "label", id_column: str = "vec_id", scale: float = 256.0) -> DataFrame:
    """(id, label, v): rows that take part, components floor(scale * x) as doubles."""
    r = rows.select(F.col(id_column).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v")).dropna(subset=["id", "label", "v"])
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = lambda x: F.coalesce(_floor(x * scale), F.lit(0.0))
    return r.where(finite).select("id", "label", F.transform("v", whole).alias("v"))


def _floor(x: Column) -> Column:
    """Floor as a double, also beyond the longs, where doubles are whole anyway."""
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)


def _lengthened(rows: DataFrame) -> DataFrame:
    """Vectors of one width, zeros at the end."""
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    return rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("v"))))


def leading(rows: DataFrame, most: int) -> DataFrame:
    """The first ``most`` ids of each vector and label: no list of fewer rows holds another of them."""
    one = rows.dropDuplicates(["id", "label", "v"])
    order = W.partitionBy("v", "label").orderBy("id")
    return one.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).drop("k")


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


# ---------------------------------------------------------------- cells


def pivots(rows: DataFrame, norm2: float, k: int = PIVOTS, sample: int = SAMPLE) -> np.ndarray:
    """k-means centres of a bounded sample of the augmented rows: those of the smallest hashes of their vectors and labels."""
    some = rows.orderBy(F.xxhash64("v", "label"), "id").limit(sample).select("v").toPandas()["v"]
    if not len(some):
        return np.zeros((0, 1))
    x = augmented(np.array([np.asarray(v, float) for v in some]).reshape(len(some), -1), norm2)
    centre = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]
    for _ in range(ROUNDS):
        near = distances(x, centre).argmin(axis=1)
        centre = np.array([x[near == j].mean(axis=0) if (near == j).any() else c for j, c in enumerate(centre)]).reshape(centre.shape)
    return centre


def augmented(v: np.ndarray, norm2: float) -> np.ndarray:
    return np.column_stack((v, np.sqrt(np.maximum(0.0, norm2 - (v * v).sum(axis=1)))))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(0.0, d))


def assigned(rows: DataFrame, centre: np.ndarray, norm2: float, anchors: bool) -> DataFrame:
    """(id, label, v, cell, d): the nearest pivot and the distance to it, of rows or of anchors."""
    sent = rows.sparkSession.sparkContext.broadcast(centre)
    kinds = dict(rows.dtypes)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("v"))
            if not len(v):
                continue
            d = distances(np.column_stack((v, np.zeros(len(v)))) if anchors else augmented(v, norm2), sent.value)
            cell = d.argmin(axis=1)
            cols = [*(batch.column(c) for c in ("id", "label", "v")), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])]
            yield pa.RecordBatch.from_arrays(cols, ["id", "label", "v", "cell", "d"])

    return rows.mapInArrow(near, f"id {kinds['id']}, label {kinds['label']}, v array<double>, cell int, d double")


# ---------------------------------------------------------------- which rows serve which groups


def _between(spark, centre: np.ndarray) -> DataFrame:
    """(grp, cell, apart) of all pairs of pivots, at most PIVOTS^2 rows."""
    apart = distances(centre, centre)
    np.fill_diagonal(apart, 0.0)
    rows = [(i, j, float(apart[i, j])) for i in range(len(apart)) for j in range(len(apart))]
    return F.broadcast(spark.createDataFrame(rows, "grp int, cell int, apart double"))


def positive_rings(rows: DataFrame, anchors: DataFrame, between: DataFrame, k: int, unit: float) -> DataFrame:
    """(label, grp, cell, least, most): a row of the label at a distance d from the cell's pivot may serve the group if least <= d <= most.

    A group's radius in which k + 1 rows of the label must lie (one may be the anchor) comes
    from the k + 1 nearest distances that each cell has of the label.
    """
    by = W.partitionBy("label", "cell").orderBy("d")
    near = rows.select("label", "cell", "d").withColumn("k", F.row_number().over(by)).where(F.col("k") <= k + 1).select("label", "cell", "d")
    cells = rows.groupBy("label", "cell").agg(F.min("d").alias("close"), F.max("d").alias("far"))
    groups = anchors.groupBy("label", F.col("cell").alias("grp")).agg(F.max("d").alias("u"))
    reach = groups.join(between, "grp").join(near, ["label", "cell"]).withColumn("most", F.col("u") + F.col("apart") + F.col("d"))
    ranked = reach.withColumn("k", F.row_number().over(W.partitionBy("label", "grp").orderBy("most"))).where(F.col("k") <= k + 1)
    bound = ranked.groupBy("label", "grp").agg(F.max("u").alias("u"), F.max("most").alias("theta"), F.count("*").alias("n"))
    theta = F.when(F.col("n") > k, F.col("theta")).otherwise(F.lit(float("inf")))  # fewer rows: all serve
    least = F.col("apart") - F.col("u") - theta - F.lit(SLACK * unit)
    most = F.col("apart") + F.col("u") + theta + F.lit(SLACK * unit)
    met = bound.join(between, "grp").join(cells, ["label", "cell"]).withColumns({"least": least, "most": most})
    return met.where("far >= least AND close <= most").select("label", "grp", "cell", "least", "most")


def negative_rings(anchors: DataFrame, rows: DataFrame, between: DataFrame, unit: float) -> DataFrame:
    """(grp, cell, least, most): a row at a distance d may serve the group if least <= d <= most holds for its bounds from both sides."""
    groups = anchors.groupBy(F.col("cell").alias("grp")).agg(F.max("d").alias("u"), F.min("nearest").alias("nearest"), F.max("farthest").alias("farthest"))
    cells = rows.groupBy("cell").agg(F.min("d").alias("close"), F.max("d").alias("far"))
    slack = F.lit(SLACK * unit)
    # |q - x| lies between |apart - d| - u and apart + d + u, and has to lie between nearest and farthest.
    low = F.greatest(F.col("apart") - F.col("u") - F.col("farthest"), F.col("nearest") - F.col("u") - F.col("apart")) - slack
    high = F.col("apart") + F.col("u") + F.col("farthest") + slack
    return groups.join(between, "grp").withColumns({"least": low, "most": high}).join(cells, "cell").where("far >= least AND close <= most").select("grp", "cell", "least", "most")


# ---------------------------------------------------------------- local joins


def _meet(anchors: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """(piece, id, label, v, low, high, wanted): anchors and the rows of their group side by side, in pieces of bounded size; wanted is null for rows.

    A group of many anchors and rows is cut into a grid: an anchor goes to all its row pieces, a row to all its anchor pieces.
    """
    n = lambda df, name, size: df.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(float(size))).cast("int").alias(name))
    grid = materialise(n(anchors, "na", ANCHORS).join(n(rows, "nr", ROWS), keys))
    part = lambda many: F.pmod(F.xxhash64("id", "label", "v"), F.col(many)).cast("int")
    every = lambda many: F.explode(F.sequence(F.lit(0), F.col(many) - 1))
    a = anchors.join(grid, keys).withColumn("i", part("na")).withColumn("j", every("nr"))
    r = rows.join(grid, keys).withColumn("j", part("nr")).withColumn("i", every("na")).withColumn("wanted", F.lit(None).cast("array<bigint>"))
    shown = [F.xxhash64(*keys, "i", "j").alias("piece"), *dict.fromkeys((*keys, "i", "j", "id", "label", "v", "wanted"))]
    both = a.select(*shown).unionByName(r.select(*shown))
    return both.repartition("piece").sortWithinPartitions("piece")


def products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of whole-numbered rows, as longs."""
    if exact:
        return (a @ b.T).astype(np.int64)
    return np.array([[min(max(sum(int(p) * int(q) for p, q in zip(x, y, strict=True)), -(2**63)), 2**63 - 1) for y in b] for x in a], np.int64).reshape(len(a), len(b))


def _pieces(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, pa.Table]]:
    """(anchors, rows) of each piece; pieces whose hash is the same are told apart by their keys."""
    for table, starts in runs(batches, "piece"):
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            part = table.slice(a, b - a)
            name = list(zip(*(part.column(k).to_pylist() for k in (*keys, "i", "j")), strict=True))
            own = [[k for k, x in enumerate(name) if x == one] for one in set(name)] if len(set(name)) > 1 else [None]
            for rows in own:
                p = part if rows is None else part.take(pa.array(rows))
                asks = p.column("wanted").is_valid().to_numpy()
                yield p.filter(pa.array(asks)), p.filter(pa.array(~asks))


def _first(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k, by descending score and ascending id."""
    if len(score) > 4 * k:
        edge = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= edge)
    else:
        some = np.arange(len(score))
    order = np.lexsort((ids[some], -score[some]))
    return some[order[:k]]


def _positives(k: int, exact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for anchors, rows in _pieces(batches, ["label", "grp"]):
            if not len(anchors) or not len(rows):
                continue
            score = products(_matrix(anchors.column("v")), _matrix(rows.column("v")), exact)
            aid, ids = anchors.column("id").to_numpy(), rows.column("id").to_numpy()
            rank = np.unique(ids, return_inverse=True)[1]
            out = []
            for i, anchor in enumerate(aid):
                other = np.flatnonzero(ids != anchor)
                best = other[_first(score[i, other], rank[other], k)]
                out += [(anchors.column("label")[i].as_py(), anchor, ids[j], int(score[i, j])) for j in best]
            if out:
                label, a, b, s = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(label, anchors.schema.field("label").type), pa.array(a, anchors.schema.field("id").type), pa.array(b, anchors.schema.field("id").type), pa.array(s, pa.int64())], ["label", "anchor_id", "positive_id", "positive_score"])

    return run


def _negatives(k: int, margin: tuple[int, int], exact: bool):
    """``wanted`` holds the scores of an anchor's positives, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for anchors, rows in _pieces(batches, ["grp"]):
            if not len(anchors) or not len(rows):
                continue
            score = products(_matrix(anchors.column("v")), _matrix(rows.column("v")), exact)
            ids = rows.column("id").to_numpy()
            rank = np.unique(ids, return_inverse=True)[1]
            codes = pa.concat_arrays([*anchors.column("label").chunks, *rows.column("label").chunks]).dictionary_encode().indices.to_numpy()
            own, theirs = codes[: len(anchors)], codes[len(anchors) :]
            out = []
            for i, wanted in enumerate(anchors.column("wanted").to_pylist()):
                for s in wanted:
                    low = -((-margin[0] * s) // margin[1])  # the least whole score within the margin
                    fit = np.flatnonzero((theirs != own[i]) & (score[i] >= low) & (score[i] <= s))
                    best = fit[_first(score[i, fit], rank[fit], k)]
                    out += [(anchors.column("label")[i].as_py(), anchors.column("id")[i].as_py(), s, ids[j], int(score[i, j])) for j in best]
            if out:
                label, a, s, b, n = zip(*out, strict=True)
                kind = anchors.schema.field("id").type
                yield pa.RecordBatch.from_arrays([pa.array(label, anchors.schema.field("label").type), pa.array(a, kind), pa.array(s, pa.int64()), pa.array(b, kind), pa.array(n, pa.int64())], ["label", "anchor_id", "positive_score", "negative_id", "negative_score"])

    return run


# ---------------------------------------------------------------- the operator


def mine(rows: DataFrame, is_anchor: Column | str, positives: int = POSITIVES, negatives: int = NEGATIVES, margin: tuple[int, int] = MARGIN, n_pivots: int = PIVOTS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for eligible rows (id, label, v); is_anchor is a condition on id."""
    keep = max(positives + 1, negatives)
    asked = F.expr(is_anchor) if isinstance(is_anchor, str) else is_anchor
    whole = materialise(_lengthened(rows))
    asking = materialise(whole.where(asked).dropDuplicates(["id", "label", "v"]))
    lead = materialise(leading(whole, keep))
    norm2 = float(lead.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()[0] or 0.0)
    unit, exact = max(1.0, norm2**0.5), norm2 < EXACT
    centre = pivots(lead, norm2, n_pivots)
    kinds = dict(rows.dtypes)
    if not len(centre):
        return rows.sparkSession.createDataFrame([], f"anchor_id {kinds['id']}, positive_id {kinds['id']}, rank int, negative_id {kinds['id']}, positive_score long, negative_score long")
    own = materialise(assigned(lead, centre, norm2, False))
    groups = materialise(assigned(asking, centre, norm2, True))
    between = _between(rows.sparkSession, centre)

    rings = materialise(positive_rings(own, groups, between, positives, unit))
    served = own.join(rings, ["label", "cell"]).where("d >= least AND d <= most").select("label", "grp", "id", "v")
    asks = groups.select("label", F.col("cell").alias("grp"), "id", "v", F.array().cast("array<bigint>").alias("wanted"))
    found = _meet(asks, served, ["label", "grp"]).mapInArrow(_positives(positives, exact), f"label {kinds['label']}, anchor_id {kinds['id']}, positive_id {kinds['id']}, positive_score long")
    order = W.partitionBy("label", "anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    first = materialise(found.distinct().withColumn("k", F.row_number().over(order)).where(F.col("k") <= positives))

    # A negative scores within the margin of some positive: its distance lies between those of the best and of the margin of the least.
    scores = first.groupBy("label", F.col("anchor_id").alias("id")).agg(F.collect_list("positive_score").alias("s"))
    far = lambda s: F.sqrt(F.greatest(F.lit(0.0), F.col("q2") + norm2 - 2 * s))
    met = groups.join(scores, ["label", "id"]).withColumn("q2", F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    met = met.withColumns({"s": F.array_distinct(F.filter("s", lambda x: x >= 0))}).where(F.size("s") > 0)  # below zero no score lies within the margin
    edge = F.array_min("s").cast("double") * margin[0] / margin[1]
    met = materialise(met.withColumns({"nearest": far(F.array_max("s").cast("double")), "farthest": far(edge), "wanted": F.col("s")}))
    rings = F.broadcast(materialise(negative_rings(met, own, between, unit)))  # PIVOTS^2 rows at most
    served = own.join(rings, "cell").where("d >= least AND d <= most").select("grp", "label", "id", "v")
    asks = met.select(F.col("cell").alias("grp"), "label", "id", "v", "wanted")
    out = _meet(asks, served, ["grp"]).mapInArrow(_negatives(negatives, margin, exact), f"label {kinds['label']}, anchor_id {kinds['id']}, positive_score long, negative_id {kinds['id']}, negative_score long")
    order = W.partitionBy("label", "anchor_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    best = out.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return first.drop("k").join(best, ["label", "anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

