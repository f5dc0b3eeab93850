"""Exact vector search: over inverted lists, or by one scan for few questions.

``build`` gives every row to the nearest of some centres and cuts each list, in the
order of the distance from its centre, into pieces of ROWS rows. A piece is thus a ring
around a centre: a unit vector x in it, at a distance d from the centre c, satisfies
|q - x| >= | |q - c| - d | for every q. ``search`` first reads, for each question, the
pieces around the nearest centres until enough rows are seen for a k-th score, and
then only those other pieces whose ring may hold a better one. The bound holds for every row, so the top k
are those of a full scan; centres (k-means on a bounded sample) decide the cost alone.

Neither side is collected or broadcast: questions meet blocks of neighbouring pieces in a join, some ROWS rows each, of which those in the
question's pieces count, so a vector is sent once for a block, and a block once for ASKS questions, of which a task multiplies AT_ONCE by its rows at a time.

Scores are cosines rounded to DIGITS digits; ties go to the lesser id. A row without
length, or of another width than the question, scores 0 and still ranks: of those only the
first k ids by width can matter, and the index keeps as many. A null vector is no row and no question; a null
component counts as 0. Ids keep their type, and ids name rows: of equal ids with equal scores one is listed.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import materialise
from .blocks import few, first_rows, groups, large, matrix

ROWS, ASKS, AT_ONCE = 4096, 4096, 512
#: Rows that centres are fitted on, rows a list is meant to hold, and the most lists (a task knows all centres).
SAMPLE, LIST, LISTS = 8192, 2048, 1024
ROUNDS = 4
DIGITS = 6
#: Ids of each class that the index keeps for rows that score 0; the longest list that a search can ask for.
LONGEST = 1000
#: Pieces that a search reads are broadcast up to so many rows, so that only their rows are shuffled; beyond, both sides are.
WANTED = 100_000
#: So many queries, of so many components together (32 MB), are few; SLICE of rows that a task multiplies them by at a time.
FEW, FEW_VALUES, SLICE = 2048, 1 << 22, 1024
#: Bounds are widened by so much: rounding of scores, and of floating point.
SLACK = 2e-6


class Lists(NamedTuple):
    """An index of vectors: rows (width, list, piece, id, d, u), pieces (width, list, piece, n, low, high), zeros (width, flat, id, k) and centres by width."""

    rows: DataFrame
    pieces: DataFrame
    zeros: DataFrame
    centres: dict[int, np.ndarray]


def _units(rows: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(id, width, flat, u): vectors of length one; those without length are flat."""
    v = F.transform(F.col(vector).cast("array<double>"), lambda x: F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0)))
    r = rows.where(F.col(vector).isNotNull()).select(F.col(id_column).alias("id"), v.alias("v")).withColumn("width", F.size("v"))
    most = F.coalesce(F.array_max(F.transform("v", F.abs)), F.lit(0.0))  # scaled by it first, so that squares neither vanish nor overflow
    flat = (F.col("m") == 0) | (F.col("m") == float("inf"))
    r = r.withColumn("m", most).withColumn("flat", flat).withColumn("v", F.transform("v", lambda x: F.try_divide(x, F.col("m"))))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return r.withColumn("l", length).select("id", "width", "flat", F.transform("v", lambda x: F.try_divide(x, F.col("l"))).alias("u"))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(0.0, d))


def _fitted(x: np.ndarray, k: int) -> np.ndarray:
    """k-means centres of unit vectors."""
    centre = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]
    for _ in range(ROUNDS):
        near = _distances(x, centre).argmin(axis=1)
        sums = np.zeros_like(centre)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centre))
        centre = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centre)
    return centre


# ---------------------------------------------------------------- building


def build(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", n_lists: int | None = None, rows: int = ROWS) -> Lists:
    """The index of vectors (id, vector). Centres are fitted on the SAMPLE rows of the smallest hashed ids; every row is assigned."""
    units = _units(vectors, id_column, vector)
    n = vectors.count()
    # Of hashes under this bound there are some 4 * SAMPLE, so no more than these are sent or sorted.
    bound = -(2**63) + min(2**64 - 1, 4 * SAMPLE * 2**64 // max(1, n))
    hashed = units.where("NOT flat").withColumn("h", F.xxhash64("id")).where(F.col("h") <= bound)
    some = materialise(hashed.orderBy("h").limit(SAMPLE).select("width", "u")).toPandas()
    centres = {}
    for width, own in some.groupby("width")["u"]:
        k = n_lists or max(1, min(LISTS, round(n * len(own) / len(some) / LIST)))
        centres[int(width)] = _fitted(np.stack([np.asarray(u) for u in own]), k)
    sent = vectors.sparkSession.sparkContext.broadcast(centres)
    kind = dict(units.dtypes)["id"]

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = batch.column("width").to_numpy()
            for w in np.unique(width).tolist():
                own = batch.filter(pa.array(width == w))
                x = matrix(own.column("u"))
                d = _distances(x, sent.value.get(w, np.zeros((1, w))))
                near = d.argmin(axis=1)
                cols = [own.column("width"), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near]), own.column("id"), own.column("u")]
                yield pa.RecordBatch.from_arrays(cols, ["width", "list", "d", "id", "u"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, held, at = TaskContext.get().partitionId() << 32, 0, None
        for batch in batches:
            names = list(zip(batch.column("width").to_pylist(), batch.column("list").to_pylist(), strict=True))
            pieces = np.empty(len(names), np.int64)
            for i, name in enumerate(names):
                if name != at or held == rows:
                    piece, held, at = piece + 1, 0, name
                pieces[i], held = piece, held + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pieces)], [*batch.schema.names, "piece"])

    schema = f"width int, list int, d double, id {kind}, u array<double>"
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = units.where("NOT flat").select("width", "id", "u").mapInArrow(assigned, schema)
    order = ("width", "list", "d")
    placed = materialise(dealt.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(cut, f"{schema}, piece long"))
    pieces = materialise(placed.groupBy("width", "list", "piece").agg(F.count("*").alias("n"), F.min("d").alias("low"), F.max("d").alias("high")))
    first = F.row_number().over(W.partitionBy("width", "flat").orderBy("id"))
    zeros = materialise(units.select("width", "flat", "id").withColumn("k", first).where(F.col("k") <= LONGEST))
    return Lists(placed, pieces, zeros, centres)


# ---------------------------------------------------------------- which pieces a question reads


def _asks(queries: DataFrame, id_column: str, vector: str) -> DataFrame:
    return materialise(_units(queries, id_column, vector).withColumnRenamed("id", "qid"))


def _near_lists(index: Lists, asks: DataFrame, least: int | None) -> DataFrame:
    """(qid, width, list, apart) of lists that a question may read: the nearest that hold ``least`` rows, or, given its reach, all within it, with its reach and had."""
    lists = index.pieces.groupBy("width", "list").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect()  # LISTS a width at most
    shape = {w: {c: np.zeros(len(x)) for c in ("n", "low", "high")} for w, x in index.centres.items()}
    for r in lists:
        own = shape.setdefault(r["width"], {c: np.zeros(1) for c in ("n", "low", "high")})
        for c in ("n", "low", "high"):
            own[c][r["list"]] = r[c]
    sent = asks.sparkSession.sparkContext.broadcast((index.centres, shape))
    kept = {"reach": "double", "had": "array<long>"} if least is None else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, known = sent.value
        for batch in batches:
            width = batch.column("width").to_numpy()
            for w in np.unique(width).tolist():
                if w not in known:
                    continue
                every = batch.filter(pa.array(width == w))
                for a in range(0, len(every), SLICE):  # a question meets up to LISTS lists
                    own = every.slice(a, SLICE)
                    apart, s = _distances(matrix(own.column("u")), centres.get(w, np.zeros((1, w)))), known[w]
                    if least is None:
                        gap = np.maximum(0.0, np.maximum(apart - s["high"], s["low"] - apart))
                        some = (gap <= own.column("reach").to_numpy()[:, None]) & (s["n"] > 0)
                    else:
                        order = np.argsort(apart, axis=1)
                        before = np.cumsum(s["n"][order], axis=1) - s["n"][order]
                        some = np.zeros(apart.shape, bool)
                        np.put_along_axis(some, order, before < least, axis=1)
                        some &= s["n"] > 0
                    q, c = np.nonzero(some)
                    of = lambda name, own=own, q=pa.array(q): own.column(name).take(q)
                    yield pa.RecordBatch.from_arrays([of("qid"), of("width"), pa.array(c.astype(np.int32)), pa.array(apart[q, c]), *map(of, kept)], ["qid", "width", "list", "apart", *kept])

    kind = dict(asks.dtypes)["qid"]
    return asks.where("NOT flat").mapInArrow(run, ", ".join([f"qid {kind}, width int, list int, apart double", *(f"{c} {t}" for c, t in kept.items())]))


def _gap(piece):
    """How near a piece's ring may come to the question: | |q - c| - d | at least."""
    return F.greatest(F.lit(0.0), F.col("apart") - piece["high"], piece["low"] - F.col("apart"))


def _blocks(index: Lists) -> DataFrame:
    """(width, list, block, pieces): neighbouring pieces of a list, of some ROWS rows together; the block has the number of its first piece."""
    before = F.sum("n").over(W.partitionBy("width", "list").orderBy("piece")) - F.col("n")
    p = index.pieces.withColumn("place", F.floor(before / ROWS))
    return materialise(p.groupBy("width", "list", "place").agg(F.min("piece").alias("block"), F.sort_array(F.collect_list(F.struct("piece", "n", "low", "high"))).alias("pieces")).drop("place"))


def _first_pieces(index: Lists, blocks: DataFrame, asks: DataFrame, top: int) -> DataFrame:
    """(qid, width, block, own, n): the nearest pieces that together hold ``top`` rows, by block."""
    met = _near_lists(index, asks, top).join(few(blocks, WANTED), ["width", "list"])
    # A question's nearest of a block are enough, so no more leave the row.
    order = F.array_sort(F.transform("pieces", lambda p: F.struct(_gap(p).alias("gap"), p["piece"].alias("piece"), p["n"].alias("n"))))
    met = met.select("qid", "width", "block", F.explode(F.slice(order, 1, top)).alias("p")).select("qid", "width", "block", "p.*")
    before = F.sum("n").over(W.partitionBy("qid").orderBy("gap", "piece").rowsBetween(W.unboundedPreceding, -1))
    first = met.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < top)
    return first.groupBy("qid", "width", "block").agg(F.collect_list("piece").alias("own"), F.sum("n").alias("n"))


def _other_pieces(index: Lists, blocks: DataFrame, asks: DataFrame, found: DataFrame, read: DataFrame, top: int) -> DataFrame:
    """(qid, width, block, own, n): pieces not read yet that may hold a row as good as the k-th found; all, if fewer than k were found."""
    floor = found.groupBy("qid").agg(F.when(F.count("*") >= top, F.min("score")).alias("floor"))
    cos = F.greatest(F.lit(-1.0), F.coalesce("floor", F.lit(-1.0)) - F.lit(SLACK))
    had = read.groupBy("qid").agg(F.flatten(F.collect_list("own")).alias("had"))
    # Reach and pieces go along with a question, so that its rows, one a list, meet no table of questions.
    reaching = asks.where("NOT flat").join(large(floor), "qid", "left").join(large(had), "qid", "left").withColumn("reach", F.sqrt(2 - 2 * cos) + F.lit(1e-7))
    near = _near_lists(index, reaching.withColumn("had", F.coalesce("had", F.array().cast("array<long>"))), None)
    new = F.filter("pieces", lambda p: (_gap(p) <= F.col("reach")) & ~F.array_contains("had", p["piece"]))
    met = near.join(few(blocks, WANTED), ["width", "list"]).withColumn("new", new).where(F.size("new") > 0)
    return met.select("qid", "width", "block", F.col("new.piece").alias("own"), F.aggregate("new", F.lit(0).cast("long"), lambda s, p: s + p["n"]).alias("n"))


# ---------------------------------------------------------------- scores


def _scored(index: Lists, blocks: DataFrame, asks: DataFrame, pairs: DataFrame, top: int, digits: int) -> DataFrame:
    """(qid, id, score): of the pieces that a question reads in a block, the first ``top`` rows."""
    kinds = dict(asks.dtypes) | {"id": dict(index.rows.dtypes)["id"]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["block", "part"]):
            asked = table.column("asks").to_numpy()
            a, b = table.filter(pa.array(asked)), table.filter(pa.array(~asked))
            if not len(a) or not len(b):
                continue
            rows = matrix(b.column("u")).T
            pieces, at = np.unique(b.column("piece").to_numpy(), return_inverse=True)
            rank = np.unique(b.column("id").to_numpy(), return_inverse=True)[1]
            for start in range(0, len(a), AT_ONCE):
                some = a.slice(start, AT_ONCE)
                score = np.round(matrix(some.column("u")) @ rows, digits) + 0.0  # no negative nought
                own = some.column("own").combine_chunks()
                read = np.zeros((len(some), len(pieces)), bool)
                read[np.repeat(np.arange(len(some)), own.value_lengths().to_numpy()), np.searchsorted(pieces, own.flatten().to_numpy())] = True
                score[~read[:, at]] = -np.inf
                q, r = first_rows(score, rank, top)
                cols = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (some.column("qid").take(pa.array(q)), b.column("id").take(pa.array(r)))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(score[q, r])], ["qid", "id", "score"])

    counts = materialise(pairs.groupBy("block").agg(F.ceil(F.count("*") / F.lit(float(ASKS))).cast("int").alias("parts")))
    part = F.pmod(F.xxhash64("qid"), F.col("parts")).cast("int")
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    left = pairs.select("qid", "block", "own").join(large(asks.select("qid", "u")), "qid").join(few(counts, WANTED), "block")
    left = left.select("block", part.alias("part"), F.lit(True).alias("asks"), "qid", none("id", kinds["id"]), none("piece", "long"), "own", "u")
    members = blocks.join(counts, "block").select("block", "parts", F.explode("pieces.piece").alias("piece"))
    right = index.rows.select("piece", "id", "u").join(few(members, WANTED), "piece")
    right = right.select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("asks"), none("qid", kinds["qid"]), "id", "piece", none("own", "array<long>"), "u")
    both = left.unionByName(right).repartition("block", "part").sortWithinPartitions("block", "part")
    return both.mapInArrow(run, f"qid {kinds['qid']}, id {kinds['id']}, score double")


def _noughts(index: Lists, asks: DataFrame, top: int) -> DataFrame:
    """(qid, id, 0.0): the first ``top`` ids of rows without length or of another width; of all rows, if the question has no length."""
    kinds = asks.select(F.col("width").alias("w"), F.col("flat").alias("f")).distinct()
    met = index.zeros.where(F.col("k") <= top).join(F.broadcast(kinds), F.col("f") | F.col("flat") | (F.col("w") != F.col("width")))
    first = met.withColumn("n", F.row_number().over(W.partitionBy("w", "f").orderBy("id"))).where(F.col("n") <= top)
    own = first.select(F.col("w").alias("width"), F.col("f").alias("flat"), "id")
    return asks.select("qid", "width", "flat").join(F.broadcast(own), ["width", "flat"]).select("qid", "id", F.lit(0.0).alias("score"))


def search(index: Lists, queries: DataFrame, top: int = 20, id_column: str = "qid", vector: str = "embedding", digits: int = DIGITS) -> DataFrame:
    """(qid, id, score, rank): the first ``top`` rows of each question (qid, vector) by exact cosine."""
    return _search(index, queries, top, id_column, vector, digits)[0]


def rows_read(index: Lists, queries: DataFrame, top: int = 20, id_column: str = "qid", vector: str = "embedding") -> DataFrame:
    """(qid, n): how many rows of the index a search multiplies with each question."""
    return _search(index, queries, top, id_column, vector, DIGITS)[1].groupBy("qid").agg(F.sum("n").alias("n"))


def _search(index: Lists, queries: DataFrame, top: int, id_column: str, vector: str, digits: int) -> tuple[DataFrame, DataFrame]:
    if top > LONGEST:
        raise ValueError(f"at most {LONGEST} rows a question")
    asks = _asks(queries, id_column, vector)
    order = W.partitionBy("qid").orderBy(F.desc("score"), "id")
    ranked = lambda hits: hits.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    blocks = _blocks(index)
    read = materialise(_first_pieces(index, blocks, asks, top))
    found = materialise(ranked(_scored(index, blocks, asks, read, top, digits)))
    more = materialise(_other_pieces(index, blocks, asks, found, read, top))
    every = found.drop("rank").unionByName(_scored(index, blocks, asks, more, top, digits)).unionByName(_noughts(index, asks, top))
    return ranked(every), read.unionByName(more)


# ---------------------------------------------------------------- without an index


def scan(rows: DataFrame, queries: DataFrame, top: int = 20, id_column: str = "vec_id", digits: int = DIGITS) -> DataFrame:
    """(qid, id, score, rank) as ``search`` gives them, of queries (qid, embedding) that are sent to every task: the caller bounds their number.

    A task multiplies the queries by SLICE rows at a time and keeps the best.
    """
    asked = _units(queries, "qid", "embedding").collect()
    sent = rows.sparkSession.sparkContext.broadcast([(q["width"], q["flat"], q["u"]) for q in asked])
    units = _units(rows, id_column, "embedding")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = sorted({(w, f) for w, f, _ in sent.value})
        members = {k: np.array([i for i, (w, f, _) in enumerate(sent.value) if (w, f) == k]) for k in kinds}
        held = None
        for batch in batches:
            ids, width, flat = batch.column("id").to_numpy(zero_copy_only=False), batch.column("width").to_numpy(), batch.column("flat").to_numpy(zero_copy_only=False)
            found = [] if held is None else [held]
            for w, f in kinds:
                asks = members[w, f]
                like = np.flatnonzero((width == w) & ~flat) if not f else np.zeros(0, int)
                u = np.array([sent.value[i][2] for i in asks]).reshape(len(asks), w) if len(like) else None
                for a in range(0, len(like), SLICE):
                    some = like[a : a + SLICE]
                    score = np.round(u @ matrix(batch.column("u").take(pa.array(some))).T, digits) + 0.0
                    q, r = first_rows(score, np.unique(ids[some], return_inverse=True)[1], top)
                    found.append((asks[q], ids[some][r], score[q, r]))
                rest = np.sort(np.delete(ids, like))[:top]  # these score 0
                found.append((np.repeat(asks, len(rest)), np.tile(rest, len(asks)), np.zeros(len(rest) * len(asks))))
            q, i, s = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((np.unique(i, return_inverse=True)[1], -s, q))
            q = q[order]
            keep = np.arange(len(q)) - np.searchsorted(q, q, "left") < top
            held = (q[keep], i[order][keep], s[order][keep])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(held[0].astype(np.int32)), pa.array(held[1], batch.schema.field("id").type), pa.array(held[2])], ["ask", "id", "score"])

    kind = dict(units.dtypes)["id"]
    hits = units.mapInArrow(best, f"ask int, id {kind}, score double")
    names = rows.sparkSession.createDataFrame([(i, q["id"]) for i, q in enumerate(asked)], f"ask int, qid {dict(queries.dtypes)['qid']}")
    order = W.partitionBy("qid").orderBy(F.desc("score"), "id")
    met = hits.join(F.broadcast(names), "ask").select("qid", "id", "score").distinct()
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def nearest(rows: DataFrame, queries: DataFrame, top: int = 20, id_column: str = "vec_id") -> DataFrame:
    """(qid, id, score, rank) of queries (qid, embedding): few are scanned for, more go over lists built for them. Both find the same."""
    return nearest_each(rows, [queries], top, id_column)[0]


def nearest_each(rows: DataFrame, queries: list[DataFrame], top: int = 20, id_column: str = "vec_id") -> list[DataFrame]:
    """What ``nearest`` gives for each of several tables of queries; lists are built once for all."""
    scanned = []
    for q in queries:
        some = q.where("embedding IS NOT NULL").select(F.size("embedding").alias("n")).limit(FEW + 1).agg(F.count("*").alias("n"), F.sum("n").alias("size")).first()
        scanned.append(some["n"] <= FEW and (some["size"] or 0) <= FEW_VALUES)
    own = None if all(scanned) else build(rows, id_column)
    return [scan(rows, q, top, id_column) if s else search(own, q, top) for q, s in zip(queries, scanned, strict=True)]


# ---------------------------------------------------------------- storing


def write(index: Lists, path: str) -> None:
    """The index under a new path; rows stay in the order of their pieces."""
    index.rows.write.parquet(f"{path}/rows")
    index.zeros.write.parquet(f"{path}/zeros")
    spark = index.rows.sparkSession
    centres = [(w, i, c.tolist()) for w, x in index.centres.items() for i, c in enumerate(x)]
    spark.createDataFrame(centres, "width int, list int, centre array<double>").write.parquet(f"{path}/centres")
    index.pieces.write.parquet(f"{path}/pieces")


def read(spark, path: str) -> Lists:
    centres: dict[int, list] = {}
    for r in spark.read.parquet(f"{path}/centres").orderBy("width", "list").collect():  # LISTS a width at most
        centres.setdefault(r["width"], []).append(r["centre"])
    tables = (spark.read.parquet(f"{path}/{name}") for name in ("rows", "pieces", "zeros"))
    return Lists(*tables, {w: np.array(c) for w, c in centres.items()})
