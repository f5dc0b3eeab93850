"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Slot t of the schedule falls at the fraction of (t + 1) / golden ratio; the cumulative
target shares give the slot's source, and the rank of a slot among its source's slots
gives the block. So any stretch of the schedule holds the sources in nearly their
shares. Each source's documents are laid end to end in a hashed order, which shuffles
them; a source that is used more than once is laid out again. The words up to the
source's target are cut into as many blocks as the source has slots, whose sizes differ
by one word at most; a source that no slot falls to has one after the others. So every
source meets its target at any size by the same rule, and a block has nearly as many
words in one source as in another, as slots come in the shares of the targets.

Documents meet the blocks that hold their words, and blocks their slots by (source,
rank): the table of slots has SLOTS rows and one for each missed source. Everything is
DataFrame operations; running sums over a source are taken in pieces (4096 hash ranges
a source), so no source meets in one task.

Nulls: a null text has no words; a null source is a source of its own, sorted last; a
null doc_id is hashed as the empty string. Documents without words are never taken.
Empty tables give empty results. Repeated rows are separate documents of equal size,
which one of them is taken more often is open but the rows of the result are not. Further
columns may have any names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, put_back, set_apart, word_count

WEIGHTS = (1.0, 2.0, 3.0)
MOST_TIMES = 3
SLOTS = 1 << 18
GOLDEN = 0.6180339887498949
CELLS = 1024
CHUNK = 1024


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_TIMES) -> DataFrame:
    """(source, source_size, target) from rows (source, source_size), one for each source.

    Targets are min(most * size, rate * weight) with the one rate that makes them add
    up to all sizes: what resharing excess by weight, again and again, comes to. Sources
    are few against documents; only they meet in one window.
    """
    one = F.lit(1)
    by_name = W.partitionBy(one).orderBy(F.col("source").asc_nulls_last())
    by_ratio = W.partitionBy(one).orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    t = sizes.withColumn("weight", weight).withColumn("ratio", most * F.col("source_size") / F.col("weight"))
    total = F.sum("source_size").over(W.partitionBy(one))
    left = total - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    open_weight = F.sum("weight").over(W.partitionBy(one)) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    t = t.withColumn("rate", left / open_weight)  # if the sources before this one stop at their most
    t = t.withColumn("rate", F.min(F.when(F.col("rate") <= F.col("ratio"), F.struct("ratio", "source", "rate"))).over(W.partitionBy(one))["rate"])
    return t.select("source", "source_size", F.least((most * F.col("source_size")).cast("double"), F.col("rate") * F.col("weight")).alias("target"))


def schedule(goals: DataFrame) -> DataFrame:
    """(slot, source, rank) from (source, source_size, target, block); rank counts a source's slots from 0."""
    one = F.lit(1)
    order = W.partitionBy(one).orderBy(F.col("source").asc_nulls_last())
    total = F.sum("source_size").over(W.partitionBy(one))
    edges = goals.where("target > 0").withColumn("total", total).withColumn("high", F.sum("target").over(order) / F.col("total"))
    edges = edges.withColumn("low", F.coalesce(F.lag("high").over(order), F.lit(0.0))).withColumn("high", F.when(F.lead("total").over(order).isNull(), 1.0).otherwise(F.col("high")))
    floor = lambda c: F.floor(c * CELLS).cast("long")
    spans = F.sequence(floor(F.col("low")), F.least(floor(F.col("high")), F.lit(CELLS - 1).cast("long")))
    cells = edges.where("low < high").select("source", "low", "high", F.explode(spans).alias("cell"))
    size = edges.agg(F.ceil(F.max("total") / F.max("block")).alias("n")).where("n > 0")
    made = size.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("slot"))
    point = (F.col("slot") + 1) * F.lit(GOLDEN)
    made = made.withColumn("u", point - F.floor(point)).withColumn("cell", floor(F.col("u")))
    hit = materialise(made.join(cells, "cell").where("low <= u AND u < high").select("slot", "source"))
    missed = edges.join(hit.select(F.col("source").alias("s")).distinct(), F.col("source").eqNullSafe(F.col("s")), "left_anti")
    after = F.ceil(F.col("total") / F.col("block")) + F.row_number().over(order) - 1
    # A source's slots meet in chunks; the chunks' counts are summed before.
    hit = hit.unionByName(missed.select(after.cast("long").alias("slot"), "source")).withColumn("chunk", F.floor(F.col("slot") / CHUNK))
    counts = hit.groupBy("source", "chunk").agg(F.count("*").alias("n"))
    first = counts.withColumn("first", F.sum("n").over(W.partitionBy("source").orderBy("chunk")) - F.col("n")).select(F.col("source").alias("s"), F.col("chunk").alias("c"), "first")
    inside = F.row_number().over(W.partitionBy("source", "chunk").orderBy("slot"))
    ranked = hit.withColumn("inside", inside).join(first, F.col("source").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("c")))
    return ranked.select("slot", "source", (F.col("first") + F.col("inside") - 1).alias("rank"))


def _laid_out(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs (source, _id, _size, ...) with _key and _piece; and (source, _piece) with the words before the piece."""
    d = docs.withColumn("_key", F.md5(F.coalesce(F.col("_id").cast("string"), F.lit("")))).withColumn("_piece", F.substring("_key", 1, 3))
    sums = materialise(d.groupBy("source", "_piece").agg(F.sum("_size").alias("_words")))
    before = F.sum("_words").over(W.partitionBy("source").orderBy("_piece")) - F.col("_words")
    return d, sums.withColumn("_before", before)


def _placed(d: DataFrame, pieces: DataFrame, per_source: DataFrame) -> DataFrame:
    """d with _row (a number in its piece), _start (words before the document in its source) and the columns of its source, a _ before their names."""
    order = W.partitionBy("source", "_piece").orderBy("_key", "_size")
    inside = F.sum("_size").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("_size")
    d = d.withColumn("_inside", inside).withColumn("_row", F.row_number().over(order))
    own = per_source.select(F.col("source").alias("_s"), *[F.col(c).alias(f"_{c}") for c in per_source.columns if c != "source"])
    info = pieces.withColumnsRenamed({"source": "_of", "_piece": "_p"}).drop("_words").join(own, F.col("_of").eqNullSafe(F.col("_s"))).drop("_of")
    out = d.join(info, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_piece") == F.col("_p")))
    return out.withColumn("_start", F.col("_before") + F.col("_inside")).drop("_s", "_p", "_key", "_inside", "_before")


def _goals(pieces: DataFrame, weights: Sequence[float], most: int, slots: int) -> DataFrame:
    goals = targets(pieces.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, most)
    total = F.sum("source_size").over(W.partitionBy(F.lit(1)))
    return goals.withColumn("block", F.ceil(total / slots).cast("long"))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _block_start(rank: Column) -> Column:
    return rank * F.col("_least") + F.least(rank, F.col("_longer"))


def _block_of(word: Column) -> Column:
    """The rank of the block that holds a word of a source's layouts, under _used."""
    longer = F.col("_longer") * (F.col("_least") + 1)
    return F.when(word < longer, _div(word, F.col("_least") + 1)).otherwise(F.col("_longer") + _div(word - longer, F.greatest(F.col("_least"), F.lit(1))))


def _planned(pieces: DataFrame, weights: Sequence[float], most: int, slots: int) -> tuple[DataFrame, DataFrame]:
    """(source, source_size, target, used, least, longer) and the schedule, as (_of, _rank, _slot).

    used is the words up to the target; a source's blocks have least words, its first longer ones one more.
    """
    goals = materialise(_goals(pieces, weights, most, slots))
    plan = materialise(schedule(goals))
    blocks = plan.groupBy(F.col("source").alias("_u")).agg(F.count("*").alias("blocks"))
    met = goals.join(blocks, F.col("source").eqNullSafe(F.col("_u")), "left")
    used = F.least(F.round("target").cast("long"), most * F.col("source_size"))
    per = met.select("source", "source_size", "target", used.alias("used"), F.coalesce("blocks", F.lit(1).cast("long")).alias("blocks"))
    per = per.withColumn("least", _div(F.col("used"), F.col("blocks"))).withColumn("longer", F.col("used") % F.col("blocks")).drop("blocks")
    return materialise(per), plan.select(F.col("source").alias("_of"), F.col("rank").alias("_rank"), F.col("slot").alias("_slot"))




def _in_slots(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows with the _slot of their source's block _rank; null where _rank is."""
    slots = plan.withColumnRenamed("_rank", "_r")
    return rows.join(slots, F.col("source").eqNullSafe(F.col("_of")) & (F.col("_rank") == F.col("_r")), "left").drop("_of", "_r")


def mix(docs: DataFrame, text: str = "text", id_column: str = "doc_id", weights: Sequence[float] = WEIGHTS, most: int = MOST_TIMES, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, source, source_size, target, taken, first_slot, n_blocks).

    taken is the words that the mix takes of the document, repeats counted; first_slot the
    slot in which it comes first (-1: never), n_blocks the number of blocks that hold a part of it.
    """
    sized = docs.select(F.col(id_column).alias("_id"), "source", word_count(F.col(text)).alias("_size"))
    d, pieces = _laid_out(sized)
    per, plan = _planned(pieces, weights, most, slots)
    placed = _placed(d, pieces, per)
    # A layout's words of a document, and the blocks that hold them.
    layouts = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: k * F.col("_source_size") + F.col("_start"))
    layouts = F.filter(layouts, lambda a: (a < F.col("_used")) & (F.col("_size") > 0))
    end = lambda a: F.least(a + F.col("_size"), F.col("_used"))
    held = lambda a, r: F.least(end(a), _block_start(r + 1)) - F.greatest(a, _block_start(r))
    parts = F.transform(layouts, lambda a: F.transform(F.sequence(_block_of(a), _block_of(end(a) - 1)), lambda r: F.struct(r.alias("rank"), held(a, r).alias("words"))))
    cut = placed.withColumn("_part", F.explode_outer(F.flatten(parts))).withColumn("_rank", F.col("_part.rank"))
    met = _in_slots(cut, plan).withColumn("_words", F.when(F.col("_slot").isNotNull(), F.col("_part.words")))
    # Rows are still dealt by source and piece, so they are summed where they are.
    own = [F.first(c).alias(c.lstrip("_")) for c in ("_size", "_source_size", "_target")]
    taken = F.coalesce(F.sum("_words"), F.lit(0).cast("long"))
    out = met.groupBy("source", "_piece", "_row").agg(F.first("_id").alias("doc_id"), *own, taken.alias("taken"), F.coalesce(F.min("_slot"), F.lit(-1).cast("long")).alias("first_slot"), F.count("_slot").alias("n_blocks"))
    return out.select("doc_id", "size", "source", "source_size", "target", "taken", "first_slot", "n_blocks")


def mix_documents(docs: DataFrame, text: str = "text", id_column: str = "doc_id", weights: Sequence[float] = WEIGHTS, most: int = MOST_TIMES, slots: int = SLOTS, slot: str | None = None) -> DataFrame:
    """Whole documents of the mix, columns as in docs: a document comes once for each layout in which its first word is taken.

    With slot, a column of that name has the slot whose block holds the first word: rows sorted by it are in the mix's order.
    """
    inner, names = set_apart(docs)
    sized = inner.withColumns({"source": F.col(names["source"]), "_id": F.col(names[id_column]), "_size": word_count(F.col(names[text]))})
    d, pieces = _laid_out(sized)
    per, plan = _planned(pieces, weights, most, slots)
    placed = _placed(d, pieces, per).where("_size > 0 AND _start < _used")
    first = F.col("_start") + F.col("_time") * F.col("_source_size")
    times = F.sequence(F.lit(0).cast("long"), F.ceil((F.col("_used") - F.col("_start")) / F.col("_source_size")) - 1)
    met = _in_slots(placed.withColumn("_time", F.explode(times)).withColumn("_rank", _block_of(first)), plan).where("_slot IS NOT NULL")
    return put_back(met.withColumnRenamed("_slot", slot), names, slot) if slot else put_back(met, names)
