"""Source divergence audit by a baseline-correction inverted index.

How far apart the sources of a language use its terms. A group (lang, source) gives a term
with c occurrences the share p = 1 + floor(SCALE * (c + 1) / (N + V)), N occurrences of all
V kept terms; p against q costs f = floor((p - q)^2 / q), in whole numbers throughout.

A pair of sources (a, b) would sum f over all V terms, though nearly all have a count of
zero in both. So each pair starts at V times f of two zero counts, and postings add what
differs from that baseline:

- a term that a has: f(p_a, q_b of zero) less the baseline. It depends on the count alone,
  so a's terms are counted by their count first, and a pair gets one correction for each
  different count, not for each term; likewise for b's terms;
- a term that both have: f(p_a, q_b) less both one-sided values plus the baseline. Only
  these meet by term, in an equi-join of postings that holds the sources of one term.

Terms against the whole language are ranked by a window a group, of which Spark keeps the
first ``top`` rows of each task before the shuffle.

Nulls: a null text, lang or source is ''. A row is a document of its own, repeated or not.
Empty tables give no rows. A language without kept terms gives its pairs at 0. Ties rank by
the item's UTF-8. Input columns other than text, lang and source are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_texts, materialise

SCALE = 1_000_000_000
LEAST_DOCS, TOP = 3, 200
#: Different (group, term) entries that a task holds before it hands them on, and bytes of text cut at once.
ENTRIES, PIECE = 400_000, 4 << 20
#: ASCII letters become small, other ASCII becomes a blank; bytes of longer characters stay.
_LETTERS = bytes(b if b >= 0x80 else (b | 0x20 if chr(b).isalpha() else 0x20) for b in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in lists: runs of characters other than ASCII non-letters, A-Z lower-cased."""
    text = text.translate(_LETTERS)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple, Counter] = {}
    holders: dict[tuple, Counter] = {}
    for batch in batches:
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), arrow_texts(batch), strict=True):
            own = counts.setdefault((lang, source), Counter())
            different: set[bytes] = set()
            for some in terms(text):
                own.update(some)
                different.update(some)
            holders.setdefault((lang, source), Counter()).update(different)
        if sum(map(len, counts.values())) > ENTRIES:
            yield _counted(counts, holders)
            counts, holders = {}, {}
    yield _counted(counts, holders)


def _counted(counts: dict[tuple, Counter], holders: dict[tuple, Counter]) -> pa.RecordBatch:
    """One row a group and term, and one of a null term for the group itself."""
    lang, source, term, n, df = [], [], [], [], []
    for key, own in counts.items():
        size, holds = len(own) + 1, holders[key]
        lang += [key[0]] * size
        source += [key[1]] * size
        term += [None, *own]
        n += [0, *own.values()]
        df += [0, *(holds[t] for t in own)]
    cols = [pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(df, pa.int64())]
    return pa.RecordBatch.from_arrays(cols, ["lang", "source", "term", "n", "df"])


def share(count: Column, total: Column, different: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + different)); null if there is no term."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")
    return F.call_function("div", above, F.nullif(total + different, F.lit(0)).cast("decimal(20,0)")) + 1


def cost(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q): both are at most SCALE + 1, so the square is a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def _exact(x: Column) -> Column:
    return x.cast("decimal(38,0)")


def postings(docs: DataFrame, least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """(lang, source, term, n, p, q) of the kept terms that a group has, and (lang, source, total, v, p0) of all groups.

    p is the group's share of the term, q the language's, p0 the group's of a term that it lacks.
    """
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")], F.col("text"))
    found = rows.mapInArrow(_scan, "lang string, source string, term string, n long, df long")
    counts = materialise(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")))
    own = W.partitionBy("lang", "term")
    kept = counts.where("term IS NOT NULL").select(
        "lang", "source", "term", "n", F.sum("df").over(own).alias("df"), F.sum("n").over(own).alias("c"), (F.row_number().over(own.orderBy("source")) == 1).cast("long").alias("first"))
    kept = materialise(kept.where(F.col("df") >= least_docs).drop("df"))
    langs = kept.groupBy("lang").agg(F.sum("first").alias("v"), F.sum("n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = materialise(groups.select("lang", "source", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("total", "v", "lang_total")]))
    met = kept.join(groups, ["lang", "source"])
    p = share(F.col("n"), F.col("total"), F.col("v"))
    q = share(F.col("c"), F.col("lang_total"), F.col("v"))
    posts = materialise(met.select("lang", "source", "term", "n", p.alias("p"), q.alias("q")))
    return posts, groups.select("lang", "source", "total", "v", share(F.lit(0), F.col("total"), F.col("v")).alias("p0"))


def pairs(posts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): the summed cost of each ordered pair of a language's sources."""
    side = lambda s: groups.select("lang", F.col("source").alias(s), F.col("p0").alias(f"{s}0"), F.col("v").alias(f"v_{s}"))
    pair = materialise(side("a").join(side("b"), "lang").where("a <> b").withColumn("f0", cost(F.col("a0"), F.col("b0"))))
    base = pair.select("lang", "a", "b", F.coalesce(_exact(F.col("v_a")) * _exact(F.col("f0")), _exact(F.lit(0))).alias("x"))
    levels = materialise(posts.groupBy("lang", "source", "n", "p").agg(F.count("*").alias("m")))  # terms of one count cost the same
    of = lambda s: levels.select("lang", F.col("source").alias(s), "p", "m")
    gain = lambda f: F.sum(_exact(F.col("m")) * _exact(f - F.col("f0"))).alias("x")
    left = pair.join(of("a"), ["lang", "a"]).groupBy("lang", "a", "b").agg(gain(cost(F.col("p"), F.col("b0"))))
    right = pair.join(of("b"), ["lang", "b"]).groupBy("lang", "a", "b").agg(gain(cost(F.col("a0"), F.col("p"))))
    zero = groups.select("lang", "source", "p0")
    one = posts.join(zero, ["lang", "source"])
    own = lambda s: one.select("lang", "term", F.col("source").alias(s), F.col("p").alias(f"{s}p"), F.col("p0").alias(f"{s}0"))
    a, b, a0, b0 = (F.col(c) for c in ("ap", "bp", "a0", "b0"))
    both = own("a").join(own("b"), ["lang", "term"]).where("a <> b").withColumn("x", cost(a, b) - cost(a, b0) - cost(a0, b) + cost(a0, b0))
    both = both.where("x <> 0").groupBy("lang", "a", "b").agg(F.sum(_exact(F.col("x"))).alias("x"))
    every = base.unionByName(left).unionByName(right).unionByName(both)
    return every.groupBy("lang", "a", "b").agg(F.sum("x").cast("long").alias("value")).select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of documents (text, lang, source).

    part ``pair``: how far the source is from each other source of its language, all ranks;
    part ``term``: its terms of a larger share than in the language, to rank ``top``.
    """
    posts, groups = postings(docs, least_docs)
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = pairs(posts, groups).withColumn("rank", F.row_number().over(order))
    over = posts.where("p > q").select("lang", "source", F.col("term").alias("item"), cost(F.col("p"), F.col("q")).alias("value"))
    term = over.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    out = pair.withColumn("part", F.lit("pair")).unionByName(term.withColumn("part", F.lit("term")))
    return out.select("lang", "source", "part", "item", "value", "rank")
