"""Scoring texts with a probabilistic suffix tree over tokens, beside an add-one unigram base.

A text's tokens are its lower-cased (A-Z) words and one end. The base counts tokens.

In the model a token's context is the tokens before it, back to the start of the
text: up to ORDER of them. Every context seen LEAST times is tried, level by level. It
is retained if its next-token distribution diverges from that of its suffix, by
``gain`` nats over all its occurrences, and its suffix is retained. Next tokens are
listed from LISTED times on, if they themselves are seen LEAST times. Each token is
scored in the longest retained suffix of what precedes it: listed counts, with
everything unlisted and ``FOLLOW_SMOOTH`` more left to the suffix, down to the root. These
bars are the same at every size, so contexts grow with the corpus. They are kept as
a table of keys (64-bit hashes) and values that add up to a text's score, so
that documents meet it by an equality join. The root counts every word, and leaves as much as there are words seen
once to spelling: a second suffix tree, over the characters of all different words, whose contexts are what a token
has so far after an open mark (DEPTH symbols at most) and whose root is uniform over
all code points. So the scores are those of one distribution over all texts.

Counts cover all training texts. What goes to the executors is bounded: the ``head``
most frequent words, the ``model_head`` most frequent keys, bitmaps that spare rows a
shuffle, and DEPTH / LEAST_SHARE spelling counts. All other words and keys reach the
documents by a join, so these bounds change no result but the spelling's.

Nulls: a null text is an empty one, with the end token alone; a null doc_id is in
training. Empty tables give empty results; without training texts, N and V are 0 and
all symbols fall to the spelling's uniform share. Repeated rows train and score as
often as they occur. Texts of any length are handled whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_texts, bitmap, bits_for, bucket_bits, from_low_bytes, in_bitmap, long_hashes, low_bytes, materialise, mixed, packed, run_starts, runs, short_batches, unpacked
from ..sources.scratch import discard

DEPTH = 7
OPEN, CLOSE, END = "\x01", "\x02", "\x03"
SYMBOLS = 0x110000 + 2
LEAST_SHARE = 4e-6
GAIN = 3.0
SMOOTH = 2.0
ORDER = 3
LEAST = 64
LISTED = 3
FOLLOW_SMOOTH = 50.0
#: Bits of a token's hash that go into keys.
TOKEN = (1 << 40) - 1
HEAD = 200_000
MODEL_HEAD = 2_000_000
FLUSH = 250_000
#: Contexts with more than this part of all tokens are cut; there are at most as many.
HOT = 1024
FLUSHED = 1 << 20
#: Each text has a token at least, so a group of texts has no more texts than fit two bytes.
CHUNK = 1 << 16
#: Documents whose sums are packed together, as an exponent.
BLOCK = 10


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    others: set[bytes] = set()
    ends = 0

    def rows() -> pa.RecordBatch:
        rest = [w for w in others if w not in counts]
        words = pa.array([*counts.keys(), *rest], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array([*counts.values(), *[0] * len(rest)], pa.int64())], ["word", "c"])

    for batch in batches:
        for text, held in zip(arrow_texts(batch), batch.column("held_out").to_pylist(), strict=True):
            words = text.lower().split()
            if held:
                others.update(words)
            else:
                counts.update(words)
                ends += 1
            if len(counts) + len(others) > FLUSH:
                yield rows()
                counts.clear()
                others.clear()
    yield rows()
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([ends], pa.int64())], ["word", "c"])


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, c) of every word: its count in training texts. The row of the null word counts these texts, each of which has one end token."""
    counted = docs.select(F.col(text).alias("text"), "held_out").mapInArrow(_count_words, "word string, c long")
    return counted.groupBy("word").agg(F.sum("c").alias("c"))


def _head(counted: DataFrame, most: int) -> pa.Table:
    """At most ``most`` rows, all those whose c is above some count.

    The count comes from a histogram of logarithms, so no more than the head itself reaches the driver.
    """
    step = F.floor(F.log2("c") * 16).cast("int")
    total, least = 0, None
    for b, k in sorted(((r[0], r[1]) for r in counted.groupBy(step).count().collect()), reverse=True):
        total += k
        if total > most:
            break
        least = b
    return (counted.limit(0) if least is None else counted.where(step >= least)).toArrow()


def _spelling(words: DataFrame, speller: Speller) -> DataFrame:
    """words with log10 of the spelling's probability of each."""
    sent = words.sparkSession.sparkContext.broadcast(speller)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sent.value.logs(batch.column("word").to_pylist()))], ["word", "c", "spelling"])

    return words.mapInArrow(spell, "word string, c long, spelling double")


class Tree:
    """Retained contexts with their counts: probability of a symbol after what came before in its token."""

    def __init__(self, contexts: dict[str, tuple[int, dict[str, int]]], smooth: float = SMOOTH):
        self.contexts = contexts
        self.smooth = smooth
        self.depth = max(map(len, contexts), default=0)

    def state(self, before: str) -> str:
        """The longest retained context that ends in ``before``."""
        for k in range(max(0, len(before) - self.depth), len(before)):
            if before[k:] in self.contexts:
                return before[k:]
        return ""

    def share(self, context: str, symbol: str) -> float:
        """Counts dropped as rare go to the suffix, so the shares of all symbols add up to 1."""
        total, nexts = self.contexts.get(context, (0, {}))
        lower = 1 / SYMBOLS if context == "" else self.share(context[1:], symbol)
        listed = nexts.get(symbol, 0)
        rest = self.smooth + total - nexts.get("", total)
        return (listed + rest * lower) / (total + self.smooth)

    def token(self, token: str | None) -> float:
        """log10 probability of a word, or of the end token if None. Plain form; ``Speller`` has it for many words."""
        spelt = _spelt(token)
        return sum(math.log10(self.share(self.state(spelt[:i]), spelt[i])) for i in range(1, len(spelt)))


def _spelt(token: str | None) -> str:
    return OPEN + (END if token is None else token + CLOSE)


class _Places:
    """Where each of some different 64-bit keys stands, in an open-addressed table at most half full."""

    def __init__(self, keys: np.ndarray):
        size = 1 << max(4, (2 * len(keys)).bit_length())
        self.mask = np.uint64(size - 1)
        self.keys, self.at = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        left, probe = np.arange(len(keys)), np.uint64(0)
        while len(left):
            slot = ((keys[left] + probe) & self.mask).astype(np.int64)
            free = self.at[slot] < 0
            taken, first = np.unique(slot[free], return_index=True)
            self.at[taken] = left[free][first]
            self.keys[taken] = keys[left[free][first]]
            left = left[self.at[slot] != left]
            probe += np.uint64(1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of the keys; -1: not among them."""
        slot = (keys & self.mask).astype(np.int64)
        at = self.at[slot]
        out = np.where(self.keys[slot] == keys, at, np.int32(-1))
        open_, probe = np.flatnonzero((out < 0) & (at >= 0)), np.uint64(1)
        while len(open_):
            slot = ((keys[open_] + probe) & self.mask).astype(np.int64)
            hit = (self.keys[slot] == keys[open_]) & (self.at[slot] >= 0)
            out[open_[hit]] = self.at[slot[hit]]
            open_ = open_[~hit & (self.at[slot] >= 0)]
            probe += np.uint64(1)
        return out


_LEVEL = np.uint64(0xD6E8FEB86659FD93)


def _level(k: int) -> np.ndarray:
    return np.array([k], np.uint64) * _LEVEL


class Speller:
    """A Tree in arrays, for many words at once: contexts and their listed symbols are found by 64-bit hashes."""

    def __init__(self, tree: Tree):
        self.depth, self.smooth = tree.depth, tree.smooth
        contexts = list(tree.contexts)
        keys = np.array([self._key(c) for c in contexts], np.uint64)
        self.contexts = _Places(keys)
        nodes = [tree.contexts[c] for c in contexts]
        self.total = np.array([t for t, _ in nodes], np.float64) + self.smooth
        self.rest = self.total - np.array([x.get("", t) for t, x in nodes], np.float64)
        listed = [(k, ord(s), c) for k, (_, x) in enumerate(nodes) for s, c in x.items() if s]
        node, symbol, count = (np.array(x) for x in zip(*listed, strict=True)) if listed else (np.zeros(0, np.int64),) * 3
        self.pairs = _Places(mixed(keys[node] + mixed(symbol.astype(np.uint64) + np.uint64(1))))
        self.counts = count.astype(np.float64)

    def _key(self, context: str) -> np.uint64:
        codes = mixed(np.array([ord(x) for x in reversed(context)], np.uint64) + np.uint64(1))
        return mixed((codes * self._powers(len(codes))).sum(dtype=np.uint64, keepdims=True) + _level(len(codes)))[0]

    @staticmethod
    def _powers(n: int) -> np.ndarray:
        return np.cumprod(np.full(n, _LEVEL), dtype=np.uint64)

    def logs(self, words: list[str | None]) -> np.ndarray:
        """log10 of each word's probability (None: the end token). Memory is some 30 bytes a character."""
        if not words:
            return np.zeros(0)
        spelt = [_spelt(w) for w in words]
        length = np.fromiter(map(len, spelt), np.int64, len(spelt))
        starts = np.cumsum(length) - length
        codes = np.frombuffer("".join(spelt).encode("utf-32-le", "surrogatepass"), np.uint32)
        place = np.arange(len(codes)) - np.repeat(starts, length)
        out = np.zeros(len(codes))
        for k in range(0, len(codes), FLUSH):
            at = k + np.flatnonzero(place[k : k + FLUSH])
            out[at] = np.log10(self._shares(codes, place, at))
        return np.add.reduceat(out, starts)

    def _shares(self, codes: np.ndarray, place: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Shares of the symbols at ``at``, from the root to the longest retained context; retained contexts have their suffixes retained."""
        out, powers = np.full(len(at), 1 / SYMBOLS), self._powers(self.depth)
        symbol = mixed(codes[at].astype(np.uint64) + np.uint64(1))
        hashed, here = np.zeros(len(at), np.uint64), np.arange(len(at))
        for k in range(self.depth + 1):
            if k:
                deep = place[at[here]] >= k
                here = here[deep]
                hashed = hashed[deep] + mixed(codes[at[here] - k].astype(np.uint64) + np.uint64(1)) * powers[k - 1]
            key = mixed(hashed + _level(k))
            node = self.contexts.find(key)
            known = node >= 0
            here, hashed, key, node = here[known], hashed[known], key[known], node[known]
            if not len(here):
                break
            pair = self.pairs.find(mixed(key + symbol[here]))
            listed = np.append(self.counts, 0.0)[pair]  # -1 meets the 0
            out[here] = (listed + self.rest[node] * out[here]) / self.total[node]
        return out


def _windows(words: DataFrame, depth: int) -> DataFrame:
    """(context, symbol, c) of full depth: each symbol of each token with what precedes it, depth at most."""
    spelt = F.concat(F.lit(OPEN), F.when(F.col("word").isNull(), F.lit(END)).otherwise(F.concat("word", F.lit(CLOSE))))
    at = words.select(spelt.alias("s"), "c", F.explode(F.sequence(F.lit(2), F.length(spelt))).alias("i"))
    start = F.greatest(F.lit(1), F.col("i") - depth)
    windows = at.select(F.substring(F.col("s"), start, F.col("i") - start).alias("context"), F.substring(F.col("s"), F.col("i"), F.lit(1)).alias("symbol"), "c")
    return windows.groupBy("context", "symbol").agg(F.sum("c").alias("c"))


def grow(words: DataFrame, depth: int = DEPTH, least_share: float = LEAST_SHARE, gain: float = GAIN) -> Tree:
    """The tree from word counts, level by level. At most depth / least_share next-symbol counts reach the driver, and 1 / least_share contexts a level the executors.

    A context occurs as often as its last symbol follows the rest of it, so a level's counts say which contexts the next one has.
    """
    spark = words.sparkSession
    windows = materialise(_windows(words, depth))
    total = windows.agg(F.sum("c")).first()[0] or 0
    least = max(2.0, least_share * total)
    seen = F.col("c") >= least
    nodes: dict[str, tuple[int, dict[str, int]]] = {}
    level = [""]
    for k in range(depth + 1):
        tall = spark.createDataFrame(pa.table({"context": pa.array(level, pa.string())}))
        ends = windows.where(F.length("context") >= k).select(F.substring(F.col("context"), F.length("context") - k + 1, F.lit(k)).alias("context"), "symbol", "c")
        counts = ends.join(F.broadcast(tall), "context", "left_semi").groupBy("context", "symbol").agg(F.sum("c").alias("c"))
        sums = counts.groupBy("context").agg(F.sum("c").alias("total"), F.sum(F.when(seen, F.col("c")).otherwise(0)).alias("listed"), F.collect_list(F.when(seen, F.struct("symbol", "c"))).alias("nexts"))
        found = sums.where((F.col("total") >= least) | (F.col("context") == "")).toPandas()
        here = {c: (int(t), {"": int(n), **{x["symbol"]: int(x["c"]) for x in nexts}}) for c, t, n, nexts in found.itertuples(index=False)}
        nodes |= here
        level = [c + s for c, (_, nexts) in here.items() for s in nexts if s and s not in (CLOSE, END)] + [OPEN] * (k == 0)
        if not level:
            break
    discard(windows)
    return Tree(_retained(nodes, gain))


def _retained(nodes: dict[str, tuple[int, dict[str, int]]], gain: float) -> dict[str, tuple[int, dict[str, int]]]:
    keep = {""} & nodes.keys()
    for context in sorted(nodes, key=len, reverse=True):
        if context in keep or context == "" or context[1:] not in nodes:
            continue
        total, nexts = nodes[context]
        parent_total, parent = nodes[context[1:]]
        divergence = sum(c * math.log(c / total * parent_total / parent[s]) for s, c in nexts.items() if s and parent.get(s))
        if divergence >= gain:
            while context and context not in keep:
                keep.add(context)
                context = context[1:]
    return {c: nodes[c] for c in keep}


# ---------------------------------------------------------------- contexts of tokens


def _flat(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, list[bytes]]]:
    """Texts in groups of some CHUNK tokens: (first text, starts, tokens). A text's last token is its end, the empty word."""
    tokens: list[bytes] = []
    starts: list[int] = []
    for k, text in enumerate(texts):
        starts.append(len(tokens))
        tokens += text.lower().split()
        tokens.append(b"")
        if len(tokens) >= CHUNK or k == len(texts) - 1:
            yield k + 1 - len(starts), np.array(starts), tokens
            tokens, starts = [], []


def _hashes(tokens: list[bytes]) -> np.ndarray:
    """As the xxhash64 function of Spark."""
    return np.fromiter(map(xxhash.xxh64_intdigest, tokens, repeat(42)), np.uint64, len(tokens))


_ENDED = _hashes([b""])


def _append(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Keys of contexts with one more token at their end. The empty context is 0."""
    return long_hashes(context ^ (token & np.uint64(TOKEN)))


def _appended(context: Column, token: Column) -> Column:
    """As ``_append``. A Python function here would hold a second Python worker in tasks that have one."""
    return F.xxhash64(context.bitwiseXOR(token.bitwiseAND(F.lit(TOKEN))))


def _words(tokens: list[bytes], ids: dict[bytes, int], known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, hashes) of tokens: the hashes of those with an id are known, the others (-1) are hashed here."""
    n = np.fromiter(map(ids.get, tokens, repeat(-1)), np.int64, len(tokens))
    hashes, others = known[n], np.flatnonzero(n < 0)
    hashes[others] = _hashes([tokens[k] for k in others.tolist()])
    return n, hashes


def _last(hashes: np.ndarray, starts: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(context, key) at every place for 1, 2, ... k tokens before it: the key of these tokens, and that of them and the place's own.

    The start of a text is a token, written as an end. A place with fewer tokens before it is not to be used; ``_deep`` says which are.
    A context is the key of one token less at the place before.
    """
    key = _append(np.zeros(len(hashes) + 1, np.uint64), np.concatenate((_ENDED, hashes)))
    for _ in range(k):
        context = key[:-1]
        own = _append(context, hashes)
        yield context, own
        key = np.concatenate((own[:1], own))  # no place before the first has so many tokens before it


def _deep(starts: np.ndarray, n: int, k: int) -> np.ndarray:
    """Which of n places have k tokens before them, the start of the text included."""
    out = np.ones(n, bool)
    for j in range(k - 1):
        at = starts + j
        out[at[at < n]] = False
    return out


def _order(key: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Order by key, then low, where most keys are different."""
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    runs_ = np.zeros(len(order), bool)
    runs_[1:] = same
    runs_[:-1] |= same
    some = order[runs_]
    order[runs_] = some[np.lexsort((low[some], key[some]))]
    return order


def _spread(context: np.ndarray, token: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Hashes whose top bits are buckets. Contexts stay whole in a bucket, but for the hot ones (in order), which are cut by 64 parts of their next tokens."""
    part = np.zeros(len(context), np.uint64)
    if len(hot):
        known = hot[np.minimum(np.searchsorted(hot, context), len(hot) - 1)] == context
        part[known] = (token[known] & np.uint64(63)) + np.uint64(1)
    return mixed(context + part)


def follow_counts(train: DataFrame, k: int, contexts, nexts, parents, hot: np.ndarray, bits: int, listed: int, words=None, text: str = "text") -> DataFrame:
    """(context, token, c): how often a token follows a context of k tokens, if ``listed`` times, of contexts and tokens in these (broadcast) bitmaps.

    A token that is not listed after the context's suffix (``parents``, a bitmap of keys; None: all are) is not listed after the context.
    Counts of a task travel packed in 2 ** bits buckets and are summed bucket by bucket. ``words`` (broadcast) numbers words, all in ``nexts`` among
    them, and has their hashes: other words are in no context and need none.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        ids, known = words.value if words else (None, _ENDED)
        passed, ended = np.append(in_bitmap(nexts.value, known), False), in_bitmap(nexts.value, _ENDED)

        def rows() -> pa.RecordBatch:
            context, token = (np.concatenate(x) for x in zip(*held, strict=True))
            spread = _spread(context, token, hot)
            # One sort puts buckets, contexts and tokens in order; contexts that agree in 24 bits may mix, and then have several rows of one token.
            order = np.argsort((spread & ~np.uint64(TOKEN)) | token)
            context, token, spread = context[order], token[order], spread[order]
            first = run_starts(context, token)
            c = np.diff(first, append=len(context)).astype(np.uint32)
            buckets, columns = packed(spread[first] >> np.uint64(64 - bits), [context[first], low_bytes(token[first], 5), c])
            return pa.RecordBatch.from_arrays([pa.array(buckets.astype(np.int32)), *columns], ["bucket", "context", "token", "c"])

        for batch in batches:
            for _, starts, tokens in _flat(arrow_texts(batch)):
                if ids:
                    n = np.fromiter(map(ids.get, tokens, repeat(-1)), np.int64, len(tokens))
                    hashes, here = known[n], passed[n]
                else:
                    hashes = _hashes(tokens)
                    here = in_bitmap(nexts.value, hashes)
                *_, suffix, last = None, None, *_last(hashes, starts, k)
                at = _deep(starts, len(hashes), k)
                for _ in range(k + 1):
                    at &= here
                    here = np.concatenate((ended, here[:-1]))
                at = np.flatnonzero(at)
                at = at[in_bitmap(contexts.value, last[0][at])]
                if parents:
                    at = at[in_bitmap(parents.value, suffix[1][at])]
                held.append((last[0][at], hashes[at] & np.uint64(TOKEN)))
                size += len(held[-1][0])
                if size > FLUSHED:
                    yield rows()
                    held.clear()
                    size = 0
        if size:
            yield rows()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in runs(batches, "bucket"):
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                part = table.slice(a, b - a)
                context, token = unpacked(part.column("context"), np.uint64), from_low_bytes(unpacked(part.column("token"), np.uint8), 5)
                key = _append(context, token)
                order = np.argsort(key)
                first = run_starts(context[order], token[order])
                if len(first) > len(run_starts(key[order])):  # two that differ share a key
                    order = np.lexsort((token, context))
                    first = run_starts(context[order], token[order])
                context, token = context[order], token[order]
                c = np.add.reduceat(unpacked(part.column("c"), np.uint32)[order].astype(np.int64), first)
                first, c = first[c >= listed], c[c >= listed]
                context, token = context[first], token[first]
                yield pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in (context, token)), pa.array(c)], ["context", "token", "c"])

    blocks = train.select(F.col(text).alias("text")).mapInArrow(scan, "bucket int, context binary, token binary, c binary")
    return blocks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(add, "context long, token long, c long")


def follow(train: DataFrame, unigrams: DataFrame, order: int = ORDER, least: int = LEAST, listed: int = LISTED, gain: float = GAIN, words=None) -> DataFrame:
    """(key, value, c): the retained contexts and their listed next tokens, from (word, c, share) of the root.

    log10 of a token's probability is that of its share in the root, the value of each retained context before it
    (key ~context) and of each such context with the token listed in it (key of both). A context's value is what it
    leaves to its suffix; a listed token's makes up for that. c counts occurrences in training.
    """
    spark = train.sparkSession
    own = unigrams.where(F.col("c") >= least).select(F.xxhash64(F.coalesce("word", F.lit(""))).alias("h"), "c", "share")
    nexts = materialise(own)
    size, n = nexts.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    passed = spark.sparkContext.broadcast(bitmap(nexts.select("h"), bits_for(size, 32)))
    # Words that agree in the 40 bits of a token count as one there.
    tokens = nexts.groupBy(F.col("h").bitwiseAND(F.lit(TOKEN)).alias("token")).agg(F.sum("c").alias("total"), F.min("share").alias("lower"))
    level = materialise(tokens.select(_appended(F.lit(0).cast("long"), F.col("token")).alias("context"), F.lit(0).cast("long").alias("suffix"), "total", "lower"))
    lower, contexts = level.select(F.col("context").alias("parent"), "lower"), level.select("context", "suffix", "total")
    end = int(_ENDED[0]) & TOKEN
    model = spark.createDataFrame([], "key long, value double, c long")
    for k in range(1, order + 1):
        size = contexts.count()
        if not size:
            break
        allowed = spark.sparkContext.broadcast(bitmap(contexts.select("context"), bits_for(size, 32)))
        hot = np.sort(np.array([r[0] for r in contexts.where(F.col("total") > n / HOT).select("context").collect()], np.int64).view(np.uint64))
        parents = spark.sparkContext.broadcast(bitmap(lower.select("parent"), bits_for(lower.count(), 32))) if k > 1 else None
        counted = follow_counts(train, k, allowed, passed, parents, hot, bucket_bits(n), listed, words)
        grams = materialise(counted.join(contexts, "context").withColumn("parent", _appended(F.col("suffix"), F.col("token"))).join(lower, "parent"))
        sums = grams.groupBy("context", "total").agg(F.sum("c").alias("all"), F.sum(F.col("c") * F.log(F.col("c") / F.col("total") / F.col("lower"))).alias("gain"))
        rest = F.col("total") - F.col("all") + FOLLOW_SMOOTH
        kept = materialise(sums.where(F.col("gain") >= gain).select("context", "total", rest.alias("rest"), F.log10(rest / (F.col("total") + FOLLOW_SMOOTH)).alias("leaves")))
        key = _appended(F.col("context"), F.col("token"))  # not carried through the joins
        share = (F.col("c") + F.col("rest") * F.col("lower")) / (F.col("total") + FOLLOW_SMOOTH)
        shares = materialise(grams.join(kept.drop("total"), "context").select(key.alias("key"), "c", "lower", share.alias("share"), "leaves"))
        model = model.union(kept.select(F.bitwise_not("context"), "leaves", "total")).union(shares.select("key", F.log10("share") - F.log10("lower") - F.col("leaves"), "c"))
        longer = grams.where((F.col("c") >= least) & (F.col("token") != end)).select(key.alias("context"), F.col("parent").alias("suffix"), F.col("c").alias("total"))
        contexts = materialise(longer.join(kept.select(F.col("context").alias("suffix")), "suffix", "left_semi").select("context", "suffix", "total"))
        lower = shares.select(F.col("key").alias("parent"), F.col("share").alias("lower"))
        discard(grams)
    return materialise(model)


class Follow:
    """The most frequent part of a model of contexts, and a bitmap of the keys in the rest."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, order: int, others: np.ndarray):
        self.places, self.values, self.order, self.others = _Places(keys.view(np.uint64)), values, order, others

    def logs(self, hashes: np.ndarray, starts: np.ndarray, nexts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sums, places, keys): what the frequent part adds to log10 at each place, and the keys that the rest may have. ``nexts``: which places' tokens may be listed at all."""
        sums, places, keys = np.zeros(len(hashes)), [], []

        def look(at: np.ndarray, asked: np.ndarray) -> np.ndarray:
            found = self.places.find(asked)
            hit = found >= 0
            sums[at[hit]] += self.values[found[hit]]
            maybe = ~hit & in_bitmap(self.others, asked)
            places.append(at[maybe])
            keys.append(asked[maybe])
            return hit | maybe

        at = np.arange(len(hashes))
        listed = np.ones(len(hashes), bool) if nexts is None else nexts.copy()
        for k, (context, key) in enumerate(_last(hashes, starts, self.order), 1):
            at = at[_deep(starts, len(hashes), k)[at]]
            at = at[look(at, ~context[at])]  # the suffixes of a retained context are retained
            here = at[listed[at]]  # what is listed after a context is listed after its suffix
            listed[here] = look(here, key[here])
        return sums, np.concatenate(places), np.concatenate(keys).view(np.int64)


def score(docs: DataFrame, text: str = "text", id_column: str = "doc_id", head: int = HEAD, model_head: int = MODEL_HEAD, order: int = ORDER) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, unigram_score), one row for each document.

    unigram_score is that of the tree's root alone: the unigram with the same spelling, whose shares add up to 1 as the tree's do (the base's don't).
    All of it is done when this returns, so that texts reach Python in short batches throughout.
    """
    with short_batches(docs.sparkSession):
        return _score(docs, text, id_column, head, model_head, order)


def _score(docs: DataFrame, text: str, id_column: str, head: int, model_head: int, order: int) -> DataFrame:
    spark = docs.sparkSession
    named = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text")).withColumn("held_out", held_out(F.col("doc_id")))
    train = named.where("NOT held_out")
    words = materialise(word_counts(named, "text"))
    n, v, ends, once = words.where("c > 0").agg(F.sum("c"), F.count("*"), F.max(F.when(F.col("word").isNull(), F.col("c"))), F.count(F.when(F.col("c") == 1, 1))).first()
    n, ends, fresh = n or 0, ends or 0, float(max(1, once))
    speller = Speller(grow(words.where("c > 0").select("word", F.lit(1).cast("long").alias("c"))))  # unseen words are like different words, not like frequent ones
    known_words = words.where("word IS NOT NULL")
    top_words = _head(known_words.where("c > 0"), head)
    rare = known_words.where(F.col("c") < (pc.min(top_words["c"]).as_py() or 0)) if len(top_words) else known_words
    # Rare words are asked for by their hashes; should two of all words share one, they count among the head.
    shared = [r[0] for r in known_words.groupBy(F.xxhash64("word").alias("h")).agg(F.count("*").alias("k")).where("k > 1").collect()]
    frequent = pa.concat_tables([top_words, *([rare.where(F.xxhash64("word").isin(shared)).toArrow()] if shared else [])]).to_pandas()
    ids = {b"": 0, **{w.encode(): k + 1 for k, w in enumerate(frequent["word"])}}
    counts = np.append(float(ends), frequent["c"].to_numpy(np.float64))
    spelt = speller.logs([None, *frequent["word"]])
    root = (counts + fresh * 10**spelt) / (n + fresh)
    del frequent, top_words
    share = (F.col("c") + fresh * F.pow(F.lit(10.0), "spelling")) / F.lit(n + fresh)
    sent_words = spark.sparkContext.broadcast((ids, _hashes(list(ids))))
    often = rare.where(F.col("c") >= LEAST).isEmpty()  # all words that may be listed have ids
    model = follow(train, _spelling(words.where(F.col("c") >= LEAST), speller).withColumn("share", share), order, words=sent_words if often else None)
    top = _head(model, model_head)
    others = model.where(F.col("c") < (pc.min(top["c"]).as_py() or 0)) if len(top) else model
    marks = bitmap(others.select("key"), bits_for(others.count(), 32))
    sent = spark.sparkContext.broadcast((counts, root, Follow(top["key"].to_numpy(), top["value"].to_numpy(), order, marks)))
    sent_speller, bits = spark.sparkContext.broadcast(speller), bucket_bits(n)
    kind = dict(named.dtypes)["doc_id"]
    own_type = f"struct<doc_id:{kind}, held_out:boolean, n_tokens:bigint, known:bigint, logs:double, unigram:double, score:double>"
    own_names = ["doc_id", "held_out", "n_tokens", "known", "logs", "unigram", "score"]
    names = ["bucket", "side", "keys", "first", "second", "row", "own"]

    def block(side: int, word: np.ndarray, key: np.ndarray, columns: list[np.ndarray], base: int, own: pa.DataType) -> pa.RecordBatch:
        """Rows packed by bucket: the top bits of the key, words after the model's keys. Seven bytes of a key are left to say."""
        bucket = (key >> np.uint64(64 - bits)).astype(np.int32) + (word.astype(np.int32) << bits)
        buckets, packs = packed(bucket, [low_bytes(key, 7), *columns])
        return pa.RecordBatch.from_arrays([pa.array(buckets), pa.array(np.full(len(buckets), side, np.int32)), *packs, pa.array(np.full(len(buckets), base, np.int64)), pa.nulls(len(buckets), own)], names)

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Spells rare words here, not in a task of its own before, which would keep a second Python worker."""
        for batch in batches:
            key, word = batch.column("key").to_numpy().view(np.uint64), batch.column("spelt").is_valid().to_numpy(zero_copy_only=False)
            c, value = batch.column("c").to_numpy(), np.array(batch.column("value"))
            value[word] = np.log10((c[word] + fresh * 10 ** sent_speller.value.logs(batch.column("spelt").drop_null().to_pylist())) / (n + fresh))
            for kind in (False, True):
                at = np.flatnonzero(word == kind)
                at = at[np.argsort(key[at])]
                # Only a word's answer needs its count.
                yield block(0, word[at], key[at], [value[at], c[at] if kind else np.zeros((len(at), 0), np.int64)], 0, batch.column("own").type)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, shares, follow = sent.value
        logs, nexts = np.log10(known + 1), np.append(known >= LEAST, not often)
        held: tuple[list, list] = ([], [])
        size, base = 0, 0

        def asked(own: pa.DataType) -> Iterator[pa.RecordBatch]:
            for word, parts in enumerate(held):
                key, row = (np.concatenate(x) for x in zip(*parts, strict=True))
                order = _order(key, row)
                key, row = key[order], row[order]
                first = run_starts(key, row)
                times = np.diff(first, append=len(row)).astype(np.uint32)
                yield block(1, np.full(len(first), word == 1), key[first], [(row[first] - base).astype(np.uint16), times], base, own)
                parts.clear()

        for batch in batches:
            row = batch.column("row").to_numpy()
            for first, starts, tokens in _flat(arrow_texts(batch)):
                n, hashes = _words(tokens, *sent_words.value)
                here, length = n >= 0, np.diff(starts, append=len(n))
                sums = lambda x: np.add.reduceat(x, starts)  # noqa: B023, E731
                plain = np.log10(np.where(here, shares[n], 1.0))
                added, places, keys = follow.logs(hashes, starts, nexts[n])
                rows = row[first : first + len(starts)]
                own = pa.StructArray.from_arrays(
                    [batch.column("doc_id").slice(first, len(starts)), batch.column("held_out").slice(first, len(starts)), pa.array(length), pa.array(sums((here & (known[n] > 0)).astype(np.int64))),
                     pa.array(sums(np.where(here, logs[n], 0.0))), pa.array(sums(plain)), pa.array(sums(plain + added))], own_names)
                # The document's own row meets nothing.
                spread = (mixed(rows.astype(np.uint64)) >> np.uint64(64 - bits)).astype(np.int32)
                nothing = pa.nulls(len(rows), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(spread), pa.array(np.full(len(rows), 2, np.int32)), nothing, nothing, nothing, pa.array(rows), own], names)
                if held[0] and (size > FLUSHED or rows[-1] - base >= 1 << 16):
                    yield from asked(own.type)
                    size = 0
                of, rare = np.repeat(rows, length), np.flatnonzero(~here)
                base = base if held[0] else int(rows[0])
                held[0].append((keys.view(np.uint64), of[places]))
                held[1].append((hashes[rare], of[rare]))
                size += len(keys) + len(rare)
        if held[0]:
            yield from asked(own.type)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds up what is answered for a document here. The sums travel packed by groups of documents."""
        held: tuple[list, list] = ([], [])
        size = 0
        out = ["block", "rows", "score", "more", "more_logs", "row", "own"]

        def sums(own: pa.DataType) -> Iterator[pa.RecordBatch]:
            for parts in held:
                if parts:
                    row, *added = (np.concatenate(x) for x in zip(*parts, strict=True))
                    rows, at = np.unique(row, return_inverse=True)
                    blocks, packs = packed(rows >> BLOCK, [(rows & ((1 << BLOCK) - 1)).astype(np.uint16), *(np.bincount(at, x, len(rows)) for x in added)])
                    packs += [pa.nulls(len(blocks), pa.binary())] * (4 - len(packs))
                    yield pa.RecordBatch.from_arrays([pa.array(blocks), *packs, pa.nulls(len(blocks), pa.int64()), pa.nulls(len(blocks), own)], out)
                parts.clear()

        for table, starts in runs(batches, "bucket"):
            side, kind = table.column("side").to_numpy(), table.schema.field("own").type
            alone = table.filter(pa.array(side == 2)).combine_chunks()
            for own in alone.select(["row", "own"]).to_batches():
                nothing = pa.nulls(own.num_rows, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(own.column("row").to_numpy() >> BLOCK), *[nothing] * 4, *own.columns], out)
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                part, own_side = table.slice(a, b - a), side[a:b]
                given, asked = (part.filter(pa.array(own_side == k)) for k in (0, 1))
                if not given.num_rows or not asked.num_rows:
                    continue
                keys, mine = (from_low_bytes(unpacked(x.column("keys"), np.uint8), 7) for x in (given, asked))
                order = np.argsort(keys)
                keys, value = keys[order], unpacked(given.column("first"), np.float64)[order]
                at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
                hit = keys[at] == mine
                at = at[hit]
                each = [len(x) // 7 for x in asked.column("keys").to_pylist()]
                row = (np.repeat(asked.column("row").to_numpy(), each) + unpacked(asked.column("first"), np.uint16))[hit]
                times = unpacked(asked.column("second"), np.uint32)[hit].astype(np.float64)
                if part.column("bucket")[0].as_py() >> bits:
                    c = unpacked(given.column("second"), np.int64)[order]
                    held[1].append((row, times * value[at], times * (c[at] > 0), times * np.log10(c[at] + 1.0)))
                else:
                    held[0].append((row, times * value[at]))
                size += len(row)
                if size > FLUSHED:
                    yield from sums(kind)
                    size = 0
        if size:
            yield from sums(kind)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A document's own row with all that was added up for it."""
        for table, starts in runs(batches, "block"):
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                part = table.slice(a, b - a)
                mine = part.column("row").is_valid()
                given, alone = part.filter(pc.invert(mine)), part.filter(mine).combine_chunks()

                def added(column: str, given: pa.Table) -> np.ndarray:
                    return np.bincount(unpacked(given.column("rows"), np.uint16), unpacked(given.column(column), np.float64), 1 << BLOCK)

                at = alone.column("row").to_numpy() & ((1 << BLOCK) - 1)
                words = given.filter(given.column("more").is_valid())
                score, unigram, more, more_logs = (x[at] for x in (added("score", given), *(added(x, words) for x in ("score", "more", "more_logs"))))
                own = dict(zip(own_names, alone.column("own").combine_chunks().flatten(), strict=True))
                for x, plus in (("known", np.rint(more).astype(np.int64)), ("logs", more_logs), ("unigram", unigram), ("score", score)):
                    own[x] = pc.add(own[x], pa.array(plus))
                yield pa.RecordBatch.from_arrays([own[x] for x in own_names], own_names)

    schema = f"bucket int, side int, keys binary, first binary, second binary, row long, own {own_type}"
    read = named.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
    no_own = F.lit(None).cast(own_type).alias("own")
    said = rare.select(F.xxhash64("word").alias("key"), F.col("word").alias("spelt"), F.lit(0.0).alias("value"), "c", no_own)
    said = said.union(others.select("key", F.lit(None).cast("string"), "value", "c", no_own)).mapInArrow(answers, schema)
    met = read.mapInArrow(scan, schema).union(said).repartition("bucket").sortWithinPartitions("bucket")
    sums = met.mapInArrow(meet, f"block long, rows binary, score binary, more binary, more_logs binary, row long, own {own_type}")
    each = sums.repartition("block").sortWithinPartitions("block").mapInArrow(gather, own_type.removeprefix("struct<").removesuffix(">"))
    base = F.col("logs") - F.col("n_tokens") * F.lit(math.log10(n + v + 1))
    return materialise(each.select("doc_id", "held_out", "n_tokens", F.col("known").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score", F.col("unigram").alias("unigram_score")))
