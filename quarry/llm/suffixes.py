"""Exact substring dedup by merging the Burrows-Wheeler transforms of shards.

A byte goes if a string of LENGTH bytes that covers it also starts in a document with a
smaller id. Which strings repeat is read from the intervals of a merged suffix order:

1. *Runs.* Each start of a LENGTH-byte string is named by the least hash of its MARK-byte
   strings (its minimizer). Neighbouring starts mostly have one name and form a run. Equal
   strings have equal names, so a run whose name occurs in one document only holds no
   repeat. Names are counted by packed rows; those that recur become a bitmap of 16 MB at
   most, by which the second scan picks its runs. A full bitmap costs time, not results.
2. *Buckets.* A task cuts its texts into blocks of BLOCK bytes. The picked runs of a block,
   each different one once, go to buckets by name: all places of a repeated string meet in
   one bucket. There equal runs of several blocks become one. A name that is left with one
   run shares no string with any other; the others are what has to be compared.
3. *Merge.* They are cut into shards of SHARD bytes, whose Burrows-Wheeler transforms
   (rotations, sorted by doubling) are interleaved by iterative refinement: from the order of
   all suffixes by their first h bytes, a stable pass over the preceding bytes gives the
   order by h + 1. Where the preceding byte or the parent's interval changes, a new interval
   begins, of suffixes whose common prefix is longer than h. No suffix is sorted again across
   shards. An interval of one suffix stays one and leaves. After LENGTH passes the intervals
   are the repeated strings; the least document of each goes back to the blocks.
4. *Cover.* A block turns that into byte spans of its documents.

Hot names: one that occurs HOT times or more (a passage that very many documents quote,
before ever different words) has its runs cut into single strings, which go to buckets
by their own hash, so no bucket grows with a passage's fame.

Defined cases: a null text is empty. A null id comes after all ids, so such a row loses
what it shares with rows that have one. Rows of equal ids, repeated rows among them, never
remove each other's bytes. Texts are UTF-8, in which the byte 255 (the end mark) does not
occur. Long texts are cut into pieces of PIECE bytes that overlap by LENGTH - 1. Ids of any
ordered type do: others than integers are numbered first. Empty tables give no rows. Only
the id and the text are read; other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..operators.blocks import groups, number
from ..sources.scratch import discard
from .common import arrow_texts, bitmap, bits_for, in_bitmap, materialise, mixed, packed, runs

LENGTH, MARK = 50, 20
HOT = 16384
BLOCK, PIECE, CHUNK = 8 << 20, 4 << 20, 1 << 18
#: Longest run of starts, bytes of runs that a bucket is meant to hold, and of a shard.
RUN, BUCKET, SHARD = 64, 2 << 20, 1 << 18
END = 255
LAST = np.iinfo(np.int64).max


# ---------------------------------------------------------------- blocks and runs


class Block(NamedTuple):
    """Pieces of texts end to end: raw bytes, where pieces begin and end, their documents and their first byte there; ord and h by document."""

    raw: bytes
    begin: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    at: np.ndarray
    ord: np.ndarray
    h: np.ndarray


def _blocks(batches: Iterator[pa.RecordBatch], length: int, most: int, reach: int) -> Iterator[Block]:
    """Blocks of ``most`` bytes, of texts cut into pieces of ``reach`` bytes."""
    parts, size, doc, at, ords, hs, total = [], [], [], [], [], [], 0

    def block() -> Block:
        end = np.cumsum(size)
        return Block(b"".join(parts), end - size, end, np.array(doc, np.int64), np.array(at, np.int64), np.array(ords, np.int64), np.array(hs, np.int64))

    for some in (batch.slice(k, 256) for batch in batches for k in range(0, batch.num_rows, 256)):  # few texts at a time are copied
        for order, h, text in zip(some.column("ord").to_pylist(), some.column("h").to_pylist(), arrow_texts(some), strict=True):
            if len(text) < length:
                continue
            first = True
            for start in range(0, len(text) - length + 1, reach):
                if total > most:
                    yield block()
                    parts, size, doc, at, ords, hs, total = [], [], [], [], [], [], 0
                    first = True
                if first:
                    ords.append(order)
                    hs.append(h)
                    first = False
                parts.append(text[start : start + reach + length - 1])
                size.append(len(parts[-1]))
                doc.append(len(ords) - 1)
                at.append(start)
                total += size[-1]
    if parts:
        yield block()


def _words(raw: bytes, start: int, n: int) -> np.ndarray:
    """The 8 bytes that begin at each of n places."""
    return np.ndarray((n,), "<u8", raw, start, (1,))


def _joined(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    h = a * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += b
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h += c
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def mark_hashes(raw: bytes, start: int, n: int) -> np.ndarray:
    """A 64-bit hash of the MARK bytes that begin at each of n places."""
    return _joined(*(_words(raw, start + k, n) for k in (0, 8, MARK - 8)))


def string_hashes(raw: bytes, places: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of the strings of ``length`` bytes that begin at the places."""
    words, out = _words(raw, 0, len(raw) - 7), np.zeros(len(places), np.uint64)
    for k in (*range(0, length - 8, 8), length - 8):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + words[places + k])
    return out


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[: len(x) - done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def _runs(block: Block, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names, first starts, numbers of starts) of the block's runs, none over RUN."""
    names, firsts, counts = [], [], []
    n = len(block.raw) - length + 1
    for c in range(0, n, CHUNK):
        size = min(CHUNK, n - c)
        low = _least(mark_hashes(block.raw, c, size + length - MARK), length - MARK + 1)
        valid = np.zeros(size + 1, np.int32)  # starts whose string ends in its piece
        begin, end = np.clip(block.begin - c, 0, size), np.clip(block.end - length + 1 - c, 0, size)
        some = end > begin
        np.add.at(valid, begin[some], 1)
        np.add.at(valid, end[some], -1)
        valid = np.cumsum(valid[:-1]) > 0
        change = np.ones(size + 1, bool)
        change[1:-1] = (low[1:] != low[:-1]) | (valid[1:] != valid[:-1])
        cut = np.flatnonzero(change)
        first, count = cut[:-1][valid[cut[:-1]]], np.diff(cut)[valid[cut[:-1]]]
        if len(count) and count.max() > RUN:
            k = -(-count // RUN)
            place = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            first, count = np.repeat(first, k) + place * RUN, np.minimum(RUN, np.repeat(count, k) - place * RUN)
        names.append(mixed(low[first]))  # minima crowd at the low end; spread again, they suit buckets and bitmaps
        firsts.append(first + c)
        counts.append(count)
    return (np.concatenate(names), np.concatenate(firsts), np.concatenate(counts)) if names else (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 2)


def _docs_of(block: Block, first: np.ndarray) -> np.ndarray:
    """The piece that each start lies in."""
    return np.searchsorted(block.end, first, "right")


# ---------------------------------------------------------------- which names recur

_NAME, _KEPT = 48, 5
_MANY, _SEVERAL = 32767, 32768


def _count(texts: DataFrame, length: int, block: int, piece: int) -> DataFrame:
    """(value, n) of the names that may recur across documents: top _NAME bits and occurrences. Cutting the hash only lets more names pass."""
    bits = min(20, max(8, (4 * texts.rdd.getNumPartitions()).bit_length()))  # some two million names each where a partition has 128 MB
    rest = np.uint64(_NAME - bits)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts_ in _blocks(batches, length, block, piece):
            name, first, _ = _runs(texts_, length)
            order = np.argsort(name)
            own = texts_.ord[texts_.doc[_docs_of(texts_, first[order])]]
            name = name[order] >> np.uint64(64 - _NAME)
            start = np.flatnonzero(np.append(np.ones(min(1, len(name)), bool), name[1:] != name[:-1]))
            if not len(start):
                continue
            n = np.minimum(np.diff(np.append(start, len(name))), _MANY)
            several = np.minimum.reduceat(own, start) < np.maximum.reduceat(own, start)
            marks = (n + several * _SEVERAL).astype(np.uint16)
            name = name[start]
            low = np.ascontiguousarray(name.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_KEPT])
            bucket, cols = packed((name >> rest).astype(np.int64), [low.view(f"V{_KEPT}").ravel(), marks])
            yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), *cols], ["bucket", "names", "marks"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in runs(batches, "bucket"):
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                part = table.slice(a, b - a)
                raw = np.frombuffer(b"".join(part.column("names").to_pylist()), np.uint8).reshape(-1, _KEPT)
                name = np.zeros((len(raw), 8), np.uint8)
                name[:, :_KEPT] = raw
                name = name.view("<u8").ravel() & ((np.uint64(1) << rest) - np.uint64(1))
                marks = np.frombuffer(b"".join(part.column("marks").to_pylist()), np.uint16)
                order = np.argsort(name)
                name, marks = name[order], marks[order]
                start = np.flatnonzero(np.append(True, name[1:] != name[:-1]))
                blocks = np.diff(np.append(start, len(name)))
                recur = (blocks > 1) | (np.maximum.reduceat(marks, start) >= _SEVERAL)
                n = np.add.reduceat((marks & np.uint16(_MANY)).astype(np.int64), start)[recur]
                value = ((np.uint64(table.column("bucket")[int(a)].as_py()) << rest) | name[start][recur]) << np.uint64(64 - _NAME)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n)], ["value", "n"])

    names = texts.mapInArrow(scan, "bucket int, names binary, marks binary").repartition("bucket")
    return materialise(names.sortWithinPartitions("bucket").mapInArrow(met, "value long, n long"))


# ---------------------------------------------------------------- shards


def transform(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, order) of the Burrows-Wheeler transform of different strings, each with an end mark.

    Rotations are sorted by 8 bytes and then by doubling, for those that are still equal.
    order: the strings in the order of the rotations that begin with their end marks, which come last.
    """
    size = np.fromiter(map(len, strings), np.int64, len(strings)) + 1
    begin = np.cumsum(size) - size
    n = int(size.sum())
    text = np.frombuffer(b"".join(x for s in strings for x in (s, b"\xff")), np.uint8)
    wide = b"".join(x for s in strings for x in (s, b"\xff", ((s + b"\xff") * 8)[:8] if len(s) < 8 else s[:8]))
    string = np.repeat(np.arange(len(strings)), size)
    key = np.ndarray((len(wide) - 7,), ">u8", wide, 0, (1,))[np.arange(n) + 8 * string].astype(np.uint64)
    own, length = begin[string], size[string]
    order = np.argsort(key)
    key = key[order]
    first = np.append(True, key[1:] != key[:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    places = np.arange(n)  # in order, of rotations that are not alone yet
    open_ = ~(first & np.append(first[1:], True))
    places, h = places[open_], 8
    while len(places):
        at = order[places]
        follow = rank[own[at] + (at - own[at] + h) % length[at]]
        pair = rank[at] * n + follow
        again = np.argsort(pair)
        at, pair = at[again], pair[again]
        order[places] = at
        first = np.append(True, pair[1:] != pair[:-1])
        rank[at] = np.maximum.accumulate(np.where(first, places, 0))
        places, h = places[~(first & np.append(first[1:], True))], h * 2
    before = np.where(order == own[order], order + length[order] - 1, order - 1)
    return text[before], string[order[n - len(strings) :]]


_CUT = "block long, bucket int, first int, texts binary, names binary, low binary, sizes binary, frags binary, docs binary, starts binary, ids binary"
_NAMES = [c.split()[0] for c in _CUT.split(", ")]


def _small(raw: bytes | np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw if isinstance(raw, bytes) else raw.tobytes())


def _large(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def _cut(texts: DataFrame, picked: np.ndarray, hot: np.ndarray, bits: int, length: int, block: int, piece: int) -> DataFrame:
    """Rows of two kinds: a block's runs for a bucket, numbered in the block from ``first`` on (texts, names, sizes, least documents there), and a block's places (bucket -1)."""
    sent = texts.sparkSession.sparkContext.broadcast((picked, hot))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, famous = sent.value
        at = TaskContext.get().partitionId() << 32
        for k, texts_ in enumerate(_blocks(batches, length, block, piece)):
            name, first, count = _runs(texts_, length)
            some = in_bitmap(marks, name)
            name, first, count = name[some], first[some], count[some]
            many = in_bitmap(famous, name)
            if many.any():  # single strings, by their own hash
                n = np.where(many, count, 1)
                place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                name, first, count, single = (np.repeat(x, n) for x in (name, first, count, many))
                first, count = first + place, np.where(single, 1, count)
                name[single] = string_hashes(texts_.raw, first[single], length)
            if len(first):
                yield _block_rows(at + k, texts_, name, bits, first, count, length)

    return materialise(texts.mapInArrow(scan, _CUT))


def _block_rows(number_: int, block: Block, name: np.ndarray, bits: int, first: np.ndarray, count: np.ndarray, length: int) -> pa.RecordBatch:
    raw, different = block.raw, {}
    size = count + length - 1
    frag = np.fromiter((different.setdefault(raw[a : a + n], len(different)) for a, n in zip(first.tolist(), size.tolist(), strict=True)), np.int64, len(first))
    piece = _docs_of(block, first)
    doc, start = block.doc[piece], block.at[piece] + first - block.begin[piece]
    strings = list(different)
    lead = np.zeros(len(strings), np.int64)
    lead[frag] = np.arange(len(frag))
    order = np.argsort(name[lead])  # runs are numbered by name, so those of a bucket follow each other
    number_of = np.empty(len(order), np.int32)
    number_of[order] = np.arange(len(order))
    frag = number_of[frag]
    low = np.full(len(strings), LAST)
    np.minimum.at(low, frag, block.ord[doc])
    own, sizes = name[lead[order]], size[lead[order]].astype(np.uint16)
    target = own >> np.uint64(64 - bits)
    rest = (own >> np.uint64(32 - bits)).astype(np.uint32)  # tells the names of a bucket apart; if not, they are compared in vain
    bounds = np.flatnonzero(np.append(True, target[1:] != target[:-1])).tolist()
    rows = []
    for a, b in zip(bounds, [*bounds[1:], len(order)], strict=True):
        texts = b"".join([strings[i] for i in order[a:b].tolist()])
        rows.append((number_, int(target[a]), a, _small(texts), _small(rest[a:b]), _small(low[a:b]), _small(sizes[a:b]), None, None, None, None))
    ids = np.column_stack((block.ord, block.h))
    rows.append((number_, -1, 0, None, None, *map(_small, (low, sizes, frag, doc.astype(np.int32), start, ids))))
    types = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 8]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], _NAMES)


# ---------------------------------------------------------------- merge


def back_steps(bwt: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each row of transforms that lie end to end, the row of the rotation that begins one byte before, in the same transform."""
    shard = np.repeat(np.arange(len(sizes)), sizes)
    counts = np.bincount(shard * 256 + bwt, minlength=256 * len(sizes)).reshape(-1, 256)
    base = np.cumsum(sizes) - sizes
    inside = base[:, None] + np.cumsum(counts, axis=1) - counts  # where a byte's rows begin in its shard
    by_byte = counts.T.ravel()
    adjust = inside.T.ravel() - (np.cumsum(by_byte) - by_byte)
    order = np.argsort(bwt, kind="stable")
    out = np.empty(len(bwt), np.int32)
    out[order] = np.arange(len(bwt)) + np.repeat(adjust, by_byte)
    return out


def intervals(bwt: np.ndarray, back: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, interval starts) of the suffixes whose first ``depth`` bytes, without an end mark, are those of another, side by side.

    The interleave is refined byte by byte: equal preceding bytes of one interval make an interval of longer strings.
    """
    at, parent = np.arange(len(bwt), dtype=np.int32), np.zeros(len(bwt), np.int32)
    for _ in range(depth):
        before = bwt[at]
        order = np.argsort(before, kind="stable")[: np.count_nonzero(before != END)]
        if not len(order):
            return at[:0], at[:0]
        before, parent = before[order], parent[order]
        new = np.append(True, (before[1:] != before[:-1]) | (parent[1:] != parent[:-1]))
        some = ~(new & np.append(new[1:], True))
        at, parent = back[at[order[some]]], np.cumsum(new, dtype=np.int32)[some]
    return at, np.flatnonzero(np.append(np.ones(min(1, len(at)), bool), parent[1:] != parent[:-1]))


def _strings(bwt: np.ndarray, back: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset) of each row; strings are numbered through all shards in the order of their end marks' rows."""
    shard = np.repeat(np.arange(len(sizes)), sizes)
    k = np.bincount(shard[bwt == END], minlength=len(sizes))
    first = np.cumsum(sizes) - k
    number_ = np.arange(k.sum())
    row = np.repeat(first - (np.cumsum(k) - k), k) + number_
    string, left, length = np.empty(len(bwt), np.int32), np.empty(len(bwt), np.int32), np.zeros(len(number_), np.int32)
    string[row], left[row], step = number_, 0, 0
    while len(number_):
        row, step = back[row], step + 1
        string[row], left[row] = number_, step
        begins = bwt[row] == END
        length[number_[begins]] = step
        row, number_ = row[~begins], number_[~begins]
    return string, length[string] - left


_FOUND = np.dtype([("frag", "<i4"), ("first", "u1"), ("last", "u1"), ("low", "<i8")])


def shared(strings: list[bytes], least: np.ndarray, depth: int, shard: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, offset, document) where different strings have ``depth`` bytes that another has in a document less than their own least."""
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    part = np.cumsum(size) // shard
    cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist()
    built = [(a, transform(strings[a:b])) for a, b in zip(cuts, [*cuts[1:], len(strings)], strict=True)]
    bwt, sizes = np.concatenate([t for _, (t, _) in built]), np.array([len(t) for _, (t, _) in built])
    named = np.concatenate([a + order for a, (_, order) in built])
    back = back_steps(bwt, sizes)
    rows, start = intervals(bwt, back, depth)
    if not len(rows):
        return rows, rows, least[:0]
    string, offset = _strings(bwt, back, sizes)
    own, offset = named[string[rows]], offset[rows]
    low = np.repeat(np.minimum.reduceat(least[own], start), np.diff(np.append(start, len(rows))))
    less = low < least[own]
    return own[less], offset[less], low[less]


def merged(rows: list[dict], depth: int, shard: int = SHARD) -> tuple[np.ndarray, np.ndarray]:
    """(blocks, found) of a bucket's rows: stretches of a block's runs whose strings occur in a document less than any that has the run there."""
    different: dict[bytes, int] = {}
    contents, blocks, frags = [], [], []
    get = lambda c, kind: np.frombuffer(b"".join(_large(r[c]) for r in rows), kind)
    for r in rows:
        at, texts, sizes = 0, _large(r["texts"]), np.frombuffer(_large(r["sizes"]), np.uint16)
        for n in sizes.tolist():
            contents.append(different.setdefault(texts[at : at + n], len(different)))
            at += n
        blocks.append(np.full(len(sizes), r["block"]))
        frags.append(np.arange(len(sizes)) + r["first"])
    low, size, name, block, frag = get("low", np.int64), get("sizes", np.uint16), get("names", np.uint32), np.concatenate(blocks), np.concatenate(frags)
    content, strings = np.array(contents), list(different)
    least, own = np.full(len(strings), LAST), np.zeros(len(strings), np.uint32)
    np.minimum.at(least, content, low)
    own[content] = name
    whole = np.flatnonzero(least[content] < low)
    out = [np.zeros(len(whole), _FOUND)]
    out[0]["frag"], out[0]["last"], out[0]["low"] = frag[whole], size[whole] - depth, least[content[whole]]
    at = [block[whole]]

    order = np.argsort(own, kind="stable")
    first = np.flatnonzero(np.append(True, own[order][1:] != own[order][:-1]))
    n = np.diff(np.append(first, len(order)))
    some, group = order[np.repeat(n > 1, n)], np.repeat(np.arange(len(n)), n)[np.repeat(n > 1, n)]
    if len(some):
        # Only runs of one name share strings, so a few names are compared at a time.
        sizes = np.array([len(strings[i]) for i in some.tolist()])
        begins = np.append(True, group[1:] != group[:-1])
        part = np.maximum.accumulate(np.where(begins, (np.cumsum(sizes) - sizes) // (4 * shard), 0))
        cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist()
        met = []
        for a, b in zip(cuts, [*cuts[1:], len(some)], strict=True):
            string, offset, low_ = shared([strings[i] for i in some[a:b].tolist()], least[some[a:b]], depth, shard)
            met.append((string + a, offset, low_))
        string, offset, low_ = (np.concatenate(x) for x in zip(*met, strict=True))
        order = np.lexsort((offset, string))
        string, offset, low_ = some[string[order]], offset[order], low_[order]
        new = np.flatnonzero(np.append(np.ones(min(1, len(string)), bool), (string[1:] != string[:-1]) | (offset[1:] != offset[:-1] + 1) | (low_[1:] != low_[:-1])))
        end = offset[np.append(new[1:], len(string)) - 1] if len(new) else offset
        held = np.argsort(content, kind="stable")  # every block's copy of the run
        left, right = np.searchsorted(content[held], string[new], "left"), np.searchsorted(content[held], string[new], "right")
        which = np.repeat(np.arange(len(new)), right - left)
        place = held[np.arange(len(which)) - np.repeat(np.cumsum(right - left) - (right - left), right - left) + left[which]]
        more = np.zeros(len(which), _FOUND)
        more["frag"], more["first"], more["last"], more["low"] = frag[place], offset[new][which], end[which], low_[new][which]
        keep = more["low"] < low[place]
        out.append(more[keep])
        at.append(block[place[keep]])
    return np.concatenate(at), np.concatenate(out)


def _merge(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["bucket"]):
            block, found = merged(table.to_pylist(), depth)
            order = np.argsort(block, kind="stable")
            blocks, cols = packed(block[order], [found[order]])
            yield pa.RecordBatch.from_arrays([pa.array(blocks), *cols], ["block", "found"])

    return run


# ---------------------------------------------------------------- cover


def union(doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of documents, in order; those that overlap or touch become one."""
    order = np.lexsort((begin, doc))
    doc, begin, end = doc[order], begin[order], end[order]
    if not len(doc):
        return doc, begin, end
    wide = np.int64(max(end.max(), 1)) + 1
    reach = np.maximum.accumulate(doc * wide + end)
    first = np.flatnonzero(np.append(True, (doc * wide + begin)[1:] > reach[:-1]))
    return doc[first], begin[first], reach[np.append(first[1:], len(doc)) - 1] - doc[first] * wide


def _cover(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["block"]):
            rows = table.to_pylist()
            found = np.frombuffer(b"".join(r["found"] for r in rows if r["found"]), _FOUND)
            own = next(r for r in rows if r["frags"] is not None)
            get = lambda c, kind, own=own: np.frombuffer(_large(own[c]), kind)
            frag, low, doc, start, size, ids = get("frags", np.int32), get("low", np.int64), get("docs", np.int32), get("starts", np.int64), get("sizes", np.uint16), get("ids", np.int64).reshape(-1, 2)
            order = np.argsort(frag, kind="stable")
            frag, doc, start = frag[order], doc[order].astype(np.int64), start[order]
            order_of = ids[doc, 0]
            later = order_of > low[frag]  # whole runs that the block itself has in a lesser document
            spans = [(doc[later], start[later], start[later] + size[frag[later]])]
            left, right = np.searchsorted(frag, found["frag"], "left"), np.searchsorted(frag, found["frag"], "right")
            which = np.repeat(np.arange(len(found)), right - left)
            place = np.arange(len(which)) - np.repeat(np.cumsum(right - left) - (right - left), right - left) + left[which]
            hit = (order_of[place] > found["low"][which]) & ~later[place]
            which, place = which[hit], place[hit]
            spans.append((doc[place], start[place] + found["first"][which], start[place] + found["last"][which] + length))
            d, s, e = union(*(np.concatenate(x) for x in zip(*spans, strict=True)))
            docs, cols = packed(d, [np.column_stack((s, e)).astype(np.int64).view("V16").ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(ids[docs, 0]), pa.array(ids[docs, 1]), *cols], ["ord", "h", "spans"])

    return run


# ---------------------------------------------------------------- the operator


def _ordered(docs: DataFrame, text: str, id_column: str) -> DataFrame:
    """(id, ord, h, text): ord orders the ids, null last."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    if isinstance(rows.schema["id"].dataType, IntegralType):
        place = F.col("id").cast("long")
    else:
        ids = materialise(number(rows.select("id").where("id IS NOT NULL").distinct(), "id"))
        rows, place = rows.join(ids, "id", "left"), F.col("n")
    return rows.select("id", F.coalesce(place, F.lit(int(LAST))).alias("ord"), F.xxhash64("text").alias("h"), "text")


def repeats(docs: DataFrame, text: str = "text", id_column: str = "doc_id", length: int = LENGTH, hot: int = HOT, block: int = BLOCK, piece: int = PIECE) -> DataFrame:
    """(id, text, spans): every row of docs, with lists of the byte spans that go, as pairs of longs in bytes (null: none)."""
    texts = _ordered(docs, text, id_column)
    scan = texts.select("ord", "h", "text")
    names = _count(scan, length, block, piece)
    n, most = names.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits = min(20, max(4, (most * (length + (length - MARK) // 2) // BUCKET).bit_length()))
    famous = names.where(F.col("n") >= hot)
    cut = _cut(scan, bitmap(names, bits_for(n, 32)), bitmap(famous, bits_for(famous.count())), bits, length, block, piece)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(parts, min(1 << bits, 8 * parts))  # small partitions, since a task's rows go to Python at once
    shards = cut.where("bucket >= 0").drop("frags", "docs", "starts", "ids").repartition(parts, "bucket").sortWithinPartitions("bucket")
    found = shards.mapInArrow(_merge(length), "block long, found binary")
    places = cut.where("bucket < 0").drop("bucket", "first", "texts", "names")
    both = places.withColumn("found", F.lit(None).cast("binary")).unionByName(found, allowMissingColumns=True)
    spans = both.repartition("block").sortWithinPartitions("block").mapInArrow(_cover(length), "ord long, h long, spans binary")
    spans = materialise(spans.groupBy("ord", "h").agg(F.collect_set("spans").alias("spans")))
    discard(cut)
    return texts.join(spans, ["ord", "h"], "left").select("id", "text", "spans")


def spans_of(packed_spans: list[bytes] | None) -> np.ndarray:
    """(begin, end) rows of a document's lists of spans, merged."""
    s = np.frombuffer(b"".join(packed_spans or ()), np.int64).reshape(-1, 2)
    _, begin, end = union(np.zeros(len(s), np.int64), s[:, 0], s[:, 1])
    return np.column_stack((begin, end))


def deduplicate(docs: DataFrame, text: str = "text", id_column: str = "doc_id", length: int = LENGTH, hot: int = HOT, block: int = BLOCK, piece: int = PIECE) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept) of every row: spans are [begin, end) bytes, kept is what is left of the text, as bytes."""
    return _results(repeats(docs, text, id_column, length, hot, block, piece), id_column, True)


def digest(docs: DataFrame, text: str = "text", id_column: str = "doc_id", length: int = LENGTH, hot: int = HOT, block: int = BLOCK, piece: int = PIECE) -> DataFrame:
    """``deduplicate`` without spans and texts."""
    return _results(repeats(docs, text, id_column, length, hot, block, piece), id_column, False)


def _results(rows: DataFrame, id_column: str, texts: bool) -> DataFrame:
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):
            cols: list[list] = [[] for _ in range(6)]
            for raw, own in zip(arrow_texts(batch), batch.column("spans").to_pylist(), strict=True):
                spans = spans_of(own).tolist()
                kept, at = [], 0
                for a, b in spans:
                    kept.append(raw[at:a])
                    at = b
                kept = b"".join((*kept, raw[at:])) if spans else raw
                row = (len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), spans if texts else None, kept if texts else None)
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())), pa.binary()]
            arrays = [batch.column("id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    out = rows.mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<bigint>>, kept binary")
    out = out.withColumnRenamed("id", id_column)
    return out if texts else out.drop("spans", "kept")
