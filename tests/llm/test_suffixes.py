"""Merged transforms against plainly sorted rotations, and whole results against plain byte strings."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import suffixes
from tests.llm.test_operators import SCHEMA, odd_rows, rows_of


def plain_dedup(rows, length=50):
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept) of (id, text) rows; a null id comes last."""
    first, out = {}, []
    place = lambda i: float("inf") if i is None else i
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            first[s] = min(place(i), first.get(s, place(i)))
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < place(i):
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), bytes(gone).replace(b"\0", b" ").split().__len__(), hashlib.sha256(kept).hexdigest(), kept))
    return out


def in_order(rows):
    return sorted(map(repr, rows))


def test_transforms_and_intervals():
    rng = random.Random(1)
    for _ in range(120):
        depth, shards = rng.choice([2, 3, 5, 8]), []
        for _ in range(rng.randint(1, 4)):
            shards.append(list({bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 20))) for _ in range(rng.randint(1, 8))}))
        built = [suffixes.transform(s) for s in shards]
        for strings, (bwt, order) in zip(shards, built, strict=True):
            marked = [s + b"\xff" for s in strings]
            rotations = sorted(((m[i:] + m[:i]) * 60, m[i - 1], j, i) for j, m in enumerate(marked) for i in range(len(m)))
            assert bwt.tolist() == [r[1] for r in rotations] and order.tolist() == [j for _, _, j, i in rotations if i == len(strings[j])]
        bwt, sizes = np.concatenate([b for b, _ in built]), np.array([len(b) for b, _ in built])
        back = suffixes.back_steps(bwt, sizes)
        rows, start = suffixes.intervals(bwt, back, depth)
        string, offset = suffixes._strings(bwt, back, sizes)
        names = [(a, j) for a, (_, order) in enumerate(built) for j in order.tolist()]
        got = [frozenset((*names[string[r]], int(offset[r])) for r in some) for some in np.split(rows, start[1:]) if len(some)]
        want = {}
        for a, strings in enumerate(shards):
            for j, s in enumerate(strings):
                for i in range(len(s) - depth + 1):
                    want.setdefault(s[i : i + depth], set()).add((a, j, i))
        want = [frozenset(v) for v in want.values() if len(v) > 1]
        assert len(got) == len(want) and set(got) == set(want)


def passages():
    """Passages in other contexts, near copies, overlapping repeats, runs of one letter, texts around 50 bytes, equal and null ids."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    quote, long = text(20), text(900)
    rows = [(k, f"{text(rng.randint(0, 30))} {quote} {text(rng.randint(0, 30))}") for k in range(100, 140)]
    rows += [(40, long), (41, long[:1500] + "X" + long[1500:]), (42, long[200:900] + text(50) + long[850:2000]), (39, long[3000:3100])]
    rows += [(50, "a" * 49), (51, "a" * 50), (52, "a" * 51), (53, "a" * 300), (54, "b" + "a" * 120 + "c"), (55, "\0" * 80), (56, "x\0" * 60), (57, "\0" * 60)]
    rows += [(60, quote), (60, quote), (61, "é" * 40), (62, "日本" * 20), (63, "é" * 41), (None, quote), (None, long), (-5, long[1000:1400])]
    return rows


@pytest.mark.parametrize("hot, block, piece", [(4096, 16 << 20, 4 << 20), (2, 3000, 1000), (3, 1 << 20, 130)])
def test_whole_results(spark, hot, block, piece):
    """Also with hot names, small blocks and cut texts."""
    rows = passages() + [(i, t) for i, t, *_ in odd_rows() if i != 9]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA).repartition(3, "doc_id", F.rand(1))
    docs = docs.withColumns({c: F.lit("x") for c in ("ord", "h", "id", "spans", "kept", "n", "bucket", "block", "n_bytes", "low")})
    got = suffixes.deduplicate(docs, hot=hot, block=block, piece=piece).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans").collect()
    want = plain_dedup(rows)
    assert sum(r[2] for r in want) > 3000
    assert in_order((*r[:5], bytes(r[5])) for r in got) == in_order(want)
    assert all(sum(b - a for a, b in r["spans"]) == r["n_removed"] and len(r["spans"]) == r["n_spans"] for r in got)


@pytest.mark.parametrize("shard", [1, 200, 1 << 20])
def test_strings_shared_across_shards(shard):
    """However strings fall to shards, the least document of each shared stretch comes out."""
    rng = random.Random(shard)
    strings = list({bytes(rng.choice(b"abc") for _ in range(rng.randint(6, 40))) for _ in range(80)})
    least = np.array([rng.randint(0, 40) for _ in strings])
    low = {}
    for s, d in zip(strings, least.tolist(), strict=True):
        for i in range(len(s) - 5):
            low[s[i : i + 6]] = min(d, low.get(s[i : i + 6], d))
    want = {(j, i, low[s[i : i + 6]]) for j, s in enumerate(strings) for i in range(len(s) - 5) if low[s[i : i + 6]] < least[j]}
    got = list(zip(*(x.tolist() for x in suffixes.shared(strings, least, 6, shard)), strict=True))
    assert set(got) == want and len(got) == len(want)


def test_text_ids(spark):
    """Ids are ordered as text; their type stays."""
    quote = "the same sixty bytes or so of text in each of the three documents here"
    docs = spark.createDataFrame([("b", quote), ("a", "x " + quote), ("c", quote + " y"), (None, quote)], "name string, body string")
    got = {r["name"]: r["n_removed"] for r in rows_of(suffixes.digest(docs, "body", "name"))}
    assert got == {"a": 0, "b": len(quote), "c": len(quote), None: len(quote)}


def test_nothing(spark):
    assert not rows_of(suffixes.digest(spark.createDataFrame([], SCHEMA)))
    nulls = rows_of(suffixes.digest(spark.createDataFrame([(1, None, None, None, None), (None, "", None, None, None)], SCHEMA)))
    assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"]) for r in nulls) == [(0, 0, 0)] * 2
