"""What a token is: counters that chunking takes as a parameter."""

from __future__ import annotations

import base64
import heapq

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import TOKEN, token_count

#: How byte-pair vocabularies of this family cut a text before merging (a fixed value of the format).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Different pieces that a task remembers at once; forgetting costs time only.
REMEMBERED = 200_000


class Words:
    """Words and single punctuation marks."""

    def counted(self, texts: DataFrame) -> DataFrame:
        """texts (text, ...) with n_tokens."""
        return texts.withColumn("n_tokens", token_count(F.col("text")))

    def windows(self, text: str, size: int, overlap: int) -> list[str]:
        """A long text in windows of ``size`` tokens; what stands between tokens stays as it is."""
        at = [m.span() for m in regex.finditer(TOKEN, text)]
        starts = range(0, max(1, len(at) - overlap), size - overlap)
        return [text[at[s][0] : at[min(s + size, len(at)) - 1][1]] for s in starts]


def merges(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The tokens of a piece: of neighbours whose joint bytes have a rank, those of the lowest join first, the left one of equals."""
    if piece in ranks:
        return [piece]
    n = len(piece)
    end = list(range(1, n + 1))  # where the token that begins here ends; 0: none begins here
    last = list(range(-1, n - 1))  # where the token before it begins
    rank = lambda a: ranks.get(piece[a : end[end[a]]]) if end[a] < n else None
    heap = [(r, a, a + 2) for a in range(n - 1) if (r := rank(a)) is not None]
    heapq.heapify(heap)
    while heap:
        _, a, b = heapq.heappop(heap)
        if not end[a] or end[a] >= n or end[end[a]] != b:  # one of the two has changed since
            continue
        gone = end[a]
        end[a], end[gone] = b, 0
        if b < n:
            last[b] = a
        for c in (last[a], a):
            if c >= 0 and end[c] < n and (r := rank(c)) is not None:
                heapq.heappush(heap, (r, c, end[end[c]]))
    return [piece[a : end[a]] for a in range(n) if end[a]]


class BytePairs:
    """Tokens of a byte-pair vocabulary: a file of base64 tokens and their ranks, read once on the driver.

    A text is cut by the pattern; each different piece is merged once a task, since words repeat.
    """

    def __init__(self, path: str, pattern: str = PATTERN):
        self.pattern = pattern
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}

    def tokens(self, text: str) -> list[bytes]:
        return [t for p in regex.findall(self.pattern, text) for t in merges(p.encode(), self.ranks)]

    def counted(self, texts: DataFrame) -> DataFrame:
        """texts (text, ...) with n_tokens; a null text has none."""
        sent, pattern = texts.sparkSession.sparkContext.broadcast(self.ranks), self.pattern  # some 4 MB, whatever the data

        def count(batches):
            known: dict[str, int] = {}
            cut = regex.compile(pattern)
            for batch in batches:
                out = []
                for text in batch:
                    n = 0
                    for p in cut.findall(text or ""):
                        k = known.get(p)
                        if k is None:
                            if len(known) >= REMEMBERED:
                                known.clear()
                            k = known[p] = len(merges(p.encode(), sent.value))
                        n += k
                    out.append(n)
                yield pd.Series(out, dtype="int64")

        return texts.withColumn("n_tokens", F.pandas_udf(count, "long", F.PandasUDFType.SCALAR_ITER)("text"))

    def windows(self, text: str, size: int, overlap: int) -> list[str]:
        """A long text in windows of ``size`` tokens; a character cut between two shows as a replacement mark in both."""
        t = self.tokens(text)
        return [b"".join(t[s : s + size]).decode("utf-8", "replace") for s in range(0, max(1, len(t) - overlap), size - overlap)]
