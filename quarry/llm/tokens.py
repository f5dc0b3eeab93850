"""Token counts by a Viterbi search that keeps no pieces: an Aho-Corasick automaton finds them, a DP counts them.

The vocabulary is a list of (piece, score) as a unigram tokenizer has it. A text is
cut at Unicode white space and each word gets the word mark in front; the automaton
lists all vocabulary pieces in the word by their ends, and for each position the DP
carries the best score, the number of pieces on the best path and whether its last
piece is unknown. Exact rules of the tokenizer that ``reference`` builds:

- scores add up as doubles from the left;
- at equal scores the path whose last piece starts first (the longest) stays;
- a character that no piece of one character covers can be an unknown piece, which
  costs the lowest score less 10; neighbouring unknown pieces fuse into one, or count
  their UTF-8 bytes if the vocabulary has all 256 byte pieces.

Vocabularies come from files of public tokenizers, whose path is a parameter; nothing
is trained. A byte-pair file holds ranks in place of scores; pieces then get the logarithm
of Zipf's law at their rank, which is a distribution, as a unigram search needs. Nulls: a null text has no tokens. Empty tables give empty results, repeated
rows are counted one by one, words of any length take time in proportion.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "\u2581"
UNKNOWN_PENALTY = 10.0
#: Unicode White_Space, as the tokenizer cuts.
WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
CACHE = 200_000
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


@cache
def vocabulary(path: str) -> tuple[tuple[str, float], ...]:
    """(piece, score) of a SentencePiece file, in order of ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [(model.id_to_piece(k), model.get_score(k)) for k in range(model.get_piece_size())]
    ranks = [-s for _, s in pieces]
    if all(r == int(r) >= 0 for r in ranks):  # minus ranks: no logarithms of probabilities
        total = math.log(sum(1 / (r + 2) for r in ranks))
        pieces = [(p, -math.log(r + 2) - total) for (p, _), r in zip(pieces, ranks, strict=True)]
    return tuple(pieces)


def has_bytes(pieces: tuple[tuple[str, float], ...]) -> bool:
    return {f"<0x{k:02X}>" for k in range(256)} <= {p for p, _ in pieces}


def reference(pieces: tuple[tuple[str, float], ...], unknown: int = 0):
    """The tokenizer whose counts these are."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.Unigram([*pieces], unk_id=unknown, byte_fallback=has_bytes(pieces)))
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace(replacement=MARK, prepend_scheme="always")])
    return t


class Counter:
    """Counts tokens of words; keeps the counts of the last CACHE different words at most."""

    def __init__(self, pieces: tuple[tuple[str, float], ...]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.bytes = has_bytes(pieces)
        self.known: dict[str, tuple[int, float]] = {}

    def word(self, word: str) -> tuple[int, float]:
        """(tokens, score) of a word with its mark."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[word] = found = self._search(word)
        return found

    def _search(self, word: str) -> tuple[int, float]:
        n = len(word)
        score, count, loose = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        ending: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(word):
            ending[end].append(match)
        for end in range(1, n + 1):
            best, start, unknown, single = None, 0, False, False
            for length, s in sorted(ending[end - 1], reverse=True):  # from the first start on
                single |= length == 1
                if best is None or score[end - length] + s > best:
                    best, start = score[end - length] + s, end - length
            if not single and (best is None or score[end - 1] + self.unknown > best):
                best, start, unknown = score[end - 1] + self.unknown, end - 1, True
            score[end], loose[end] = best, unknown
            if unknown and self.bytes:
                count[end] = count[start] + len(word[start].encode("utf-8", "replace"))
            else:
                count[end] = count[start] + (not (unknown and loose[start] and start))
        return count[n], score[n]

    def text(self, text: str) -> tuple[int, float]:
        tokens, total = 0, 0.0
        for w in WHITE.split(text):
            if w:
                for part in _marked(w):
                    n, s = self.word(part)
                    tokens += n
                    total += s
        return tokens, total


def _marked(word: str) -> list[str]:
    """The word with its mark; a mark inside it starts a new word."""
    word = word if word.startswith(MARK) else MARK + word
    return [word] if MARK not in word[1:] else [MARK + x for x in word[1:].split(MARK)]


_counters: dict[str, Counter] = {}


def count(docs: DataFrame, path: str = VOCABULARY, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns with n_tokens (long) and token_score (double, the best path's). No shuffle.

    The path must be readable on the executors, as tokenizer files are in a library there.
    """
    chosen = docs.select(*carry, F.col(text).alias("_text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _counters:
            _counters[path] = Counter(vocabulary(path))
        counter = _counters[path]
        for batch in batches:
            found = [counter.text(x or "") for x in batch.column("_text").to_pylist()]
            cols = [*(batch.column(c) for c in carry), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, [*carry, "n_tokens", "token_score"])

    return chosen.mapInArrow(counted, chosen.drop("_text").schema.add("n_tokens", "long").add("token_score", "double"))
