"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Every rule looks at a share in a text and votes good (1), bad (-1) or abstains (0). The
rules overlap: junk of one kind mostly meets several of them, and a clean text may meet
one (a table has many symbols, a poem repeats lines). Only the counts of vote patterns
leave the cluster (at most 3 ** rules of them, whatever the input's size).
Expectation-maximisation on them estimates, without labels, how often each rule votes
good, bad or abstains on good and on bad documents; nothing but a few pseudo-votes holds
these rates. A document is kept if the posterior probability of good quality is at least
``threshold``, so several good votes can outweigh a bad one.

Nulls: a null text has no words and all counts zero; it fails the base rules.
Empty tables: the rules keep their first rates. Repeated rows are judged alike and all
returned. Columns of the input other than the text are carried unread; those named like
a result column are replaced by it. Repeated words are found by hashes of 64 bits less
those that number the text's words: exact but where hashes of different windows are equal and
lie between equal windows, which at ten million words (40 bits left) is about one window in a
text of a hundred, at 30,000 words practically none.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, put_back, set_apart

SYMBOLS = "[#*$%&|<>]"
PUNCTUATION = r"[^\p{L}\p{M}\p{N}_\s]"
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_punctuation", "n_single", "n_distinct", "n_ended")
ENDS = (".", "!", "?", ":", "\u3002", "\uff01", "\uff1f")
ALL = 1e9


@dataclass(frozen=True)
class Rule:
    """Votes good where a share lies within ``good``, bad where it lies outside ``fair``, and abstains in between or where nothing can be said."""

    name: str
    part: str
    whole: str
    good: tuple[float, float]
    fair: tuple[float, float]

    def vote(self) -> Column:
        share = F.col(self.part) / F.when(F.col(self.whole) > 0, F.col(self.whole))
        return F.when(share.between(*self.good), 1).when(~share.between(*self.fair), -1).otherwise(0).cast("int")


RULES = (
    Rule("symbols", "n_symbols", "n_words", (0, 0.02), (0, 0.10)),
    Rule("punctuation", "n_punctuation", "word_chars", (0, 0.07), (0, 0.10)),
    Rule("single", "n_single", "n_words", (0, 0.10), (0, 0.25)),
    Rule("length", "n_words", "word_chars", (0.155, 0.23), (0.14, 0.235)),
    Rule("repeats", "n_repeat_words", "n_words", (0, 0.10), (0, 0.30)),
    Rule("lines", "n_dup_lines", "n_lines", (0, 0.05), (0, 0.50)),
    Rule("shouting", "n_upper", "word_chars", (0, 0.10), (0, 0.30)),
    Rule("variety", "n_distinct", "n_words", (0.50, ALL), (0.30, ALL)),
    Rule("sentences", "n_ended", "n_lines", (0.90, ALL), (0.50, ALL)),
)
#: Rates of bad votes, abstentions and good votes from which estimation starts, on bad and on good documents.
START = np.array([[0.5, 0.3, 0.2], [0.1, 0.2, 0.7]])
PSEUDO = 2.0


def _each(text: Column, chars: str, by: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(by))
    return text


def _with_repeats(df: DataFrame, words: str, window: int = 3) -> DataFrame:
    """df with _repeats, the number of words that lie in a window of words found twice or more in the text.

    A window becomes one long: its hash above, its position below, in as many bits as
    the text needs (so 49 bits of hash are left for 30,000 words). Sorting these longs
    puts equal windows side by side, whose words are then compared; n log n for any
    text. Each step is a projection of its own, which sorts in generated code.
    """
    w, k, s, p = F.col(words), F.col("_bits"), F.col("_sorted"), F.col("_at")
    low = F.call_function("shiftleft", F.lit(1).cast("long"), k) - 1
    mix = lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(window)])
    packed = lambda i: F.coalesce(F.call_function("shiftleft", mix(i), k).bitwiseOR(i.cast("long")), F.lit(0).cast("long"))
    close = lambda x, y: F.coalesce(F.call_function("shiftrightunsigned", x.bitwiseXOR(y), k) == 0, F.lit(False))

    def same(x: Column, y: Column) -> Column:
        here = lambda z: z.bitwiseAND(low).cast("int")
        out = close(x, y)
        for j in range(window):
            out = out & (F.get(w, here(x) + j) == F.get(w, here(y) + j))
        return out

    near = F.filter(s, lambda x, i: close(x, F.get(s, i + 1)) | close(x, F.get(s, i - 1)))
    twice = F.filter(p, lambda x, i: F.coalesce(same(x, F.get(p, i + 1)), F.lit(False)) | F.coalesce(same(x, F.get(p, i - 1)), F.lit(False)))
    at = F.sort_array(F.transform(twice, lambda x: F.coalesce(x.bitwiseAND(low), F.lit(0).cast("long"))))
    step = lambda i, j: F.least(F.lit(window), F.coalesce(F.get(F.col("_places"), j + 1) - i, F.lit(window)))
    total = F.aggregate(F.transform("_places", step), F.lit(0).cast("long"), lambda acc, x: acc + x)
    df = df.withColumn("_bits", F.coalesce(F.length(F.bin(F.size(w))), F.lit(1)))
    df = df.withColumn("_sorted", F.sort_array(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - window, F.lit(0))), packed)))
    df = df.withColumn("_at", near).drop("_sorted").withColumn("_places", at).drop("_at", "_bits")
    return df.withColumn("_repeats", total).drop("_places")


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns FEATURES (all long), in place of any of these names."""
    inner, names = set_apart(docs)
    t = F.coalesce(F.col(names[text]), F.lit(""))
    names = {own: new for own, new in names.items() if own not in FEATURES}
    count = lambda pattern: F.regexp_count(t, F.lit(pattern))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(" \t\x0b\f\r"))) > 0)
    words = F.array_remove(F.split(_each(t, "\t\n\x0b\f\r", " "), " ", -1), "")
    ended = F.filter("_l", lambda x: F.right(F.rtrim(x, F.lit(" \t\x0b\f\r")), F.lit(1)).isin(*ENDS))
    out = inner.withColumns({"_w": words, "_l": lines, "_found": F.struct(
        F.length(_each(t, " \t\n\x0b\f\r", "")).alias("word_chars"), count(SYMBOLS).alias("n_symbols"),
        count("[A-Z]").alias("n_upper"), count(PUNCTUATION).alias("n_punctuation"))})
    out = _with_repeats(out, "_w")
    named = {"n_words": F.size("_w"), "n_dup_lines": F.size("_l") - F.size(F.array_distinct("_l")), "n_repeat_words": F.col("_repeats"), "n_lines": F.size("_l")}
    named |= {"n_single": F.size(F.filter("_w", lambda x: F.length(x) == 1)), "n_distinct": F.size(F.array_distinct("_w")), "n_ended": F.size(ended)}
    named |= {c: F.col(f"_found.{c}") for c in ("word_chars", "n_symbols", "n_upper", "n_punctuation")}
    return put_back(out, names, *[named[c].cast("long").alias(c) for c in FEATURES])


def expectation_maximisation(patterns: Sequence[tuple[tuple[int, ...], int]], n_rules: int, rounds: int = 100, prior: float = 0.8) -> tuple[float, np.ndarray]:
    """(share of good documents, rates) from counts of vote patterns; rates[q, j, v + 1]: how often rule j votes v on documents of quality q.

    Given the quality, rules vote independently. Estimation starts from rules that are
    better than chance, so good and bad can't change places, and adds PSEUDO votes of
    that kind to each rule, which keeps rare rules finite.
    """
    rates = np.repeat(START[:, None, :], n_rules, axis=1)
    if not sum(c for _, c in patterns):
        return prior, rates
    votes, counts = np.array([v for v, _ in patterns]), np.array([c for _, c in patterns], np.float64)
    for _ in range(rounds):
        good = 1 / (1 + np.exp(-np.clip([log_odds(v, prior, rates) for v in votes], -700, 700)))
        prior = float(np.clip((good * counts).sum() / counts.sum(), 0.02, 0.98))
        for q, share in enumerate((1 - good, good)):
            for v in (-1, 0, 1):
                rates[q, :, v + 1] = PSEUDO * START[q, v + 1] + ((votes == v) * (share * counts)[:, None]).sum(axis=0)
        rates /= rates.sum(axis=2, keepdims=True)
    return prior, rates


def log_odds(votes: Sequence[int], prior: float, rates: np.ndarray) -> float:
    """Of good quality, given one document's votes."""
    return math.log(prior / (1 - prior)) + sum(math.log(rates[1, j, v + 1] / rates[0, j, v + 1]) for j, v in enumerate(votes))


def judge(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, min_words: int = 50, max_repeat_percent: int = 50, threshold: float = 0.5, carry: Sequence[str] | None = None) -> DataFrame:
    """The carried columns (all by default) with FEATURES, vote_<rule>, quality, base_failed and kept.

    base_failed: under min_words words, or repeated words above max_repeat_percent.
    The counted table is written once to the shared folder, so texts are read once.
    """
    new = {*FEATURES, *(f"vote_{r.name}" for r in rules), "quality", "base_failed", "kept"}
    carry = [c for c in (docs.columns if carry is None else carry) if c not in new]
    clear = docs.select(*{*carry, text})
    counted = with_features(clear, text).select(*carry, *FEATURES)
    voted = materialise(counted.withColumns({f"vote_{r.name}": r.vote() for r in rules}))
    names = [f"vote_{r.name}" for r in rules]
    patterns = sorted((tuple(row[:-1]), row[-1]) for row in voted.groupBy(*names).count().collect())
    prior, rates = expectation_maximisation(patterns, len(rules))
    odds = F.lit(math.log(prior / (1 - prior)))
    for name, weight in zip(names, np.log(rates[1] / rates[0]).tolist(), strict=True):
        odds = odds + F.when(F.col(name) > 0, weight[2]).when(F.col(name) < 0, weight[0]).otherwise(weight[1])
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return voted.withColumn("quality", 1 / (1 + F.exp(-odds))).withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("quality") >= threshold))
