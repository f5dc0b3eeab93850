"""The divergence audit against plain sums over all terms."""

import collections
import re

import pytest
from pyspark.sql import functions as F

from quarry.llm import divergence
from tests.llm.test_operators import SCHEMA, SF, odd_rows, rows_of

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_audit(rows, least=3, top=200):
    """{(lang, source, part, item): (value, rank)} of (text, lang, source) rows."""
    counts, holders, langs = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), collections.defaultdict(set)
    for text, lang, source in rows:
        own = [t.translate(LOWER) for t in TERM.findall(text or "")]
        counts[lang or "", source or ""].update(own)
        holders[lang or ""].update(set(own))
        langs[lang or ""].add(source or "")
    out = {}
    for lang, sources in langs.items():
        kept = [t for t, n in holders[lang].items() if n >= least]
        count = {s: {t: counts[lang, s][t] for t in kept} for s in sources}
        count[None] = {t: sum(count[s][t] for s in sources) for t in kept}
        share = {s: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept} for s, c in count.items()}
        cost = lambda p, q: (p - q) ** 2 // q
        for s in sources:
            pair = [(sum(cost(share[s][t], share[o][t]) for t in kept), o) for o in sources if o != s]
            term = [(cost(share[s][t], share[None][t]), t) for t in kept if count[s][t] and share[s][t] > share[None][t]]
            for part, items, most in (("pair", pair, None), ("term", term, top)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
                out |= {(lang, s, part, item): (value, k + 1) for k, (value, item) in enumerate(ranked)}
    return out


def as_dict(df):
    rows = rows_of(df)
    out = {(r["lang"], r["source"], r["part"], r["item"]): (r["value"], r["rank"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_audit_of_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert as_dict(divergence.audit(docs)) == plain_audit([(r["text"], r["lang"], r["source"]) for r in rows_of(docs)])


def test_audit_of_odd_rows(spark):
    """Null columns, repeated rows, empty and long texts, letters beyond ASCII, ties, clashing columns."""
    rows = odd_rows() + [(90, "Ünï ünï QUIZ quiz2quiz", None, None, 1), (91, "ünï QUIZ Q-U", None, "", 1), (92, "ünï ﬁn fin QUIZ", None, "z", 1), (93, None, "xx", "z", 1), (94, "12 34", "xx", "y", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("term", "n", "p", "q", "p0", "v", "item", "rank", "a", "b", "m", "x", "df", "first", "total", "part")})
    got = as_dict(divergence.audit(docs, top=5))
    assert got == plain_audit([(t, lang, s) for _, t, lang, s, _ in rows], top=5)
    assert got["xx", "z", "pair", "y"] == (0, 1) and ("", "z", "pair", "") in got


def test_audit_of_nothing(spark):
    assert not rows_of(divergence.audit(spark.createDataFrame([], SCHEMA)))


def test_counts_beyond_longs(spark):
    """SCALE times a count passes 64 bits; shares stay exact."""
    n = 10**13
    row = spark.range(1).select(divergence.share(F.lit(n), F.lit(3 * n), F.lit(7)).alias("p"))
    assert row.first()["p"] == 1 + 10**9 * (n + 1) // (3 * n + 7)


@pytest.mark.parametrize("piece", [1, 7, 1 << 20])
def test_terms_in_pieces(monkeypatch, piece):
    monkeypatch.setattr(divergence, "PIECE", piece)
    text = "Über Straße, naïve-café 3rd x1y\n日本 ends"
    assert [t.decode() for some in divergence.terms(text.encode()) for t in some] == [t.translate(LOWER) for t in TERM.findall(text)]
