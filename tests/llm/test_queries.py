"""Every registered query of quarry.llm as registered, its SQL twins, and the pipeline beside a plain one."""

import collections
import glob
import hashlib
import math
import os
import zlib

import duckdb
import pytest

import corpus_pipeline
from quarry.llm import mixing, quality, queries
from tests.llm.test_operators import SF, plain_components, plain_features, plain_fingerprint, plain_targets, plain_vote, rows_of, shingles
from tests.llm.test_suffixes import plain_dedup

COLUMNS = {
    "op1_decontamination": {"doc_id", "item_id", "containment"}, "op2_mixing": {"doc_id", "size", "source_size", "target", "taken", "first_slot", "n_blocks"}, "op3_sharding": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    "op4_token_counts": {"doc_id", "n_tokens"}, "op5_url_filters": {"page_id", "host", "path", "rule", "verdict"}, "op6_chat_formatting": {"conv_id", "chunk", "rendered"},
    "op7_quality_rules": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"}, "op8_lm_scoring": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op9_simhash": {"doc_id", "fingerprint", "component_id"}, "op10_substring_dedup": {"doc_id", "first_word", "n_words", "removed"},
    "op11_suffix_dedup": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"}, "op12_divergence": {"lang", "source", "part", "item", "value", "rank"},
    "op13_hard_negatives": {"anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"},
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_runs_over_its_table(spark, name):
    got = queries.QUERIES[name](spark, SF)
    assert set(got.columns) >= COLUMNS[name]
    rows = rows_of(got)
    if name not in ("op1_decontamination", "op10_substring_dedup", "op12_divergence", "op13_hard_negatives"):
        table, key = {"op5_url_filters": ("pages", "page_id"), "op6_chat_formatting": ("conversations", "conv_id")}.get(name, ("documents", "doc_id"))
        assert {r[key] for r in rows} == {r[key] for r in rows_of(spark.read.parquet(f"{SF}/{table}.parquet").select(key))}
    else:
        assert rows


def test_suffix_query(spark):
    """The registered query against plain byte strings over the whole table."""
    docs = [(r["doc_id"], r["text"]) for r in rows_of(spark.read.parquet(f"{SF}/documents.parquet"))]
    got = [tuple(r) for r in queries.QUERIES["op11_suffix_dedup"](spark, SF).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert sorted(got) == sorted(r[:5] for r in plain_dedup(docs)) and sum(r[2] for r in got) > 0


def test_sharding_query(spark):
    rows = rows_of(queries.QUERIES["op3_sharding"](spark, SF))
    counts = collections.Counter(r["shard"] for r in rows)
    assert set(counts) == set(range(40)) and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n)) for s, n in counts.items())
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in rows_of(spark.read.parquet(f"{SF}/documents.parquet"))}
    assert all(r["size"] == len(texts[r["doc_id"]]) + 16 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]]) and r["law"] == "rows" and r["grown_shard"] is None for r in rows)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_twin(spark, name):
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), c.execute(queries.SQL[name]).df()
    cols = sorted(got.columns)
    rows = lambda df: sorted(map(repr, df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False, name=None)))
    assert cols == sorted(want.columns) and rows(got) == rows(want)


# ---------------------------------------------------------------- the pipeline, plainly


def plain_copies(docs):
    """How often the mix takes each document: in the order of hashed ids, as long as their first word lies under the target."""
    size = {k: plain_features(d["text"])[0] for k, d in enumerate(docs)}
    per = collections.Counter()
    for k, d in enumerate(docs):
        per[d["source"]] += size[k]
    target = plain_targets(per)
    out = collections.Counter()
    for s in per:
        start = 0
        for k in sorted((k for k, d in enumerate(docs) if d["source"] == s), key=lambda k: (hashlib.md5(str(docs[k]["doc_id"]).encode()).hexdigest(), size[k])):
            out[docs[k]["doc_id"]] += sum(size[k] > 0 and start + n * per[s] < min(round(target[s]), 3 * per[s]) for n in range(3))
            start += size[k]
    return out


def test_pipeline_against_a_plain_one(spark):
    docs = rows_of(spark.read.parquet(f"{SF}/documents.parquet"))
    # 1: the posterior of the plain votes
    counted = rows_of(quality.with_features(spark.read.parquet(f"{SF}/documents.parquet")))
    for r in counted:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain_features(r["text"])
    votes = {r["doc_id"]: tuple(plain_vote(r[q.part] / r[q.whole] if r[q.whole] else None, q) for q in quality.RULES) for r in counted}
    prior, rates = quality.expectation_maximisation(sorted(collections.Counter(votes.values()).items()), len(quality.RULES))
    words = {r["doc_id"]: (r["n_words"], r["n_repeat_words"]) for r in counted}
    docs = [d for d in docs if words[d["doc_id"]][0] >= 50 and 100 * words[d["doc_id"]][1] <= 50 * words[d["doc_id"]][0] and quality.log_odds(votes[d["doc_id"]], prior, rates) >= 0]
    # 2: one document of each component of fingerprints
    fps = [plain_fingerprint(d["text"]) for d in docs]
    label = plain_components(len(docs), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    first = {}
    for d, x in zip(docs, label):
        first[x] = min(first.get(x, d["doc_id"]), d["doc_id"])
    docs = [d for d, x in zip(docs, label) if d["doc_id"] == first[x]]
    # 3: documents that hold 0.8 of an item's shingles
    items = [s for r in rows_of(spark.read.parquet(f"{SF}/benchmark.parquet")) if (s := shingles(r["text"]))]
    docs = [d for d in docs if not _leaks(shingles(d["text"]), items)]
    # 4: copies by the schedule; 5: shards of equal counts
    want = plain_copies(docs)
    got = rows_of(corpus_pipeline.run(spark, SF))
    assert collections.Counter(r["doc_id"] for r in got) == +want and len(docs) > 100
    shards = collections.defaultdict(list)
    for r in got:
        shards[r["shard"]].append(r["slot"])
    assert len(shards) == 40 and all(sorted(s) == list(range(len(s))) for s in shards.values()) and max(map(len, shards.values())) - min(map(len, shards.values())) <= 1


def _leaks(own, items):
    return any(len(s & own) >= 0.8 * len(s) - 1e-9 for s in items)


def test_pipeline_stages_keep_columns():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "SimHash near-dedup", "benchmark decontamination", "mixing sources", "sharding"]
