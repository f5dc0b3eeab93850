"""Chunk folding against a plain walk through the paragraphs, and token counters against a plain encoder."""

import base64
import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import chunking as C
from quarry.operators.counters import PATTERN, BytePairs, Words, merges

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def plain_bounds(sizes, headings, most, overlap):
    """(first, end, heading) of the chunks, paragraph by paragraph."""
    out, open_, label = [], [], list(headings)

    def close():
        out.append((open_[0], open_[-1] + 1, label[open_[0]]))
        kept = []
        while open_ and sum(sizes[k] for k in kept) + sizes[open_[-1]] <= overlap:
            kept.insert(0, open_.pop())
        return kept

    for k, n in enumerate(sizes):
        if k and headings[k] != headings[k - 1] and open_:
            open_ = close()
            for c in open_:
                label[c] = headings[k]
        if n > most:
            if open_:
                close()
            out.append((k, k + 1, headings[k]))
            open_ = []
            continue
        if open_ and sum(sizes[c] for c in open_) + n > most:
            open_ = close()
        open_.append(k)
    if open_:
        close()
    return out


def plain_fold(paragraphs, most, overlap):
    out = []
    for doc in sorted({p[0] for p in paragraphs}):
        own = sorted(p[1:] for p in paragraphs if p[0] == doc)
        texts = [t or "" for _, _, _, t in own]
        index = 0
        for a, b, heading in plain_bounds([len(t.split()) for t in texts], [h or "" for _, _, h, _ in own], most, overlap):
            for text in Words().windows(texts[a], most, overlap) if len(texts[a].split()) > most else ["\n\n".join(texts[a:b])]:
                out.append((doc, index, own[a][1], heading, text))
                index += 1
    return sorted(out)


def some_paragraphs(seed):
    rng = random.Random(seed)
    rows = []
    for doc in range(25):
        heading = "h0"
        for k in range(rng.randint(1, 60)):
            if rng.random() < 0.12:
                heading = rng.choice(["h0", "h1", "h2", None])
            n = rng.choice([0, 1, 2, 3, 5, 8, 20, 25, 26, 60]) if rng.random() < 0.3 else rng.randint(0, 9)
            rows.append((f"d{doc:02d}", k, k // 7, heading, " ".join(f"w{doc}x{k}x{i}" for i in range(n)) or rng.choice([None, ""])))
    return rows


@pytest.mark.parametrize("most, overlap, seed", [(25, 8, 1), (25, 24, 2), (9, 0, 3)])
def test_sections_fold_as_whole_documents(spark, most, overlap, seed):
    rows = some_paragraphs(seed)
    df = spark.createDataFrame(rows, "doc_id string, para_no int, page int, heading string, text string").repartition(3)
    got = [tuple(r) for r in C.fold_chunks(df, most, overlap).select("doc_id", "chunk_index", "page", "heading", "text").collect()]
    assert sorted(got) == plain_fold(rows, most, overlap)


def test_one_document_of_many_paragraphs(spark):
    """A million paragraphs under one heading fold in one document."""
    n = 1_000_000
    df = spark.range(n).select(F.lit(1).alias("doc_id"), F.col("id").cast("int").alias("para_no"), F.lit(1).alias("page"), F.lit("h").alias("heading"), F.lit("a b c d e f g h i j").alias("text"))
    chunks = C.fold_chunks(df).agg(F.count("*").alias("n"), F.max("chunk_index").alias("last"), F.max(F.length("text")).alias("most")).first()
    # 80 paragraphs a chunk, of which ten are carried over.
    want = 1 + -(-(n - 80) // 70)
    assert (chunks["n"], chunks["last"]) == (want, want - 1) and chunks["most"] == 80 * 19 + 79 * 2


def test_paragraphs_without_a_document(spark):
    df = spark.createDataFrame([(None, 1, 1, "h", "a"), (7, 1, 1, None, "b"), (7, 2, 1, "", None)], "doc_id long, para_no int, page int, heading string, text string")
    assert [tuple(r) for r in C.fold_chunks(df).collect()] == [(7, 0, 1, "", "b\n\n")]
    assert not C.fold_chunks(df.limit(0)).count()


# ---------------------------------------------------------------- byte pairs


@pytest.fixture(scope="module")
def encoder():
    tiktoken = pytest.importorskip("tiktoken")
    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", "Hello world, it's 2024!", "  two  spaces\n\n\ttabs ", "naïve café 日本語 🎉🎉 ß", "a" * 3000, "abcabcabd" * 200, "don't we'll I've x=1;y+=2", "\u2003wide\xa0spaces\x1f", "ﬁn Ωmega ٣٤", "\0\x01 control"]


def test_merges_equal_a_plain_encoder(encoder):
    own = BytePairs(VOCABULARY)
    rng = random.Random(1)
    letters = "abcdefghij ee  tt\n.,'0123éß日"
    for text in TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 80))) for _ in range(400)]:
        assert own.tokens(text) == [encoder.decode_single_token_bytes(t) for t in encoder.encode_ordinary(text)], text
    assert merges(b"abc", {b"ab": 1, b"bc": 0, b"abc": 5}) == [b"abc"] and merges(b"abcd", {b"ab": 1, b"bc": 0}) == [b"a", b"bc", b"d"]


def test_counts_in_spark(spark, encoder):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None)], "doc_id long, text string"))
    got = BytePairs(VOCABULARY).counted(docs).collect()
    assert all(r["n_tokens"] == len(encoder.encode_ordinary(r["text"] or "")) for r in got) and len(got) == 201


def test_chunks_by_byte_pairs(spark, encoder):
    """Chunks keep their bound by this counter too; a long paragraph is cut into windows of its tokens."""
    words = "incomprehensibilities antidisestablishmentarianism internationalization " * 30
    rows = [(1, k, 1, "h", words[: 300 * (k + 1)]) for k in range(6)]
    own = BytePairs(VOCABULARY)
    got = C.fold_chunks(spark.createDataFrame(rows, "doc_id long, para_no int, page int, heading string, text string"), 120, 30, own).orderBy("chunk_index").collect()
    sizes = [len(encoder.encode_ordinary(r["text"])) for r in got]
    assert max(sizes) <= 120 + 3 and len(got) > 6 and own.windows(words, 50, 10)[0] == encoder.decode(encoder.encode_ordinary(words)[:50])


def test_texts_meet_by_document_once(spark):
    """Chunks are numbered from counts: no window over texts is left, and a cut paragraph moves all that follow."""
    rows = [(1, 0, 1, "", "a b"), (1, 1, 1, "", " ".join(["w"] * 1700)), (1, 2, 2, "h", "c"), (2, 0, 1, "", "d")]
    df = spark.createDataFrame(rows, "doc_id long, para_no int, page int, heading string, text string")
    out = C.fold_chunks(df)
    windows = [x for x in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window [" in x]
    assert windows and not any("row_number" in x for x in windows)
    got = sorted((r["doc_id"], r["chunk_index"], len(r["text"].split())) for r in out.collect())
    assert got == [(1, 0, 2), (1, 1, 800), (1, 2, 800), (1, 3, 300), (1, 4, 1), (2, 0, 1)]
