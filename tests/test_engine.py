"""Fixed cases of the engine's operators, and every SQL twin at the smallest scale."""

import glob
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators.counters import Words
from quarry.operators import chunking as C
from quarry.operators import evaluation as V
from quarry.operators import measures as M
from quarry.operators import providers as P
from quarry.operators import retrieval as R
from quarry.plans import catalog
from quarry.sources import files as S
from quarry.sources import stores as T
from quarry.streaming.ingest import ingest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_sql_twin(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF), duck.execute(catalog.SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda df: sorted(map(repr, df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False, name=None)))
    assert rows(got.toPandas()) == rows(want)


def test_stems():
    assert len({X.stem(w) for w in ("run", "runs", "running")}) == 1
    assert len({X.stem(w) for w in ("retrieval", "retrieve", "retrieved")}) == 1
    assert [X.stem(w) for w in ("caresses", "ponies", "relational", "hopping", "filing", "happy", "controlling", "9")] == ["caress", "poni", "relat", "hop", "file", "happi", "control", "9"]


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_segments_windows_and_boxes(spark):
    seg = lambda a, b: [(r["start"], r["stop"]) for r in one(spark, C.scene_segments(F.lit(float(a)), F.lit(float(b))))]
    assert seg(0, 250) == [(0, 120), (115, 235), (230, 250)] and seg(0, 120) == [(0, 120)]
    assert seg(0, 500) == [(0, 120), (115, 235), (230, 350), (345, 465), (460, 500)]
    assert [(r["start"], r["stop"]) for r in one(spark, C.token_windows(F.lit(1800)))] == [(0, 800), (700, 1500), (1400, 1800)]
    box = lambda *b: one(spark, C.rescue_box([F.lit(v) for v in b], F.lit(200), F.lit(100)))
    assert box(-10, -5, 250, 150) == [0, 0, 200, 100] and box(0, 83, 200, 120) == [0, 83, 200, 100] and box(0, 150, 200, 200) is None


def test_fusion(spark):
    schema = "qid long, text string, source string, page int, modality string, rank int"
    make = lambda *rows: spark.createDataFrame([(0, t, s, p, "pdf", k) for t, s, p, k in rows], schema)
    got = {r["text"]: r for r in R.fuse(make(("e", "a", 1, 1), ("s", "a", 5, 2)), make(("s", "b", 9, 1), ("t", "b", 1, 2), ("t", "b", 1, 3))).collect()}
    assert got["s"]["pos"] == 1 and got["s"]["source"] == "a" and got["s"]["page"] == 5 and abs(got["s"]["score"] - (1 / 62 + 1 / 61)) < 1e-9
    assert got["t"]["vector_rank"] == 3 and got["t"]["bm25_rank"] is None and abs(got["t"]["score"] - (1 / 62 + 1 / 63)) < 1e-9


def test_rerank(spark):
    cand = lambda n: spark.createDataFrame([(0, k, 1 / (60 + k)) for k in range(1, n + 1)], "qid long, pos int, score double")
    given = lambda s: spark.createDataFrame([(0, k + 1, 1, float(v)) for k, v in enumerate(s)], "qid long, pos int, given int, model_score double")
    assert R.rerank(cand(5), given([0.9, 0.3, 0.24, 0.1, 0])).count() == 2
    assert R.rerank(cand(5), given([0.1] * 5)).count() == 3
    assert [r["pos"] for r in R.rerank(cand(10), given([]), top=3).orderBy("rank").collect()] == [1, 2, 3]
    assert R.rerank(cand(1), given([0.0])).first()["rerank_score"] == pytest.approx(1 / 61)


def test_bm25_lists_every_document(spark):
    docs = spark.createDataFrame([(0, "hello world"), (1, "other text here"), (2, None)], "doc_id long, text string")
    rows = R.bm25(R.index(docs), spark.createDataFrame([(7, "unknown"), (8, "other")], "qid long, text string")).orderBy("qid", "rank").collect()
    assert [(r["qid"], r["doc_id"]) for r in rows] == [(7, 0), (7, 1), (7, 2), (8, 1), (8, 0), (8, 2)] and rows[0]["score"] == 0


def test_percentiles_and_names(spark):
    v = spark.range(1, 11).select(F.col("id").cast("double").alias("x"))
    assert M.truncating(v, "x", (50, 95)).first().asDict() == {"p50": 5.0, "p95": 9.0}
    assert M.summary(spark.createDataFrame([], "ts timestamp, latency_ms double, input_tokens long, output_tokens long")).first()["p95"] == 0
    assert one(spark, C.chunk_id(F.lit("a" * 64), F.lit(0))) == "eaecf10f61123aa52165f28155f85acc65a7bb9a989a46e8670441b2460d77d8"
    assert one(spark, S.results_name(F.lit("2025-01-02T03:04:05.6+00:00"))) == "results_2025-01-02T03-04-05-600-00.json"
    assert one(spark, X.masked(F.lit("abcdefgh"))) == "****efgh" and one(spark, X.masked(F.lit("abc"))) == "****"


def test_fold(spark):
    words = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    sizes = [300, 300, 80, 300, 300, 60, 1400, 5]
    rows = [(1, k, k + 1, "A" if k < 4 else "B", words(k, n)) for k, n in enumerate(sizes)]
    got = C.fold_chunks(spark.createDataFrame(rows, "doc_id long, para_no int, page int, heading string, text string")).orderBy("chunk_index").collect()
    starts = [r["text"].split()[0] for r in got]
    # 300 + 300 + 80, over; 80 carried + 300, new heading: nothing above 100 fits; 300 + 60; the long one in two windows; the rest.
    assert starts == ["w0x0", "w2x0", "w4x0", "w6x0", "w6x700", "w7x0"]
    assert [r["heading"] for r in got] == ["A", "A", "B", "B", "B", "B"] and [r["page"] for r in got] == [1, 3, 5, 7, 7, 8]
    assert [len(r["text"].split()) for r in got] == [680, 380, 360, 800, 700, 5]


def test_windows_keep_what_stands_between_tokens():
    assert Words().windows("a,  b\n c d", 3, 1) == ["a,  b", "b\n c d"]


def test_bm25_fillers_with_negative_scores(spark):
    """A term of most documents scores below 0, so documents without it lead, whatever their ids."""
    docs = spark.createDataFrame([(k, "common word here" if k < 60 else "thing") for k in range(63)], "doc_id long, text string")
    rows = R.bm25(R.index(docs), spark.createDataFrame([(1, "common"), (2, "thing")], "qid long, text string")).orderBy("qid", "rank").collect()
    first = [(r["doc_id"], r["score"]) for r in rows if r["qid"] == 1]
    assert [d for d, _ in first] == [60, 61, 62, *range(17)] and [s for _, s in first[:3]] == [0, 0, 0] and all(s < 0 for _, s in first[3:])
    assert [r["doc_id"] for r in rows if r["qid"] == 2] == [60, 61, 62, *range(17)]


def test_bm25_with_stems(spark):
    """Against the formula."""
    texts = ["running dogs run", "a dog retrieves", "retrieval of runs", "cats", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    terms = [[X.stem(w) for w in (t or "").split()] for t in texts]
    n, avg = len(terms), sum(map(len, terms)) / len(terms)
    df = {w: sum(w in t for t in terms) for t in terms for w in t}
    raw = {w: math.log((n - k + 0.5) / (k + 0.5)) for w, k in df.items()}
    idf = {w: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, x in raw.items()}
    asked = [X.stem(w) for w in "dogs running retrieving dog".split()]
    want = [sum(idf.get(w, 0) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in asked) for t in terms]
    got = R.bm25(R.index(docs, True), spark.createDataFrame([(0, "dogs running retrieving dog")], "qid long, text string")).collect()
    assert sorted((r["doc_id"], round(r["score"], 6)) for r in got) == [(k, pytest.approx(w, abs=1e-6)) for k, w in enumerate(want)]


def test_vectors(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [-1.0, 0.0]), (3, [1.0, 1.0]), (4, None)], "vec_id long, embedding array<double>")
    got = R.vector_search(v, v.where("vec_id < 2").withColumnRenamed("vec_id", "qid")).orderBy("qid", "rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got if r["qid"] == 0] == [(0, 1.0), (3, 0.707107), (1, 0.0), (2, -1.0)]
    assert {r["score"] for r in got if r["qid"] == 1} == {0.0}
    assert one(spark, R.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0
    assert R.vector_search(v, v.limit(0).withColumnRenamed("vec_id", "qid")).count() == 0


def test_citations_and_outputs(spark):
    assert one(spark, X.citations(F.lit("[2][99999999999999999999] [1]"))) == [1, 2, (1 << 63) - 1]
    assert one(spark, X.invented(X.citations(F.lit("[2][99999999999999999999]")), F.lit(3))) == [(1 << 63) - 1]
    assert one(spark, X.grouped_citations(F.lit("[1, 2] [3]"))) == [1, 2, 3]
    scores = lambda raw: one(spark, X.rerank_scores(F.lit(raw)))
    assert [tuple(x) for x in scores('```json\n[{"id": 1, "score": 0.5}, {"id": "2", "score": 1}]\n```')] == [(1, 0.5), (2, 1.0)]
    assert scores("nothing") is None and scores('[{"id": 1}]') is None
    assert tuple(one(spark, X.judged(F.lit('```\n{"score": 9, "reasoning": "r"}\n```'), "score", 5))) == (5.0, "r")
    assert tuple(one(spark, X.judged(F.lit("bad"), "score", 5))) == (0.0, "parse_error: bad")
    assert one(spark, X.without_fences(F.lit("```json\n[1]\n```"))) == "[1]" and one(spark, X.caption(F.lit("Description: a Transcription : b"))) == "a b"
    assert one(spark, X.http_status(F.lit("generation"), F.lit("config"))) == 500 and one(spark, X.http_status(F.lit("query"), F.lit(None).cast("string"))) == 200


def test_percentiles_by_group(spark):
    rows = [(g, float(v)) for g in "ab" for v in ([5] * 1000 if g == "a" else range(100))]
    v = spark.createDataFrame([*rows, ("b", None)], "g string, x double")
    got = {r["g"]: (r["p50"], r["p95"]) for r in M.truncating(v, "x", (50, 95), ("g",)).collect()}
    assert got == {"a": (5, 5), "b": (49, 94)}
    got = {r["g"]: (r["p50"], r["p95"]) for r in M.linear(v, "x", (50, 95), ("g",)).collect()}
    assert got["a"] == (5, 5) and got["b"] == (49.5, pytest.approx(94.05))
    assert M.linear(spark.range(1, 11).select(F.col("id").cast("double").alias("x")), "x", (95,)).first()["p95"] == pytest.approx(9.55)


class Refused(Exception):
    code = 400


def test_retries():
    slept, calls = [], []

    def twice():
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("again")
        return "ok"

    assert P.with_retry(twice, sleep=slept.append) == "ok" and slept == [1, 2]
    with pytest.raises(P.ProviderError) as e:
        P.with_retry(lambda: (_ for _ in ()).throw(Refused()), sleep=slept.append)
    assert e.value.attempts == 1
    with pytest.raises(P.ProviderError):
        P.with_retry(twice, attempts=0)
    assert P.status_of(ConnectionError()) is None and P.status_of(Refused()) == 400
    with pytest.raises(ValueError):
        P.embed_batch(["image", "video"], [1, 2], lambda k, x: x)


def test_providers(spark):
    c = spark.createDataFrame([("document", "a b"), ("video", "c"), ("other", "d")], "type string, embed_text string").coalesce(1)
    got = P.embed_chunks(c, P.hashed_vectors).collect()
    assert [r["embedding"] is None for r in got] == [False, False, True] and sum(x * x for x in got[0]["embedding"]) == pytest.approx(1)
    q = spark.createDataFrame([(1, "good"), (2, "bad")], "qid long, question string")

    def model(p):
        if p == "bad":
            error = RuntimeError("no")
            error.code = 400
            raise error
        return p + " answer"

    assert {r["qid"]: r["expansion"] for r in P.expanded(q, model).collect()} == {1: "good answer", 2: "bad"}
    assert P.overlap("a b", "b c") == 0.5


def test_stores(spark, tmp_path):
    run = lambda k: spark.createDataFrame([(f"r{k}", f"2025-01-0{k}T00:00:00", 1)], "run_id string, timestamp string, num_queries long")
    for k in (1, 2, 1):
        T.add_run(spark, str(tmp_path / "runs"), run(k))
    runs = T.read_runs(spark, str(tmp_path / "runs"))
    assert [r["run_id"] for r in V.newest_first(runs).collect()] == ["r2", "r1"] and runs.first()["p95_latency_ms"] is None
    assert V.chosen_run(runs).first()["run_id"] == "r2" and V.chosen_run(runs, "r9").count() == 0
    name = T.write_results(spark.createDataFrame([(1, "ok")], "query_id long, status string"), str(tmp_path / "results"), "r1", "2025-01-01T00:00:00+00:00")
    assert name == "results_2025-01-01T00-00-0000-00.json" and T.read_results(spark, str(tmp_path / "results"), "r1").count() == 1
    by_name = lambda run_id, at: T.read_results(spark, str(tmp_path / "results"), run_id, at).count()
    assert by_name("r1", "2025-01-01T00:00:00+00:00") == by_name("r1", "2026-01-01T00:00:00+00:00") == 1 and by_name("r2", "2025-01-01T00:00:00+00:00") == 0
    assert T.read_logs(spark, str(tmp_path / "logs")).count() == 0
    logs = spark.createDataFrame([("2025-02-01T00:00:00", 1.0), ("2025-01-01T00:00:00", 2.0)], "timestamp string, latency_ms double")
    assert [r["latency_ms"] for r in T.recent_logs(logs, "2025-02-10T00:00:00").collect()] == [1.0]
    for _ in range(2):
        T.add_chunks(spark, str(tmp_path / "chunks"), spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "chunk_id string, n long"))
    assert spark.read.parquet(str(tmp_path / "chunks")).count() == 2
    (tmp_path / "golden.json").write_text('{"queries": [{"id": "a", "category": "x"}, {"id": "b", "category": "y"}]}')
    assert S.golden_questions(spark, str(tmp_path / "golden.json")).count() == 2 and S.golden_questions(spark, str(tmp_path / "golden.json"), "y").first()["id"] == "b"
    assert [r["id"] for r in V.dry_run(S.golden_questions(spark, str(tmp_path / "golden.json")), "id", 1).collect()] == ["a"]


def test_media_join_and_dispatch(spark):
    chunks = spark.createDataFrame([("gs://m/a", 1), ("gs://m/b", 2)], "gcs_uri string, n int")
    got = S.with_media(chunks, spark.createDataFrame([("gs://m/a", bytearray(b"x"))], "gcs_uri string, content binary")).orderBy("n").collect()
    assert [r["fetched"] for r in got] == [True, False]
    files = spark.createDataFrame([("a.pdf", 1), ("b.PNG", 1), ("c.mov", 1), ("d.exe", 1)], "path string, length long")
    kinds = S.dispatched(S.accepted(files), *[lambda df, k=k: df.select("path", F.lit(k).alias("kind")) for k in ("p", "i", "v")])
    assert sorted((r["path"], r["kind"]) for r in kinds.collect()) == [("a.pdf", "p"), ("b.PNG", "i"), ("c.mov", "v")]


def test_uploads_and_ingest(spark, tmp_path):
    for name in ("a.PDF", "b.exe", "c.png"):
        (tmp_path / name).write_bytes(b"x")
    assert sorted(r["format"] for r in S.uploads(spark, str(tmp_path)).select("format").collect()) == ["image", "pdf"]
    schema = "chunk_id string, text string"
    for _ in range(2):
        spark.createDataFrame([("a", "x"), ("b", "y")], schema).write.mode("append").parquet(str(tmp_path / "in"))
        ingest(spark, str(tmp_path / "in"), schema, str(tmp_path / "store"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "store")).count() == 2
