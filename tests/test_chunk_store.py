"""A store whose files are found by Bloom filters."""

from pyspark.sql import functions as F

from quarry.sources import chunk_store as S


def chunks(spark, a, b):
    return spark.range(a, b).select(F.sha2(F.col("id").cast("string"), 256).alias("chunk_id"), F.col("id").alias("n"), F.concat(F.lit("text "), "id").alias("text"))


def test_replays_and_overlaps(spark, tmp_path):
    path = str(tmp_path / "store")
    assert S.read_chunks(spark, path) is None
    assert S.add_chunks(spark, path, chunks(spark, 0, 500)).inserted == 500
    assert S.add_chunks(spark, path, chunks(spark, 0, 500)).inserted == 0
    twice = chunks(spark, 400, 700).unionByName(chunks(spark, 600, 700).withColumn("text", F.lit("other"))).unionByName(chunks(spark, 0, 1).withColumn("chunk_id", F.lit(None).cast("string")))
    assert S.add_chunks(spark, path, twice).inserted == 200
    stored = S.read_chunks(spark, path)
    assert stored.columns == ["chunk_id", "n", "text"] and sorted(r["n"] for r in stored.collect()) == list(range(700))
    assert stored.where("n < 500 AND text = 'other'").isEmpty()  # what is stored stays
    assert S.add_chunks(spark, path, chunks(spark, 0, 0)).inserted == 0


def test_a_batch_reads_few_files(spark, tmp_path):
    """New ids read next to no file, known ones those that hold them, and every id is found."""
    path = str(tmp_path / "store")
    S.add_chunks(spark, path, chunks(spark, 0, 3000), most=20)
    new = S.add_chunks(spark, path, chunks(spark, 5000, 5020))
    assert new.inserted == 20 and new.files > 150 and new.files_read < 0.1 * new.files
    known = S.add_chunks(spark, path, chunks(spark, 100, 105))
    assert known.inserted == 0 and 1 <= known.files_read <= 12
    held, _ = S.files_for(spark, path, chunks(spark, 0, 3000))
    assert S._rows(spark, path, held).where("n < 3000").count() == 3000


def test_a_failed_upload_shows_nothing(spark, tmp_path):
    path = tmp_path / "store"
    S.add_chunks(spark, str(path), chunks(spark, 0, 10))
    chunks(spark, 10, 20).withColumn("_bucket", F.lit(0)).write.partitionBy("_bucket").parquet(str(path / "data" / "_upload=half"))
    assert S.read_chunks(spark, str(path)).count() == 10 and S.add_chunks(spark, str(path), chunks(spark, 0, 20)).inserted == 10


def test_long_ids(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.range(50).withColumnRenamed("id", "row_id")
    assert S.add_chunks(spark, path, rows, "row_id").inserted == 50 and S.add_chunks(spark, path, rows.where("row_id > 40"), "row_id").inserted == 0
