"""Queries of paragraphs, chunks, images and videos made of the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import chunking as C
from ..operators import media as D
from ..sources import blobs as B
from ..sources import files as S
from ..sources.scratch import shared_dir
from .registry import query

# ---------------------------------------------------------------- paragraphs and chunks

#: A document's lines as blocks of pages of ten; its first and fifth line stand in its table of contents.
BLOCKS = """
b AS (SELECT doc_id, i // 10 AS page, i, trim(x, ' ' || chr(9) || chr(10) || chr(13)) AS text FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)),
para AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS para_no, text FROM b WHERE text <> ''),
titles AS (SELECT DISTINCT doc_id, text FROM para WHERE para_no IN (0, 4)),
headed AS (SELECT doc_id, CAST(page AS INTEGER) AS page, CAST(para_no AS INTEGER) AS para_no, text, heading FROM (
  SELECT *, coalesce(last_value(CASE WHEN is_title THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY para_no), '') AS heading FROM (
    SELECT p.*, t.text IS NOT NULL AS is_title FROM para p LEFT JOIN titles t ON t.doc_id = p.doc_id AND t.text = p.text)) WHERE NOT is_title)
"""


def _headed(t):
    lines = t("documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "x"))
    pages = lines.groupBy("doc_id", F.floor(F.col("i") / 10).cast("int").alias("page")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda r: r["x"]).alias("blocks"))
    para = S.paragraphs(pages)
    titles = para.where("para_no IN (0, 4)").select("doc_id", F.col("text").alias("title"))
    return C.headings(S.marked_titles(para, titles))


@query(f"WITH {BLOCKS} SELECT doc_id, page, para_no, text, heading FROM headed")
def paragraph_headings(t):
    return _headed(t).select("doc_id", "page", "para_no", "text", "heading")


#: The fold over paragraphs, all documents at once, one paragraph a step. Sizes and running sums are lists; a is the first
#: paragraph of the open chunk, labels from relabelled on up to the step's own carry the heading given last.
FOLD = f"""{BLOCKS},
g AS (
  SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE para_no END AS k, para_no, page, CASE WHEN doc_id % 5 = 0 THEN '' ELSE heading END AS heading, text FROM headed),
u AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i, min(page) AS page, min(heading) AS heading, string_agg(text, ' ' ORDER BY para_no) AS text FROM g GROUP BY doc_id, k),
n AS (SELECT *, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_ \\t\\n\\x0b\\f\\r]') AS tok FROM u),
s AS (SELECT doc_id, list(CAST(len(tok) AS BIGINT) ORDER BY i) AS sizes, list(heading ORDER BY i) AS heads, list(page ORDER BY i) AS pages, list(tok ORDER BY i) AS toks FROM n GROUP BY doc_id),
c AS (SELECT *, list_transform(range(0, len(sizes) + 1), lambda e: coalesce(list_sum(sizes[1:e]), 0)) AS total FROM s),
f AS (
  SELECT doc_id, 0 AS i, 0::BIGINT AS a, 0::BIGINT AS from_, 0::BIGINT AS to_, '' AS label, CAST([] AS STRUCT(a BIGINT, b BIGINT, h VARCHAR)[]) AS made FROM c
  UNION ALL
  SELECT doc_id, i + 1, CASE WHEN mega THEN i + 1 WHEN over_ THEN greatest(a1, len(list_filter(total, lambda x: x < total[i + 1] - 100))) ELSE a1 END, from1, to1, label1,
    made1 || CASE WHEN mega AND a1 < i THEN [{{'a': a1, 'b': i::BIGINT, 'h': CASE WHEN a1 >= from1 AND a1 < to1 THEN label1 ELSE heads[a1 + 1] END}}, {{'a': i::BIGINT, 'b': i + 1::BIGINT, 'h': heads[i + 1]}}]
      WHEN mega THEN [{{'a': i::BIGINT, 'b': i + 1::BIGINT, 'h': heads[i + 1]}}]
      WHEN over_ THEN [{{'a': a1, 'b': i::BIGINT, 'h': CASE WHEN a1 >= from1 AND a1 < to1 THEN label1 ELSE heads[a1 + 1] END}}] ELSE [] END
  FROM (
    SELECT *, sizes[i + 1] > 800 AS mega, sizes[i + 1] <= 800 AND a1 < i AND total[i + 2] - total[a1 + 1] > 800 AS over_ FROM (
      SELECT *, CASE WHEN turn THEN greatest(a, len(list_filter(total, lambda x: x < total[i + 1] - 100))) ELSE a END AS a1, CASE WHEN turn THEN greatest(a, len(list_filter(total, lambda x: x < total[i + 1] - 100))) ELSE from_ END AS from1,
        CASE WHEN turn THEN i ELSE to_ END AS to1, CASE WHEN turn THEN heads[i + 1] ELSE label END AS label1,
        made || CASE WHEN turn THEN [{{'a': a, 'b': i::BIGINT, 'h': CASE WHEN a >= from_ AND a < to_ THEN label ELSE heads[a + 1] END}}] ELSE [] END AS made1
      FROM (SELECT f.*, c.sizes, c.heads, c.total, i > 0 AND heads[i + 1] <> heads[i] AND a < i AS turn FROM f JOIN c USING (doc_id) WHERE i < len(c.sizes))))),
done AS (
  SELECT f.doc_id, c.pages, c.toks, c.sizes, made || CASE WHEN a < len(c.sizes) THEN [{{'a': a, 'b': len(c.sizes)::BIGINT, 'h': CASE WHEN a >= from_ AND a < to_ THEN label ELSE heads[a + 1] END}}] ELSE [] END AS made
  FROM f JOIN c USING (doc_id) WHERE f.i = len(c.sizes)),
chunk AS (SELECT doc_id, unnest(made) AS m, generate_subscripts(made, 1) AS nth, pages, toks, sizes FROM done),
part AS (
  SELECT doc_id, nth, m.h AS heading, pages[m.a + 1] AS page, flatten(toks[m.a + 1:m.b]) AS tok, unnest(range(0, CASE WHEN sizes[m.a + 1] > 800 THEN 1 + CAST(ceil((sizes[m.a + 1] - 800) / 700.0) AS BIGINT) ELSE 1 END)) AS w, sizes[m.a + 1] > 800 AS mega FROM chunk)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY nth, w) - 1 AS INTEGER) AS chunk_index, page, heading, array_to_string(CASE WHEN mega THEN tok[w * 700 + 1:w * 700 + 800] ELSE tok END, ' ') AS tokens FROM part
"""


@query(f"WITH RECURSIVE {FOLD}")
def chunk_fold(t):
    """Chunks of paragraphs with headings; every fifth document is one paragraph, so long ones are cut. Chunks are compared by their tokens."""
    p = _headed(t)
    whole = F.col("doc_id") % 5 == 0
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("para_no", "text"))), lambda r: r["text"])
    one = p.where(whole).groupBy("doc_id").agg(F.min("page").alias("page"), F.array_join(ordered, " ").alias("text")).select("doc_id", F.lit(0).alias("para_no"), "page", F.lit("").alias("heading"), "text")
    chunks = C.fold_chunks(p.where(~whole).select("doc_id", "para_no", "page", "heading", "text").unionByName(one))
    tokens = F.regexp_extract_all("text", F.lit(C.TOKEN), F.lit(0))
    return chunks.select("doc_id", "chunk_index", "page", "heading", F.array_join(tokens, " ").alias("tokens"))


# ---------------------------------------------------------------- images and videos

#: Images of 200 x 100: three regions each, of which the second repeats the first and the third may lie outside.
IMAGES = """
r AS (
  SELECT doc_id, source, lang, 0 AS pos, (doc_id % 40)::INTEGER - 20 AS x1, (doc_id % 90)::INTEGER AS y1, (doc_id % 40)::INTEGER + 60 AS x2, (doc_id % 90)::INTEGER + (doc_id % 37)::INTEGER AS y2 FROM documents
  UNION ALL SELECT doc_id, source, lang, 2, 10, 20, 150 + (doc_id % 130)::INTEGER, 60 FROM documents),
k AS (SELECT *, greatest(0, least(x1, 200)) a1, greatest(0, least(y1, 100)) b1, greatest(0, least(x2, 200)) a2, greatest(0, least(y2, 100)) b2 FROM r),
ok AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM k WHERE a2 - a1 >= 10 AND b2 - b1 >= 10)
"""


def _images(t):
    x, y, k = (F.col("doc_id") % 40).cast("int"), (F.col("doc_id") % 90).cast("int"), F.col("doc_id")
    region = lambda kind, label, box, found: F.struct(kind.alias("region_type"), label.alias("label"), F.array(*box).alias("bbox"), found.alias("caption"))
    first = [x - 20, y, x + 60, y + (k % 37).cast("int")]
    none = F.lit(None).cast("string")
    found = F.when(F.col("lang") == "fr", F.concat(F.lit("Description: "), "source"))
    regions = F.array(region(F.lit("chart"), none, first, found), region(F.lit("table"), F.lit("again"), first, none), region(F.lit("photo"), F.lit("wide"), [F.lit(10), F.lit(20), 150 + (k % 130).cast("int"), F.lit(60)], none))
    caption = F.when(F.col("lang") != "de", F.concat(F.lit("Transcription: "), "source"))
    return t("documents").select(k.alias("image_id"), F.concat(F.lit("img"), k.cast("string")).alias("filename"), F.lit("image/png").alias("mime_type"), F.lit(200).alias("width"), F.lit(100).alias("height"), caption.alias("caption"), regions.alias("regions"))


@query(f"""
WITH {IMAGES}
SELECT doc_id AS image_id, 'image_global' AS modality, 0 AS chunk_index, CASE WHEN lang = 'de' THEN 'Image: img' || doc_id ELSE source END AS text, '' AS box, CAST((SELECT count(*) FROM ok WHERE ok.doc_id = documents.doc_id) AS INTEGER) AS region_count,
  -1.0::DOUBLE AS left_share, -1.0::DOUBLE AS top_share, -1.0::DOUBLE AS right_share, -1.0::DOUBLE AS bottom_share FROM documents
UNION ALL
SELECT doc_id, 'image_local', CAST(n AS INTEGER), CASE WHEN pos = 0 AND lang = 'fr' THEN source ELSE 'Image: img' || doc_id END || CASE pos WHEN 0 THEN ' | Region: chart | chart' ELSE ' | Region: photo | wide' END, concat_ws(',', a1, b1, a2, b2), 0,
  round(a1 / 200.0::DOUBLE, 6), round(b1 / 100.0::DOUBLE, 6), round(a2 / 200.0::DOUBLE, 6), round(b2 / 100.0::DOUBLE, 6) FROM ok
""")
def image_chunks(t):
    c = D.image_chunks(_images(t))
    shares = [F.coalesce(F.round(F.get("crop_bbox_normalized", F.lit(k)), 6), F.lit(-1.0)).alias(f"{side}_share") for k, side in enumerate(("left", "top", "right", "bottom"))]
    box = F.concat_ws(",", F.col("crop_bbox").cast("array<string>")).alias("box")
    return c.select("image_id", "modality", "chunk_index", "text", box, F.coalesce("region_count", F.lit(0)).alias("region_count"), *shares)


SCENES = """
s0 AS (
  SELECT doc_id, 0 AS i, 0.0::DOUBLE AS s, n_chars / 2.0::DOUBLE AS e FROM documents WHERE lang <> 'de' UNION ALL SELECT doc_id, 1, n_chars / 2.0::DOUBLE, n_chars::DOUBLE FROM documents WHERE lang <> 'de'
  UNION ALL SELECT doc_id, 0, 0.0, n_chars::DOUBLE FROM documents WHERE lang = 'de' AND n_chars > 0),
s1 AS (SELECT *, unnest(range(0, 1 + CASE WHEN e - s <= 120 THEN 0 ELSE CAST(ceil((e - s - 120) / 115) AS BIGINT) END)) AS j FROM s0),
sc AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS INTEGER) AS scene_index, s + j * 115 AS start, least(s + j * 115 + 120, e) AS stop, e - s > 120 AS forced FROM s1)
"""


def _scenes(t):
    half = F.col("n_chars") / F.lit(2.0)
    scene = lambda a, b: F.struct(a.alias("start"), b.alias("stop"))
    found = F.when(F.col("lang") != "de", F.array(scene(F.lit(0.0), half), scene(half, F.col("n_chars").cast("double"))))
    return D.scenes(t("documents").select(F.col("doc_id").alias("video_id"), F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("filename"), F.col("n_chars").alias("duration"), found.alias("scenes")))


@query(f"WITH {SCENES} SELECT doc_id AS video_id, scene_index, start, stop, forced FROM sc")
def video_scenes(t):
    """Two scenes a video, or none found: then one of its whole length; long ones in segments."""
    return _scenes(t).drop("filename")


@query(f"""
WITH {SCENES},
cl AS (SELECT *, CASE WHEN scene_index % 3 = 1 THEN '' ELSE 'summary ' || scene_index END AS summary FROM sc WHERE (doc_id + scene_index) % 11 <> 0),
rows_ AS (SELECT *, 0 AS k, 'video_clip' AS modality FROM cl UNION ALL SELECT *, 1, 'video_summary' FROM cl WHERE summary <> '')
SELECT doc_id AS video_id, modality, CASE WHEN summary = '' THEN 'Video: v' || doc_id || ' scene ' || scene_index ELSE summary END AS text, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY scene_index, k) - 1 AS INTEGER) AS chunk_index, scene_index,
  k = 0 AND forced AS forced_split FROM rows_
""")
def video_chunks(t):
    k = F.col("scene_index")
    clips = _scenes(t).withColumn("clip_hash", F.when((F.col("video_id") + k) % 11 != 0, F.sha2(F.concat("filename", k.cast("string")), 256))).withColumn("summary", F.when(k % 3 != 1, F.concat(F.lit("summary "), k.cast("string"))))
    return D.video_chunks(clips).select("video_id", "modality", "text", "chunk_index", "scene_index", F.coalesce("forced_split", F.lit(False)).alias("forced_split"))


@query("""
SELECT doc_id, 'Doc ' || doc_id || '.pdf' AS source, sha256(text) AS file_hash, CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'Doc ' || doc_id END AS title, CASE WHEN doc_id % 3 = 0 THEN 'media/x.jpg' ELSE 'gs://other/media/x.jpg' END AS blob FROM documents
""")
def stamped_chunks(t):
    """Chunks with source and hash, the document's title and the name of a blob."""
    name = F.concat(F.lit("Doc "), F.col("doc_id").cast("string"), F.lit(".pdf"))
    d = D.stored(D.stamped(t("documents"), name, F.sha2("text", 256)))
    uri = F.when(F.col("doc_id") % 3 == 0, "gs://media/media/x.jpg").otherwise("gs://other/media/x.jpg")
    title = S.title(F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise(" "), F.concat(F.lit("/up/"), "source"))
    return d.select("doc_id", "source", "file_hash", title.alias("title"), S.blob_name(uri, "media").alias("blob"))


@query("""
SELECT DISTINCT 'media/' || sha256(text) || '/img_0.png' AS name, CAST(octet_length(encode(text)) AS BIGINT) AS length, sha256(text) AS content_hash FROM documents WHERE text IS NOT NULL
""")
def media_objects(t):
    """What a store of objects holds after the bytes of all documents were written to it twice: equal bytes are one object."""
    d = t("documents").where("text IS NOT NULL").select(F.concat(F.lit("media/"), F.sha2("text", 256), F.lit("/img_0.png")).alias("name"), F.encode("text", "UTF-8").alias("content"))
    spark, root = d.sparkSession, f"{shared_dir(d.sparkSession)}/{uuid.uuid4().hex}"
    for _ in range(2):
        B.write_blobs(d, root)
    return B.read_blobs(spark, root).select("name", "length", F.sha2("content", 256).alias("content_hash"))
