"""Text expressions: cleaning, tokens, stems, citations and labels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Artefacts of PDF text and what they stand for, in the order of replacement.
ARTEFACTS = (("10II", "10^-9"), ("10\u25a0\u25a0", "10^-9"), ("\u03b5=", "epsilon="), ("\u025b=", "epsilon="), ("\x00", ""), ("\xa0", " "))
#: Marker tokens of models that never belong in a chunk.
MARKERS = ("<EOS>", "<pad>", "<unk>", "<s>", "</s>", "<mask>")
#: Words by which a question names a scope; alternatives that another one covers are left out.
SCOPES = {
    "has_video": r"(?i)\b(video|presenter)\b",
    "has_image": r"(?i)\b(diagram|figure|image|what (does|is) (shown|labeled|depicted) in)\b",
    "has_text": r"(?i)\b(paper|document|report)\b",
}
#: What error messages of a bad request and of a passing failure hold.
CONFIG_ERRORS = ("401", "403", "api key", "permission denied", "400", "invalid argument", "bad request")
#: Characters of a snippet, of a passage for reranking and of a clip's summary there, of a judge's output in an error.
SNIPPET, PASSAGE, CLIP_PASSAGE, RAW = 100, 400, 300, 200
#: What ``token_count`` counts: words and single punctuation marks.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_ \t\n\x0b\f\r]"
_LARGEST = (1 << 63) - 1


def clean(text: Column) -> Column:
    for a, b in ARTEFACTS:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def stripped(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def has_marker(text: Column) -> Column:
    """A marker occurs that no word character touches."""
    alternatives = "|".join(MARKERS)
    return text.rlike(rf"(^|[^\p{{L}}\p{{N}}_])({alternatives})([^\p{{L}}\p{{N}}_]|$)")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores, duplicates kept."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def token_count(text: Column) -> Column:
    """Offline counter: words and single punctuation marks."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(TOKEN)).cast("long")


def embed_input(title: Column, heading: Column, text: Column) -> Column:
    title, heading = F.coalesce(title, F.lit("")), F.coalesce(heading, F.lit(""))
    return F.when((title != "") | (heading != ""), F.concat(F.lit("Doc: "), title, F.lit(" | Section: "), heading, F.lit("\n\n"), text)).otherwise(text)


def mime(content: Column) -> Column:
    return F.when(F.hex(F.substring(content, 1, 4)) == "89504E47", "image/png").otherwise("image/jpeg")


def _numbers(marks: Column) -> Column:
    """Different numbers of an array of digits, ascending; those beyond 64 bits count as the largest, so they are invented ones."""
    return F.array_sort(F.array_distinct(F.transform(marks, lambda x: F.coalesce(x.try_cast("long"), F.lit(_LARGEST)))))


def citations(answer: Column) -> Column:
    """Different numbers of [n] marks, ascending."""
    return _numbers(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1)))


def grouped_citations(answer: Column) -> Column:
    """Different numbers of [n] and [n, m] marks, ascending."""
    groups = F.regexp_extract_all(answer, F.lit(r"\[(\d+(?:,\s*\d+)*)\]"), F.lit(1))
    return _numbers(F.flatten(F.transform(groups, lambda g: F.split(g, r",\s*"))))


def invented(cited: Column, n: Column) -> Column:
    """Cited numbers outside 1 to n."""
    return F.filter(cited, lambda x: (x < 1) | (x > n))


def masked(secret: Column) -> Column:
    return F.when(F.length(secret) > 4, F.concat(F.repeat(F.lit("*"), F.length(secret) - 4), F.right(secret, F.lit(4)))).otherwise("****")


def error_class(message: Column) -> Column:
    """config if the message holds a pattern of bad requests, which are tested first; else retryable."""
    low = F.lower(F.coalesce(message, F.lit("")))
    return F.when(low.rlike("|".join(CONFIG_ERRORS)), "config").otherwise("retryable")


def http_status(stage: Column, error: Column) -> Column:
    """Status of a failed request by stage (upload, embedding, store, retrieval, generation) and error kind; 200 without error."""
    given = {("generation", "config"): 500, ("generation", "retryable"): 503, ("generation", "other"): 502, ("upload", "format"): 400, ("upload", "size"): 413, ("upload", "content"): 422}
    status = F.lit(None).cast("int")
    for (s, e), code in given.items():
        status = F.when((stage == s) & (error == e), code).otherwise(status)
    by_stage = F.when(stage == "empty", 400).when(stage.isin("embedding", "store", "upload", "generation"), 503).otherwise(502)
    return F.when(error.isNull(), 200).otherwise(F.coalesce(status, by_stage))


def snippet(text: Column) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, SNIPPET)


def header(n: Column, source: Column, page: Column, text: Column, modality: Column, uri: Column) -> Column:
    """A chunk as it stands in the context: number, where it comes from in the wording of its modality, text."""
    start = F.concat(F.lit("["), n.cast("string"), F.lit("] Source: "), F.coalesce(source, F.lit("unknown")))
    body = F.coalesce(text, F.lit(""))
    page = F.coalesce(page, F.lit(0)).cast("string")
    return (
        F.when(is_image(modality), F.concat(start, F.lit(" (image)\nCaption: "), body))
        .when((modality == "video_clip") & has_uri(uri), F.concat(start, F.lit(" (video clip)\n"), body))
        .otherwise(F.concat(start, F.lit(", Page: "), page, F.lit("\n"), body))
    )


def is_image(modality: Column) -> Column:
    return F.coalesce(modality.isin("image_global", "image_local"), F.lit(False))


def has_uri(uri: Column) -> Column:
    return F.coalesce(uri, F.lit("")) != ""


def passage(text: Column, modality: Column, uri: Column, fetched: Column) -> Column:
    """A candidate's text for the reranker; empty where its picture is sent alone, a clip's summary beside its frame."""
    media = has_uri(uri) & F.coalesce(fetched, F.lit(False))
    body = F.coalesce(text, F.lit(""))
    clip = F.concat(F.lit("[Video segment] Summary: "), F.substring(body, 1, CLIP_PASSAGE), F.lit("\nFrame: "))
    return F.when(is_image(modality) & media, "").when((modality == "video_clip") & media, clip).otherwise(F.substring(body, 1, PASSAGE))


def degraded(modality: Column, uri: Column, fetched: Column) -> Column:
    """Whether a chunk's picture or frame should be there and could not be fetched."""
    return (is_image(modality) | F.coalesce(modality == "video_clip", F.lit(False))) & has_uri(uri) & ~F.coalesce(fetched, F.lit(False))


# ---------------------------------------------------------------- outputs of models


def fenced_block(raw: Column) -> Column:
    """What stands in the first code fence of an output that begins with one, without its json mark; else all."""
    raw = stripped(raw)
    return F.when(raw.startswith("```"), F.regexp_replace(F.get(F.split(raw, "```", -1), F.lit(1)), "^json", "")).otherwise(raw)


def without_fence_lines(raw: Column) -> Column:
    """An output without its first line if that opens a fence and without its last if that closes one."""
    raw = stripped(raw)
    return F.when(raw.startswith("```"), stripped(F.regexp_replace(F.regexp_replace(raw, r"^[^\n]*(\n|$)", ""), r"(^|\n)[ \t]*```[ \t]*$", ""))).otherwise(raw)


def without_fences(raw: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(stripped(raw), r"^```(?:json)?\s*", ""), r"\s*```$", "")


def rerank_scores(raw: Column) -> Column:
    """Array of (id, score) of a reranker's output; null if it can't be read as a whole."""
    items = F.from_json(fenced_block(raw), "array<struct<id:string,score:string>>")
    read = F.transform(items, lambda x: F.struct(x["id"].try_cast("int").alias("id"), x["score"].try_cast("double").alias("score")))
    return F.when(~F.exists(read, lambda x: x["id"].isNull() | x["score"].isNull()), read)


def judged(raw: Column, field: str, most: float) -> Column:
    """Struct (score, reasoning) of a judge's output: the score within 0 to most, or 0 and the output's start if it can't be read."""
    clean = without_fence_lines(raw)
    data = F.from_json(clean, f"struct<{field}:string,reasoning:string>")
    score = data[field].try_cast("double")
    good = score.isNotNull() & data["reasoning"].isNotNull()
    failed = F.concat(F.lit("parse_error: "), F.substring(F.coalesce(clean, F.lit("")), 1, RAW))
    return F.struct(F.when(good, F.greatest(F.lit(0.0), F.least(F.lit(float(most)), score))).otherwise(0.0).alias("score"), F.when(good, data["reasoning"]).otherwise(failed).alias("reasoning"))


def caption(text: Column) -> Column:
    """A model's caption without its labels."""
    return stripped(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)(transcription|description)\s*:\s*", ""))


# ---------------------------------------------------------------- stems (Porter, 1980)


def _measure(stem: str) -> int:
    """Number of vowel-consonant changes."""
    kinds = "".join("c" if _consonant(stem, i) else "v" for i in range(len(stem)))
    return sum(kinds[i : i + 2] == "vc" for i in range(len(kinds) - 1))


def _consonant(w: str, i: int) -> bool:
    return w[i] not in "aeiou" and (w[i] != "y" or i == 0 or not _consonant(w, i - 1))


def _vowel_in(stem: str) -> bool:
    return any(not _consonant(stem, i) for i in range(len(stem)))


def _short_end(w: str) -> bool:
    return len(w) > 2 and _consonant(w, len(w) - 1) and not _consonant(w, len(w) - 2) and _consonant(w, len(w) - 3) and w[-1] not in "wxy"


#: Suffixes of the published algorithm's steps 2, 3 and 4.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _longest(w: str, suffixes) -> str | None:
    return max((s for s in suffixes if w.endswith(s)), key=len, default=None)


def stem(w: str) -> str:
    if len(w) < 3:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = next((s for s in ("ed", "ing") if w.endswith(s) and _vowel_in(w[: -len(s)])), None)
        if cut:
            w = w[: -len(cut)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _short_end(w):
                w += "e"
    if w.endswith("y") and _vowel_in(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        s = _longest(w, table)
        if s and _measure(w[: -len(s)]) > 0:
            w = w[: -len(s)] + table[s]
    s = _longest(w, STEP4)
    if s and _measure(w[: -len(s)]) > 1 and (s != "ion" or w[: -len(s)].endswith(("s", "t"))):
        w = w[: -len(s)]
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short_end(w[:-1])):
            w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


@pandas_udf(StringType())
def stemmed(words: pd.Series) -> pd.Series:
    """Stems of a column of words; each different word of a batch is stemmed once."""
    return words.map({w: stem(w) for w in words.dropna().unique()})
