"""Models and services as functions over rows, with batches and retries; offline stand-ins exercise the contract.

A provider is a plain function that a task calls for a batch of rows. What it returns
becomes columns; what it throws is retried or, at the end, either ends the job or becomes
an error column, by the operator's rule. Keys and clients belong into the function.
"""

from __future__ import annotations

import math
import time
import zlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .chunking import BATCHES

#: Statuses worth another try, and those that remote-procedure codes stand for.
RETRYABLE = (429, 500, 502, 503, 504)
RPC_STATUS = {8: 429, 13: 500, 14: 503}
ATTEMPTS = 3


class ProviderError(RuntimeError):
    def __init__(self, kind: str, attempts: int, cause: Exception):
        super().__init__(f"{kind}: failed after {attempts} attempts: {cause}")
        self.attempts = attempts


def status_of(error: Exception) -> int | None:
    """The HTTP status that an error carries; None for operating-system errors and those that carry none."""
    if isinstance(error, OSError):
        return None
    for name in ("code", "status_code"):
        if isinstance(found := getattr(error, name, None), int):
            return found
    return RPC_STATUS.get(getattr(getattr(error, "grpc_status_code", None), "value", None))


def with_retry(call: Callable, kind: str = "call", attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep):
    """call(), tried again after 1, 2, ... seconds; a permanent status ends it at once."""
    if attempts < 1:
        raise ProviderError(kind, 0, ValueError("attempts must be at least 1"))
    for k in range(1, attempts + 1):
        try:
            return call()
        except ProviderError:
            raise
        except Exception as e:
            status = status_of(e)
            if k == attempts or (status is not None and status not in RETRYABLE):
                raise ProviderError(kind, k, e) from e
            sleep(2.0 ** (k - 1))


def embed_batch(kinds: Sequence[str], inputs: Sequence, embed: Callable) -> list:
    """Vectors of one batch, which must be of one kind."""
    if len(set(kinds)) > 1:
        raise ValueError(f"a batch of several kinds: {sorted(set(kinds))}")
    return with_retry(lambda: embed(kinds[0], list(inputs)), kinds[0])


def embed_chunks(chunks: DataFrame, embed: Callable[[str, list], list], source: str = "embed_text") -> DataFrame:
    """chunks (type, ...) with embedding; embed(kind, inputs) gets the kind's batch size at most, within a partition. Unknown kinds get null."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            vectors: list = [None] * len(pdf)
            for kind, size in BATCHES.items():
                at = [k for k, t in enumerate(pdf["type"]) if t == kind]
                for s in range(0, len(at), size):
                    part = at[s : s + size]
                    for k, v in zip(part, embed_batch([kind] * len(part), pdf[source].iloc[part], embed), strict=True):
                        vectors[k] = v
            yield pdf.assign(embedding=pd.Series(vectors, index=pdf.index, dtype=object))

    return chunks.mapInPandas(run, chunks.drop("embedding").schema.add("embedding", ArrayType(FloatType())))


def ask(rows: DataFrame, prompt: str, model: Callable[[str], str], out: str = "output", attempts: int = ATTEMPTS) -> DataFrame:
    """rows with the model's output for a column of prompts and error, its message if it failed; null prompts aren't asked."""

    def one(p: str | None) -> tuple[str | None, str | None]:
        if p is None:
            return None, None
        try:
            return with_retry(lambda: model(p), "model", attempts), None
        except ProviderError as e:
            return None, str(e)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            got = [one(p) for p in pdf[prompt]]
            yield pdf.assign(**{out: [g[0] for g in got], "error": [g[1] for g in got]})

    return rows.mapInPandas(run, rows.drop(out, "error").schema.add(out, "string").add("error", "string"))


def expanded(questions: DataFrame, model: Callable[[str], str]) -> DataFrame:
    """questions (qid, question) with expansion, a hypothetical answer; a failure, or an empty one, leaves the question."""
    asked = ask(questions, "question", model, "_x")
    return asked.withColumn("expansion", F.coalesce(F.nullif(F.trim("_x"), F.lit("")), "question")).drop("_x", "error")


# ---------------------------------------------------------------- offline stand-ins


def hashed_vectors(kind: str, texts: list, width: int = 64) -> list[list[float]]:
    """Unit vectors of hashed words."""
    out = []
    for t in texts:
        v = [0.0] * width
        for w in (t or "").lower().split():
            v[zlib.crc32(w.encode()) % width] += 1.0
        length = math.sqrt(sum(x * x for x in v)) or 1.0
        out.append([x / length for x in v])
    return out


def overlap(question: str, text: str) -> float:
    """Share of the question's words that a text has."""
    q = set((question or "").lower().split())
    return len(q & set((text or "").lower().split())) / max(1, len(q))
