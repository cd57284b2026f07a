"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams on the executors, one dense vector of hash buckets per
language and task, and adds the vectors up in blocks, so what is shuffled
depends on the languages and tasks only. The log-probability matrix
(``buckets`` x languages, at most ``max_languages``) is broadcast; a batch of
texts is scored as one sparse product: a gather of matrix rows by bucket and a
segmented sum by document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common

ORDERS = (1, 2, 3, 4)
BUCKET_BITS = 15
BLOCKS = 64
SMOOTHING = 0.5
MAX_LANGUAGES = 400
#: Code points handled at once; bounds the memory of a batch.
CHUNK = 1 << 20


@dataclass
class Model:
    """``log_prob[bucket, language]`` and ``log_prior[language]``; languages in code-point order."""

    languages: list[str]
    log_prob: np.ndarray
    log_prior: np.ndarray


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document index, bucket) of every n-gram, ordered by n, then position; and which texts have a letter.

    Texts are lower-cased, runs of other characters than letters become one
    space, and each text is framed by spaces.
    """
    lower = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), [len(t) for t in lower])
    letter = _letters()[codes]
    has_letter = np.bincount(doc[letter], minlength=len(texts)) > 0
    keep = letter.copy()
    keep[0:1] = True
    keep[1:] |= letter[:-1] | (doc[1:] != doc[:-1])  # the first of a run of other characters
    codes, doc, letter = codes[keep].astype(np.uint64), doc[keep], letter[keep]
    codes[~letter] = 32
    docs, buckets = [], []
    value = np.zeros(len(codes), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if len(codes) < n:
            break
        value = value[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :]
        if n in ORDERS:
            whole = doc[n - 1 :] == doc[: len(codes) - n + 1]
            if n == 1:
                whole &= letter
            hashed = (value[whole] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            docs.append(doc[: len(whole)][whole])
            buckets.append((hashed >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
    empty = [np.zeros(0, np.int64)]
    return np.concatenate(docs or empty), np.concatenate(buckets or empty), has_letter


def fit(df: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Counts over all rows with a language; null texts add nothing, an empty table gives a model of no language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            body, langs = common.strings(batch.column(0)), batch.column(1).to_pylist()
            for a, b in common.slices([len(t) for t in body], CHUNK):
                doc, bucket, _ = grams(body[a:b])
                names = sorted(set(langs[a:b]))
                place = {name: i for i, name in enumerate(names)}
                of = np.array([place[x] for x in langs[a:b]], np.int64)
                width = 1 << BUCKET_BITS
                sums = np.bincount(of[doc] * width + bucket, minlength=len(names) * width).reshape(len(names), width)
                rows = np.bincount(of, minlength=len(names))
                for i, name in enumerate(names):
                    if name not in totals and len(totals) >= MAX_LANGUAGES:
                        raise ValueError(f"more than {MAX_LANGUAGES} languages")
                    total = totals.setdefault(name, np.zeros(width + BLOCKS, np.int64))
                    total[:width] += sums[i]
                    total[width] += rows[i]
        for name, total in totals.items():
            parts = [*total[: 1 << BUCKET_BITS].reshape(BLOCKS, -1), total[1 << BUCKET_BITS :]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(parts)), pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())],
                names=["lang", "block", "counts"],
            )

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.int64) for x in pdf.counts)
        return pd.DataFrame({"lang": [pdf.lang[0]], "block": [pdf.block[0]], "counts": [total.tobytes()]})

    schema = "lang string, block int, counts binary"
    rows = df.where(F.col(lang).isNotNull()).select(F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("l"))
    found = rows.mapInArrow(count, schema).groupBy("lang", "block").applyInPandas(add, schema).collect()
    languages = sorted({r.lang for r in found})
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    counts = np.zeros((len(languages), 1 << BUCKET_BITS))
    docs = np.zeros(len(languages))
    blocks = counts.reshape(len(languages), BLOCKS, (1 << BUCKET_BITS) // BLOCKS)
    for r in found:
        values = np.frombuffer(r.counts, np.int64)
        if r.block == BLOCKS:
            docs[languages.index(r.lang)] = values[0]
        else:
            blocks[languages.index(r.lang), r.block] = values
    log_prob = np.log(counts + SMOOTHING) - np.log((counts + SMOOTHING).sum(1, keepdims=True))
    return Model(languages, np.ascontiguousarray(log_prob.T), np.log(docs / docs.sum()) if len(docs) else docs)


def score_batch(model: Model, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text.

    The language maximises log prior + sum of log probabilities. The score is
    the softmax of these sums over sqrt(number of n-grams), which keeps the
    order but doesn't run to 1 on every long text.
    """
    k = len(model.languages)
    doc, bucket, has_letter = grams(texts)
    joint, count = np.zeros((len(texts), k)), np.bincount(doc, minlength=len(texts))
    step = max(1, (4 << 20) // max(k, 1))
    for a in range(0, len(doc), step):
        d = doc[a : a + step]
        starts = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
        np.add.at(joint, d[starts], np.add.reduceat(model.log_prob[bucket[a : a + step]], starts, axis=0))
    if not k:
        return ["und"] * len(texts), np.zeros(len(texts))
    joint += model.log_prior
    best = joint.argmax(1)
    tempered = (joint - joint.max(1, keepdims=True)) / np.sqrt(np.maximum(count, 1))[:, None]
    score = 1 / np.exp(tempered).sum(1)
    return [model.languages[i] if ok else "und" for i, ok in zip(best, has_letter)], np.where(has_letter, score, 0.0)


def predict(df: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row; ``und`` and 0 for null texts and texts without a letter."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, langs, scores = common.strings(batch.column(1)), [], []
            for a, b in common.slices([len(t) for t in body], CHUNK):
                x, y = score_batch(shared.value, body[a:b])
                langs += x
                scores += y.tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[id, "lang_pred", "score"])

    kind = df.schema[id].dataType.simpleString()
    return df.select(id, F.col(text).cast("string").alias("t")).mapInArrow(run, f"`{id}` {kind}, lang_pred string, score double")


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents; learned from those with crc32(doc_id) mod 4 other than 2."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = common.crc_mod("doc_id", 4) == 2
    model = fit(docs.where(~held_out))
    return predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
