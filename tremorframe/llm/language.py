"""Language identification by a mixture of character n-gram models (operator 7).

A text is taken as drawn from several languages at once. Expectation-maximisation finds the
proportions from n-gram likelihoods; languages are added while the log-likelihood gains more than
a penalty per language. The prediction is the language with the largest proportion in the chosen
set, and the score that proportion.

Defined cases: NULL text, or one without a letter, gives ``und`` with score 0. Without any learned
language everything is ``und``. Texts are read whole. Ties go to the language that sorts first.
Repeated rows each get their own equal prediction; other columns are never read.
"""

from __future__ import annotations

import re
import zlib
from typing import Iterator, Optional

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tremorframe.llm import common

UNKNOWN = "und"
BUCKETS = 1 << 16
# The models are fitted on at most so many texts of each language, the first by hash of their id.
RANKED_PARTS = 64
TRAIN_TEXTS = 2000
# Neighbouring n-grams overlap, so the gain of a language must beat three times the usual penalty.
PENALTY = 1.5
ROUNDS = 20
_LETTER = re.compile(r"[^\W\d_]")
_PRIME = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)


def ngram_ids(text: str) -> np.ndarray:
    """Hashed ids of the character trigrams of the lower-cased text; non-letters of ASCII are blanks."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ascii_ = points < 128
    letter = (points >= 97) & (points <= 122)
    points = np.where(ascii_ & ~letter, np.uint32(32), points)
    blank = points == 32
    points = points[~(blank & np.concatenate(([False], blank[:-1])))]
    points = np.concatenate(([np.uint32(32)], points, [np.uint32(32)]))
    if len(points) < 3:
        return np.zeros(0, dtype=np.int64)
    a, b, c = (p * np.uint32(k) for p, k in zip((points[:-2], points[1:-1], points[2:]), _PRIME))
    h = a ^ ((b << np.uint32(11)) | (b >> np.uint32(21))) ^ ((c << np.uint32(22)) | (c >> np.uint32(10)))
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(16)).astype(np.int64)


def mixture(counts: np.ndarray, likelihood: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """(proportions, log-likelihood) of n-grams with ``counts`` and per-language ``likelihood`` rows."""
    share = np.full(likelihood.shape[1], 1.0 / likelihood.shape[1])
    before, total = -np.inf, counts.sum()
    for _ in range(rounds):
        joint = likelihood * share
        mass = joint.sum(axis=1)
        now = float(counts @ np.log(mass))
        share = ((counts / mass) @ joint) / total
        if now - before < 1e-3:
            break
        before = now
    return share, now


def identify(text: Optional[str], languages: list[str], table: np.ndarray, logs: np.ndarray) -> tuple[str, float]:
    """Prediction for one text; ``table`` holds P(n-gram | language) as (bucket, language)."""
    if text is None or not languages or not _LETTER.search(text):
        return UNKNOWN, 0.0
    ids = ngram_ids(text)
    if not len(ids):
        return UNKNOWN, 0.0
    if len(ids) > 4096:
        all_counts = np.bincount(ids, minlength=BUCKETS)
        ids = np.flatnonzero(all_counts)
        counts = all_counts[ids].astype(np.float64)
    else:
        ids, counts = np.unique(ids, return_counts=True)
        counts = counts.astype(np.float64)
    alone = counts @ logs[ids]
    if len(languages) == 1:
        return languages[0], 1.0
    rows = table[ids]
    order = [int(np.argmax(alone))]
    best, chosen, share = float(alone[order[0]]), order, np.ones(1)
    # the next language to try is the one that most often explains n-grams better than the chosen ones
    penalty = PENALTY * np.log(max(counts.sum(), 2.0))
    while len(chosen) < len(languages):
        rest = [i for i in range(len(languages)) if i not in chosen]
        floor = rows[:, chosen].max(axis=1)
        gains = [float(counts @ np.log(np.maximum(rows[:, i], floor) / floor)) for i in rest]
        if max(gains) <= penalty:
            break  # a mixture cannot gain more than the better of both at each n-gram
        trial = chosen + [rest[int(np.argmax(gains))]]
        proportions, likelihood = mixture(counts, rows[:, trial])
        if likelihood - penalty <= best:
            break
        best, chosen, share = likelihood - penalty, trial, proportions
    at = min(range(len(chosen)), key=lambda i: (-share[i], languages[chosen[i]]))
    return languages[chosen[at]], float(min(max(share[at], 0.0), 1.0))


def fit(docs: DataFrame, train_texts: int = TRAIN_TEXTS) -> tuple[list[str], np.ndarray]:
    """Languages and P(n-gram | language) from ``docs`` (doc_id, text, lang): a table of fixed width.

    The sample is chosen by id and label alone; texts are read only for the chosen rows, and only
    bucket counts per language reach the driver.
    """
    ranked = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang").distinct()
    # ranked in parts first, so that no task sees all ids of a language; then train_texts of a few parts each
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(RANKED_PARTS)).alias("part")
    sample = ranked.select("doc_id", "lang", part)
    for within in (["lang", "part"], ["lang"]):
        order = W.partitionBy(*within).orderBy(F.xxhash64("doc_id"), "doc_id")
        sample = sample.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= train_texts).drop("rank")
    sample = sample.select("doc_id", "lang")
    texts = docs.select("doc_id", "lang", "text").join(F.broadcast(sample), ["doc_id", "lang"])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"]):
                if text is not None:
                    found = np.bincount(ngram_ids(text), minlength=BUCKETS)
                    sums[lang] = sums[lang] + found if lang in sums else found
        for lang, found in sums.items():
            yield pd.DataFrame({"lang": [lang], "counts": [zlib.compress(found.astype("<i8").tobytes(), 1)]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(x), dtype="<i8") for x in pdf["counts"])
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "counts": [zlib.compress(total.tobytes(), 1)]})

    schema = "lang string, counts binary"
    rows = texts.mapInPandas(count, schema).groupBy("lang").applyInPandas(add, schema).collect()
    models = {r["lang"]: np.frombuffer(zlib.decompress(bytes(r["counts"])), dtype="<i8") for r in rows}
    languages = sorted(models)
    table = np.zeros((BUCKETS, len(languages)), dtype=np.float64)
    for i, lang in enumerate(languages):
        found = models[lang] + 0.05
        table[:, i] = found / found.sum()
    return languages, table


def predictor(spark: SparkSession, languages: list[str], table: np.ndarray):
    """Column function text -> struct<lang, score>; the broadcast model is BUCKETS x languages."""
    shared = spark.sparkContext.broadcast((languages, table.astype(np.float32)))

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names, likelihood = shared.value
        likelihood = likelihood.astype(np.float64)
        logs = np.log(likelihood) if likelihood.size else likelihood
        for texts in batches:
            found = [identify(t if isinstance(t, str) else None, names, likelihood, logs) for t in texts]
            yield pd.DataFrame(found, columns=["lang", "score"])

    return predict


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(common.fold("doc_id", 4) != 2).select("doc_id", "text", "lang")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    predict = predictor(spark, *fit(training_rows(docs)))
    held = F.coalesce(common.fold("doc_id", 4) == 2, F.lit(False))
    found = docs.select("doc_id", held.alias("held_out"), predict("text").alias("_p"))
    return found.select(
        "doc_id", "held_out", F.col("_p.lang").alias("lang_pred"), F.col("_p.score").alias("score")
    )


QUERIES = {"op7_language_id": op7_language_id}
