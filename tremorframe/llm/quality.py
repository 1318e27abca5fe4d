"""Quality scores by nearest-neighbour voting in a latent-semantic space (operator 8).

Texts become counts of hashed words and character trigrams (both without case), of shape trigrams
(letters by case, digits, blanks, each punctuation mark) and of repetition terms; characters are code
points. Weighted by inverse document frequency and projected onto the leading singular vectors of the
labelled sample they become unit vectors. Every document is compared with all broadcast labelled
vectors in blocks, exactly; its nearest neighbours vote with their labels, weighted by similarity.

Defined cases: NULL and empty texts have the zero vector and get the mean label of the sample, as
does every text when nothing was learned (0.5 without labels). Texts are read whole. Similarity
ties keep all tied neighbours, so that the order of the sample is never seen. Documents with
several label rows count once, with the smallest label; NULL labels teach nothing. Repeated rows
each get their own equal score; other columns are never read. Of several rows with a labelled
doc_id the text with the smallest hash is learned, NULL only if there is no other.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from typing import Iterator, NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorframe.llm import common

# Hashed terms of each kind; shapes end with _REPEATS terms that stand for repetition.
SHAPES, WORDS, GRAMS = 4096, 2048, 2048
TERMS = SHAPES + WORDS + GRAMS
RANK = 48
# Neighbours that vote, and the most labelled texts that are learned (the first by hash of the id).
NEIGHBOURS = 25
TRAIN_TEXTS = 4000
THRESHOLD = 0.7
_REPEATS = 64
# Texts whose counts a worker holds at a time; a batch of texts stays Arrow data but for these.
_ROWS = 128


class Model(NamedTuple):
    weights: np.ndarray  # inverse document frequencies
    basis: np.ndarray  # (TERMS, rank)
    vectors: np.ndarray  # (labelled texts, rank), unit length
    labels: np.ndarray
    mean: float


@lru_cache(maxsize=1)
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """(class, lower form) of every code point.

    Classes: blank, line end, lower letter (and letters without case), capital, digit, marks.
    """
    kinds = {"Lu": 3, "Lt": 3, "Nd": 4, "Zs": 0, "Cc": 0}
    classes, lower = np.full(0x110000, 2, dtype=np.uint8), np.arange(0x110000, dtype=np.uint32)
    for c in range(0x30000):  # planes beyond hold letters without case and unassigned points alone
        kind = unicodedata.category(chr(c))
        classes[c] = 5 + c % 57 if kind[0] in "PS" else kinds.get(kind, 2)
        if kind in ("Lu", "Lt"):
            small = chr(c).lower()
            lower[c] = ord(small) if len(small) == 1 else c
    classes[[10, 13]] = 1
    return classes, lower


def _trigrams(x: np.ndarray, kinds: int) -> np.ndarray:
    x = x.astype(np.uint64)
    key = (x[:-2] << np.uint64(42)) | (x[1:-1] << np.uint64(21)) | x[2:]
    return (common.mix(key) % np.uint64(kinds)).astype(np.int64)


def term_counts(texts: list) -> np.ndarray:
    """(texts, TERMS) counts of shape trigrams, repetition terms, words and character trigrams."""
    classes, lower = _characters()
    whole = [t or "" for t in texts]
    sizes = np.array([len(t) + 2 for t in whole], dtype=np.int64)
    points = np.frombuffer("".join(t + "  " for t in whole).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    owner = np.repeat(np.arange(len(whole)), sizes)
    same = owner[:-2] == owner[2:]
    first = owner[:-2][same] * TERMS
    words, offsets = common.word_hashes(texts)
    holder = np.repeat(np.arange(len(whole)), np.diff(offsets))
    found = [
        first + _trigrams(classes[points], SHAPES - _REPEATS)[same],
        holder * TERMS + SHAPES + (words % np.uint64(WORDS)).astype(np.int64),
        first + SHAPES + WORDS + _trigrams(lower[points], GRAMS)[same],
    ]
    out = np.bincount(np.concatenate(found), minlength=len(whole) * TERMS)
    out = out.reshape(len(whole), TERMS).astype(np.float32)
    total = np.maximum(np.diff(offsets), 1)
    again = np.zeros(len(words), dtype=bool)
    if len(words):
        again[1:] = (words[1:] == words[:-1]) & (holder[1:] == holder[:-1])
    adjacent = np.bincount(holder[again], minlength=len(whole))
    order = np.lexsort((words, holder))
    repeated = np.zeros(len(words), dtype=bool)
    repeated[1:] = (words[order][1:] == words[order][:-1]) & (holder[order][1:] == holder[order][:-1])
    seen = np.bincount(holder[order][repeated], minlength=len(whole))
    # shares of repeated words become counts of one of 32 graded terms each, as heavy as the text is long
    for share, at in ((adjacent / total, SHAPES - _REPEATS), (seen / total, SHAPES - _REPEATS + 32)):
        level = np.minimum((share * 32).astype(np.int64), 31)
        out[np.arange(len(whole)), at + level] += np.diff(offsets)
    return out


def _blocks(texts: list, rows: int = _ROWS):
    """Ranges of ``texts`` of about 250,000 characters and at most ``rows`` texts, so that counts stay bounded."""
    for lo, hi in common.slices(texts, 250_000):
        for at in range(lo, hi, rows):
            yield at, min(at + rows, hi)


def _directions(weighted: np.ndarray, basis: np.ndarray) -> np.ndarray:
    vectors = weighted @ basis
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return (vectors / np.where(length > 0, length, 1)).astype(np.float32)


def project(counts: np.ndarray, weights: np.ndarray, basis: np.ndarray) -> np.ndarray:
    return _directions(np.log1p(counts) * weights, basis)


def fit(docs: DataFrame, labels: DataFrame, train_texts: int = TRAIN_TEXTS) -> Model:
    """Model from ``docs`` (doc_id, text) and ``labels`` (doc_id, quality): at most ``train_texts`` rows, one of each doc_id."""
    marked = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL")
    marked = marked.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_texts)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    first = F.min(F.struct(F.col("text").isNull().alias("none"), F.xxhash64("text").alias("draw"), "text"))
    texts = texts.groupBy("doc_id", "quality").agg(first.alias("first")).select("doc_id", "quality", "first.text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            values = [t if isinstance(t, str) else None for t in pdf["text"]]
            for lo, hi in _blocks(values):
                found = term_counts(values[lo:hi])
                at = [np.flatnonzero(row) for row in found]
                yield pd.DataFrame(
                    {
                        "doc_id": pdf["doc_id"].iloc[lo:hi],
                        "quality": pdf["quality"].iloc[lo:hi],
                        "terms": [x.astype("<i4").tobytes() for x in at],
                        "counts": [r[x].astype("<f4").tobytes() for r, x in zip(found, at)],
                    }
                )

    rows = texts.mapInPandas(count, "doc_id long, quality int, terms binary, counts binary").collect()
    rows = sorted(rows, key=lambda r: r["doc_id"])
    matrix = np.zeros((len(rows), TERMS), dtype=np.float32)
    for i, r in enumerate(rows):
        matrix[i, np.frombuffer(bytes(r["terms"]), dtype="<i4")] = np.frombuffer(bytes(r["counts"]), dtype="<f4")
    targets = np.array([r["quality"] for r in rows], dtype=np.float32)
    if not rows:
        return Model(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), targets, 0.5)
    weights = np.log((1 + len(rows)) / (1 + (matrix > 0).sum(axis=0))).astype(np.float32) + np.float32(0.1)
    # in place: the sample's matrix is the driver's largest array
    np.log1p(matrix, out=matrix)
    matrix *= weights
    basis = singular_basis(matrix, RANK)
    return Model(weights, basis, _directions(matrix, basis), targets, float(targets.mean()))


def singular_basis(matrix: np.ndarray, rank: int) -> np.ndarray:
    """Leading right singular vectors by subspace iteration from a fixed start."""
    matrix = matrix.astype(np.float32, copy=False)
    start = np.random.default_rng(7).standard_normal((matrix.shape[1], min(rank + 16, *matrix.shape)))
    span = np.linalg.qr(start)[0].astype(np.float32)
    for _ in range(4):
        span = np.linalg.qr(matrix.T @ (matrix @ span))[0]
    _, _, right = np.linalg.svd(matrix @ span, full_matrices=False)
    return (span @ right.T)[:, :rank].astype(np.float32)


def vote(vectors: np.ndarray, model: Model) -> np.ndarray:
    """Similarity-weighted mean label of the nearest labelled vectors of every row."""
    out = np.full(len(vectors), model.mean, dtype=np.float64)
    if not len(model.labels):
        return out
    k = min(NEIGHBOURS, len(model.labels))
    for lo in range(0, len(vectors), 512):
        block = vectors[lo : lo + 512]
        near = block @ model.vectors.T
        kth = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k][:, None]
        weight = np.where(near >= kth, np.maximum(near, 0.0) ** 8, 0.0).astype(np.float64)
        mass = weight.sum(axis=1)
        good = (mass > 0) & (np.abs(block).sum(axis=1) > 0)
        score = (weight @ model.labels.astype(np.float64)) / np.where(mass > 0, mass, 1)
        out[lo : lo + 512] = np.where(good, score, model.mean)
    return np.clip(out, 0.0, 1.0)


def scores(batch: pa.Array, model: Model) -> pa.Array:
    """Scores of an Arrow batch of texts, of which a few at a time become strings and counts."""
    out = np.zeros(len(batch))
    for begin in range(0, len(batch), _ROWS):
        texts = [t if isinstance(t, str) and t else None for t in batch.slice(begin, _ROWS).to_pylist()]
        for lo, hi in _blocks(texts):
            vectors = project(term_counts(texts[lo:hi]), model.weights, model.basis)
            vectors[[t is None for t in texts[lo:hi]]] = 0
            out[begin + lo : begin + hi] = vote(vectors, model)
    return pa.array(out)


def scorer(spark: SparkSession, model: Model):
    """Column function text -> score; the broadcast model is bounded by the sample's size."""
    shared = spark.sparkContext.broadcast(tuple(model))

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held = Model(*shared.value)
        for texts in batches:
            yield scores(texts, held)

    return score


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents", "doc_id", "text")
    labels = common.read(spark, sf_dir, "labels", "doc_id", "quality")
    model = fit(docs, labels.filter(common.fold("doc_id", 4) != 2))
    held = F.coalesce(common.fold("doc_id", 4) == 2, F.lit(False))
    found = docs.select("doc_id", held.alias("held_out"), scorer(spark, model)("text").alias("score"))
    return found.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


QUERIES = {"op8_quality": op8_quality}
