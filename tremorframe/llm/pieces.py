"""SentencePiece encoding and decoding (operator 1).

An Aho-Corasick automaton over the pieces reports, at every position, all pieces that end there:
the longest one and, along its output links, the shorter ones. A single pass relaxes the best score
of every position from these matches; back pointers give the pieces. Characters that no piece
covers cost a fixed penalty and become byte pieces, so that decoding restores every text exactly.

Spaces are written as U+2581 and one is put in front of the text, as the vocabulary expects. A
U+2581 of the text itself is written as its three bytes, so the round trip stays exact. Pieces have
this mark at their start only, hence no piece spans a border between a word and a following
space, and the best path of a text is the best paths of its units joined. Units repeat, so each
worker keeps a bounded table of those it has seen; a vocabulary with other pieces is searched over
whole texts.

Defined cases: NULL text gives NULL ids; empty text gives no ids. Equal scores keep the longer last
piece. Texts are taken whole. Lone surrogates, which Spark strings cannot hold, do not occur.
Repeated rows each get their own equal result; other columns are never read.
"""

from __future__ import annotations

import hashlib
import os
import re
import sys
from typing import Iterator, NamedTuple, Optional

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from tremorframe.llm import common

SPACE = "▁"
MODEL = "piece_bpe_32k.model"
UNKNOWN_PENALTY = 10.0
_CACHE_UNITS, _CACHE_LENGTH = 400_000, 48
# Ids of so many rows leave the worker at a time.
_ROWS_OUT = 256


class Vocabulary(NamedTuple):
    pieces: list  # (piece, id, score) of the matchable pieces
    byte_ids: list  # id of each byte piece
    decoded: list  # bytes that each id stands for


def model_path(name: str = MODEL) -> str:
    """Place of a public vocabulary file: folder ``TOKENIZER_DIR``, else the installed package."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, byte_ids, decoded = [], [0] * 256, []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            value = int(piece[1:-1], 16)
            byte_ids[value] = i
            decoded.append(bytes([value]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            decoded.append(b"")
        else:
            pieces.append((piece, i, float(model.get_score(i))))
            decoded.append(piece.replace(SPACE, " ").encode())
    return Vocabulary(pieces, byte_ids, decoded)


class Encoder:
    """Encodes and decodes single texts; one lives in each Python worker."""

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, i, score in vocabulary.pieces:
            self.automaton.add_word(piece, (len(piece), i, score))
        self.automaton.make_automaton()
        self.unknown = min((p[2] for p in vocabulary.pieces), default=0.0) - UNKNOWN_PENALTY
        self.byte_ids, self.decoded = vocabulary.byte_ids, vocabulary.decoded
        self.by_unit = all(SPACE not in p.lstrip(SPACE) for p, _, _ in vocabulary.pieces)
        self.known: dict[str, bytes] = {}

    def best(self, text: str) -> list[int]:
        """Ids of the best path over ``text``, whose spaces are already marked."""
        size = len(text)
        score = [0.0] + [-np.inf] * size
        length = [1] * (size + 1)
        ident = [-1] * (size + 1)
        done = 0  # positions up to here are final
        for last, (n, i, gain) in self.automaton.iter(text):
            end = last + 1
            while done < last:  # positions that no match ended at: an unknown character
                done += 1
                base = score[done - 1] + self.unknown
                if base > score[done]:
                    score[done], length[done], ident[done] = base, 1, -1
            candidate = score[end - n] + gain
            if candidate > score[end]:
                score[end], length[end], ident[end] = candidate, n, i
        while done < size:
            done += 1
            base = score[done - 1] + self.unknown
            if base > score[done]:
                score[done], length[done], ident[done] = base, 1, -1
        path, at = [], size
        while at > 0:
            if ident[at] >= 0:
                path.append(ident[at])
            else:
                path.extend(self.byte_ids[b] for b in reversed(text[at - 1].encode("utf-8")))
            at -= length[at]
        path.reverse()
        return path

    def unit(self, text: str) -> bytes:
        found = self.known.get(text)
        if found is None:
            found = np.array(self.best(text), dtype="<i4").tobytes()
            if len(text) <= _CACHE_LENGTH:
                if len(self.known) >= _CACHE_UNITS:
                    self.known.clear()
                self.known[text] = found
        return found

    def _span(self, text: str) -> bytes:
        marked = text.replace(" ", SPACE)
        if not self.by_unit:
            return np.array(self.best(marked), dtype="<i4").tobytes()
        if "  " in text:
            parts = re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", marked)
        else:
            head, *rest = marked.split(SPACE)
            parts = ([head] if head else []) + [SPACE + part for part in rest]
        unit = self.unit
        return b"".join([unit(part) for part in parts])

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype="<i4")
        spaced = " " + text
        if SPACE not in spaced:
            return np.frombuffer(self._span(spaced), dtype="<i4")
        mark = np.array([self.byte_ids[b] for b in SPACE.encode()], dtype="<i4").tobytes()
        spans = [self._span(part) if part else b"" for part in spaced.split(SPACE)]
        return np.frombuffer(mark.join(spans), dtype="<i4")

    def decode(self, ids) -> str:
        table = self.decoded
        values = ids.tolist() if isinstance(ids, np.ndarray) else ids
        text = b"".join([table[i] for i in values]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def _worker(path: str) -> Encoder:
    """The worker's encoder: kept between tasks under the interpreter's own module table."""
    held = sys.modules.setdefault("_piece_encoders", type(sys)("_piece_encoders"))
    made = held.__dict__.setdefault("made", {})
    if path not in made:
        made[path] = Encoder(load(path))
    return made[path]


def encode_ids(path: str):
    """Column function text -> array of piece ids."""

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _worker(path)
        for texts in batches:
            yield pd.Series([encoder.encode(t) if isinstance(t, str) else None for t in texts], dtype=object)

    return encode


def encode_rows(docs: DataFrame, path: str, *keep: str) -> DataFrame:
    """Columns ``keep`` of ``docs`` and ``piece_ids``, the ids of its ``text``.

    Rows pass through as Arrow data and ids leave every few hundred rows, so a worker holds one batch
    of texts but neither its strings nor its ids.
    """
    kept = docs.select(*keep)
    schema = StructType([*kept.schema.fields]).add("piece_ids", ArrayType(IntegerType()))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _worker(path)
        for batch in batches:
            for begin in range(0, batch.num_rows, _ROWS_OUT):
                *columns, texts = batch.slice(begin, _ROWS_OUT).columns
                values = (text.as_py() for text in texts)
                ids = pa.array([None if t is None else encoder.encode(t) for t in values], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*columns, ids], names=schema.names)

    return docs.select(*keep, F.col("text").cast("string").alias("_text")).mapInArrow(encode, schema)


def decode_ids(path: str):
    """Column function array of piece ids -> text."""

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _worker(path)
        for rows in batches:
            yield pd.Series([None if ids is None else encoder.decode(ids) for ids in rows], dtype=object)

    return decode


def encoded_digest(path: str):
    """Column function text -> struct<n_tokens, ids_sha256, round_trip> without moving the ids.

    The ids are encoded and decoded in the worker; only their number, the digest of their 32-bit
    little-endian form and whether decoding restored the text leave it.
    """

    @F.pandas_udf("n_tokens long, ids_sha256 string, round_trip boolean")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = _worker(path)

        def one(text: Optional[str]):
            if not isinstance(text, str):
                return None, None, None
            ids = encoder.encode(text)
            return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), encoder.decode(ids) == text

        for texts in batches:
            found = pd.DataFrame([one(t) for t in texts], columns=["n_tokens", "ids_sha256", "round_trip"])
            yield found.astype({"n_tokens": "Int64", "round_trip": "boolean"})

    return digest


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, round_trip of every whole text."""
    docs = common.read(spark, sf_dir, "documents", "doc_id", "text")
    return docs.select("doc_id", encoded_digest(model_path())("text").alias("_e")).select("doc_id", "_e.*")


QUERIES = {"op1_sentencepiece": op1_sentencepiece}
