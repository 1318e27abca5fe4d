"""Language-model scores from an Elias-Fano n-gram trie (operator 10).

The model is an interpolated bigram model with absolute discounting over a smoothed unigram model:
P(w | u) = max(c(uw) - D, 0) / C(u) + D N(u) / C(u) P(w), with C the count of the context, N the
number of its different successors and P(w) the base of the contract. It is a trie of two levels in
shards by hash of the context. A shard keeps its contexts, the pointers to their successors and the
successors themselves as Elias-Fano sequences, and discounted probabilities as 16-bit codes on a
logarithmic grid. The levels lie in one memory-mapped file of the task that answers for the shard. A
query searches its context, follows the pointers and searches its word among values relative to the
context.

Texts stay where they are read. A first pass counts words: their number N, the different ones V, and
the contexts that would fill a quarter of a shard, which are dealt to as many shards as they have
quarters. Then a task turns its texts into chunks: ids of words in the chunk, its different words and
pairs with their training counts. A chunk sends a row to each shard for which it has any, built from
flat arrays at once, so that the work grows with the pairs and not with chunks times shards. A shard
adds up the counts of all chunks, builds its trie and searches every different pair once, in one call;
the answers meet their chunk again, which sums up its texts. The number of followers of a spread
context is asked of each of its shards. Everything that is counted or searched covers all texts and
grows with them; the driver sees N, V and at most some four spread contexts a shard.

Searches read the mapped bytes: a directory holds the stops before every 128 upper bits, so that a
position or a value is found within one such block.

Defined cases: NULL and empty texts score as the end token alone. Rows with NULL doc_id train
nothing. Without training text every count is 0: N and V are 0, and each token gets probability 1.
Repeated rows count and score each. Word identity is a 64-bit hash, successor identity within a
context a 40-bit one. Other columns are never read.
"""

from __future__ import annotations

import mmap
import tempfile
import zlib
from typing import Iterator, NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorframe.llm import common

DISCOUNT = 0.9
# Tokens that one chunk gathers, and the bytes of text whose words and pairs make one shard.
CHUNK_TOKENS = 4_500_000
SHARD_BYTES = 32 << 20
# A context is spread when it occurs more than once in so many bytes of a shard: a quarter of its
# tokens, at six bytes each.
SPREAD_BYTES = 24
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
_FP = np.uint64(24)  # successors keep the upper 40 bits of their hash
_GRID = 4096.0  # codes per factor of ten
_BLOCK = 16  # bytes of upper bits for each entry of a directory
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
_ONES = _BITS.sum(axis=1).astype(np.uint8)
# position of the k-th set bit of each byte; unset ones sort to the end
_PLACE = np.argsort(1 - _BITS, axis=1, kind="stable")


class EliasFano(NamedTuple):
    """A non-decreasing sequence: ``low`` bits packed, the upper ones in unary with one stop each."""

    n: int
    low: int
    packed: np.ndarray
    high: np.ndarray  # whole blocks
    before: np.ndarray  # stops before each block

    @staticmethod
    def of(values: np.ndarray, universe: int) -> "EliasFano":
        n = len(values)
        low = max(min((universe // max(n, 1)).bit_length() - 1, 56), 0)
        width = np.uint64(low)
        size = n + (int(values[-1] >> width) if n else 0) + 1
        bits = np.zeros(-(-size // (8 * _BLOCK)) * 8 * _BLOCK, dtype=np.uint8)
        bits[(values >> width).astype(np.int64) + np.arange(n)] = 1
        packed = np.zeros((n * low + 7) // 8 + 9, dtype=np.uint8)
        rest = values & np.uint64((1 << low) - 1)
        for b in range(low):
            at = np.arange(n, dtype=np.int64) * low + b
            bit = ((rest >> np.uint64(b)) & np.uint64(1)).astype(np.uint8)
            np.add.at(packed, at >> 3, bit << (at & 7).astype(np.uint8))
        stops = np.cumsum(bits.reshape(-1, 8 * _BLOCK).sum(axis=1, dtype=np.int64))
        return EliasFano(n, low, packed, np.packbits(bits, bitorder="little"), np.concatenate(([0], stops[:-1])))

    def lows(self, i: np.ndarray) -> np.ndarray:
        at = i * self.low
        word = np.zeros(len(i), dtype=np.uint64)
        for k in range(8):
            word |= self.packed[(at >> 3) + k].astype(np.uint64) << np.uint64(8 * k)
        return (word >> (at & 7).astype(np.uint64)) & np.uint64((1 << self.low) - 1)

    def _nth(self, i: np.ndarray, bit: int) -> np.ndarray:
        """Places of the ``i``-th upper bits that equal ``bit``: a block by the directory, the rest inside it."""
        before = self.before if bit else np.arange(len(self.before)) * (8 * _BLOCK) - self.before
        blocks = self.high.reshape(-1, _BLOCK)
        out = np.empty(len(i), dtype=np.int64)
        for lo in range(0, len(i), 1 << 16):
            want = i[lo : lo + (1 << 16)]
            block = np.searchsorted(before, want, side="right") - 1
            rest = want - before[block]
            data = blocks[block] if bit else ~blocks[block]
            ones = np.cumsum(_ONES[data], axis=1, dtype=np.uint8)
            byte = (ones <= rest[:, None]).sum(axis=1)
            row = np.arange(len(want))
            rest -= np.where(byte > 0, ones[row, byte - 1], 0)
            out[lo : lo + (1 << 16)] = (block * _BLOCK + byte) * 8 + _PLACE[data[row, byte], rest]
        return out

    def select(self, i: np.ndarray) -> np.ndarray:
        """Values at positions ``i``."""
        upper = self._nth(i, 1) - i
        return (upper.astype(np.uint64) << np.uint64(self.low)) | self.lows(i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """First position whose value is at least ``x``: gaps bound the upper bits, halving finds the lower."""
        gaps = len(self.high) * 8 - self.n
        top = (x >> np.uint64(self.low)).astype(np.int64)
        inside = top < gaps
        h = np.minimum(top, gaps - 1)
        last = np.maximum(h - 1, 0)
        begin = np.where(inside, np.where(h > 0, self._nth(last, 0) - last, 0), self.n)
        end = np.where(inside, self._nth(h, 0) - h, self.n)
        want = x & np.uint64((1 << self.low) - 1)
        while True:
            open_ = np.flatnonzero(begin < end)
            if not len(open_):
                return begin
            middle = (begin[open_] + end[open_]) >> 1
            less = self.lows(middle) < want[open_]
            begin[open_[less]] = middle[less] + 1
            end[open_[~less]] = middle[~less]


class Trie:
    """Contexts, pointers, successors and probability codes of one shard in a memory-mapped file."""

    def __init__(self, contexts, starts, successors, probabilities):
        index = np.repeat(np.arange(len(contexts), dtype=np.uint64), np.diff(starts))
        relative = (index << np.uint64(40)) | successors
        levels = [
            EliasFano.of(contexts, 1 << 64),
            EliasFano.of(starts.astype(np.uint64), len(successors) + 1),
            EliasFano.of(relative, max(len(contexts), 1) << 40),
        ]
        parts = [x for level in levels for x in (level.before, level.high, level.packed)]
        parts.insert(0, quantise(probabilities))
        self.file = tempfile.TemporaryFile()
        places = []
        for part in parts:
            self.file.write(b"\0" * (-self.file.tell() % 8))
            places.append(self.file.tell())
            self.file.write(part.tobytes())
        self.file.write(b"\0" * 8)
        self.file.flush()
        self.map = mmap.mmap(self.file.fileno(), 0, access=mmap.ACCESS_READ)
        views = [
            np.frombuffer(self.map, dtype=part.dtype, count=len(part), offset=at) for part, at in zip(parts, places)
        ]
        self.codes = views[0]
        self.contexts, self.pointers, self.successors = (
            EliasFano(level.n, level.low, views[3 * i + 3], views[3 * i + 2], views[3 * i + 1])
            for i, level in enumerate(levels)
        )

    def code(self, contexts: np.ndarray, owner: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Codes of pairs (contexts[owner], words), 0 for absent ones; ``contexts`` ascend."""
        out = np.zeros(len(words), dtype=np.uint16)
        if not self.contexts.n or not len(words):
            return out
        at = self.contexts.successor(contexts)
        there = at < self.contexts.n
        place = np.minimum(at, self.contexts.n - 1)
        there &= self.contexts.select(place) == contexts
        stop = self.pointers.select(place + 1).astype(np.int64)
        known = np.flatnonzero(there[owner])
        row = owner[known]
        want = (place[row].astype(np.uint64) << np.uint64(40)) | words[known]
        found = self.successors.successor(want)
        hit = np.flatnonzero(found < stop[row])
        hit = hit[self.successors.select(found[hit]) == want[hit]]
        out[known[hit]] = self.codes[found[hit]]
        return out

    def close(self) -> None:
        self.contexts = self.pointers = self.successors = self.codes = None
        self.map.close()
        self.file.close()


def quantise(p: np.ndarray) -> np.ndarray:
    """16-bit codes; rounding down keeps the sum of a context's probabilities at most one."""
    codes = np.ceil(-np.log10(np.maximum(p, 1e-15)) * _GRID - 1e-9) + 1
    return np.clip(codes, 1, 65535).astype(np.uint16)


def restored(codes: np.ndarray) -> np.ndarray:
    table = np.power(10.0, -np.arange(-1, 65535, dtype=np.float64) / _GRID)
    table[0] = 0.0
    return table[codes]


# -- chunks -------------------------------------------------------------------------------------


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes; planes of equal significance lie together, so that small numbers shrink."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()
        body = zlib.compress(planes, 1) if a.dtype != np.uint64 else planes
        head = f"{a.dtype.str},{len(a)},{len(body)};".encode()
        out += [head, body]
    return b"".join(out)


def _unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        stop = data.index(b";", at)
        kind, count, size = data[at:stop].decode().split(",")
        body = data[stop + 1 : stop + 1 + int(size)]
        kind = np.dtype(kind)
        planes = np.frombuffer(body if kind == np.uint64 else zlib.decompress(body), dtype=np.uint8)
        planes = planes.reshape(kind.itemsize, int(count)).T
        out.append(np.ascontiguousarray(planes).view(kind).reshape(-1))
        at = stop + 1 + int(size)
    return out


def _sequence(tokens: np.ndarray, offsets: np.ndarray, start: int) -> np.ndarray:
    """Context of every token: the one before it, ``start`` for the first of a text."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[offsets[:-1]] = start
    return before


def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted different keys, place of each key in them); keys that fit are sorted with their position inside."""
    bits = len(key).bit_length()
    if not len(key) or int(key.max()).bit_length() + bits > 63:
        return np.unique(key, return_inverse=True)
    packed = np.sort((key << bits) | np.arange(len(key)))
    order, packed = packed & ((1 << bits) - 1), packed >> bits
    new = np.concatenate(([True], packed[1:] != packed[:-1]))
    place = np.empty(len(key), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    return packed[new], place


def _pairs(vocabulary: np.ndarray, tokens: np.ndarray, offsets: np.ndarray):
    """(sorted different keys of pairs, place of every token's pair in them)."""
    start = int(np.searchsorted(vocabulary, START))
    return _ranked(_sequence(tokens, offsets, start).astype(np.int64) * len(vocabulary) + tokens)


def _column(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Binary column whose rows are the bytes of ``values`` between ``bounds``."""
    values = np.ascontiguousarray(values)
    offsets = (bounds * values.dtype.itemsize).astype(np.int32)
    data = values.view(np.uint8) if len(values) else np.zeros(1, dtype=np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _flat(table: pa.Table, name: str, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(values of all rows of a binary column, bounds of the rows in them)."""
    kind, values, sizes = np.dtype(kind), [], [[0]]
    for part in table.column(name).chunks:
        if not len(part):
            continue
        _, offsets, data = part.buffers()
        offsets = np.frombuffer(offsets, dtype=np.int32)[part.offset : part.offset + len(part) + 1]
        sizes.append(np.diff(offsets) // kind.itemsize)
        if data is not None and offsets[-1] > offsets[0]:
            values.append(np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]].copy().view(kind))
    return (np.concatenate(values) if values else np.zeros(0, kind)), np.cumsum(np.concatenate(sizes)).astype(np.int64)


class Spread(NamedTuple):
    """Contexts that lie in several shards, ascending, and in how many."""

    words: np.ndarray
    parts: np.ndarray

    def of(self, words: np.ndarray) -> np.ndarray:
        """Number of shards of each word, 1 for most."""
        if not len(self.words):
            return np.ones(len(words), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.parts[at], 1)


class Requests(NamedTuple):
    """What a chunk asks of the shards that it asks at all, in the order of the shards."""

    shards: np.ndarray
    words: np.ndarray  # places in the vocabulary: a shard's own words, then its spread contexts
    is_spread: np.ndarray
    bounds: np.ndarray
    fans: np.ndarray  # pairs of each word as a context
    pairs: np.ndarray  # places in the keys
    pair_bounds: np.ndarray


def _by_shard(shard: np.ndarray, second: np.ndarray, shards: int) -> np.ndarray:
    """Stable order by shard and flag, by counting where numbers are small."""
    return np.argsort((shard * 2 + second).astype(np.uint16 if shards < 1 << 15 else np.int64), kind="stable")


def _requests(vocabulary: np.ndarray, keys: np.ndarray, spread: Spread, shards: int) -> Requests:
    width = len(vocabulary)
    home = (common.mix(vocabulary) % np.uint64(shards)).astype(np.int64)
    parts = spread.of(vocabulary)
    context = keys // width
    # words and their pairs as contexts share a shard; spread contexts deal their pairs by successor
    shard = home[context]
    spreads = parts > 1
    far = np.flatnonzero(spreads[context])
    successor = common.mix(vocabulary[keys[far] - context[far] * width] >> _FP)
    # the shards of a spread context follow one another, so that none holds two of its parts
    shard[far] = (shard[far] + (successor % parts[context[far]].astype(np.uint64)).astype(np.int64)) % shards
    is_far = np.zeros(len(keys), dtype=bool)
    is_far[far] = True
    pairs = _by_shard(shard, is_far, shards)
    used = np.zeros(width, dtype=bool)
    used[context[far]] = True
    asked = np.repeat(np.flatnonzero(used), parts[used])
    runs = np.cumsum(parts[used]) - parts[used]
    asked_shard = (home[asked] + np.arange(len(asked)) - np.repeat(runs, parts[used])) % shards
    words = np.concatenate((np.arange(width), asked))
    word_shard = np.concatenate((home, asked_shard))
    is_spread = np.arange(len(words)) >= width
    order = _by_shard(word_shard, is_spread, shards)
    words, word_shard, is_spread = words[order], word_shard[order], is_spread[order]
    fans = np.bincount(context[~is_far], minlength=width)[words]
    far = pairs[is_far[pairs]]
    far = shard[far] * width + context[far]
    there = word_shard[is_spread] * width + words[is_spread]
    fans[is_spread] = np.searchsorted(far, there, side="right") - np.searchsorted(far, there)
    present = word_shard[np.flatnonzero(np.concatenate(([True], word_shard[1:] != word_shard[:-1])))]
    bounds = np.append(np.searchsorted(word_shard, present), len(words))
    total = np.concatenate(([0], np.cumsum(fans)))
    return Requests(present, words, is_spread, bounds, fans, pairs, total[bounds])


_ASK = (
    "shard long, chunk long, n_spread long, words binary, counts binary, counts_large binary, fans binary, "
    "fans_large binary, successors binary, pair_counts binary, pair_counts_large binary, own binary"
)
_TELL = (
    "shard long, chunk long, counts binary, counts_large binary, codes binary, followers binary, "
    "followers_large binary, own binary"
)


def _numbers(name: str, values: np.ndarray, bounds: np.ndarray) -> dict:
    """Columns of numbers as bytes, with those from 255 on in a second column."""
    large = values >= 255
    behind = np.concatenate(([0], np.cumsum(large)))
    return {
        name: _column(np.minimum(values, 255).astype(np.uint8), bounds),
        f"{name}_large": _column(values[large].astype(np.int64), behind[bounds]),
    }


def _read_numbers(table: pa.Table, name: str) -> np.ndarray:
    values = _flat(table, name, "u1")[0].astype(np.int64)
    values[values == 255] = _flat(table, f"{name}_large", "<i8")[0]
    return values


def _batch(columns: dict, schema: str) -> pa.RecordBatch:
    """Columns in the order of ``schema``; missing ones are NULL."""
    n = len(next(iter(columns.values())))
    names = [(part.split()[0], pa.int64() if part.endswith("long") else pa.binary()) for part in schema.split(", ")]
    arrays = [pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in names]
    return pa.RecordBatch.from_arrays(arrays, names=[c for c, _ in names])


def _chunk_rows(chunk: int, ids, missing, train, lengths, hashes, spread: Spread, shards: int):
    """The chunk's own row (shard below zero) and its requests."""
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    vocabulary, tokens = np.unique(np.concatenate((hashes, [START, END])), return_inverse=True)
    tokens = tokens[:-2].astype(np.int64)
    learned = np.repeat(train, lengths)
    counts = np.bincount(tokens[learned], minlength=len(vocabulary))
    keys, place = _pairs(vocabulary, tokens, offsets)
    pair_counts = np.bincount(place[learned], minlength=len(keys))
    del place
    own = _pack(ids, missing, train, lengths.astype(np.int64), tokens.astype(np.uint32), vocabulary)
    yield _batch({"shard": [-1 - chunk], "chunk": [chunk], "own": [own]}, _ASK)
    ask = _requests(vocabulary, keys, spread, shards)
    # five bytes of each successor
    successors = vocabulary[keys[ask.pairs] % len(vocabulary)] >> _FP
    successors = np.ascontiguousarray(successors.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).reshape(-1)
    yield _batch(
        {
            "shard": ask.shards,
            "chunk": np.full(len(ask.shards), chunk),
            "n_spread": np.add.reduceat(ask.is_spread.astype(np.int64), ask.bounds[:-1]),
            "words": _column(vocabulary[ask.words], ask.bounds),
            **_numbers("counts", np.where(ask.is_spread, 0, counts[ask.words]), ask.bounds),
            **_numbers("fans", ask.fans, ask.bounds),
            "successors": _column(successors, ask.pair_bounds * 5),
            **_numbers("pair_counts", pair_counts[ask.pairs], ask.pair_bounds),
        },
        _ASK,
    )


def _texts(batches: Iterator[pa.RecordBatch], limit: int):
    """(ids, missing ids, train, numbers of tokens, hashes of tokens) of some ``limit`` tokens at a time."""
    held: list = []
    size = 0
    for batch in batches:
        texts = batch.column("text").to_pylist()
        ids = batch.column("doc_id")
        missing = ids.is_null().to_numpy(zero_copy_only=False)
        ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        train = batch.column("train").to_numpy(zero_copy_only=False).astype(bool)
        for lo, hi in common.slices(texts):
            words, offsets = common.word_hashes(texts[lo:hi])
            ends = np.insert(words, offsets[1:], END)
            held.append((ids[lo:hi], missing[lo:hi], train[lo:hi], np.diff(offsets) + 1, ends))
            size += len(ends)
            if size >= limit:
                yield tuple(np.concatenate(x) for x in zip(*held))
                held, size = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _chunks(spread: Spread, shards: int, chunk_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, texts in enumerate(_texts(batches, chunk_tokens)):
            yield from _chunk_rows((task << 24) + number, *texts, spread, shards)

    return run


# -- shards -------------------------------------------------------------------------------------


def _answer(table: pa.Table) -> pa.Table:
    """Answers of one shard to all chunks; a chunk's own row passes through."""
    if table.column("shard")[0].as_py() < 0:
        own = {name: table.column(name).combine_chunks() for name in ("shard", "chunk", "own")}
        return pa.Table.from_batches([_batch(own, _TELL)])
    asked, bounds = _flat(table, "words", "<u8")
    words, at = np.unique(asked, return_inverse=True)
    del asked
    counts = np.bincount(at, _read_numbers(table, "counts"), len(words)).astype(np.int64)
    narrow, pair_bounds = _flat(table, "successors", "u1")
    pair_bounds //= 5
    key = np.zeros((len(narrow) // 5, 8), dtype=np.uint8)
    key[:, :5] = narrow.reshape(-1, 5)
    del narrow
    key = key.reshape(-1).view("<u8")
    key |= np.repeat(at, _read_numbers(table, "fans")).astype(np.uint64) << np.uint64(40)
    pairs, place = np.unique(key, return_inverse=True)
    del key
    pair_counts = np.bincount(place, _read_numbers(table, "pair_counts"), len(pairs))
    owner, successor = (pairs >> np.uint64(40)).astype(np.int64), pairs & np.uint64((1 << 40) - 1)
    seen = pair_counts > 0
    followers = np.bincount(owner[seen], minlength=len(words))
    # each occurrence of a context has one follower; a spread one has here its part of them
    totals = np.bincount(owner, pair_counts, len(words)).astype(np.int64)
    trie = Trie(
        words[followers > 0],
        np.concatenate(([0], np.cumsum(followers[followers > 0]))),
        successor[seen],
        (pair_counts[seen] - DISCOUNT) / totals[owner[seen]],
    )
    codes = trie.code(words, owner, successor)
    trie.close()
    sizes = np.diff(bounds)
    n_spread = table.column("n_spread").to_numpy()
    is_spread = np.arange(bounds[-1]) >= np.repeat(bounds[1:] - n_spread, sizes)
    return pa.Table.from_batches(
        [
            _batch(
                {
                    "shard": table.column("shard").combine_chunks(),
                    "chunk": table.column("chunk").combine_chunks(),
                    **_numbers("counts", np.where(is_spread, totals[at], counts[at]), bounds),
                    "codes": _column(codes[place], pair_bounds),
                    **_numbers("followers", followers[at], bounds),
                },
                _TELL,
            )
        ]
    )


_SCORE = "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(spread: Spread, shards: int, n: int, v: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("shard")
        ids, missing, train, lengths, tokens, vocabulary = _unpack(table.column("own")[0].as_py())
        table = table.slice(1)
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        tokens = tokens.astype(np.int64)
        keys, place = _pairs(vocabulary, tokens, offsets)
        ask = _requests(vocabulary, keys, spread, shards)
        told, fan = _read_numbers(table, "counts"), _read_numbers(table, "followers")
        counts = np.zeros(len(vocabulary), dtype=np.int64)
        counts[ask.words[~ask.is_spread]] = told[~ask.is_spread]
        before = counts.copy()  # how often each word was a context
        before[np.searchsorted(vocabulary, START)] = counts[np.searchsorted(vocabulary, END)]
        # followers of a spread context lie in all its shards; a part's probabilities count within the part
        followers = np.zeros(len(vocabulary), dtype=np.int64)
        followers[ask.words[~ask.is_spread]] = fan[~ask.is_spread]
        far = ask.words[ask.is_spread]
        followers[far] = 0
        np.add.at(followers, far, fan[ask.is_spread])
        share = np.ones(len(ask.words))
        share[ask.is_spread] = told[ask.is_spread] / np.maximum(before[far], 1)
        seen = np.empty(len(keys))
        seen[ask.pairs] = restored(_flat(table, "codes", "<u2")[0]) * np.repeat(share, ask.fans)
        base = (counts + 0.5) / (n + 0.5 * (v + 1))
        # the share of a context that its unseen successors get; all of it for unseen contexts
        rest = np.where(before > 0, DISCOUNT * followers / np.maximum(before, 1), 1.0)
        pair = np.log10(seen + rest[keys // len(vocabulary)] * base[keys % len(vocabulary)])
        starts = offsets[:-1]
        return pa.table(
            {
                "doc_id": pa.array(ids, pa.int64(), mask=missing),
                "train": train,
                "n_tokens": lengths,
                "n_known": np.add.reduceat((counts > 0)[tokens].astype(np.int64), starts),
                "train_tokens": np.full(len(ids), n, dtype=np.int64),
                "base_score": np.add.reduceat(np.log10(base)[tokens], starts),
                "score": np.add.reduceat(pair[place], starts),
            }
        )

    return run


def word_totals(docs: DataFrame, shards: int, shard_bytes: int, chunk_tokens: int) -> tuple[int, int, Spread]:
    """(training tokens N, different ones V, spread contexts) of all texts, by one count of their words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, train, lengths, hashes in _texts(batches, chunk_tokens):
            words, at = np.unique(np.concatenate((hashes, [START])), return_inverse=True)
            times = np.bincount(at[:-1], minlength=len(words))
            times[at[-1]] += len(lengths)
            learned = np.bincount(at[:-1][np.repeat(train, lengths)], minlength=len(words))
            yield pa.RecordBatch.from_arrays(
                [pa.array(words.view(np.int64)), pa.array(times), pa.array(learned)], ["word", "times", "learned"]
            )

    counted = docs.mapInArrow(count, "word long, times long, learned long").groupBy("word")
    counted = counted.agg(F.sum("times").alias("times"), F.sum("learned").alias("learned"))
    often = F.col("times") * SPREAD_BYTES > shard_bytes
    n, v, hot = counted.agg(
        F.sum("learned"),
        F.sum((F.col("learned") > 0).cast("long")),
        F.collect_list(F.when(often, F.struct("word", "times"))),
    ).first()
    words = np.array([r["word"] for r in hot], dtype=np.int64).view(np.uint64)
    parts = np.array([min(shards, -(-r["times"] * SPREAD_BYTES // shard_bytes)) for r in hot], dtype=np.int64)
    order = np.argsort(words)
    return int(n or 0), int(v or 0), Spread(words[order], parts[order])


def score(docs: DataFrame, chunk_tokens: int = CHUNK_TOKENS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Scores of ``docs`` (doc_id, text, train): one row per row, with the columns of the contract."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "train")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-int(size) // shard_bytes))
    n, v, spread = word_totals(docs, shards, shard_bytes, chunk_tokens)
    asks = docs.mapInArrow(_chunks(spread, shards, chunk_tokens), _ASK)
    answers = asks.groupBy("shard").applyInArrow(_answer, _TELL)
    return answers.groupBy("chunk").applyInArrow(_score(spread, shards, n, v), _SCORE)


def op10_bigram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents", "doc_id", "text")
    # NULL ids are neither held out nor learned from
    remainder = common.fold("doc_id", 5)
    train = F.coalesce(remainder != 1, F.lit(False))
    scored = score(docs.withColumn("train", train))
    held = F.coalesce(remainder == 1, F.lit(False))
    return scored.select(
        "doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


QUERIES = {"op10_bigram_trie": op10_bigram_trie}
