"""Minibatches as cells of a table that is written once.

Rows are dealt by hash into cells: a bucket, which is a folder, and a slice within it, by which its
files are sorted. An epoch is a permutation of the cells, and a minibatch a run of it, so every row
comes once per epoch, a step reads only its own folders and row groups, and nothing is written again.
The permutation is computed cell by cell from the epoch's number, so no list of it exists.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass
from typing import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorframe import lineage

# Cells that make up one minibatch, folders of a store, rows of a file.
CELLS_PER_BATCH, MOST_BUCKETS, ROWS_PER_FILE = 8, 2048, 5_000_000


def permuted(position: int, n: int, key: str) -> int:
    """Where a keyed permutation of 0 .. n-1 sends ``position``.

    A Feistel network permutes the next power of four; values outside are sent on until they fall inside.
    """
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = position >> half, position & mask
        for turn in range(6):
            digest = hashlib.blake2b(f"{key}:{turn}:{right}".encode(), digest_size=8).digest()
            left, right = right, left ^ (int.from_bytes(digest, "big") & mask)
        position = left << half | right
        if position < n:
            return position


@dataclass(frozen=True)
class MinibatchStore:
    """``table`` has the rows with ``_bucket`` and ``_slice``; ``counts`` the rows of every cell."""

    table: DataFrame
    counts: DataFrame
    n_batches: int
    n_buckets: int
    n_slices: int
    columns: tuple[str, ...]

    @property
    def n_cells(self) -> int:
        return self.n_buckets * self.n_slices

    def cells(self, batch: int, epoch: int, seed: str = "") -> list[tuple[int, int]]:
        """(bucket, slice) of the cells of a minibatch."""
        first, last = (self.n_cells * b // self.n_batches for b in (batch, batch + 1))
        order = (permuted(p, self.n_cells, f"{seed}:{epoch}") for p in range(first, last))
        return [divmod(cell, self.n_slices) for cell in order]

    def batch(self, batch: int, epoch: int, seed: str = "") -> tuple[DataFrame, int]:
        """The rows of a minibatch and their number, from the counts of its few cells."""
        held = F.lit(False)
        for bucket, part in self.cells(batch, epoch, seed):
            inside = F.col("_bucket") == bucket
            if self.n_slices > 1:
                inside &= F.col("_slice") == part
            held |= inside
        n = self.counts.filter(held).agg(F.sum("n")).first()[0]
        return self.table.filter(held).select(*self.columns), n or 0

    def epoch(self, epoch: int, seed: str = "") -> Iterator[tuple[DataFrame, int]]:
        """All minibatches of an epoch; one without rows is left out."""
        for batch in range(self.n_batches):
            rows, n = self.batch(batch, epoch, seed)
            if n:
                yield rows, n


def store_minibatches(
    rows: DataFrame,
    n_rows: int,
    batch_size: int,
    path: str,
    row_key: str = "arid",
    most_buckets: int = MOST_BUCKETS,
) -> MinibatchStore:
    """Write ``rows`` below ``path`` in cells for minibatches of about ``batch_size`` rows."""
    n_batches = max(1, math.ceil(n_rows / batch_size))
    wanted = n_batches * CELLS_PER_BATCH
    n_buckets = min(wanted, most_buckets)
    n_slices = math.ceil(wanted / n_buckets)
    n_files = max(1, math.ceil(n_rows / n_buckets / ROWS_PER_FILE))
    dealt = lambda what, n: F.pmod(F.xxhash64(row_key, F.lit(what)), F.lit(n)).cast("int")
    marked = rows.withColumns(
        {"_bucket": dealt("bucket", n_buckets), "_slice": dealt("slice", n_slices), "_file": dealt("file", n_files)}
    )
    # a task writes whole files of some buckets, sorted for the footers to tell slices apart
    marked = marked.repartition("_bucket", "_file").sortWithinPartitions("_bucket", "_file", "_slice").drop("_file")
    table = lineage.as_table(marked, "minibatches", partition_by="_bucket", path=f"{path}/rows")
    counts = table.groupBy("_bucket", "_slice").agg(F.count(F.lit(1)).alias("n"))
    counts = lineage.as_table(counts.orderBy("_bucket", "_slice"), "counts", path=f"{path}/counts")
    return MinibatchStore(table, counts, n_batches, n_buckets, n_slices, tuple(rows.columns))
