"""Near-duplicate documents by ProbMinHash over weighted word shingles (operator 4).

A text is the multiset of its runs of five words (lower-cased; shorter texts are one run), each run
weighing as often as it occurs. Every run sends exponential arrivals to random signature slots, at a
rate of its weight; a slot keeps the run that arrives first. Arrivals later than the latest kept one
cannot matter and end the run early. Two texts agree in a slot with the probability Jaccard
similarity of their weighted runs. Slots form bands; texts that share a band are candidates, and
candidates are verified on their whole texts. A text that repeats a run has the bands of its distinct
runs as well, all of weight 1, where texts agree with their plain Jaccard similarity; for texts that
repeat none both are the same bands.

Bands are not expanded into all pairs. In every round the texts of a band that are outside its
largest group so far meet the band's leaders: the text that shares the most bands with others and a
hashed choice of one, then 64, 4096, ... texts. Groups grow, so ever fewer texts are outside when
leaders become many; bands whose texts are one group are done. The rounds end when all are, or when
those outside have met every text of their bands, so no candidate that could join two groups is
left out. Bands with few such pairs emit them; in larger ones blocks of outside texts meet blocks of
leaders as products of their run matrices, and only links that join groups leave the task.

Links are exact: probability Jaccard, or plain Jaccard of the distinct runs, of at least 0.8. With
36 bands of 6 slots a pair at 0.8 of either shares no band with a chance of 1.8e-5.

Defined cases: rows with NULL texts and texts without words are groups of their own. Equal texts are
one node from the start, whatever their number. A group's id is the smallest doc_id of its rows;
NULL ids come last. The kept row has that id and, if several texts of the group do, the smallest
node. Rows that repeat it in id and text share the mark; ``keep_one`` leaves one of them. Repeated
rows share a group. Only doc_id and text are read.
"""

from __future__ import annotations

from typing import Iterator, Optional

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorframe.llm import common

RUN = 5
SIMILARITY = 0.8
BANDS, ROWS = 36, 6
# Factor by which the leaders of a band become more from round to round.
GROWTH = 64
# Bands with more meetings of outside texts and leaders than this compare blocks; no block is
# expected to hold more texts or runs than these.
PAIRED = 256
BLOCK_TEXTS, BLOCK_RUNS = 512, 500_000
# Columns of a run matrix that are multiplied at a time.
_COLUMNS = 4096
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_MULTIPLIERS = np.array([0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], dtype=np.uint64)


def runs(texts: list, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, run hash, weight) of the distinct word runs of every text, sorted by owner and hash."""
    words, offsets = common.word_hashes(texts)
    count = np.diff(offsets)
    owner = np.repeat(np.arange(len(texts)), count)
    index = np.arange(len(words)) - offsets[:-1][owner]
    # texts of fewer words have one run of all of them; absent words leave a zero term
    starts = np.flatnonzero((index == 0) | (index + run <= count[owner]))
    total = np.zeros(len(starts), dtype=np.uint64)
    for k in range(run):
        at = starts + k
        there = index[starts] + k < count[owner[starts]]
        term = words[np.minimum(at, len(words) - 1)] * _MULTIPLIERS[k % 5] + np.uint64(k)
        total += np.where(there, common.mix(term), np.uint64(0))
    total, holder = common.mix(total), owner[starts]
    order = np.lexsort((total, holder))
    total, holder = total[order], holder[order]
    if not len(total):
        return holder, total, np.zeros(0)
    new = np.concatenate(([True], (total[1:] != total[:-1]) | (holder[1:] != holder[:-1])))
    first = np.flatnonzero(new)
    weight = np.diff(np.concatenate((first, [len(total)]))).astype(np.float64)
    return holder[first], total[first], weight


def signatures(n: int, owner: np.ndarray, run: np.ndarray, weight: np.ndarray, slots: int) -> np.ndarray:
    """(n, slots) runs that arrive first; zero where a text has no run."""
    earliest = np.full(n * slots, np.inf)
    kept = np.zeros(n * slots, dtype=np.uint64)
    time = np.zeros(len(run))
    alive = np.arange(len(run))
    step = 0
    while len(alive):
        step += 1
        state = common.mix(run[alive] + np.uint64(int(_GOLD) * step % (1 << 64)))
        gap = -np.log(((state >> np.uint64(11)).astype(np.float64) + 1.0) / float((1 << 53) + 1))
        time[alive] += gap / weight[alive]
        slot = (common.mix(state ^ _GOLD) % np.uint64(slots)).astype(np.int64)
        cell = owner[alive] * slots + slot
        now = time[alive]
        sooner = now < earliest[cell]
        cell, now, who = cell[sooner], now[sooner], run[alive][sooner]
        np.minimum.at(earliest, cell, now)
        won = now == earliest[cell]
        kept[cell[won]] = who[won]
        # the latest kept arrival of a text bounds the arrivals that can still matter
        bound = earliest.reshape(n, slots).max(axis=1)
        alive = alive[time[alive] < bound[owner[alive]]]
    return kept.reshape(n, slots)


def band_keys(texts: list, bands: int = BANDS, rows: int = ROWS) -> list[Optional[np.ndarray]]:
    """Different 64-bit keys of the bands of every text; None for texts without words.

    Texts that repeat a run have the bands of their counted and of their distinct runs.
    """
    out: list[Optional[np.ndarray]] = [None] * len(texts)
    for begin in range(0, len(texts), 256):
        for lo, hi in common.slices(texts[begin : begin + 256], 1_000_000):
            lo, hi = begin + lo, begin + hi
            owner, run, weight = runs(texts[lo:hi])
            key = _keys(signatures(hi - lo, owner, run, weight, bands * rows), bands, rows)
            for i in np.flatnonzero(np.bincount(owner, minlength=hi - lo)):
                out[lo + i] = key[i].view(np.int64)
            heavy = np.bincount(owner, weights=weight > 1, minlength=hi - lo) > 0
            again = heavy[owner]
            if again.any():
                place = (np.cumsum(heavy) - 1)[owner[again]]
                unit = signatures(int(heavy.sum()), place, run[again], np.ones(len(place)), bands * rows)
                for i, k in zip(np.flatnonzero(heavy), _keys(unit, bands, rows)):
                    out[lo + i] = np.union1d(out[lo + i], k.view(np.int64))
    return out


def _keys(kept: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(n, bands) keys of signatures."""
    key = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * _GOLD
    grouped = kept.reshape(len(kept), bands, rows)
    for r in range(rows):
        key = common.mix(key ^ grouped[:, :, r]) + np.uint64(r + 1)
    return key


def similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Larger of the exact probability Jaccard and the plain Jaccard similarity of two weighted run sets."""
    if not len(a) or not len(b):
        return 0.0
    _, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    plain = len(ia) / (len(a) + len(b) - len(ia))
    if plain >= SIMILARITY or not len(ia):
        return plain
    if highest(wa[ia].sum() / wa.sum(), wb[ib].sum() / wb.sum()) < SIMILARITY - 1e-6:
        return plain
    return max(plain, _probability_jaccard(wa, wb, ia, ib))


def highest(x, y):
    """Upper bound of the probability Jaccard of texts whose common runs weigh shares ``x`` and ``y`` of them.

    Every term of the sum is at most 1 / (A / a_i + (B - B_common) / b_i), which is concave and
    homogeneous in (a_i, b_i); so the sum is at most that value at the sums of the common weights.
    """
    return 1.0 / (1.0 / x + 1.0 / y - 1.0)


def _probability_jaccard(wa: np.ndarray, wb: np.ndarray, ia: np.ndarray, ib: np.ndarray) -> float:
    """Sum over common i of 1 / sum over all j of max(a_j / a_i, b_j / b_i).

    Sorting all j by a_j / b_j splits each inner sum into one part led by a and one led by b.
    """
    alone_a = wa.sum() - wa[ia].sum()
    alone_b = wb.sum() - wb[ib].sum()
    u, v = wa[ia], wb[ib]
    order = np.argsort(u / v, kind="stable")
    u, v = u[order], v[order]
    upto_u, upto_v = np.cumsum(u), np.cumsum(v)
    ratio = u / v
    edge = np.searchsorted(ratio, ratio, side="right") - 1
    led_by_a = alone_a + upto_u[-1] - upto_u[edge]
    led_by_b = alone_b + upto_v[edge]
    return float((1.0 / (led_by_a / u + led_by_b / v)).sum())


def node_id(text: Column) -> Column:
    """Equal texts are one node: 64 bits of the text's MD5."""
    return F.xxhash64(F.md5(text.cast("binary")))


def sketch(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, node, bands of ``docs`` (doc_id, text)."""

    @F.pandas_udf("array<long>")
    def keys(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = band_keys([t if isinstance(t, str) else None for t in texts], bands, rows)
            yield pd.Series(found, dtype=object)

    return docs.select("doc_id", node_id(F.col("text")).alias("node"), keys("text").alias("bands"))


def _run_table(texts: DataFrame) -> DataFrame:
    """node, runs, weights, n_runs of ``texts`` (node, text): sorted run hashes and their weights as bytes."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            values = list(pdf["text"])
            for lo, hi in common.slices(values, 1_000_000):
                owner, run, weight = runs(values[lo:hi])
                ends = np.searchsorted(owner, np.arange(hi - lo + 1))
                spans = list(zip(ends[:-1], ends[1:]))
                yield pd.DataFrame(
                    {
                        "node": pdf["node"].iloc[lo:hi],
                        "runs": [run[i:j].astype("<u8").tobytes() for i, j in spans],
                        "weights": [weight[i:j].astype("<f8").tobytes() if (weight[i:j] > 1).any() else b"" for i, j in spans],
                        "n_runs": np.diff(ends),
                    }
                )

    return texts.mapInPandas(count, "node long, runs binary, weights binary, n_runs long")


def _unpacked(packed: bytes, weights: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Run hashes and weights; no bytes of weights stand for ones."""
    run = np.frombuffer(packed, dtype="<u8")
    return run, np.frombuffer(weights, dtype="<f8") if len(weights) else np.ones(len(run))


def _verified(pairs: DataFrame, table: DataFrame, name: str) -> DataFrame:
    """Different pairs (a, b), a < b, with the exact similarity ``s`` of their whole texts."""
    both = pairs.join(table.select(F.col("node").alias("a"), F.col("runs").alias("x"), F.col("weights").alias("wx")), "a")
    both = both.join(table.select(F.col("node").alias("b"), F.col("runs").alias("y"), F.col("weights").alias("wy")), "b")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [
                similarity(*_unpacked(x, wx), *_unpacked(y, wy))
                for x, wx, y, wy in zip(pdf["x"], pdf["wx"], pdf["y"], pdf["wy"])
            ]
            yield pdf[["a", "b"]].assign(s=np.array(found, dtype=np.float64))

    return common.staged(both.mapInPandas(check, "a long, b long, s double"), name)


def block_links(left: list, right: list) -> np.ndarray:
    """(i, j) of all texts of ``left`` and ``right``, lists of (runs, weights), that are linked."""
    runs_l, runs_r = (np.concatenate([r for r, _ in side]) for side in (left, right))
    weights_l, weights_r = (np.concatenate([w for _, w in side]) for side in (left, right))
    row_l, row_r = (np.repeat(np.arange(len(side)), [len(r) for r, _ in side]) for side in (left, right))
    size_l, size_r = (np.array([float(len(r)) for r, _ in side]) for side in (left, right))
    all_l, all_r = (np.array([w.sum() for _, w in side]) for side in (left, right))
    shared = np.intersect1d(runs_l, runs_r)
    columns = []
    for run in (runs_l, runs_r):
        at = np.searchsorted(shared, run)
        at[at == len(shared)] = 0
        columns.append(np.where(shared[at] == run, at, -1) if len(shared) else np.full(len(run), -1))
    uniform = (weights_l == 1).all() and (weights_r == 1).all()
    count = np.zeros((len(left), len(right)))
    common_l, common_r = np.zeros_like(count), np.zeros_like(count)
    for lo in range(0, len(shared), _COLUMNS):
        width = min(_COLUMNS, len(shared) - lo)
        parts = []
        for side, row, column, weight in ((left, row_l, columns[0], weights_l), (right, row_r, columns[1], weights_r)):
            inside = (column >= lo) & (column < lo + width)
            there = np.zeros((len(side), width), dtype=np.float32)
            there[row[inside], column[inside] - lo] = 1
            weighed = there
            if not uniform:
                weighed = np.zeros_like(there)
                weighed[row[inside], column[inside] - lo] = weight[inside]
            parts.append((there, weighed))
        (has_l, heavy_l), (has_r, heavy_r) = parts
        count += has_l @ has_r.T
        if not uniform:
            common_l += heavy_l @ has_r.T
            common_r += has_l @ heavy_r.T
    linked = count / (size_l[:, None] + size_r[None, :] - count) >= SIMILARITY
    if not uniform:
        some = count > 0
        x = np.where(some, common_l / all_l[:, None], 1)
        y = np.where(some, common_r / all_r[None, :], 1)
        open_ = some & ~linked & (highest(x, y) >= SIMILARITY - 1e-6)
        for i, j in np.argwhere(open_):
            linked[i, j] = similarity(*left[i], *right[j]) >= SIMILARITY
    return np.argwhere(linked)


def _joining(pairs: np.ndarray, left: np.ndarray, right: np.ndarray) -> list:
    """The pairs (i, j) that join two groups of labels not joined by the pairs before them."""
    into: dict = {}

    def top(x: int) -> int:
        while x in into:
            x = into[x]
        return x

    kept = []
    for i, j in pairs:
        x, y = top(left[i]), top(right[j])
        if x != y:
            into[max(x, y)] = min(x, y)
            kept.append((i, j))
    return kept


def _block_links(outside: DataFrame, leading: DataFrame, table: DataFrame, name: str) -> DataFrame:
    """Links (a, b) that join groups, of outside texts and leaders of large keys.

    Each side is dealt by hash into as many blocks as its texts and runs need, and each block meets
    every block of the other side once.
    """
    rows = outside.withColumn("side", F.lit(0)).unionByName(leading.withColumn("side", F.lit(1)))
    draw = F.xxhash64("node", "key", F.lit("block"))
    own = F.pmod(draw, F.when(F.col("side") == 0, F.col("n0")).otherwise(F.col("n1"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("side") == 0, F.col("n1")).otherwise(F.col("n0")) - 1))
    dealt = rows.select("key", "node", "label", "side", own.alias("own"), other.alias("met"))
    dealt = dealt.withColumn("i", F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("met")))
    dealt = dealt.withColumn("j", F.when(F.col("side") == 0, F.col("met")).otherwise(F.col("own")))
    dealt = dealt.drop("own", "met").join(table.drop("n_runs"), "node")

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = [pdf[pdf["side"] == k] for k in (0, 1)]
        none = pd.DataFrame({"a": [], "b": []}, dtype="int64")
        if not len(sides[0]) or not len(sides[1]):
            return none
        held = [[_unpacked(r, w) for r, w in zip(x["runs"], x["weights"])] for x in sides]
        labels = [x["label"].to_numpy() for x in sides]
        nodes = [x["node"].to_numpy() for x in sides]
        kept = _joining(block_links(*held), *labels)
        if not kept:
            return none
        i, j = np.array(kept).T
        return pd.DataFrame({"a": np.minimum(nodes[0][i], nodes[1][j]), "b": np.maximum(nodes[0][i], nodes[1][j])})

    links = dealt.groupBy("key", "i", "j").applyInPandas(meet, "a long, b long")
    return common.staged(links, name)


def _opened(members: DataFrame, roots: DataFrame, name: str) -> DataFrame:
    """key, node, label, size, main, out, held, held_out: members (key, node) of keys that hold several groups.

    ``main`` is the key's largest group, ``out`` the number of members outside it; ``held`` and
    ``held_out`` are the runs of all members and of those outside.
    """
    named = members.join(roots.withColumnRenamed("root", "label"), "node")
    groups_ = named.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("n_runs").alias("held"))
    keys = groups_.groupBy("key").agg(
        F.sum("n").alias("size"), F.sum("held").alias("held"), F.max(F.struct("n", "label", "held")).alias("most")
    )
    keys = keys.filter("size > most.n").select(
        "key",
        "size",
        "held",
        F.col("most.label").alias("main"),
        (F.col("size") - F.col("most.n")).alias("out"),
        (F.col("held") - F.col("most.held")).alias("held_out"),
    )
    return common.staged(named.drop("n_runs").join(keys, "key"), name)


def _candidates(open_: DataFrame, leaders: int) -> tuple[DataFrame, DataFrame]:
    """Members outside their key's largest group, and leaders, which may repeat: key, node, label, meetings, n0, n1.

    A hash picks about ``leaders`` members of each key, all of them if it has no more; the first
    round adds the one that shares the most keys with others. More leaders include the fewer.
    ``meetings`` is the expected number of the key's pairs, ``n0`` and ``n1`` the blocks of the sides.
    """
    led = F.least(F.col("size"), F.lit(leaders))

    def blocks(texts: Column, held: Column) -> Column:
        return F.greatest(F.ceil(texts / BLOCK_TEXTS), F.ceil(held / BLOCK_RUNS), F.lit(1)).cast("int")

    sized = open_.withColumns(
        {
            "meetings": F.col("out") * led,
            "n0": blocks(F.col("out"), F.col("held_out")),
            "n1": blocks(led, F.col("held") * led / F.col("size")),
        }
    )
    columns = ["key", "node", "label", "meetings", "n0", "n1"]
    draw = F.pmod(F.xxhash64("key", "node"), F.lit(1 << 30)) / float(1 << 30)
    lead = sized.filter(draw * F.col("size") < leaders).select(*columns)
    if leaders == 1:
        degree = open_.groupBy("node").agg(F.sum("size").alias("degree"))
        widest = F.max(F.struct("degree", *columns[1:])).alias("lead")
        top = sized.join(degree, "node").groupBy("key").agg(widest)
        lead = lead.unionByName(top.select("key", *[f"lead.{c}" for c in columns[1:]]))
    return sized.filter("label <> main").select(*columns), lead


def _pairs(outside: DataFrame, lead: DataFrame) -> DataFrame:
    """Different pairs (a, b) of outside members and leaders of the same key and different labels."""
    lead = lead.select("key", F.col("node").alias("b"), F.col("label").alias("other"))
    pairs = outside.join(lead, "key").filter("label <> other")
    return pairs.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()


def groups(docs: DataFrame, sketches: DataFrame) -> DataFrame:
    """(node, root) of all nodes that share a band with another one."""
    worded = sketches.filter("bands IS NOT NULL")
    nodes = worded.groupBy("node").agg(F.first("bands").alias("bands"), F.min("doc_id").alias("doc_id"))
    nodes = common.staged(nodes, "nodes")
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    members = common.staged(keyed.join(shared, "key"), "members")
    # one row with the text of each member; rows that repeat an id only repeat a comparison
    wanted = members.select("node").distinct().join(nodes.select("node", F.col("doc_id").alias("_id")), "node")
    keyed_docs = docs.select("doc_id", node_id(F.col("text")).alias("_node"), "text")
    here = (F.col("_node") == F.col("node")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    texts = keyed_docs.join(wanted, here).select("node", "text")
    table = common.staged(_run_table(texts).dropDuplicates(["node"]), "member-runs")

    roots = table.select("node", F.col("node").alias("root"), "n_runs")
    seen = None
    leaders = 1
    while True:
        open_ = _opened(members, roots, f"open-{leaders}")
        largest = open_.agg(F.max("size")).first()[0]
        if largest is None:
            return roots.drop("n_runs")
        members = open_.select("key", "node")  # keys of one group stay so
        outside, lead = _candidates(open_, leaders)
        few, many = F.col("meetings") <= PAIRED, F.col("meetings") > PAIRED
        pairs = _pairs(outside.filter(few), lead.filter(few))
        if seen is not None:
            pairs = pairs.join(seen, ["a", "b"], "left_anti")
        checked = _verified(pairs, table, f"checked-{leaders}")
        seen = checked.select("a", "b") if seen is None else seen.unionByName(checked.select("a", "b"))
        # links between groups join them; the groups are the nodes here
        at = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        to = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        links = checked.filter(F.col("s") >= SIMILARITY).select("a", "b")
        if outside.filter(many).head(1):
            found = _block_links(outside.filter(many), lead.filter(many), table, f"blocks-{leaders}")
            links = links.unionByName(found)
        links = links.join(at, "a").join(to, "b").select("ra", "rb")
        links = common.staged(links.filter("ra <> rb").distinct(), f"links-{leaders}")
        if links.head(1):
            merged = common.components(links, "ra", "rb").withColumnRenamed("root", "into")
            roots = roots.join(merged.withColumnRenamed("node", "root"), "root", "left")
            roots = common.staged(roots.select("node", F.coalesce("into", "root").alias("root"), "n_runs"), f"roots-{leaders}")
        if leaders >= largest:
            # everyone outside the largest group of a key has met all its members
            return roots.drop("n_runs")
        leaders *= GROWTH


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, node, component_id, kept: one row per row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    sketches = common.staged(sketch(docs), "sketches")
    linked = groups(docs, sketches)
    worded = sketches.filter("bands IS NOT NULL").select("doc_id", "node")
    lowest = worded.groupBy("node").agg(F.min("doc_id").alias("low"))
    named = lowest.join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = common.staged(named, "named")
    first = F.min(F.struct(F.col("low").isNull().alias("unnamed"), "low", "node")).alias("first")
    least = named.groupBy("root").agg(first)
    named = named.join(least, "root").select(
        "node", F.col("first.low").alias("component_id"), F.col("first.node").alias("_kept_node")
    )
    out = worded.join(named, "node")
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("node") == F.col("_kept_node"))
    out = out.select("doc_id", "node", "component_id", kept.alias("kept"))
    alone = sketches.filter("bands IS NULL")
    return out.unionByName(alone.select("doc_id", "node", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept")))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without all but one row of each group; its columns stay as they are."""
    found = common.staged(near_duplicates(docs), "kept")
    own, at, to = common.free_names(docs, "_node_of_text", "_keep_id", "_keep_node")
    keep = found.filter("kept").select(F.col("doc_id").alias(at), F.col("node").alias(to))
    keyed = docs.withColumn(own, node_id(F.col("text")))
    same = F.col("doc_id").eqNullSafe(F.col(at)) & F.col(own).eqNullSafe(F.col(to))
    kept = keyed.join(keep, same, "left_semi").drop(own)
    if keep.groupBy(at, to).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").head(1):
        # repeated rows of one id share all that a group is named by
        kept = kept.dropDuplicates(["doc_id", "text"])
    return kept


def op4_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents", "doc_id", "text")
    return near_duplicates(docs).select("doc_id", "component_id", "kept")


QUERIES = {"op4_near_copies": op4_near_copies}
