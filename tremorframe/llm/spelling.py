"""Spelling variant grouping by finite-state composition (operator 13).

Two words are near if one inserted, deleted or replaced code point makes them equal. The pairs are the
paths of vocabulary acceptor o one-edit transducer o vocabulary acceptor. Before its edit such a path
reads the same code points on both sides, so in a deterministic acceptor both sides are in one state;
after it both read the same rest. Every pair is counted at one edit only: the first place where its
words differ.

The composition is cut at its initial states. Its first arcs are unrolled over the cluster: paths that
edit among the first ``UNROLLED`` code points must agree in all others, so they meet under that key.
Paths without an edit so far have read one prefix, and prefixes are the partitions. In each task the
words of a partition become a minimised acceptor whose states number the words they accept; pairs of a
state are found once for all paths that lead to it. A partition above ``MOST_WORDS`` is unrolled again
from the longest prefix its words share, so no task holds more, whatever the vocabulary.

Defined cases: NULL texts have no words; a NULL doc_id is written as the empty text. Equal rows count
each. Of two near words with equal n the smaller in code-point order is the form. Empty tables give no
rows. Columns other than doc_id and text are never read.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tremorframe.llm import common

# Code points of a word: A-Z, a-z and U+00C0 to U+00FF; only A-Z are lower-cased.
LETTERS = "A-Za-zÀ-ÿ"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TYPO_EVERY = 199
LEAST_LENGTH, LEAST_COUNT, FORM_RATIO = 6, 5, 5
# Code points whose edits are found over the cluster, and the words that one partition may hold.
UNROLLED, MOST_WORDS = 3, 20_000

_GAIN = "word string, n_near long, near_n long, near string"


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n of ``docs`` (doc_id, text): the words that take part, with their occurrences."""
    # deletions only shorten, so shorter runs never become words
    runs = F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{LEAST_LENGTH},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    rows = rows.select("id", F.translate("run", CAPITALS, SMALL).alias("run"))
    rows = rows.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    deleted = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % TYPO_EVERY == 0, deleted).otherwise(F.col("run"))
    counts = rows.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter((F.length("word") >= LEAST_LENGTH) & (F.col("n") >= LEAST_COUNT))


class Acceptor:
    """Minimised acyclic acceptors that share states; a state numbers its words in code-point order."""

    def __init__(self) -> None:
        self.final: list[bool] = []
        self.arcs: list[dict[str, int]] = []
        self.skip: list[dict[str, int]] = []  # words of a state before those of an arc
        self.size: list[int] = []
        self._known: dict[tuple, int] = {}
        self._common: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def _state(self, final: bool, arcs: list[tuple[str, int]]) -> int:
        key = (final, *arcs)
        found = self._known.get(key)
        if found is None:
            found = self._known[key] = len(self.arcs)
            before, skip = int(final), {}
            for letter, target in arcs:
                skip[letter] = before
                before += self.size[target]
            self.final.append(final)
            self.arcs.append(dict(arcs))
            self.skip.append(skip)
            self.size.append(before)
        return found

    def add(self, words: list[str]) -> int:
        """The initial state of an acceptor of ``words``, which are distinct and sorted."""
        open_states: list[list] = [[False, []]]
        path = ""

        def close(depth: int) -> None:
            while len(open_states) > depth + 1:
                final, arcs = open_states.pop()
                open_states[-1][1].append((path[len(open_states) - 1], self._state(final, arcs)))

        for word in words:
            same = 0
            for a, b in zip(path, word):
                if a != b:
                    break
                same += 1
            close(same)
            open_states.extend([False, []] for _ in range(len(word) - same))
            open_states[-1][0] = True
            path = word
        close(0)
        return self._state(*open_states[0])

    def common(self, left: int, right: int) -> list[tuple[int, int]]:
        """Numbers in both states of the words that both accept; ``left`` <= ``right``."""
        todo = [(left, right)]
        while todo:
            pair = todo[-1]
            if pair in self._common:
                todo.pop()
                continue
            a, b = pair
            if a == b:
                self._common[pair] = [(i, i) for i in range(self.size[a])]
                continue
            arcs_a, arcs_b = self.arcs[a], self.arcs[b]
            shared = [(c, arcs_a[c], arcs_b[c]) for c in arcs_a.keys() & arcs_b.keys()]
            missing = [(min(x, y), max(x, y)) for _, x, y in shared]
            missing = [p for p in missing if p not in self._common]
            if missing:
                todo.extend(missing)
                continue
            both = [(0, 0)] if self.final[a] and self.final[b] else []
            for c, x, y in shared:
                both.extend(self._shifted(x, y, self.skip[a][c], self.skip[b][c]))
            self._common[pair] = both
        return self._common[left, right]

    def _shifted(self, x: int, y: int, by_x: int, by_y: int) -> list[tuple[int, int]]:
        if x <= y:
            return [(i + by_x, j + by_y) for i, j in self.common(x, y)]
        return [(i + by_x, j + by_y) for j, i in self.common(y, x)]

    def edited(self, state: int) -> list[tuple[int, int]]:
        """Pairs of the state's words that differ first at their first code point."""
        arcs, skip = list(self.arcs[state].items()), self.skip[state]
        found = []
        for k, (c, x) in enumerate(arcs):
            for d, y in arcs[:k]:  # replaced
                found.extend(self._shifted(x, y, skip[c], skip[d]))
            if self.final[state] and self.final[x]:  # inserted behind the end
                found.append((0, skip[c]))
            inner = self.arcs[x]
            for d, y in arcs:  # inserted before another code point
                if d != c and d in inner:
                    found.extend(self._shifted(y, inner[d], skip[d], skip[c] + self.skip[x][d]))
        return found

    def pairs(self, root: int):
        """(number, number) of all near words below ``root``."""
        memo: dict[int, list[tuple[int, int]]] = {}
        todo = [(root, 0)]
        while todo:
            state, base = todo.pop()
            if state not in memo:
                memo[state] = self.edited(state)
            for i, j in memo[state]:
                yield base + i, base + j
            todo.extend((target, base + self.skip[state][c]) for c, target in self.arcs[state].items() if self.size[target] > 1)


def _compose(pdf: pd.DataFrame) -> pd.DataFrame:
    """Near words within each prefix of one task: word, n_near, near_n, near."""
    words, counts, prefixes = pdf["word"].tolist(), pdf["n"].tolist(), pdf["prefix"].tolist()
    order = sorted(range(len(words)), key=lambda i: (prefixes[i], words[i]))
    words, counts, prefixes = ([values[i] for i in order] for values in (words, counts, prefixes))
    acceptor = Acceptor()
    near = [0] * len(words)
    best: list = [None] * len(words)
    start = 0
    while start < len(words):
        stop = start
        while stop < len(words) and prefixes[stop] == prefixes[start]:
            stop += 1
        depth = len(prefixes[start])
        root = acceptor.add([w[depth:] for w in words[start:stop]])
        for i, j in acceptor.pairs(root):
            for own, other in ((start + i, start + j), (start + j, start + i)):
                near[own] += 1
                seen = best[own]
                if seen is None or (-counts[other], other) < (-counts[seen], seen):
                    best[own] = other
        start = stop
    some = [i for i, k in enumerate(near) if k]
    return pd.DataFrame(
        {
            "word": pd.Series([words[i] for i in some], dtype=object),
            "n_near": pd.Series([near[i] for i in some], dtype="int64"),
            "near_n": pd.Series([counts[best[i]] for i in some], dtype="int64"),
            "near": pd.Series([words[best[i]] for i in some], dtype=object),
        }
    )


def _unrolled(words: DataFrame) -> DataFrame:
    """Near words whose first difference is among the ``UNROLLED`` code points from ``start`` on.

    Words replaced at one place are those of a key. Of words around an insertion the longer one leaves
    a code point out, and only where the next differs, so that the pair meets at one place.
    """
    length, letter = F.length("word"), lambda at: F.substring("word", at + 1, F.lit(1))
    at = F.explode(F.sequence(F.col("start"), F.col("start") + UNROLLED - 1)).alias("at")
    placed = words.select("word", "n", at).filter(F.col("at") <= length)
    at = F.col("at")
    head = F.substring("word", F.lit(1), at)
    rest, own = F.substring("word", at + 2, length), F.substring("word", at + 1, length)
    inside = at < length

    def entry(kind: str, role: str, tail: Column, holds: Column) -> Column:
        key = F.concat(head, F.lit(kind), tail)
        return F.when(holds, F.struct(key.alias("key"), F.lit(role).alias("role")))

    entries = F.array(
        entry("?", "replaced", rest, inside),
        entry("+", "longer", rest, inside & (letter(at) != letter(at + 1))),
        entry("+", "shorter", own, F.lit(True)),
    )
    rows = placed.select("word", "n", F.explode(F.array_compact(entries)).alias("e")).select("word", "n", "e.key", "e.role")
    rows = rows.withColumn("rank", F.struct((-F.col("n")).alias("less"), "word"))
    # a key holds one word for each letter of the alphabet and one shorter word at most
    group, ranked = W.partitionBy("key"), W.partitionBy("key").orderBy("rank")
    role = F.col("role")
    longer = F.when(role == "longer", F.col("rank"))
    shorter = F.when(role == "shorter", F.col("rank"))
    rows = rows.select(
        "word",
        "role",
        F.count(F.lit(1)).over(group).alias("all"),
        F.count(longer).over(group).alias("longer"),
        F.min(longer).over(group).alias("best_longer"),
        F.min(shorter).over(group).alias("best_shorter"),
        F.when(F.row_number().over(ranked) == 1, F.lead("rank").over(ranked))
        .otherwise(F.min("rank").over(group))
        .alias("best_other"),
    ).filter(F.col("all") > 1)
    near = F.when(role == "replaced", F.struct((F.col("all") - 1).alias("n_near"), F.col("best_other").alias("rank")))
    near = near.when(role == "shorter", F.struct(F.col("longer").alias("n_near"), F.col("best_longer").alias("rank")))
    near = near.otherwise(
        F.struct((F.col("all") - F.col("longer")).alias("n_near"), F.col("best_shorter").alias("rank"))
    )
    rows = rows.select("word", near.alias("near")).filter("near.n_near > 0")
    return rows.select("word", "near.n_near", (-F.col("near.rank.less")).alias("near_n"), F.col("near.rank.word").alias("near"))


def _shared(low: Column, high: Column) -> Column:
    """Length of the longest prefix that two texts share."""
    places = F.sequence(F.lit(1), F.greatest(F.least(F.length(low), F.length(high)), F.lit(1)))
    same = F.filter(places, lambda k: F.substring(low, F.lit(1), k) != F.substring(high, F.lit(1), k))
    return F.coalesce(F.array_min(same) - 1, F.least(F.length(low), F.length(high)))


def near_words(words: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """word, n_near, near_n, near of ``words`` (word, n): near words and the largest of them."""
    gains = []
    rows = words.select("word", "n", F.lit(0).alias("start"))
    while True:
        gains.append(_unrolled(rows))
        deep = rows.filter(F.length("word") >= F.col("start") + UNROLLED)
        rows = deep.select("word", "n", F.substring("word", F.lit(1), F.col("start") + UNROLLED).alias("prefix"))
        sizes = rows.groupBy("prefix").agg(
            F.count(F.lit(1)).alias("held"), F.min("word").alias("low"), F.max("word").alias("high")
        )
        sizes = common.staged(sizes.filter(F.col("held") > 1), "prefixes")
        total = sizes.filter(F.col("held") <= most_words).agg(F.sum("held")).first()[0] or 0
        # small prefixes share a task, so that a task's words stay bounded and tasks are few
        tasks = max(1, math.ceil(total / most_words * 4))
        small = rows.join(sizes.filter(F.col("held") <= most_words).select("prefix"), "prefix")
        small = small.withColumn("task", F.pmod(F.xxhash64("prefix"), F.lit(tasks)))
        gains.append(small.groupBy("task").applyInPandas(_compose, _GAIN))
        large = sizes.filter(F.col("held") > most_words)
        if not large.head(1):
            break
        large = large.select("prefix", _shared(F.col("low"), F.col("high")).alias("start"))
        rows = common.staged(rows.join(large, "prefix").select("word", "n", "start"), "large-prefixes")
    found = gains[0]
    for more in gains[1:]:
        found = found.unionByName(more)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return found.select("word", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.near").alias("near"))


def last_forms(forms: DataFrame) -> DataFrame:
    """word, root of ``forms`` (word, form): the last form that is reached by following them.

    Every round doubles the steps taken. A form is ``FORM_RATIO`` times as frequent as its word, so
    chains have at most some 27 steps and the rounds are few.
    """
    at = forms.select("word", F.col("form").alias("root"))
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.isnotnull("next").alias("moved"))
        moved = common.staged(moved, "roots")
        at = moved.select("word", "root")
        if not moved.filter("moved").head(1):
            return at


def variants(docs: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """word, n, n_near, form, form_n, root of the words of ``docs`` (doc_id, text)."""
    words = common.staged(vocabulary(docs), "vocabulary")
    found = words.join(near_words(words, most_words), "word", "left")
    fits = F.col("near_n") >= F.col("n") * FORM_RATIO
    found = found.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(fits, F.col("near")).alias("form"),
        F.when(fits, F.col("near_n")).alias("form_n"),
    )
    found = common.staged(found, "forms")
    roots = last_forms(found.filter(F.col("form").isNotNull()))
    return found.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents", "doc_id", "text")
    return variants(docs).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {"op13_spelling": op13_spelling}
