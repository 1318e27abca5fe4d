"""Every operator against a brute-force version on small tables with awkward rows."""

import hashlib
import math
import random
import re
import tracemalloc
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from tremorframe.llm import (
    bigram_trie,
    chat,
    common,
    language,
    mixing,
    multi_index,
    near_copies,
    pieces,
    quality,
    registry,
    url_rules,
    vector_groups,
)

DOCS = "doc_id long, text string, lang string, source string, extra string, rank int"


def prose(rng, n, words="the of and to in is that it an on with for as by ma lo ri ka tu sen dor vil".split()):
    return " ".join(rng.choice(words) + rng.choice(["", "", "n", "ra"]) for _ in range(n))


@pytest.fixture(scope="module")
def awkward(spark):
    rng = random.Random(3)
    base = prose(rng, 120)
    words = base.split()
    near = words[:]
    near[60] = "changed"
    far = words[:60] + prose(rng, 60).split()
    rows = [
        (1, base, "en", "a"),
        (2, " ".join(near), "en", "a"),
        (3, " ".join(far), "de", "b"),
        (4, base, "en", None),
        (5, None, "en", "a"),
        (6, "", None, "b"),
        (7, "  \n\t ", "de", "b"),
        (8, "one two", "en", "b"),
        (9, "One TWO", "en", "c"),
        (10, "12 34 !!", "de", "c"),
        (11, "ÉÀ \U0001f600 ▁x  y", "de", "c"),
        (None, prose(rng, 30), "en", "a"),
        (12, base * 40, "en", "b"),
        (13, "x " * 300, "en", "a"),
        (13, "x " * 300, "en", "a"),
    ]
    rows += [(20 + i, prose(rng, 40), rng.choice(["en", "de"]), rng.choice("abc")) for i in range(60)]
    return spark.createDataFrame([(*r, "z", i) for i, r in enumerate(rows)], DOCS)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_word_hashes_tell_words_apart():
    texts = ["a b  a\tB", None, "", "é a"]
    hashes, offsets = common.word_hashes(texts)
    assert np.diff(offsets).tolist() == [4, 0, 0, 2]
    assert hashes[0] == hashes[2] == hashes[5] and hashes[1] == hashes[3] != hashes[0] != hashes[4]


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 1), (20, 21), (5, 5)]
    found = dict(common.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 9: 1, 20: 20, 21: 20}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- 1 ------------------------------------------------------------------------------------------


def test_pieces_match_exhaustive_search_and_round_trip(awkward):
    vocabulary = pieces.load(pieces.model_path())
    encoder = pieces.Encoder(vocabulary)
    score = {p: s for p, _, s in vocabulary.pieces}
    ident = {p: i for p, i, _ in vocabulary.pieces}
    assert encoder.by_unit
    for text in ["hello world", "  two  spaces ", "naïve ▁mark", "", "\n\tß\U0001f600", "a" * 300]:
        ids = encoder.encode(text)
        assert encoder.decode(ids) == text
        if "▁" in text or not text:
            continue
        marked = "▁" + text.replace(" ", "▁")
        best = [(0.0, [])]
        for end in range(1, len(marked) + 1):
            choices = [(best[end - 1][0] + encoder.unknown, best[end - 1][1] + [vocabulary.byte_ids[b] for b in marked[end - 1].encode()])]
            for begin in range(max(0, end - 40), end):
                if marked[begin:end] in score:
                    choices.append((best[begin][0] + score[marked[begin:end]], best[begin][1] + [ident[marked[begin:end]]]))
            best.append(max(choices, key=lambda c: c[0]))
        gain = {i: s for _, i, s in vocabulary.pieces}
        total = sum(gain[i] for i in ids.tolist() if i in gain)
        assert math.isclose(total, sum(gain[i] for i in best[-1][1] if i in gain))
    path = pieces.model_path()
    rows = awkward.select("doc_id", "text", pieces.encode_ids(path)("text").alias("ids"))
    rows = rows.select("text", "ids", pieces.decode_ids(path)("ids").alias("back")).collect()
    assert all(r["back"] == r["text"] for r in rows)
    assert all((r["ids"] is None) == (r["text"] is None) for r in rows)

def test_rows_pass_through_encoding(awkward):
    path = pieces.model_path()
    column = pieces.encode_ids(path)("text").alias("piece_ids")
    expected = sorted(map(repr, awkward.select("doc_id", "text", column).collect()))
    found = pieces.encode_rows(awkward, path, "doc_id", "text")
    assert found.columns == ["doc_id", "text", "piece_ids"]
    assert sorted(map(repr, found.collect())) == expected
    assert pieces.encode_rows(awkward.limit(0), path, "doc_id").collect() == []


# -- 2, 3 ---------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 16))
    x[200:300] = x[:100] + 0.05 * rng.standard_normal((100, 16))
    x[300:330] = x[0]
    rows = [(i, [float(np.float32(v)) for v in row], 0) for i, row in enumerate(x)]
    rows += [(1000, None, 1), (1020, [0.0] * 16, 1), (1040, [float("nan")] * 16, 1), (1060, [1.0, None] * 8, 1)]
    rows += [(1080, [1.0] * 3, 1), (1100, [float("inf")] + [1.0] * 15, 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_nearest_over_a_small_table_is_exact(spark, table):
    x = {r["vec_id"]: np.array(r["embedding"]) for r in table.filter("vec_id < 1000").collect()}
    ids = np.array(sorted(x))
    every = np.stack([x[i] for i in ids])
    found = multi_index.nearest(table, table.filter("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()
    queries = [i for i in ids.tolist() if i % 20 == 0]
    assert len(found) == 20 * len(queries)
    for at, q in enumerate(queries):
        score = (every * x[q]).sum(axis=1)
        others = ids != q
        order = np.lexsort((ids[others], -score[others]))[:20]
        rows = found[20 * at : 20 * at + 20]
        assert [r["vec_id"] for r in rows] == ids[others][order].tolist()
        assert [r["rank"] for r in rows] == list(range(1, 21))
    assert multi_index.nearest(table.filter("false"), table).count() == 0


def test_repeated_ids_of_a_vector_leave_room_for_its_copies(spark):
    rng = np.random.default_rng(12)
    x = rng.standard_normal((60, 8)).astype(np.float32).astype(np.float64)
    x /= 2 * np.linalg.norm(x, axis=1, keepdims=True)
    x[0] = 1.0
    # more rows of one id than a list has, and a few; every query is a row of the hot vector
    rows = [(20, 0)] * 30 + [(21, 0)] * 2 + [(40 + i, 0) for i in range(25)] + [(100 + i, i) for i in range(1, 60)]
    table = spark.createDataFrame([(i, x[at].tolist()) for i, at in rows], "vec_id long, embedding array<float>")
    found = multi_index.nearest(table, table.filter("vec_id IN (20, 21, 64)")).orderBy("query_id", "rank").collect()
    for q in (20, 21, 64):
        score = {at: float((x[at] * x[0]).sum()) for at in range(60)}
        want = [i for _, i in sorted((-score[at], i) for i, at in rows if i != q)[:20]]
        assert [r["vec_id"] for r in found if r["query_id"] == q] == want


@pytest.mark.parametrize("hot", [0, 2000])
def test_recall_of_a_walk_that_leaves_cells_out(spark, hot):
    rng = np.random.default_rng(13)
    x = rng.standard_normal((6000, 32)).astype(np.float32).astype(np.float64)
    x[:hot] = x[0] + 0.01 * rng.standard_normal((hot, 32)).astype(np.float32)
    x = x.astype(np.float32).astype(np.float64)
    assert len(x) > 2 * multi_index.LEAST
    table = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<float>")
    found = {}
    for r in multi_index.nearest(table, table.filter("vec_id % 40 = 0")).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    score = x[::40] @ x.T
    score[np.arange(150), np.arange(0, 6000, 40)] = -np.inf
    best = np.argsort(-score, axis=1)[:, :20]
    # the hot cell's queries and the others each, so that neither makes up for the other
    parts = [range(hot // 40, 150)] + [range(hot // 40)] * (hot > 0)
    for k, part in enumerate(parts):
        hits = sum(len(found[40 * i] & set(best[i].tolist())) for i in part)
        assert hits >= 0.9 * 20 * len(part), (k, hits / 20 / len(part))
        if k == 0:
            assert hits < 20 * len(part)  # nothing is lost only where nothing is left out


def test_components_keep_one_table_of_their_rounds(spark):
    folder = Path(common.lineage.shared_dir(spark).removeprefix("file:"))
    before = set(folder.glob("llm-stars-*"))
    # a path, whose rounds are many, and a star
    edges = [(i, i + 1) for i in range(200)] + [(300, 301 + i) for i in range(20)]
    found = common.components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = {i: 0 for i in range(201)} | {300 + i: 300 for i in range(21)}
    assert len(found) == len(want) and {r["node"]: r["root"] for r in found} == want
    assert len(set(folder.glob("llm-stars-*")) - before) == 1


def test_blocks_and_tasks_do_not_change_the_nearest(spark):
    rng = np.random.default_rng(21)
    x = rng.standard_normal((3000, 8)).astype(np.float32).astype(np.float64)
    x[1000:2500] = x[7]  # one cell over many blocks
    table = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<float>")
    queries = table.filter("vec_id % 20 = 0")
    rows = [
        sorted(map(tuple, multi_index.nearest(table, queries, **sizes).collect()))
        for sizes in ({}, {"block_rows": 100}, {"block_rows": 700, "visits": 9})
    ]
    assert len(rows[0]) == 150 * 20
    assert rows[0] == rows[1] == rows[2]
    # batches of entries alone, of queries alone and of both
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(limit)
    try:
        spark.conf.set(limit, "64")
        small = sorted(map(tuple, multi_index.nearest(table, queries, block_rows=700).collect()))
    finally:
        spark.conf.set(limit, usual)
    assert small == rows[0]


def test_visits_rank_few_entries_of_grouped_vectors():
    rng = np.random.default_rng(22)
    x = rng.standard_normal((200, 32))[rng.integers(0, 200, 12000)] + 0.2 * rng.standard_normal((12000, 32))
    halves = multi_index.Halves(x, 31)
    cell, rests = halves.cells(x)
    n = len(halves.books[0]) * len(halves.books[1])
    sizes = np.bincount(cell, minlength=n)
    means = np.stack([np.bincount(cell, r, minlength=n) / np.maximum(sizes, 1) for r in rests])
    asked = np.arange(0, 12000, 100)
    best = np.argsort(-(x[asked] @ x.T), axis=1)[:, :20]
    seen = np.stack(list(halves.visits(x[asked], sizes, means, 20, 0.95)))
    assert np.mean([seen[i][cell[best[i]]].mean() for i in range(len(asked))]) >= 0.9
    assert (seen * sizes).sum(axis=1).mean() < 0.4 * len(x)


def test_expected_hits_add_up_and_follow_the_normal_tail():
    rng = np.random.default_rng(23)
    middle, spread = rng.standard_normal(30), rng.uniform(0.1, 1.0, 30)
    counts = rng.integers(1, 2000, 30)
    hits = multi_index.expected_hits(middle, spread, counts, 50)
    assert 50 <= hits.sum() <= 50.5 and (hits <= counts).all()
    drawn = np.concatenate([m + s * rng.standard_normal(n) for m, s, n in zip(middle, spread, counts)])
    best = np.bincount(np.repeat(np.arange(30), counts)[np.argsort(-drawn)[:50]], minlength=30)
    assert np.abs(best - hits).max() <= 15
    assert multi_index.expected_hits(middle, spread, np.ones(30, dtype=int), 50).tolist() == [1] * 30


def test_walk_visits_cells_in_order():
    rng = np.random.default_rng(1)
    a, b = rng.standard_normal(6), rng.standard_normal(5)
    seen = multi_index.walk(a, b, np.ones((6, 5)), 9)
    total = a[:, None] + b[None, :]
    assert seen.sum() == 9 and total[seen].min() >= total[~seen].max()


def test_visits_need_little_memory_for_many_cells():
    rng = np.random.default_rng(12)
    unit = lambda n: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(rng.standard_normal((n, 64)))
    centroids, vectors_ = unit(1024), unit(3000)
    tracemalloc.start()
    apart = vector_groups.distances(centroids)
    home, other = vector_groups.visits(vectors_, centroids, apart, 0.9)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20
    assert (home == (vectors_ @ centroids.T).argmax(axis=1)).all()
    for i in range(0, 3000, 500):
        exact = np.linalg.norm(centroids - centroids[home[i]], axis=1) * (math.sqrt(0.2) / 2 + 1e-7)
        score = centroids @ vectors_[i]
        margin = score[home[i]] - score - exact
        margin[home[i]] = 1
        assert set(np.flatnonzero(margin <= -1e-9)) <= set(other[i]) <= set(np.flatnonzero(margin <= 1e-6))


@pytest.mark.parametrize("members, visitors, most_cells", [(2048, 8192, 1024), (8, 24, 1024), (8, 24, 1)])
def test_vector_groups_match_brute_force(table, monkeypatch, members, visitors, most_cells):
    monkeypatch.setattr(vector_groups, "MEMBERS_PER_TASK", members)
    monkeypatch.setattr(vector_groups, "VISITORS_PER_TASK", visitors)
    rows = {r["vec_id"]: r for r in vector_groups.groups(table, most_cells=most_cells).collect()}
    ids = list(range(400))
    x = np.array([r["embedding"] for r in table.filter("vec_id < 1000").orderBy("vec_id").collect()])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    label = np.arange(400)
    for _ in range(400):
        label = np.where(near, label[None, :], 1 << 30).min(axis=1)
    assert [rows[i]["n_links"] for i in ids] == (near.sum(axis=1) - 1).tolist()
    assert [rows[i]["component_id"] for i in ids] == label.tolist()
    for i in (1000, 1020, 1040, 1060, 1080, 1100):
        assert (rows[i]["n_links"], rows[i]["component_id"], rows[i]["kept"]) == (0, i, True)
    assert vector_groups.groups(table.filter("false")).count() == 0


# -- 4 ------------------------------------------------------------------------------------------


def test_near_copies_match_brute_force(awkward):
    found = near_copies.near_duplicates(awkward)
    got = {(r["doc_id"], r["node"]): r["component_id"] for r in found.collect()}
    assert found.count() == awkward.count()
    shingles = {}
    for r in awkward.filter("doc_id IS NOT NULL").collect():
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words_of(r["text"])]
        runs = [tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))] if w else []
        shingles[r["doc_id"]] = Counter(runs)

    def alike(a, b):
        if not a or not b:
            return False
        plain = len(a.keys() & b.keys()) / len(a.keys() | b.keys())
        every = a.keys() | b.keys()
        weighted = sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in every) for i in a.keys() & b.keys())
        return max(plain, weighted) >= 0.8

    label = {i: i for i in shingles}
    for _ in range(len(label)):
        for i in label:
            for j in label:
                if label[j] < label[i] and alike(shingles[i], shingles[j]):
                    label[i] = label[j]
    assert {i: c for (i, _), c in got.items() if i is not None} == label
    kept = near_copies.keep_one(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r[0] for r in kept.filter("doc_id IS NOT NULL").select("doc_id").collect()) == sorted(set(label.values()))
    assert near_copies.near_duplicates(awkward.filter("false")).count() == 0


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(2)
    run = rng.integers(1, 1 << 62, 60).astype(np.uint64)
    a, b = np.sort(run[:50]), np.sort(run[10:])
    wa, wb = rng.integers(1, 5, 50).astype(float), rng.integers(1, 5, 50).astype(float)
    slots = 20_000
    s = near_copies.signatures(2, np.repeat([0, 1], 50), np.concatenate((a, b)), np.concatenate((wa, wb)), slots)
    x, y = dict(zip(a, wa)), dict(zip(b, wb))
    exact = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys()) for i in x.keys() & y.keys())
    assert abs((s[0] == s[1]).mean() - exact) < 0.015
    ia, ib = np.intersect1d(a, b, return_indices=True)[1:]
    assert math.isclose(near_copies._probability_jaccard(wa, wb, ia, ib), exact)


def test_plain_links_are_found_however_often_runs_repeat(spark):
    rows, pair = [], {}
    for k, (many, few) in enumerate([(50, 2), (20, 2), (100, 10), (50, 1)] * 3):
        line = " ".join(f"l{k}x{i}" for i in range(10))
        rest = " ".join(f"r{k}x{i}" for i in range(100))
        for i, n in enumerate((many, few)):
            rows.append((10 * k + i, f"{rest} " + f"{line} " * n))
            pair[10 * k + i] = 10 * k
    runs = {i: near_copies.runs([t]) for i, t in rows}
    assert all(near_copies.similarity(*runs[pair[i]][1:], *runs[i][1:]) >= 0.8 for i in pair)
    # the text with one line of a kind repeats nothing and has 36 bands
    keys = dict(zip(pair, near_copies.band_keys([t for _, t in rows])))
    assert len(keys[31]) == near_copies.BANDS < len(keys[30])
    assert all(len(np.intersect1d(keys[i], keys[pair[i]])) for i in pair)
    found = near_copies.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == pair


def test_one_row_of_a_group_is_kept(spark):
    rng = random.Random(8)
    rows = []
    for first in (None, 7, 8):
        base = prose(rng, 150).split()
        for k, doc in enumerate([first, first, 9 if first == 8 else first]):
            rows.append((doc, " ".join(base[: 50 * k] + ["other"] * (k > 0) + base[50 * k + 1 :])))
    rows += [(None, "quite another text of six words"), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_copies.near_duplicates(docs).collect()
    assert {r["component_id"] for r in found} == {None, 7, 8} and len(found) == len(rows)
    kept = near_copies.keep_one(docs).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["7", "8", "None", "None"]
    assert {r["node"] for r in found if r["kept"]} == {r[0] for r in spark.createDataFrame(kept).select(near_copies.node_id(common.F.col("text"))).collect()}


# -- 5 ------------------------------------------------------------------------------------------


def test_mix_meets_targets(awkward):
    rows = mixing.mix_sources(awkward).collect()
    assert len(rows) == awkward.count()
    again = mixing.mix_sources(awkward.repartition(5)).collect()
    key = lambda r: (str(r["doc_id"]), r["copy"], r["taken"])
    assert sorted(map(key, rows)) == sorted(map(key, again))
    sizes = Counter()
    for r in awkward.collect():
        sizes[r["source"]] += len(words_of(r["text"]))
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full = set()
    while True:  # share, cap, share the excess again
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        unit = rest / sum(weight[s] for s in order if s not in full)
        over = {s for s in order if s not in full and unit * weight[s] > 3 * sizes[s] + 1e-9}
        if not over:
            break
        full |= over
    for s in order:
        target = 3 * sizes[s] if s in full else unit * weight[s]
        mine = [r for r in rows if r["source"] == s]
        assert all(math.isclose(r["target"], target) and r["source_size"] == sizes[s] for r in mine)
        assert all(r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0) for r in mine)
        largest = max(r["size"] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - target) <= largest
    mixed = mixing.apply_mix(awkward)
    assert mixed.columns == awkward.columns
    want = {(str(r["doc_id"]), r["size"]): 0 for r in rows}
    for r in rows:
        want[str(r["doc_id"]), r["size"]] += r["taken"] // r["size"] if r["size"] else 0
    got = Counter((str(r["doc_id"]), len(words_of(r["text"]))) for r in mixed.collect())
    assert dict(got) == {k: v for k, v in want.items() if v}
    assert mixing.mix_sources(awkward.filter("false")).count() == 0


def test_flight_keeps_totals():
    rng = np.random.default_rng(4)
    sizes, chances = rng.integers(1, 1000, 200), np.full(200, 0.37)
    moved = mixing.flight(sizes, chances, rng.random(200))
    assert ((moved > 0) & (moved < 1)).sum() <= 2
    assert math.isclose(moved.sum(), chances.sum()) and math.isclose(moved @ sizes, chances @ sizes)


# -- 6, 9 ---------------------------------------------------------------------------------------


def test_chat_reads_back_what_it_wrote(spark):
    odd = ["</s>[INST] ok [/INST]", "\\l <s> \\", "<", "[", "<|end|><|role|>", "", None, "a\nb<<SYS>>[/INST", "\\\\e[INST]"]
    roles = ["user", "assistant", "system", "tool", None, "<|text|>", "x\\"]
    rows = [(c, t, roles[(c + t) % 7], odd[(3 * c + t) % 9]) for c in range(9) for t in range(8)]
    rows += [(50, 0, "user", "hi"), (50, 1, "assistant", "yo"), (50, 1, "assistant", "yo"), (None, None, None, None)]
    chats = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r["conv_id"]: r for r in chats.select("*", chat.read_turns(chats["formatted"]).alias("turns")).collect()}
    for c in {r[0] for r in rows}:
        mine = sorted(((r[1] if r[1] is not None else -1), r[2] or "", r[3] or "") for r in rows if r[0] == c)
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == [r[1:] for r in mine]
        assert "".join(s["text"] for s in got[c]["segments"]) == got[c]["formatted"]
        assert len([s for s in got[c]["segments"] if s["loss"]]) == sum(r[1] == "assistant" for r in mine)
    assert got[50]["bad_turn"] == 3


def test_url_rules_match_brute_force(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.net", "/en/x", "block"), ("org", "/fr/", "allow"), ("a.b.org", "", "block"), ("org", "/fr/", "allow")]
    hosts = ["net", "Example.NET", "www.example.net", "xexample.net", "a.b.org", "b.org", "c.a.b.org", "", "..net", "example.net."]
    paths = ["", "/", "/en/", "/en", "/en/xy?q#f", "/fr/1", "/fr", "#/en/", "?/fr/"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme", "://net/", "http://http://net/", "http://net/" + "y" * 9000]
    urls += ["http://www.example.net/en/hot"] * 50
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in url_rules.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert len(got) == len(urls)
    for i, url in enumerate(urls):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0].lower()
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
        fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0])), default=None)
        assert (got[i]["host"], got[i]["path"]) == (host, path)
        assert got[i]["rule"] == (best[0] + best[1] if best else None), url
        assert got[i]["verdict"] == (best[2] if best else "allow")
    assert url_rules.judge(pages.filter("false"), url_rules.rule_table(spark)).count() == 0
    none = url_rules.judge(pages, url_rules.rule_table(spark, ()))
    assert none.filter("rule IS NOT NULL").count() == 0 and none.count() == len(urls)


# -- 7, 8 ---------------------------------------------------------------------------------------


def test_language_and_quality_on_awkward_rows(spark, awkward):
    predict = language.predictor(spark, *language.fit(awkward))
    rows = awkward.select("doc_id", predict("text").alias("p")).collect()
    got = {r["doc_id"]: r["p"] for r in rows}
    assert [got[i]["lang"] for i in (5, 6, 7, 10)] == ["und"] * 4
    assert all(0 <= r["p"]["score"] <= 1 and r["p"]["lang"] in ("en", "de", "und") for r in rows)
    nothing = language.predictor(spark, *language.fit(awkward.filter("false")))
    assert {r[0] for r in awkward.select(nothing("text")["lang"]).collect()} == {"und"}
    labels = spark.createDataFrame([(i, i % 2) for i in range(20, 80)] + [(1, None), (20, 0)], "doc_id long, quality int")
    score = quality.scorer(spark, quality.fit(awkward, labels))
    assert all(0 <= r[0] <= 1 for r in awkward.select(score("text")).collect())
    empty = quality.scorer(spark, quality.fit(awkward, labels.filter("false")))
    assert {r[0] for r in awkward.select(empty("text")).collect()} == {0.5}


def test_rows_of_a_hot_labelled_id_are_learned_once(spark):
    rng = random.Random(9)
    rows = [(1, prose(rng, 20)) for _ in range(200)] + [(1, None)] + [(i, prose(rng, 20)) for i in range(2, 13)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i > 1)) for i in range(1, 13)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    assert model.labels.tolist() == [0] + [1] * 11 and (np.abs(model.vectors).sum(axis=1) > 0).all()
    assert sorted(quality.fit(docs.repartition(3), labels, 12).labels.tolist()) == sorted(model.labels.tolist())


def test_mixture_finds_both_languages():
    likelihood = np.array([[0.5, 0.01], [0.49, 0.01], [0.01, 0.98]])
    share, _ = language.mixture(np.array([30.0, 30.0, 40.0]), likelihood, 200)
    assert abs(share[1] - 0.4) < 0.05


def test_held_out_accuracy(spark, sf_dir):
    docs = common.read(spark, sf_dir, "documents", "doc_id", "lang")
    found = language.op7_language_id(spark, sf_dir).join(docs, "doc_id").filter("held_out")
    rows = found.selectExpr("lang = lang_pred AS hit").collect()
    assert sum(r["hit"] for r in rows) >= 0.9 * len(rows)


# -- 10 -----------------------------------------------------------------------------------------


def test_elias_fano_finds_successors():
    rng = np.random.default_rng(6)
    for n, top in ((0, 10), (1, 10), (500, 600), (500, 1 << 62)):
        values = np.sort(rng.integers(0, top, n)).astype(np.uint64)
        held = bigram_trie.EliasFano.of(values, top)
        asked = np.concatenate((values, rng.integers(0, top, 200).astype(np.uint64)))
        assert (held.successor(asked) == np.searchsorted(values, asked)).all()
        assert (held.select(np.arange(n)) == values).all()


def test_elias_fano_searches_many_blocks():
    rng = np.random.default_rng(8)
    values = np.sort(np.concatenate((rng.integers(0, 1 << 40, 150_000), rng.integers(0, 1 << 12, 50_000)))).astype(np.uint64)
    held = bigram_trie.EliasFano.of(values, 1 << 40)
    asked = np.concatenate((values[::7], rng.integers(0, 1 << 40, 90_000).astype(np.uint64)))
    assert (held.successor(asked) == np.searchsorted(values, asked)).all()
    assert (held.select(np.arange(len(values))[::-1]) == values[::-1]).all()


def test_requests_ask_every_part_of_a_spread_context_and_no_idle_shard():
    rng = np.random.default_rng(4)
    vocabulary = np.unique(rng.integers(1, 1 << 62, 300)).astype(np.uint64)
    hot = vocabulary[[3, 50, 70]]
    spread = bigram_trie.Spread(hot, np.array([2, 40, 1000]))
    keys = np.unique(rng.integers(0, len(vocabulary), 2000) * len(vocabulary) + rng.integers(0, len(vocabulary), 2000))
    keys = np.unique(np.concatenate((keys, 50 * len(vocabulary) + np.arange(len(vocabulary)))))
    ask = bigram_trie._requests(vocabulary, keys, spread, 1000)
    # every word and pair is asked once, and pairs follow the words that are their contexts
    assert sorted(ask.words[~ask.is_spread]) == list(range(len(vocabulary))) and sorted(ask.pairs) == list(range(len(keys)))
    assert (np.repeat(ask.words, ask.fans) == keys[ask.pairs] // len(vocabulary)).all()
    far = np.isin(ask.words, (3, 50, 70))
    assert (np.repeat(ask.is_spread, ask.fans) == np.repeat(far, ask.fans)).all()
    assert Counter(ask.words[ask.is_spread].tolist()) == {3: 2, 50: 40, 70: 1000}
    assert len(np.unique(ask.shards)) == len(ask.shards) and (ask.pair_bounds == np.cumsum([0, *ask.fans])[ask.bounds]).all()
    # without a context in all shards, shards that nothing is asked of get no row
    few = bigram_trie._requests(vocabulary, keys, bigram_trie.Spread(hot[:0], np.zeros(0, np.int64)), 100_000)
    assert (np.diff(few.bounds) > 0).all() and len(few.shards) <= len(vocabulary)


@pytest.mark.parametrize("chunk_tokens, shard_bytes", [(10**6, 1 << 25), (500, 3000), (2000, 300)])
def test_scores_match_brute_force(awkward, chunk_tokens, shard_bytes):
    docs = awkward.selectExpr("doc_id", "text", "coalesce(doc_id % 5 <> 1, false) AS train")
    rows = bigram_trie.score(docs, chunk_tokens, shard_bytes).collect()
    lower = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words_of(t)] + ["\n"]
    texts = [(r["doc_id"], r["train"], lower(r["text"])) for r in docs.collect()]
    count, pair, after = Counter(), Counter(), Counter()
    for _, train, tokens in texts:
        if train:
            count.update(tokens)
            pair.update(zip(["\r", *tokens], tokens))
            after.update(["\r", *tokens[:-1]])
    followers = Counter(u for u, _ in pair)
    n, v = sum(count.values()), len(count)
    base = lambda w: (count[w] + 0.5) / (n + 0.5 * (v + 1))

    def chance(u, w):
        if not after[u]:
            return base(w)
        return max(pair[u, w] - bigram_trie.DISCOUNT, 0) / after[u] + bigram_trie.DISCOUNT * followers[u] / after[u] * base(w)

    want = sorted(
        (str(i), len(t), sum(w in count for w in t), sum(math.log10(base(w)) for w in t), sum(math.log10(chance(u, w)) for u, w in zip(["\r", *t], t)))
        for i, _, t in texts
    )
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in rows)
    assert [g[:3] for g in got] == [w[:3] for w in want] and {r["train_tokens"] for r in rows} == {n}
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-9)
    # codes round down by at most a 4096th of a factor of ten
    assert all(w[4] - w[1] / 4096 - 1e-6 <= g[4] <= w[4] + 1e-6 for g, w in zip(got, want))


# -- queries ------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(name, spark, oracle, sf_dir):
    from checks.compare import compare

    ok, note = compare(spark, oracle, registry.QUERIES[name], registry.ORACLES[name], sf_dir)
    assert ok, note


# names that the stages use for helpers, some in other letter case, beside the columns of documents
CLASHING = [
    "_language", "_QUALITY", "_node_of_text", "_Keep_Id", "_keep_node", "_mix_id", "_MIX_COPY", "_mix_times",
    "_mix_each", "_mix_row", "node", "root", "copy", "size", "taken", "target", "kept", "uid", "_rn", "_text",
]


def test_pipeline_stages_keep_columns_and_the_right_rows(spark, sf_dir):
    import corpus_pipeline

    plain = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = plain.select("*", *[common.F.concat(common.F.lit(f"{name} "), "doc_id").alias(name) for name in CLASHING])
    columns, tables = docs.columns, [docs]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = common.staged(stage(spark, docs, sf_dir), f"test-stage-{i}")
        tables.append(docs)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
            rows = docs.collect()
            assert all(r[c] == f"{c} {r['doc_id']}" for r in rows for c in CLASHING), name
    ids = [sorted(r["doc_id"] for r in t.select("doc_id").collect()) for t in tables]
    held = [{r["doc_id"]: r for r in t.collect()} for t in tables]
    assert all(set(after) <= set(before) for before, after in zip(ids, ids[1:]))

    names, table = language.fit(language.training_rows(tables[0]))
    table = table.astype(np.float32).astype(np.float64)
    guess = {i: language.identify(r["text"], names, table, np.log(table)) for i, r in held[0].items()}
    known = [i for i, (lang, score) in guess.items() if lang != language.UNKNOWN and score >= 0.5]
    assert ids[1] == sorted(known)

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(common.fold("doc_id", 4) != 2)
    score = brute_votes(tables[1], labels, [r["text"] for r in held[1].values()])
    kept = [i for i, s in zip(held[1], score) if s >= quality.THRESHOLD]
    assert ids[2] == sorted(kept)

    runs = {}
    for i, r in held[2].items():
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words_of(r["text"])]
        runs[i] = Counter(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))) if w else Counter()
    root = {i: i for i in runs}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in runs:
        for j in runs:
            common_runs = runs[i].keys() & runs[j].keys()
            if i < j and common_runs:
                plain_share = len(common_runs) / len(runs[i].keys() | runs[j].keys())
                a, b = (sum(runs[k].values()) for k in (i, j))
                weighed = sum(
                    1 / sum(max(runs[i][y] / runs[i][x], runs[j][y] / runs[j][x]) for y in runs[i].keys() | runs[j].keys())
                    for x in common_runs
                ) if min(a, b) / max(a, b) > 0.5 else 0.0
                if max(plain_share, weighed) >= 0.8:
                    root[max(top(i), top(j))] = min(top(i), top(j))
    assert ids[3] == sorted(i for i in runs if top(i) == i)

    times = Counter(ids[4])
    sizes = {i: len(words_of(r["text"])) for i, r in held[3].items()}
    mixed = {r["doc_id"]: r["taken"] for r in mixing.mix_sources(tables[3].select("doc_id", "text", "source")).collect()}
    assert {i: times[i] * sizes[i] for i in sizes} == mixed and max(times.values()) <= 3

    assert tables[5].columns == ["doc_id", "source", "piece_ids", "n_pieces"] and ids[5] == ids[4]
    encoder = pieces.Encoder(pieces.load(pieces.model_path()))
    for i, r in held[5].items():
        assert r["piece_ids"] == encoder.encode(held[4][i]["text"]).tolist() and r["n_pieces"] == len(r["piece_ids"])


def brute_votes(docs, labels, texts):
    """Votes of the nearest learned texts, one comparison at a time, on the projection that is fitted."""
    model = quality.fit(docs, labels)
    scores = []
    for text in texts:
        if not text:
            scores.append(model.mean)
            continue
        own = quality.project(quality.term_counts([text]), model.weights, model.basis)[0]
        near = [float(np.dot(own, v)) for v in model.vectors]
        kth = sorted(near, reverse=True)[min(quality.NEIGHBOURS, len(near)) - 1]
        votes = [(max(s, 0.0) ** 8, label) for s, label in zip(near, model.labels.tolist()) if s >= kth - 1e-6]
        mass = sum(w for w, _ in votes)
        scores.append(sum(w * label for w, label in votes) / mass if mass > 0 else model.mean)
    return scores


def test_terms_see_words_and_code_points():
    one = lambda text: quality.term_counts([text])[0]
    shapes = slice(0, quality.SHAPES)
    prose_, noise = one("The cat sat on the mat."), one("Xqz bvk wrp fd jjh zzt.")
    assert (one("Abc def") != one("Xyz uvw")).any() and (prose_[quality.SHAPES :] != noise[quality.SHAPES :]).any()
    # shapes count a letter once, whatever its bytes; capitals and digits of other scripts are such
    assert (one("\u0414\u0430 \u0431\u0430")[shapes] == one("Da ba")[shapes]).all()
    assert (one("\u0663\u0664")[shapes] == one("34")[shapes]).all() and (one("\u00bfab")[shapes] != one("aab")[shapes]).any()
    # case changes shapes alone
    assert (one("\u0414a Ba")[quality.SHAPES + quality.WORDS :] == one("\u0434A bA")[quality.SHAPES + quality.WORDS :]).all()
    assert quality.term_counts([None, "", "a b"]).sum(axis=1)[0] == quality.term_counts([""]).sum()
    assert (quality.term_counts(["x y", "long " * 2000, None])[1] == one("long " * 2000)).all()


def test_votes_tell_words_of_equal_shape_apart(spark):
    rng = random.Random(3)
    good, bad = ["cat", "dog", "sun", "sea", "map", "red"], ["xqz", "bvk", "wrp", "fdj", "jjh", "zzt"]
    text = lambda words: " ".join(rng.choice(words) for _ in range(30))
    rows = [(i, text(good if i % 2 else bad)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality int")
    score = quality.scorer(spark, quality.fit(docs, labels))
    found = docs.filter("doc_id >= 100").select("doc_id", score("text").alias("s")).collect()
    assert all((r["s"] >= quality.THRESHOLD) == (r["doc_id"] % 2 == 1) for r in found)


def traced_peak(work):
    tracemalloc.start()
    work()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak


def test_a_workers_arrays_do_not_grow_with_its_batch():
    rng = random.Random(5)
    texts = [None, "", *(prose(rng, 800) for _ in range(600))]
    assert sum(len(t or "") for t in texts) > 1_900_000
    quality.term_counts(texts[:3])
    near_copies.band_keys(texts[:3])
    counted = traced_peak(lambda: [quality.term_counts(texts[lo:hi]).sum() for lo, hi in quality._blocks(texts)])
    assert counted < 60 << 20
    assert traced_peak(lambda: near_copies.band_keys(texts)) < 60 << 20


def test_scores_of_a_batch_are_those_of_its_texts():
    rng = random.Random(6)
    texts = [prose(rng, rng.choice([3, 40, 800])) for _ in range(200)]
    texts[5], texts[130], texts[131] = None, "", "long " * 60_000
    counts = np.log1p(quality.term_counts(texts[:100]))
    basis = quality.singular_basis(counts, 8)
    weights = np.ones(quality.TERMS, np.float32)
    labels = np.arange(100, dtype=np.float32) % 2
    model = quality.Model(weights, basis, quality.project(np.expm1(counts), weights, basis), labels, 0.25)
    batch = pa.array(["outside", *texts])[1:]
    whole = quality.scores(batch, model).to_pylist()
    alone = [quality.scores(pa.array([t], pa.string()), model)[0].as_py() for t in texts]
    assert whole == pytest.approx(alone, abs=1e-4) and whole[5] == whole[130] == 0.25
    assert len(quality.scores(pa.array([], pa.string()), model)) == 0


def test_votes_match_brute_force(spark, awkward, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(common.fold("doc_id", 4) != 2)
    found = {r["doc_id"]: r["score"] for r in quality.op8_quality(spark, sf_dir).collect()}
    rows = docs.select("doc_id", "text").collect()
    for r, score in zip(rows, brute_votes(docs, labels, [r["text"] for r in rows])):
        assert found[r["doc_id"]] == pytest.approx(score, abs=1e-3)


def test_language_sets_match_all_subsets():
    """The chosen languages are the best of all sets of three, by penalised likelihood."""
    from itertools import combinations

    rng = np.random.default_rng(21)
    names = ["aa", "bb", "cc"]
    table = rng.dirichlet(np.full(language.BUCKETS, 0.02), 3).T * 0.98 + 0.02 / language.BUCKETS
    logs = np.log(table)
    base = "abcdefghijklmnopqrstuvwxyz "
    for trial in range(20):
        text = "".join(rng.choice(list(base), 200))
        # counts from a mixture of one to three languages stand for the text's
        shares = rng.dirichlet([1.0, 1.0, 1.0]) if trial % 3 == 2 else np.eye(3)[trial % 3] * 0.5 + np.eye(3)[(trial + 1) % 3] * 0.5
        if trial % 4 == 0:
            shares = np.eye(3)[trial % 3]
        drawn = rng.choice(language.BUCKETS, size=3000, p=table @ shares / (table @ shares).sum())
        counts = np.bincount(drawn, minlength=language.BUCKETS).astype(float)
        used = np.flatnonzero(counts)
        best = None
        for size in (1, 2, 3):
            for subset in combinations(range(3), size):
                rows = table[used][:, list(subset)]
                proportions, fit = (np.ones(1), float(counts[used] @ np.log(rows[:, 0]))) if size == 1 else language.mixture(counts[used], rows)
                value = fit - language.PENALTY * np.log(counts.sum()) * (size - 1)
                if best is None or value > best[0] + 1e-6:
                    best = (value, subset, proportions)
        original = language.ngram_ids
        try:
            language.ngram_ids = lambda _: drawn
            name, share = language.identify(text, names, table, logs)
        finally:
            language.ngram_ids = original
        at = int(np.argmax(best[2]))
        assert name == names[best[1][at]] and share == pytest.approx(float(best[2][at]), abs=0.02)


def test_tiny_fractions_are_decided():
    p = np.array([1e-12, 1 - 1e-12, 0.0, 1.0, 0.5, 0.25, 0.25])
    moved = mixing.flight(np.arange(1.0, 8.0), p, np.full(7, 0.3))
    assert moved[:4].tolist() == [0.0, 1.0, 0.0, 1.0] and ((moved > 0) & (moved < 1)).sum() <= 2


def test_blocks_of_runs_find_what_pairs_find():
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for k in range(40):
        words = [w if rng.random() > 0.02 else f"x{k}" for w in base]
        texts.append(" ".join(words + words[: 8 * (k % 3)]))
    held = []
    for text in texts:
        owner, run, weight = near_copies.runs([text])
        held.append((run, weight))
    pairs = [(i, j) for i in range(15) for j in range(25)]
    exact = [(i, j) for i, j in pairs if near_copies.similarity(*held[i], *held[15 + j]) >= 0.8]
    assert 0 < len(exact) < len(pairs)
    assert [tuple(p) for p in near_copies.block_links(held[:15], held[15:]).tolist()] == exact
    for i, j in pairs:
        (a, wa), (b, wb) = held[i], held[15 + j]
        _, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        if len(ia):
            bound = near_copies.highest(wa[ia].sum() / wa.sum(), wb[ib].sum() / wb.sum())
            assert near_copies._probability_jaccard(wa, wb, ia, ib) <= bound + 1e-9


def test_classes_do_not_depend_on_how_large_bands_are_compared(spark, awkward, monkeypatch):
    def classes():
        return {(r["doc_id"], r["component_id"]) for r in near_copies.near_duplicates(awkward).collect()}

    paired = classes()
    monkeypatch.setattr(near_copies, "PAIRED", 0)
    monkeypatch.setattr(near_copies, "BLOCK_TEXTS", 2)
    assert classes() == paired
