"""Sharding, whitening and spelling variants against brute force on small tables with awkward rows."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tremorframe.llm import shards, spelling, whitening

DOCS = "doc_id long, text string, lang string, source string, shard int, slot long, word string, n int, prefix string"


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and very long texts, repeated rows and ids, and columns named like results."""
    rng = random.Random(8)
    stems = ["gardens", "gardenes", "winterly", "mountain", "Straße", "naïvement", "Überall", "aaaaaa", "bananas"]
    letters = "abcdeinrstéü"

    def word():
        w = rng.choice(stems)
        if rng.random() < 0.12:
            at, c = rng.randrange(len(w)), rng.choice(letters)
            w = rng.choice([w[:at] + c + w[at:], w[:at] + w[at + 1 :], w[:at] + c + w[at + 1 :]])
        return w.capitalize() if rng.random() < 0.2 else w

    def text(n):
        return "".join(word() + rng.choice([" ", ", ", "-", "1", "\n"]) for _ in range(n))

    rows = [(i, text(rng.randrange(1, 120))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "  \n"), (None, text(50)), (None, None), (103, text(6000)), (104, "x" * 3000 + " ")]
    rows += [(105, "same words again")] * 40 + [(105, "other words"), (106, "\U0001f600 × ÷ ÀÁÂÃÄÅ")]
    rows += [(200 + i, "y" * 3000 + "z") for i in range(6)]
    return spark.createDataFrame([(*r, "en", "a", 7, 7, "w", 7, "p") for r in rows], DOCS)


def pairs_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


# -- 11 -----------------------------------------------------------------------------------------


def test_every_record_has_one_place_and_shards_are_even(spark, docs):
    found = shards.assign(docs, n_shards=5, n_slots=512).collect()
    expected = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in pairs_of(docs))
    assert sorted((r["size"], r["text_crc32"]) for r in found) == expected
    ids = Counter(d for d, _ in pairs_of(docs))
    assert Counter(r["doc_id"] for r in found) == ids
    places, sizes = defaultdict(list), Counter()
    for r in found:
        places[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert set(places) == set(range(5))
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    # the heaviest text holds most of the bytes here, so the others share what is left
    assert max(sizes.values()) <= max(max(s for s, _ in expected), 1.05 * sum(sizes.values()) / 5)
    # rows of one virtual slot share a shard, and reruns agree whatever the partitions
    assert len({(r["virtual_slot"], r["shard"]) for r in found}) == len({r["virtual_slot"] for r in found})
    again = shards.assign(docs.repartition(7), n_shards=5, n_slots=512).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, found))
    assert shards.assign(docs.limit(0)).collect() == []


def test_a_hot_record_spreads_evenly(spark, monkeypatch):
    monkeypatch.setattr(shards, "PIECE", 64)
    monkeypatch.setattr(shards, "BUCKET", 4)
    rows = spark.createDataFrame([(1, "hot text")] * 3000 + [(i, f"t{i}") for i in range(2, 800)], "doc_id long, text string")
    found = shards.assign(rows, n_shards=8, n_slots=256).collect()
    sizes, places = Counter(), defaultdict(list)
    for r in found:
        sizes[r["shard"]] += r["size"]
        places[r["shard"]].append(r["slot"])
    assert len(found) == 3798 and max(sizes.values()) - min(sizes.values()) <= 0.01 * sum(sizes.values()) / 8
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert sorted(r["copy"] for r in found if r["doc_id"] == 1) == list(range(3000))


def test_maps_are_edited_in_versions(spark, tmp_path):
    rng = np.random.default_rng(4)
    weights = rng.integers(50, 150, 2048).tolist() + [0] * 16
    first = shards.first_map(weights, 7)
    loads = first.loads(weights)
    assert max(loads) - min(loads) <= max(weights) and sum(loads) == sum(weights)
    grown = shards.grow(first, weights)
    moved = [s for s, (a, b) in enumerate(zip(first.shards, grown.shards)) if a != b]
    assert {grown.shards[s] for s in moved} == {7} and grown.version == 2
    assert max(grown.loads(weights)) <= 1.01 * sum(weights) / 8 and min(grown.loads(weights)) >= 0.99 * sum(weights) / 8
    # one shard's records become three times as long
    heavier = [w * 3 if s == 0 else w for w, s in zip(weights, grown.shards)]
    even = shards.rebalance(grown, heavier)
    mean = sum(heavier) / 8
    assert all(abs(load - mean) <= 0.01 * mean for load in even.loads(heavier))
    moved = sum(a != b for a, b in zip(grown.shards, even.shards))
    assert moved <= sum(s == 0 for s in grown.shards)
    assert shards.rebalance(even, heavier).shards == even.shards
    path = str(tmp_path / "map")
    for version in (first, grown, even):
        shards.save_map(spark, version, path)
    assert shards.load_map(spark, path) == even and shards.load_map(spark, path, 1) == first
    with pytest.raises(Exception):
        shards.save_map(spark, grown, path)
    with pytest.raises(ValueError):
        shards.load_map(spark, path, 9)
    assert shards.first_map([0, 0, 0], 2).n_shards == 2


def test_whole_rows_are_written_by_the_map(spark, docs, tmp_path):
    slot_map = shards.first_map(shards.slot_weights(shards.records(docs, 256), 256), 4)
    plain = docs.drop("shard").withColumnRenamed("n", "copies").withColumnRenamed("word", "virtual_slot")
    shards.write_shards(plain, slot_map, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(repr, back.drop("shard").collect())) == sorted(map(repr, plain.collect()))
    with pytest.raises(ValueError):
        shards.write_shards(docs, slot_map, str(tmp_path / "other"))


# -- 12 -----------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, n int, component string"


def vector_rows(x, start=0):
    return [(start + i, [float(np.float32(v)) for v in row], 1, "c") for i, row in enumerate(x)]


def check_whitening(found, kept, wanted=8):
    """``kept``: (vec_id, vector) rows that must remain."""
    x = np.floor(1024 * np.array([v for _, v in kept], dtype=np.float64)).astype(np.int64) + 100000
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:wanted], vectors[:, ::-1][:, :wanted]
    white = np.abs(centred @ vectors / np.sqrt(values))
    rows = defaultdict(list)
    for r in found:
        rows[r["vec_id"], r["component"]].append((r["deviation"], abs(r["whitened"])))
        assert r["n"] == n and r["identity_error"] <= 1e-9
        assert abs(r["explained"] - values[r["component"] - 1] / np.trace(cov)) <= 1e-10
    expected = defaultdict(list)
    for i, (ident, _) in enumerate(kept):
        deviation = sum((n * int(v) - int(s)) ** 2 for v, s in zip(x[i], sums))
        for c in range(len(values)):
            expected[ident, c + 1].append((deviation, white[i, c]))
    assert rows.keys() == expected.keys()
    for key in rows:
        for (d1, w1), (d2, w2) in zip(sorted(rows[key]), sorted(expected[key])):
            assert d1 == d2 and abs(w1 - w2) <= 1e-8


def test_whitening_equals_a_dense_solver(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 40)) * np.linspace(2, 0.5, 40)
    rows = vector_rows(x) + vector_rows(x[:50])  # repeated ids and vectors count each
    rows.append((500, [0.0] * 40, 1, "c"))
    kept = [(r[0], r[1]) for r in rows]
    bad = [None, [], [1.0] * 3, [float("nan")] + [1.0] * 39, [float("inf")] * 40, [None] * 40, [3e38] * 40]
    rows += [(900 + i, v, 1, "c") for i, v in enumerate(bad)]
    found = whitening.whiten(spark.createDataFrame(rows, VECTORS).repartition(3)).collect()
    check_whitening(found, kept)
    # one model for all rows
    per_row = defaultdict(set)
    for r in found:
        per_row[r["component"]].add((r["explained"], r["identity_error"]))
    assert all(len(s) == 1 for s in per_row.values())


def test_whitening_of_degenerate_tables(spark):
    empty = spark.createDataFrame([(1, None, 1, "c")], VECTORS)
    assert whitening.whiten(empty).collect() == [] and whitening.whiten(empty.limit(0)).collect() == []
    rng = np.random.default_rng(3)
    few = vector_rows(rng.standard_normal((50, 3)))
    check_whitening(whitening.whiten(spark.createDataFrame(few, VECTORS)).collect(), [(r[0], r[1]) for r in few], 3)
    # rank two among five dimensions, and no variance at all
    flat = rng.standard_normal((60, 2))
    found = whitening.whiten(spark.createDataFrame(vector_rows(np.hstack([flat, np.zeros((60, 3))])), VECTORS)).collect()
    assert {r["component"] for r in found if r["whitened"] is not None} == {1, 2}
    assert all(r["explained"] == 0 for r in found if r["component"] > 2) and found[0]["identity_error"] <= 1e-9
    found = whitening.whiten(spark.createDataFrame([(None, [1.0, 2.0], 1, "c")] * 2, VECTORS)).collect()
    assert [(r["vec_id"], r["whitened"], r["identity_error"], r["deviation"]) for r in found] == [(None, None, None, 0)] * 4


def test_deviations_are_exact_or_null():
    n, sums = 10**6, np.array([10**11, 3 * 10**11])
    x = np.array([[10**5 + 3, 3 * 10**5 - 1], [10**5 + 10**4, 3 * 10**5]])
    assert whitening._deviations(x, n, sums) == [10 * 10**12, None]


@pytest.mark.parametrize("d,most", [(120, 32), (64, 48), (12, 48)])
def test_jacobi_davidson_with_restarts_and_clusters(d, most):
    rng = np.random.default_rng(d)
    q, _ = np.linalg.qr(rng.standard_normal((d, d)))
    values = np.concatenate(([5.0, 5.0, 5.0], np.linspace(4, 0, d - 3)))
    a = (q * values) @ q.T
    found = whitening.jacobi_davidson(lambda v: a @ v, d, most=most)
    assert np.allclose(found.values, values[:8], atol=1e-12)
    assert np.abs(a @ found.vectors - found.vectors * found.values).max() <= 5e-13
    assert np.abs(found.vectors.T @ found.vectors - np.eye(8)).max() <= 1e-12


def test_minres_solves_the_projected_equation():
    rng = np.random.default_rng(6)
    a = rng.standard_normal((30, 30))
    a = a @ a.T
    out, _ = np.linalg.qr(rng.standard_normal((30, 3)))
    project = np.eye(30) - out @ out.T
    residuals, shifts = project @ rng.standard_normal((30, 2)), np.array([3.0, 70.0])
    t = whitening.corrections(lambda v: a @ v, shifts, out, residuals, 60)
    for k in range(2):
        left = project @ (a @ t[:, k] - shifts[k] * t[:, k])
        assert np.linalg.norm(left + residuals[:, k]) <= 2e-3 * np.linalg.norm(residuals[:, k])
    assert np.abs(out.T @ t).max() <= 1e-10


# -- 13 -----------------------------------------------------------------------------------------


def brute_variants(pairs):
    lower = str.maketrans(spelling.CAPITALS, spelling.SMALL)
    counts = Counter()
    for ident, text in pairs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if ident is None else ident}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    found = {}
    for w, n in words.items():
        others = [o for o in words if abs(len(o) - len(w)) <= 1 and near(w, o)]
        top = min(others, key=lambda o: (-words[o], o), default=None)
        form = top if top is not None and words[top] >= 5 * n else None
        found[w] = [n, len(others), form, words.get(form)]
    out = {}
    for w in found:
        root = w
        while found[root][2] is not None:
            root = found[root][2]
        out[w] = (*found[w], root)
    return out


def rows_of(df):
    rows = df.collect()
    found = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in rows}
    assert len(found) == len(rows)
    return found


def test_variants_equal_brute_force(spark, docs):
    # every doc many times under other ids, so that misspellings pass the least count
    many = docs.unionByName(docs.withColumn("doc_id", docs.doc_id + 1000))
    expected = brute_variants(pairs_of(many))
    found = rows_of(spelling.variants(many))
    assert found == expected
    assert any(v[2] for v in found.values()) and any("é" in w or "ü" in w for w in found)
    assert max(map(len, found)) == 3001
    # partitions too large for a task are unrolled again
    assert rows_of(spelling.variants(many, most_words=6)) == expected
    assert spelling.variants(docs.limit(0)).collect() == []


def test_forms_are_followed_to_the_last(spark):
    chain = [("stations", 4000), ("station", 600), ("stetion", 90), ("stetian", 14), ("stetiun", 14), ("planet", 12)]
    rows = spark.createDataFrame([(i, w) for w, n in chain for i in range(n)], "doc_id long, text string")
    expected = brute_variants(pairs_of(rows))
    found = rows_of(spelling.variants(rows))
    assert found == expected and found["stetian"][4] == "stations" and found["planet"][4] == "planet"


def test_acceptor_pairs_are_complete_and_unique():
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(0, 8))) for _ in range(150)})
    acceptor = spelling.Acceptor()
    found = [tuple(sorted(p)) for p in acceptor.pairs(acceptor.add(words))]
    assert len(found) == len(set(found))
    expected = set()
    for j, b in enumerate(words):
        shorter = {b[:i] + b[i + 1 :] for i in range(len(b))}
        for i, a in enumerate(words):
            if a in shorter or (i < j and len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1):
                expected.add((min(i, j), max(i, j)))
    assert set(found) == expected
    # states are shared: far fewer than the letters of the words
    assert len(acceptor.arcs) < sum(map(len, words)) / 4
