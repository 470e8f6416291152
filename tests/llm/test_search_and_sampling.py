"""Ranked search, nearest neighbours and importance resampling against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tidemark.llm import lexical, neighbours, queries, resampling

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = ["the", "The", "river", "RIVER", "été", "Été", "x1", "2", "под", "lamp", "stone", "a_b", "don't", "Ünder", "rare1", "rare2"]


def cut(text: str | None) -> list[str]:
    out, word = [], ""
    for c in (text or "").translate(UP) + " ":
        if ord(c) >= 128 or c.isascii() and c.isalnum():
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def texts(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return [" ".join(rng.choices(WORDS, weights=[9, 5, 5, 2, 2, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0.05, 0.02], k=rng.randrange(1, 60))) for _ in range(n)]


def documents() -> list[tuple]:
    made = texts(60, 3)
    rows = [(i, t) for i, t in enumerate(made)] + [(100 + i, made[0]) for i in range(25)]  # a group of copies
    rows += [(200, None), (201, ""), (202, " \t\n.,;"), (203, "lamp"), (204, "word " * 40_000 + "river"), (None, made[1]), (5, made[5]), (5, made[5]), (5, "river lamp"), (None, None)]
    return rows


ITEMS = [(0, "the river"), (1, "River river RIVER lamp"), (2, None), (3, " "), (4, "unknown words only"), (5, "rare1 rare2 é té"), (5, "stone"), (None, "lamp"), (6, "lamp " * 3 + "under Ünder été")]


def ranked(docs: list[tuple], items: list[tuple], k: int) -> list[tuple]:
    held = [(i, Counter(w), len(w)) for i, w in ((i, cut(t)) for i, t in docs) if w]
    n_docs, total = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in held:
            m = 100 - 75 + (75 * n * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in cut(text) if c[t])
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return out


def same(found, expected) -> None:
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize("pairs, chunk", [(500_000, 1 << 20), (4, 16)])
def test_search_ranks_as_all_pairs_do(spark, monkeypatch, pairs, chunk):
    monkeypatch.setattr(lexical, "BLOCK_PAIRS", pairs)
    monkeypatch.setattr(lexical, "CHUNK", chunk)
    docs = spark.createDataFrame([(*r, 1, 2) for r in documents()], "doc_id long, text string, score long, rank int").repartition(3)
    items = spark.createDataFrame([(*r, 1) for r in ITEMS], "item_id long, text string, doc_id int").repartition(2)
    same(lexical.ranked_search(docs, items, k=10).collect(), ranked(documents(), ITEMS, 10))


def test_search_of_nothing(spark):
    docs, items = (spark.createDataFrame(rows, f"{key} long, text string") for rows, key in ((documents(), "doc_id"), (ITEMS, "item_id")))
    assert lexical.ranked_search(docs.limit(0), items).collect() == [] == lexical.ranked_search(docs, items.limit(0)).collect()
    assert lexical.ranked_search(docs.filter("doc_id in (200, 201)"), items).collect() == []


def test_search_by_names(spark):
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts(20, 8))], "name string, body string")
    items = spark.createDataFrame([("q", "river lamp")], "name string, body string")
    found = lexical.ranked_search(docs, items, k=3, doc_id="name", item_id="name", text="body").collect()
    same(found, ranked([(f"d{i}", t) for i, t in enumerate(texts(20, 8))], [("q", "river lamp")], 3))


def test_radix_order():
    keys = np.random.default_rng(1).integers(0, 1 << 32, 10_000, dtype=np.uint64).astype(np.uint32)
    assert (keys[lexical.radix_order(keys)] == np.sort(keys)).all() and len(lexical.radix_order(keys[:0])) == 0


def resampled(docs: list[tuple], targets: list[str | None], percent: int, min_words: int, buckets: int, seed: int) -> list[tuple]:
    def features(text):
        w = cut(text)
        return Counter(zlib.crc32(f.encode()) % buckets for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]), len(w)

    held = [(i, *features(t)) for i, t in docs]
    s, t = sum((c for _, c, _ in held), Counter()), sum((features(x)[0] for x in targets), Counter())
    s_all, t_all = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in s}
    rows = []
    for i, c, n in held:
        weight = sum(gain[b] * x for b, x in c.items()) // c.total() if c else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, c.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    long = sorted((r for r in rows if r[5] >= min_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for place, r in enumerate(long[: percent * len(long) // 100]):
        r[4] = place + 1
    return [tuple(r[:5]) for r in rows]


@pytest.mark.parametrize("batch", [2 << 20, 300])
def test_resampling_as_one_pass_does(spark, monkeypatch, batch):
    monkeypatch.setattr(resampling, "BATCH_BYTES", batch)
    docs = spark.createDataFrame([(*r, 1, 2) for r in documents()], "doc_id long, text string, score long, key int").repartition(3)
    targets = spark.createDataFrame([(t,) for _, t in ITEMS], "text string")
    found = resampling.resample(docs, targets, percent=25, min_words=20, buckets=10_000, seed=7).collect()
    expected = resampled(documents(), [t for _, t in ITEMS], 25, 20, 10_000, 7)
    same(found, expected)
    assert sum(r.rank is not None for r in found) == 25 * sum(len(cut(t)) >= 20 for _, t in documents()) // 100 > 5
    crowded = resampling.resample(docs, targets, percent=60, min_words=1, buckets=7, seed=9)
    same(crowded.collect(), resampled(documents(), [t for _, t in ITEMS], 60, 1, 7, 9))


def test_resampling_of_nothing(spark):
    docs, targets = spark.createDataFrame(documents(), "doc_id long, text string"), spark.createDataFrame([], "text string")
    assert resampling.resample(docs.limit(0), targets).collect() == []
    same(resampling.resample(docs, targets).collect(), resampled(documents(), [], 25, 20, 10_000, 7))


def vectors(n: int, dim: int, seed: int) -> list[tuple]:
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    made = (centres[rng.integers(0, 12, n)] + 0.6 * rng.normal(size=(n, dim))) * rng.uniform(0.5, 1.5, (n, 1))
    return [(i, [float(x) for x in np.float32(v)]) for i, v in enumerate(made)]


AWKWARD = [(9001, None), (9002, []), (9003, [0.0] * 8), (9020, [1.0, None] + [0.5] * 6), (9040, [math.nan] + [1.0] * 7), (9060, [math.inf] * 8), (9080, [1.0] * 7), (None, [0.5] * 8)]


def near(rows: list[tuple], dim: int, k: int) -> dict[int, list[list[tuple]]]:
    held = [(i, np.array(v, float)) for i, v in rows if v and len(v) == dim and None not in v and np.isfinite(v).all() and any(v)]
    matrix = np.stack([v for _, v in held])
    out: dict[int, list[list[tuple]]] = {}
    for j, (i, q) in enumerate(held):
        if i is not None and i % 20 == 0:
            scores = np.zeros(len(held))
            for d in range(dim):
                scores += q[d] * matrix[:, d]
            order = sorted((x for x in range(len(held)) if x != j), key=lambda x: (-scores[x], held[x][0] is None, held[x][0] or 0))
            out.setdefault(i, []).append([(held[x][0], float(scores[x])) for x in order[:k]])
    return out


def by_query(found) -> dict[int, list[list[tuple]]]:
    out: dict[int, list[list[tuple]]] = {}
    for r in found:  # a query's rows come one after the other
        runs = out.setdefault(r.query_id, [])
        if r["rank"] == 1:
            runs.append([])
        runs[-1].append((r.vec_id, r.score))
        assert r["rank"] == len(runs[-1])
    return out


def is_query():
    from pyspark.sql import functions as F

    return F.col("id") % 20 == 0


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0.0, 1) for r in rows], "vec_id long, embedding array<float>, score double, rank int").repartition(3)


def test_neighbours_of_all_leaves_are_exact(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BIN_ROWS", 50)
    monkeypatch.setattr(neighbours, "CELL_QUERIES", 7)
    rows = vectors(600, 8, 2) + AWKWARD + [(7000 + i, [1.0, 2.0] + [0.25] * 6) for i in range(200)]  # a large group of equal vectors
    rows += [rows[20], rows[20], (40, [0.5] * 8)]
    found = by_query(neighbours.nearest(frame(spark, rows), is_query(), k=20, target=2.0).collect())
    expected = near(rows, 8, 20)
    assert found.keys() == expected.keys() and all(sorted(found[q]) == sorted(expected[q]) for q in found)


def test_neighbours_reach_their_recall(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF_ROWS", 32)
    rows = vectors(4000, 16, 5)
    seen: list[tuple[int, int]] = []
    calibrated = neighbours.calibrated

    def noted(indexed, n, dim, tree, k, target):
        seen.append((calibrated(indexed, n, dim, tree, k, target), tree.n_leaves))
        return seen[-1][0]

    monkeypatch.setattr(neighbours, "calibrated", noted)
    found, expected = by_query(neighbours.nearest(frame(spark, rows), is_query(), k=20).collect()), near(rows, 16, 20)
    assert found.keys() == expected.keys()
    hits = sum(len({i for i, _ in found[q][0]} & {i for i, _ in expected[q][0]}) for q in expected)
    assert hits >= 0.9 * 20 * len(expected) and seen[0][0] < seen[0][1]
    matrix = {i: np.array(v) for i, v in rows}
    for q, (got,) in found.items():
        assert len(got) == 20 and got == sorted(got, key=lambda x: (-x[1], x[0]))
        assert all(math.isclose(s, float(matrix[q] @ matrix[i]), rel_tol=1e-12) for i, s in got)


def test_neighbours_of_few_and_none(spark):
    assert neighbours.nearest(frame(spark, []), is_query()).collect() == [] == neighbours.nearest(frame(spark, AWKWARD[:4]), is_query()).collect()
    one = neighbours.nearest(frame(spark, [(0, [1.0, 2.0])]), is_query()).collect()
    few = neighbours.nearest(frame(spark, [(0, [1.0, 2.0]), (1, [3.0, 1.0]), (2, [3.0, 1.0])]), is_query()).collect()
    assert one == [] and [tuple(r) for r in few] == [(0, 1, 1, 5.0), (0, 2, 2, 5.0)]


def test_tree_holds_every_row_once():
    data = np.array([v for _, v in vectors(500, 8, 1)])
    tree = neighbours.fit(data, 20)
    leaves = tree.leaves_of(data)
    assert 10 <= tree.n_leaves and set(leaves) <= set(range(tree.n_leaves))
    assert all(sorted(order) == list(range(tree.n_leaves)) for order in tree.visits(data[:5], tree.n_leaves))
    assert neighbours.fit(np.ones((50, 4)), 10).n_leaves == 1


def test_queries_are_registered():
    assert {"op11_ranked_search", "op12_nearest_neighbours", "op13_importance_resample"} <= set(queries.QUERIES)


def test_join_links_rows_without_identifier(spark):
    from tidemark.llm import jaccard

    words = [f"w{i}" for i in range(60)]
    near_text = " ".join([*words[:59], "other"])
    rows = [(7, " ".join(words)), (8, near_text), (None, " ".join(words[1:])), (None, " ".join([*words, "more"])), (None, "a text of its own that nothing else is like at all"), (None, None), (None, ""), (3, "x y z"), (None, "x y z"), (None, "alone one"), (None, "alone one")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int").repartition(3)
    found = jaccard.jaccard_components(df, shingle=4, percent=85).collect()
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=repr)
    assert got == sorted([(7, 57, 7), (8, 57, 7), (None, 56, 7), (None, 58, 7), (None, 9, None), (None, 0, None), (None, 0, None), (3, 1, 3), (None, 1, 3), (None, 1, None), (None, 1, None)], key=repr)
    with pytest.raises(ValueError):
        jaccard.jaccard_components(df, percent=50)


@pytest.mark.parametrize("most_bytes", [64 << 20, 0])
def test_windows_with_one_prefix_and_shared_passages(spark, monkeypatch, most_bytes):
    from tidemark.llm import decontam

    monkeypatch.setattr(decontam, "MAX_BROADCAST_BYTES", most_bytes)
    rng = random.Random(4)
    items = [(i, "which of the " + " ".join(rng.choices(WORDS[:6], k=9))) for i in range(60)] + [(100, "two words"), (101, "One"), (102, None), (103, "two words")]
    shared = items[7][1]
    docs = [(i, " ".join(rng.choices(["which of the", "river", "Lamp", "two words", "stone", shared.upper()], weights=[5, 5, 5, 1, 5, i % 3 == 0], k=40))) for i in range(40)]
    docs += [(50, None), (51, ""), (None, shared), (None, "one"), (3, shared), (52, "which of the " * 3000 + items[9][1])]
    found = decontam.with_contamination(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, w int"), spark.createDataFrame(items, "item_id long, text string"), n=10).collect()

    def expected(text):
        w, hit, held = cut(text), set(), set()
        for i, t in items:
            words = cut(t)
            n = min(10, len(words))
            grams = {tuple(words[j : j + n]) for j in range(len(words) - n + 1)} if n else set()
            at = [j for j in range(len(w) - n + 1) if tuple(w[j : j + n]) in grams] if grams else []
            hit |= {k for j in at for k in range(j, j + n)}
            held |= {str(i)} if at else set()
        return len(w), len(hit), sorted(held)

    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r.hit_items)) for r in found), key=repr) == sorted(((i, *expected(t)) for i, t in docs), key=repr)
    if not most_bytes:
        windows = decontam.item_windows(spark.createDataFrame(items, "item_id long, text string"), 10)
        words = spark.createDataFrame([(1, cut(docs[0][1]))], "id long, w array<string>")
        seen: list[str] = []
        monkeypatch.setattr(decontam, "work_table", lambda df, label: seen.append(df._jdf.queryExecution().executedPlan().toString()) or df)
        decontam.find_hits(words, windows, ["id"])
        assert seen and all(" w#" not in line for plan in seen for line in plan.splitlines() if "Exchange" in line) and "BroadcastExchange" not in seen[0].split("Exchange hashpartitioning")[0]
