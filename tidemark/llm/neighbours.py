"""Approximate nearest neighbours by largest inner product: a hierarchical k-means tree, best bin first.

1. The tree is fitted on a bounded sample of ``FIT_ROWS`` distinct vectors: k-means splits a node into up to ``BRANCH``
   children until a leaf holds its share of the sample. It has about one leaf for ``LEAF_ROWS`` rows of the table, at most
   ``MAX_LEAVES``, so what is sent to the tasks is bounded whatever the table.
2. Every row of the table descends to one leaf. Rows are laid out in the order of leaves and cut into bins of about
   ``BIN_ROWS`` rows, so a leaf of very many rows is many bins and small leaves share one.
3. A query walks the tree through a priority queue, always opening the node whose centroid has the largest inner product
   with it, and lists leaves in the order in which they come up.
4. The number of leaves that queries visit is calibrated: for ``CALIBRATION`` rows the true neighbours are found in one
   scan of all rows, and visits widen until these rows' recall, less its sampling error, reaches the target.
5. A query goes to the bins of the leaves it visits; a bin asked by very many queries is dealt to several cells. A cell
   compares its queries with its rows at once and keeps ``k`` neighbours a query; those are merged query by query.

Scores are inner products in double precision, summed in the order of components; products of single-precision components
are exact, so ties are too.

Cases: vectors that are null, empty, zero, hold null or non-finite components, or have another length than most take no
part, as query or as candidate. Rows that repeat an identifier are rows of their own, and each sees the others; ties go to
the smaller identifier, null last; rows without one are candidates. Many equal vectors are one leaf, cut into bins like any
other. Fewer than ``k`` candidates: all. Empty table: no rows. Other columns never clash, only identifiers are returned.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bounded, work_table

#: Vectors that the tree is fitted on, at most about.
FIT_ROWS = 32_768
#: Rows of the table for a leaf, and leaves of a tree at most.
LEAF_ROWS, MAX_LEAVES = 128, 4096
BRANCH, ROUNDS = 16, 12
#: Rows of a bin, and queries that meet it in one cell.
BIN_ROWS, CELL_QUERIES = 512, 4096
#: Rows whose true neighbours calibrate the visits, and the recall that they must reach.
CALIBRATION, TARGET = 256, 0.95
#: Standard errors of the calibrated recall that must still be above the target.
ERRORS = 1.5
#: Leaves and bins of a query that are read from one row.
VISIT = "bin long, query long, query_id {kind}, vector array<double>, leaves array<int>"


@dataclass
class Tree:
    """Nodes by number: centroids, children, and the leaf number of those that have none."""

    centroids: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)
    n_leaves: int = 0

    def add(self, centroid: np.ndarray) -> int:
        self.centroids.append(centroid)
        self.children.append([])
        self.leaf.append(-1)
        return len(self.leaf) - 1

    def leaves_of(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf that each vector descends to, by the nearest child."""
        out = np.zeros(len(vectors), np.int32)
        todo = [(0, np.arange(len(vectors)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node]:
                out[rows] = self.leaf[node]
                continue
            to = nearest_centroid(vectors[rows], np.stack([self.centroids[c] for c in self.children[node]]))
            todo += [(c, rows[to == i]) for i, c in enumerate(self.children[node]) if np.any(to == i)]
        return out

    def visits(self, queries: np.ndarray, most: int) -> Iterator[list[int]]:
        """For each query its first ``most`` leaves, best bin first."""
        near = queries @ np.stack(self.centroids).T
        for row in near:
            queue, found = [(-row[0], 0)], []
            while queue and len(found) < most:
                _, node = heapq.heappop(queue)
                if self.children[node]:
                    for c in self.children[node]:
                        heapq.heappush(queue, (-row[c], c))
                else:
                    found.append(self.leaf[node])
            yield found


def nearest_centroid(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids**2).sum(1) - 2 * (vectors @ centroids.T), axis=1)


def k_means(vectors: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, which of them is nearest) by Lloyd's rounds from random vectors; centroids of none are dropped."""
    centroids = vectors[rng.choice(len(vectors), k, replace=False)]
    for _ in range(ROUNDS):
        to = nearest_centroid(vectors, centroids)
        n = np.bincount(to, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, to, vectors)
        centroids = sums[n > 0] / n[n > 0, None]
    return centroids, nearest_centroid(vectors, centroids)


def fit(sample: np.ndarray, n_leaves: int, seed: int = 1) -> Tree:
    """A tree of about ``n_leaves`` leaves over the distinct rows of ``sample``."""
    vectors = np.unique(sample, axis=0)
    rng, tree, share = np.random.default_rng(seed), Tree(), max(1.0, len(vectors) / n_leaves)
    todo = [(tree.add(vectors.mean(0)), vectors)]
    while todo:
        node, held = todo.pop()
        k = min(BRANCH, math.ceil(len(held) / share), len(held))
        centroids, to = k_means(held, k, rng) if k > 1 else (held[:1], np.zeros(len(held), int))
        if len(np.unique(to)) < 2:
            tree.leaf[node] = tree.n_leaves
            tree.n_leaves += 1
            continue
        for i, c in enumerate(centroids):
            if np.any(to == i):
                child = tree.add(c)
                tree.children[node].append(child)
                todo.append((child, held[to == i]))
    return tree


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def exact_scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows, summed in the order of components."""
    out = np.zeros(len(queries))
    for i in range(queries.shape[1]):
        out += queries[:, i] * rows[:, i]
    return out


def top_pairs(queries: np.ndarray, rows: np.ndarray, allowed: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the ``k`` best allowed rows of each query, by score and then by ``ids``."""
    near = np.where(allowed, queries @ rows.T, -np.inf)
    if rows.shape[0] > k:
        # Whatever the order of a sum, it is off by far less than this part of the vectors' lengths.
        slack = 1e-9 * np.linalg.norm(queries, axis=1) * np.linalg.norm(rows, axis=1).max(initial=0.0)
        cut = np.partition(near, -k, axis=1)[:, -k] - slack
        q, r = np.nonzero(allowed & (near >= cut[:, None]))
    else:
        q, r = np.nonzero(allowed)
    scores = exact_scores(queries[q], rows[r])
    order = np.lexsort((ids[r], -scores, q))
    q, r, scores = q[order], r[order], scores[order]
    first = np.searchsorted(q, np.arange(len(queries)))
    kept = np.arange(len(q)) - first[q] < k
    return q[kept], r[kept], scores[kept]


def usable(vector: Column) -> Column:
    """Not null, not zero, all components there and finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def indexed_rows(df: DataFrame, vec_id: str, vector: str) -> tuple[DataFrame, int, int]:
    """(row, id, vector) of all rows that take part, their number and their length."""
    rows = df.select(F.col(vec_id).alias("id"), F.col(vector).cast("array<double>").alias("vector")).filter(usable(F.col("vector")))
    rows = work_table(rows.withColumn("row", F.monotonically_increasing_id()), "neighbour-rows")
    most = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    return (rows.filter(F.size("vector") == most["dim"]), most["count"], most["dim"]) if most else (rows, 0, 0)


def _sampled(rows: DataFrame, n: int, at_most: int, salt: int) -> DataFrame:
    """About ``at_most`` of the ``n`` rows, or all if they are no more; which ones depends on their numbers alone."""
    return rows if n <= at_most else rows.filter(F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(1 << 30)) < at_most * (1 << 30) // n)


def with_leaf(rows: DataFrame, tree: Tree, dim: int) -> DataFrame:
    """``rows`` (row, id, vector) with the leaf of each."""
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = shared.value.leaves_of(_matrix(batch.column("vector"), dim))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], [*batch.schema.names, "leaf"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("row", "id", "vector").mapInArrow(run, f"row long, id {kind}, vector array<double>, leaf int")


def calibrated(indexed: DataFrame, n: int, dim: int, tree: Tree, k: int, target: float) -> int:
    """Leaves to visit, by the true neighbours of a bounded number of rows."""
    chosen = _sampled(indexed, n, CALIBRATION, 2).select("row", "vector").toArrow().combine_chunks().to_batches()
    queries, own = _matrix(chosen[0].column("vector"), dim), chosen[0].column("row").to_numpy()
    shared = indexed.sparkSession.sparkContext.broadcast((queries, own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, own = shared.value
        best = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0)]
        for batch in batches:
            rows = batch.column("row").to_numpy()
            q, r, scores = top_pairs(queries, _matrix(batch.column("vector"), dim), rows[None, :] != own[:, None], rows, k)
            best = [np.concatenate(x) for x in zip(best, (q, rows[r], batch.column("leaf").to_numpy()[r], scores), strict=True)]
            order = np.lexsort((best[1], -best[3], best[0]))
            best = [x[order] for x in best]
            kept = np.arange(len(order)) - np.searchsorted(best[0], best[0]) < k
            best = [x[kept] for x in best]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in best], ["query", "row", "leaf", "score"])

    found = indexed.select("row", "vector", "leaf").mapInArrow(run, "query long, row long, leaf int, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "row")
    true: dict[int, list[int]] = {}
    for r in found.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= k).collect():  # CALIBRATION times k rows
        true.setdefault(r["query"], []).append(r["leaf"])
    orders = list(tree.visits(queries, tree.n_leaves))
    places = [np.argsort(orders[q])[np.array(leaves)] for q, leaves in true.items()]
    visits = 1
    while places and visits < tree.n_leaves:
        recall = np.array([np.mean(p < visits) for p in places])
        if recall.mean() - ERRORS * recall.std() / math.sqrt(len(recall)) >= target:
            break
        visits += max(1, visits // 16)
    return min(visits, tree.n_leaves)


def bins_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) bin of each leaf, from the leaves' numbers of rows."""
    before = np.cumsum(counts) - counts
    return before // BIN_ROWS, (before + np.maximum(counts, 1) - 1) // BIN_ROWS


def binned(indexed: DataFrame, counts: np.ndarray) -> DataFrame:
    """``indexed`` with the bin of each row: its leaf's rows are spread over the leaf's places by a hash."""
    before = np.cumsum(counts) - counts
    spark = indexed.sparkSession
    places = spark.createDataFrame(pa.table([pa.array(np.arange(len(counts)), pa.int32()), pa.array(before), pa.array(counts)], ["leaf", "before", "held"]))
    spread = F.pmod(F.xxhash64("row", F.lit(3)), F.lit(1 << 20)) / (1 << 20)
    joined = indexed.join(F.broadcast(places), "leaf")  # MAX_LEAVES rows
    return joined.withColumn("bin", F.floor((F.col("before") + F.floor(spread * F.col("held"))) / BIN_ROWS)).drop("before", "held")


def visits_of(queries: DataFrame, tree: Tree, counts: np.ndarray, dim: int, visits: int) -> DataFrame:
    """(bin, query, query_id, vector, leaves): a row for each bin of the leaves that a query visits."""
    shared = queries.sparkSession.sparkContext.broadcast((tree, counts, *bins_of(counts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, counts, first, last = shared.value
        for batch in batches:
            at: list[tuple[int, int, list[int]]] = []
            for i, leaves in enumerate(tree.visits(_matrix(batch.column("vector"), dim), visits)):
                by_bin: dict[int, list[int]] = {}
                for leaf in leaves:
                    for b in range(first[leaf], last[leaf] + 1) if counts[leaf] else ():
                        by_bin.setdefault(b, []).append(leaf)
                at += [(i, b, ls) for b, ls in by_bin.items()]
            rows = batch.take(pa.array([i for i, _, _ in at], pa.int64()))
            columns = [pa.array([b for _, b, _ in at], pa.int64()), *[rows.column(c) for c in ("row", "id", "vector")], pa.array([ls for _, _, ls in at], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["bin", "query", "query_id", "vector", "leaves"])

    return queries.select("row", "id", "vector").mapInArrow(run, VISIT.format(kind=queries.schema["id"].dataType.simpleString()))


def compared(rows: DataFrame, asked: DataFrame, dim: int, k: int) -> DataFrame:
    """(query, query_id, ids, scores): the ``k`` best rows of a cell (bin, part) for each query that asks it."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        names = ["query", "query_id", "ids", "scores"]
        if not left.num_rows or not right.num_rows:
            empty = pa.array([], pa.list_(left.schema.field("id").type))
            return pa.table([right["query"].slice(0, 0), right["query_id"].slice(0, 0), empty, pa.array([], pa.list_(pa.float64()))], names)
        leaf = left["leaf"].to_numpy()
        allowed = np.zeros((right.num_rows, int(max(leaf.max(), max(map(max, right["leaves"].to_pylist())))) + 1), bool)
        for i, leaves in enumerate(right["leaves"].to_pylist()):
            allowed[i, leaves] = True
        own = left["row"].to_numpy()[None, :] == right["query"].to_numpy()[:, None]
        order = np.argsort(pc.rank(left["id"], "ascending", null_placement="at_end", tiebreaker="min").to_numpy(), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        q, r, scores = top_pairs(*[_matrix(t["vector"].combine_chunks(), dim) for t in (right, left)], allowed[:, leaf] & ~own, place, k)
        ends = pa.array(np.searchsorted(q, np.arange(right.num_rows + 1)), pa.int32())
        ids = pa.ListArray.from_arrays(ends, left["id"].combine_chunks().take(pa.array(r)))
        return pa.table([right["query"], right["query_id"], ids, pa.ListArray.from_arrays(ends, pa.array(scores))], names)

    cell = ["bin", "part"]
    schema = f"query long, query_id {kind}, ids array<{kind}>, scores array<double>"
    return rows.groupBy(*cell).cogroup(asked.groupBy(*cell)).applyInArrow(run, schema)


def merged(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) from (query, query_id, ids, scores), a stream of rows sorted by query."""
    kind = found.schema["query_id"].dataType.simpleString()

    def best(entries: list[tuple]) -> list[tuple]:
        return heapq.nsmallest(k, entries, key=lambda e: (-e[0], e[1] is None, e[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: list[pa.DataType] = []

        def out(name, entries: list[tuple]) -> pa.RecordBatch:
            columns = [[name] * len(entries), list(range(1, len(entries) + 1)), [e[1] for e in entries], [e[0] for e in entries]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (types[0], pa.int32(), types[0], pa.float64()), strict=True)], ["query_id", "rank", "vec_id", "score"])

        query, name, entries = None, None, []
        for batch in batches:
            types[:] = [batch.schema.field("query_id").type]
            for q, n, ids, scores in zip(*[batch.column(c).to_pylist() for c in ("query", "query_id", "ids", "scores")], strict=True):
                if q != query:
                    if query is not None:
                        yield out(name, entries)
                    query, name, entries = q, n, []
                entries = best([*entries, *zip(scores, ids, strict=True)])
        if query is not None:
            yield out(name, entries)

    schema = f"query_id {kind}, rank int, vec_id {kind}, score double"
    return found.repartition("query").sortWithinPartitions("query").mapInArrow(run, schema)


def nearest(df: DataFrame, is_query: Column, *, k: int = 20, target: float = TARGET, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for each row that ``is_query`` chooses by ``id``."""
    rows, n, dim = indexed_rows(df, vec_id, vector)
    kind = rows.schema["id"].dataType.simpleString()
    if not n:
        return df.sparkSession.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    sample = _sampled(rows, n, FIT_ROWS, 1).select("vector").toArrow()
    tree = fit(np.concatenate([_matrix(c, dim) for c in sample["vector"].chunks]), min(MAX_LEAVES, math.ceil(n / LEAF_ROWS)))
    indexed = work_table(with_leaf(rows, tree, dim), "neighbour-leaves")
    counts = np.zeros(tree.n_leaves, np.int64)
    for r in indexed.groupBy("leaf").count().collect():  # MAX_LEAVES rows
        counts[r["leaf"]] = r["count"]
    visits = calibrated(indexed, n, dim, tree, k, target)
    asked = work_table(visits_of(indexed.filter(is_query), tree, counts, dim, visits), "neighbour-visits")
    loads = work_table(asked.groupBy("bin").agg(F.ceil(F.count(F.lit(1)) / CELL_QUERIES).cast("int").alias("parts")), "neighbour-loads")
    asked = asked.join(bounded(loads, 32), "bin").withColumn("part", F.pmod(F.xxhash64("query"), "parts").cast("int"))
    held = binned(indexed, counts).join(bounded(loads, 32), "bin").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    found = compared(held.select("bin", "part", "row", "id", "vector", "leaf"), asked.select("bin", "part", "query", "query_id", "vector", "leaves"), dim, k)
    return merged(work_table(found, "neighbour-found"), k)
